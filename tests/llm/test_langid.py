import zlib

import numpy as np

from nuggetry.llm import langid, queries

from .helpers import SF, clashing, docs, odd, rows


def test_query_on_held_out_documents(spark):
    base = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(queries.op1_langid(spark, SF))
    assert len(got) == len(base)
    right = 0
    held = [r for r in got if r["held_out"]]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    right = sum(r["lang_pred"] == base[r["doc_id"]].lang for r in held)
    assert right / len(held) > 0.9


def test_codes_are_apart():
    for k in (2, 3, 4, 6, 12):
        m = langid.code_matrix(k)
        gaps = [(m[i] != m[j]).sum() for i in range(k) for j in range(i)]
        assert min(gaps) >= (1 if k == 2 else 2) and np.all(np.abs(m.sum(0)) < k)


def test_prediction_does_not_depend_on_neighbours_or_blocks(spark, monkeypatch):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [b"the of and to", "der die das und für".encode(), b"", b"x" * 5000, b"les des une dans" * 400]
    together = model.margins(texts)
    assert np.allclose(together, np.concatenate([model.margins([t]) for t in texts]), rtol=0, atol=1e-5)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert np.allclose(together, model.margins(texts), atol=1e-4)


def test_odd_rows(spark):
    got = rows(langid.language_table(clashing(odd(spark))))
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[7]["lang_pred"] == "und" and by[None]["held_out"] is None
    assert langid.language_table(odd(spark).limit(0)).count() == 0
    nothing = rows(langid.language_table(docs(spark, ["some text", "1 2"], lang=[None, "en"])))
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_one_language_is_all_there_is_to_learn(spark):
    got = rows(langid.language_table(docs(spark, [f"text {i} here" for i in range(30)])))
    assert {r["lang_pred"] for r in got} == {"en"} and {r["score"] for r in got} == {1.0}


def test_every_language_is_learned(spark):
    """More languages than the sample has room for at ``LEAST`` each."""
    names = [f"l{i:02d}" for i in range(9)]
    df = docs(spark, [f"{c * 6} {c * 4}{i % 5}" for c in "abcdefghi" for i in range(30)], lang=[n for n in names for _ in range(30)])
    model = langid.train(df, total=12)
    assert model.langs == names
    got = rows(langid.predict(df, model))
    assert sum(r["lang_pred"] == r["lang"] for r in got) == len(got)


def test_decoding_against_the_definition():
    rng = np.random.default_rng(6)
    code = langid.code_matrix(5)
    trust = rng.uniform(0.1, 1, code.shape)
    model = langid.Model(list("abcde"), code, trust / trust.sum(1, keepdims=True), np.zeros((1, 1)), np.zeros(code.shape[1]))
    margins = rng.normal(0, 2, (40, code.shape[1]))
    best, second, p = model.decode(margins)
    for row, a, b, q in zip(margins, best, second, p):
        loss = [sum(model.trust[k, j] * np.log1p(np.exp(-code[k, j] * m)) for j, m in enumerate(row)) * len(row) for k in range(5)]
        order = sorted(range(5), key=loss.__getitem__)
        assert (a, b) == (order[0], order[1]) and np.isclose(q, np.exp(-loss[a]) / sum(np.exp(-x) for x in loss))


def test_margins_against_plain_counts(spark):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    for text in ("the thing of the", "Straße über 12 Brücken", "a", "é"):
        data = b" " + b" ".join(text.encode().translate(langid.WORD_TABLE).split()) + b" "
        data += b"\0\0"
        counts, n = np.zeros(langid.BUCKETS), len(data) - 2
        for i in range(n):
            pair = data[i] | data[i + 1] << 8
            counts[(pair * 2_654_435_761 % 2**32) >> 20] += 1
            counts[(((pair | data[i + 2] << 16) * 2_246_822_519 % 2**32) >> 20) + langid.BUCKETS // 2] += 1
        assert np.allclose(model.margins([text.encode()])[0], counts / n @ model.weights + model.bias, atol=1e-4)
