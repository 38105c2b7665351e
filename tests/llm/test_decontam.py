import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from nuggetry.llm import decontam, queries

from .helpers import SF, WORD, clashing, docs, lower, odd, rows


def plain(text, items, window=10):
    words, hit, names, windows = WORD.findall(lower(text)), set(), set(), {}
    for name, item in items:
        w = WORD.findall(lower(item))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(name))
    for n in set(map(len, windows)):
        for i in range(len(words) - n + 1):
            if found := windows.get(tuple(words[i : i + n])):
                hit.update(range(i, i + n))
                names |= found
    return len(words), hit, names


def digest(n_words, hit, names):
    joined = ",".join(sorted(names))
    return n_words, len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)


def table(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(df)}


words = st.lists(st.sampled_from("abcd"), max_size=14)


@given(st.lists(words, max_size=6), words, words, words)
@settings(max_examples=150, deadline=None)
def test_automaton_against_all_windows(items, a, b, c):
    text = [*a, *(items[0] if items else []), *b, *c]
    named = [(str(i), [w.encode() for w in x]) for i, x in enumerate(items)]
    sam = decontam.SuffixAutomaton(named, window=4)
    import numpy as np

    ids = np.array([sam.vocabulary.get(w.encode(), -1) for w in text] + [-1])
    starts, ends, names = [], [], set()
    for x, y in sam.stretches(ids):
        sam.scan(ids[x:y].tolist(), x, starts, ends, names)
    _, hit, want = plain(" ".join(text), [(str(i), " ".join(x)) for i, x in enumerate(items)], window=4)
    assert {p for s, e in zip(starts, ends) for p in range(s, e)} == hit
    assert names == want


def test_query_against_all_windows(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id: digest(*plain(r.text, items)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert table(queries.op5_decontamination(spark, SF)) == want
    assert any(x[4] for x in want.values())


def test_blocks_agree_with_one_automaton(spark):
    rnd = random.Random(1)
    items = [(i, " ".join(rnd.choice(["aa", "bb", "cc"]) for _ in range(rnd.randint(1, 25)))) for i in range(20)]
    texts = [" ".join(rnd.choice(["aa", "bb", "cc", "zz"]) for _ in range(80)) + ". " + items[i][1] for i in range(20)]
    df, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = {i: digest(*plain(t, items)) for i, t in enumerate(texts)}
    assert table(decontam.contamination_table(df, bench)) == want
    assert table(decontam.contamination_table(df, bench, block_words=30)) == want


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "a b c"), (2, None), (3, "..."), (None, "lost id"), (1, "word " * 12)], "item_id long, text string")
    got = rows(decontam.contamination_table(clashing(odd(spark)), bench))
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert (by[1]["n_hit"], by[1]["n_items"]) == (3, 1) and by[5]["n_hit"] == 60_000
    assert by[4]["n_words"] == by[3]["n_words"] == 0 and not by[4]["contaminated"]
    none = rows(decontam.contamination_table(odd(spark), bench.limit(0)))
    assert not any(r["contaminated"] for r in none) and len(none) == 10
    assert decontam.contamination_table(odd(spark).limit(0), bench).count() == 0


def test_spans_go_and_the_rest_stays(spark):
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine ten eleven")], "item_id long, text string")
    keep = "plain words " * 10
    df = docs(spark, [keep + "ONE two, three four five six seven eight nine ten - eleven." + keep, "one two three four five six seven eight nine ten", keep, None])
    got = {r["doc_id"]: r for r in rows(decontam.decontaminate(df, bench))}
    assert set(got) == {0, 2, 3}
    assert "two" not in got[0]["text"] and got[0]["text"].count("plain") == 20 and got[0]["n_chars"] == len(got[0]["text"])
    assert got[2]["text"] == keep
    twice = rows(decontam.decontaminate(clashing(df), bench))
    assert all(r["FOUND"] == r["Size"] == "clash" for r in twice) and {r["text"] for r in twice} == {r["text"] for r in got.values()}


def test_short_items_are_left_in_place(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, "in the city"), (3, "who wrote the long book")], "item_id long, text string")
    text = "we met in the city of Paris and asked who wrote the long book, then left"
    df = docs(spark, [text, "Paris", "who wrote the long book", None, ""])
    got = {r["doc_id"]: r["text"] for r in rows(decontam.decontaminate(df, bench))}
    assert got == {0: "we met in the city of Paris and asked , then left", 1: "Paris", 3: None, 4: ""}
    one = {r["doc_id"]: r["text"] for r in rows(decontam.decontaminate(df, bench, min_span=1))}
    assert set(one) == {3, 4}  # nine of the first one's words are hit then


def test_passes_over_many_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PASS", 2)
    items = [(i, f"alpha{i} beta gamma delta epsilon zeta eta theta iota kappa lambda{i}") for i in range(9)]
    df = docs(spark, [f"say {items[i][1]} and {items[(i * 2) % 9][1]}" for i in range(9)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {r["doc_id"]: digest(*plain(r["text"], items)) for r in rows(df)}
    assert table(decontam.contamination_table(df, bench, block_words=12)) == want
