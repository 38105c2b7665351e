import math

from pyspark.sql import functions as F

from nuggetry.llm import mixing, queries

from .helpers import SF, WHITE, clashing, docs, odd, rows


def plain_targets(sizes, share=1.5, cap=2.0):
    """sizes by source; the water-filling one clamp at a time."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        s = max(over, key=lambda s: left * weight[s] / total / max(1e-9, cap * sizes[s]))
        out[s] = cap * sizes[s]
        left -= out[s]
        open_.remove(s)
    return out


def check(got, table):
    size_of = {}
    for r in got:
        size_of.setdefault(r["doc_id"], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    sizes, taken, target, longest = {}, {}, {}, {}
    for r, s in zip(got, table):
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        longest[s] = max(longest.get(s, 0), r["size"])
        target[s] = r["target"]
    want = plain_targets(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], abs_tol=1e-6)
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6


def test_query_against_plain_water_filling(spark):
    base = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(queries.op2_mixing(spark, SF))
    assert {r["doc_id"]: r["size"] for r in got} == {i: len(WHITE.findall(d.text)) for i, d in base.items()}
    check(got, [base[r["doc_id"]].source for r in got])
    again = rows(queries.op2_mixing(spark, SF))
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_skewed_sources_reach_their_caps(spark):
    texts = ["w " * n for n in (500, 3, 3, 2, 9, 40)]
    df = docs(spark, texts, source=["big", "a", "a", "b", None, "c"])
    got = sorted(rows(mixing.mix_sources(df)), key=lambda r: r["doc_id"])
    sizes = {"big": 500, "a": 6, "b": 2, None: 9, "c": 40}
    want = plain_targets(sizes)
    for r in got:
        assert math.isclose(r["target"], want[r["source"]])
    assert want["b"] == 4.0


def test_odd_rows(spark):
    got = rows(mixing.mix_sources(clashing(odd(spark))))
    assert len(got) == 10 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["text"] is None} == {0}
    assert len([r for r in got if r["doc_id"] == 1]) == 2
    assert mixing.mix_table(odd(spark).limit(0)).count() == 0
    assert {r["taken"] for r in rows(mixing.mix_table(docs(spark, [None, "", " "])))} == {0}


def test_mixed_documents_repeat_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    times = {r["doc_id"]: r["times"] for r in rows(mixing.mix_sources(df))}
    count = {r["doc_id"]: r["count"] for r in rows(out.groupBy("doc_id").count())}
    assert count == {i: n for i, n in times.items() if n}
    assert out.where(F.col("text").isNull()).count() == 0
    clash = mixing.mixed_documents(clashing(odd(spark)))
    assert {r["Size"] for r in rows(clash)} == {"clash"}


def test_no_row_comes_more_often_than_the_cap(spark):
    """Sources at their cap, with empty and null texts among the first in the seeded order."""
    texts = ["w " * 400, *["a b c", "", None] * 8]
    df = docs(spark, texts, source=["big", *["small"] * 24])
    count = rows(mixing.mixed_documents(df).groupBy("doc_id").count())
    assert max(r["count"] for r in count) == 2
    assert {r["doc_id"]: r["count"] for r in count if r["doc_id"]} == {i: 2 for i in range(1, 25)}


def test_one_id_for_all_rows(spark):
    """Targets are met within half a document though rows share their id, or their text too."""
    texts = [f"{'w ' * (3 + i % 90)}{i}" for i in range(60)]
    for ids, said in (([7] * 60, texts), ([None] * 60, texts), ([7] * 60, ["a b c d e f g"] * 60), ([None] * 60, ["a b c"] * 30 + texts[:30])):
        source = ["x" if i % 3 else "y" for i in range(60)]
        df = docs(spark, said, doc_id=ids, source=source)
        for got in (rows(mixing.mix_sources(df)), rows(mixing.mix_table(df).join(df.select("doc_id").limit(0), "doc_id", "left_anti"))):
            by = {}
            for r in got:
                key = (r["source_size"], r["target"])
                size, taken = by.get(key, (0, 0))
                by[key] = (max(size, r["size"]), taken + r["taken"])
                assert r["taken"] <= 2 * r["size"]
            assert len(by) == 2 and all(abs(taken - target) <= size / 2 + 1e-6 for (_, target), (size, taken) in by.items())
    assert mixing.mixed_documents(df).count() == sum(r["times"] for r in rows(mixing.mix_sources(df)))
