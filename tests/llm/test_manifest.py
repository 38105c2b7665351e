import hashlib
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nuggetry.llm import manifest, queries

from .helpers import SF, clashing, docs, odd, rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def climb(nodes, arity=2):
    """The root, and for every leaf the siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // arity * arity : p // arity * arity + arity]
            paths[i].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
        nodes, at = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)], [p // arity for p in at]
    return nodes[0], paths


def plain(table, arity=2):
    groups, out = {}, []
    for r in table:
        groups.setdefault(r["lang"], []).append(r)
    tops = []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, paths = climb([leaf(r) for r in mine], arity)
        tops.append((mine, root, paths))
    root, upper = climb([t[1] for t in tops], arity)
    for (mine, subroot, paths), rest in zip(tops, upper):
        for r, p in zip(mine, paths):
            p = p + rest
            hit = r["doc_id"] is not None and r["n_chars"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf(r | {"n_chars": r["n_chars"] + 1}) if hit else leaf(r)
            for a, b in p:
                now = h(a, now, b)
            out.append({"doc_id": r["doc_id"], "leaf": leaf(r), "subroot": subroot, "root": root, "proof_sha256": h(*(x for ab in p for x in ab)), "folded_root": now, "verified": now == root})
    return out


def same(got, want):
    key = lambda r: (str(r["doc_id"]), r["leaf"], r["proof_sha256"])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_query(spark):
    got = rows(queries.op13_manifest(spark, SF))
    same(got, plain(rows(spark.read.parquet(f"{SF}/documents.parquet"))))
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 3


@pytest.mark.parametrize("arity,window,stride", [(2, 4, 4), (2, 8, 2), (3, 7, 3), (16, 5, 16)])
def test_many_rounds(spark, arity, window, stride):
    n = 300
    df = docs(spark, [f"t{i}" for i in range(n)], doc_id=[i * 7 % n for i in range(n)], lang=[None if i % 11 == 0 else "aa" if i % 3 else f"l{i % 10}é" for i in range(n)])
    same(rows(manifest.manifest_table(df.repartition(5), arity=arity, window=window, stride=stride)), plain(rows(df), arity))


@given(st.integers(1, 90), st.integers(2, 5), st.randoms())
@settings(max_examples=60, deadline=None)
def test_events_in_any_order(n, arity, random):
    leaves = [h(str(i)) for i in range(n)]
    forest, order = manifest.Forest(arity), list(range(n))
    random.shuffle(order)
    for i in order:
        forest.add(0, n, 0, i, bytes.fromhex(leaves[i]))
    root, paths = climb(leaves, arity)
    assert not forest.partial
    for i in range(n):
        level, pos, top, path = forest.link(0, 0, i)
        assert (pos, top.hex()) == (0, root) and [(s["l"].hex(), s["r"].hex()) for s in path] == paths[i]


def test_rounds_shrink(spark):
    n, trace = 5000, []
    leaves = spark.range(n, numPartitions=6).select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("id").alias("pos"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.struct("id").alias("row"))
    proofs, _ = manifest.grow(leaves, window=64, stride=8, trace=trace)
    assert trace[0] == n and trace[1] < n / 5 and trace[-1] < 40 and proofs.select("root").distinct().count() == 1


def test_odd_rows(spark):
    df = odd(spark)
    same(rows(manifest.manifest_table(clashing(df))), plain(rows(df)))
    assert manifest.manifest_table(df.limit(0)).count() == 0
    one = rows(manifest.manifest_table(docs(spark, ["x"], doc_id=[1])))[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h("")
