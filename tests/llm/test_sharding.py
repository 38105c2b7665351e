import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nuggetry.llm import queries, sharding

from .helpers import SF, clashing, docs, odd, rows


def fits(sizes, k, cap):
    n, load = 1, 0
    for s in sizes:
        if s > cap:
            return False
        n, load = (n, load + s) if load + s <= cap else (n + 1, s)
    return n <= k


def plain_capacity(sizes, k):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(sizes, k, mid) else (mid + 1, hi)
    return lo


@given(st.lists(st.integers(1, 60), min_size=1, max_size=25), st.integers(1, 6))
@settings(max_examples=25, deadline=None)
def test_cuts_are_minimax_and_in_order(spark, sizes, k):
    units = spark.createDataFrame([(f"{i:04x}", s) for i, s in enumerate(sizes)], "unit string, bytes long")
    got = sorted(rows(sharding.minimax_cuts(units, k)), key=lambda r: r["unit"])
    shards = [r["shard"] for r in got]
    loads = {}
    for s, x in zip(shards, sizes):
        loads[s] = loads.get(s, 0) + x
    assert shards == sorted(shards) and shards[0] == 0 and set(shards) == set(range(max(shards) + 1)) and max(shards) < k
    assert got[0]["capacity"] == plain_capacity(sizes, k) == max(got[0]["capacity"], *loads.values())


def test_query(spark):
    base = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(queries.op10_sharding(spark, SF))
    assert len(got) == len(base)
    units, shard_of, slots = {}, {}, {}
    for r in got:
        text = base[r["doc_id"]].encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes" and r["grown_shard"] is None
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        u = hashlib.md5(text).hexdigest()[:4]
        units[u] = units.get(u, 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    loads = {s: sum(r["size"] for r in got if r["shard"] == s) for s in slots}
    assert max(loads.values()) <= plain_capacity([units[u] for u in sorted(units)], 16)
    groups = {}
    for r in got:
        groups[hashlib.md5(base[r["doc_id"]].encode()).hexdigest()] = groups.get(hashlib.md5(base[r["doc_id"]].encode()).hexdigest(), 0) + r["size"]
    assert max(loads.values()) <= plain_capacity([groups[u] for u in sorted(groups)], 16)


def test_a_dominant_text_leaves_the_rest_even(spark):
    df = docs(spark, ["same text" * 40] * 300 + [f"text number {i} " * 5 for i in range(700)])
    got = rows(sharding.shard_documents(df, 4))
    loads = sorted(sum(r["size"] for r in got if r["shard"] == s) for s in range(4))
    assert loads[0] > 0.6 * loads[2] and len({r["shard"] for r in got if r["text"].startswith("same")}) == 1


def test_odd_rows(spark):
    got = rows(sharding.shard_documents(clashing(odd(spark))))
    assert len(got) == 10
    assert {(r["size"], r["text_crc32"]) for r in got if r["text"] is None} == {(1, None)}
    assert len({r["shard"] for r in got if r["text"] == "a b c"}) == 1
    assert sharding.shard_documents(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("digits, refine, hot", [(1, 1, 0), (2, 2, 5), (3, 2, 40)])
def test_capacity_is_that_of_the_groups(spark, monkeypatch, digits, refine, hot):
    """Against the plain minimax over all groups, whatever units it starts from, with and without a group that dominates."""
    monkeypatch.setattr(sharding, "UNIT_HEX", digits)
    monkeypatch.setattr(sharding, "REFINE_HEX", refine)
    rnd = random.Random(digits)
    groups = sorted((hashlib.md5(str(i).encode()).hexdigest(), rnd.choice([1, 5, 20, 400])) for i in range(1500))
    if hot:
        groups[700] = (groups[700][0], hot * 10_000)
    starts, capacity = sharding.partition(spark.createDataFrame(groups, "md5 string, bytes long"), 7)
    assert capacity == plain_capacity([b for _, b in groups], 7)
    loads = [sum(b for m, b in groups if (sum(s <= m for s in starts)) == k + 1) for k in range(len(starts))]
    assert max(loads) <= capacity and len(starts) <= 7 and sum(loads) == sum(b for _, b in groups)
