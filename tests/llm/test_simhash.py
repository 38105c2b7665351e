import itertools
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nuggetry.llm import queries, simhash

from .helpers import SF, WHITE, clashing, docs, lower, odd, rows


def plain_fingerprint(text):
    w = WHITE.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids):
    """ids: pairs of doc_id and fingerprint, all compared with all."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (ids[a][1] ^ ids[b][1]).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(ids[i][0])
    return {i: min(c) for c in out.values() for i in c}


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4, unique=True))
@settings(max_examples=300, deadline=None)
def test_fingerprints_within_four_bits_share_a_key(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    k1, _ = simhash.fuzzy_keys(np.array([fp], np.uint64))
    k2, _ = simhash.fuzzy_keys(np.array([other], np.uint64))
    assert set(k1) & set(k2)


def test_golay_code_is_perfect():
    keys = simhash.segment_keys(np.arange(1 << 12) * 2047 % (1 << 23))
    assert set((keys >= 0).sum(1)) <= {1, 6}


def test_query_against_all_pairs(spark):
    got = {r["doc_id"]: r for r in rows(queries.op6_simhash(spark, SF))}
    ids = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_components(ids)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in ids}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_dense_group_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHORT_RUN", 8)
    rnd = random.Random(3)
    fps = {0} | {sum(1 << b for b in rnd.sample(range(64), k)) for k in (1, 2, 3, 4) for _ in range(60)}
    at = rnd.getrandbits(64)
    for _ in range(40):  # a chain whose ends are far apart
        fps.add(at)
        at ^= sum(1 << b for b in rnd.sample(range(64), 4))
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    ids = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in ids], "doc_id long, fp long")
    got = {r["fp"] % (1 << 64): r["component_id"] for r in rows(simhash.near_components(df))}
    want = plain_components(ids)
    assert {i: got[f] for i, f in ids} == want


def test_odd_rows(spark):
    got = rows(simhash.near_duplicate_table(clashing(odd(spark))))
    assert len(got) == 10
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {3, 4, 7, None} and {r["component_id"] for r in zero} == {3}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert simhash.near_duplicate_table(odd(spark).limit(0)).count() == 0


def test_deduplicate(spark):
    base = " ".join(f"w{i}" for i in range(300))
    df = docs(spark, [base, base, base.replace("w150 ", "other "), "quite another text", "quite another text"], doc_id=[5, 3, 9, 1, 1])
    assert sorted(r["doc_id"] for r in rows(simhash.deduplicate(df))) == [1, 3]
    assert simhash.deduplicate(df).columns == df.columns
    kept = simhash.deduplicate(odd(spark))
    assert sorted(r["doc_id"] for r in rows(kept.where(F.col("doc_id").isNotNull()))) == [1, 3, 5]
    assert kept.count() == 4 and {r["text"] for r in rows(kept.where("doc_id IS NULL"))} == {"lost id here"}
    assert simhash.deduplicate(odd(spark).limit(0)).count() == 0
    assert sorted((str(r["doc_id"]), r["Size"]) for r in rows(simhash.deduplicate(clashing(odd(spark))))) == [("1", "clash"), ("3", "clash"), ("5", "clash"), ("None", "clash")]


def test_deduplicate_keeps_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    kept = sorted((r["doc_id"], r["text"][0]) for r in rows(simhash.deduplicate(docs(spark, [b, a, b, c], doc_id=[3, 5, 5, 7]))))
    assert kept == [(3, "b"), (5, "a"), (7, "c")]
    kept = sorted((str(r["doc_id"]), r["text"][0]) for r in rows(simhash.deduplicate(docs(spark, [a, a, a, b, a, c, c], doc_id=[None, None, 4, None, None, None, None]))))
    assert kept == [("4", "a"), ("None", "b"), ("None", "c")]


def shingles(text):
    w = WHITE.findall(lower(text))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_deduplicate_at_a_similarity(spark):
    """Planted pairs from 0.6 to 0.95: those below 0.8 stay, those above go but for the few that keys or reach miss."""
    rnd, texts, pairs = random.Random(5), [], []
    for g in range(160):
        w = [f"g{g}w{i}" for i in range(rnd.randint(60, 400))]
        x = list(w)
        for i in rnd.sample(range(len(x)), max(1, int(len(x) * rnd.choice((0.005, 0.01, 0.02, 0.03, 0.05, 0.07))))):
            x[i] = f"new{g}.{i}"
        texts += [" ".join(w), " ".join(x)]
        pairs.append(jaccard(shingles(texts[-1]), shingles(texts[-2])))
    kept = {r["doc_id"] for r in rows(simhash.deduplicate(docs(spark, texts)))}
    assert all(2 * g in kept for g in range(160))
    assert all(2 * g + 1 in kept for g, j in enumerate(pairs) if j < 0.8)
    high = [g for g, j in enumerate(pairs) if j >= 0.8]
    assert len(high) > 60 and sum(2 * g + 1 not in kept for g in high) >= 0.9 * len(high)


def test_no_pair_at_the_similarity_is_left_out(spark):
    """Pairs at 0.8 and just above: every one is found, also where fingerprints lie further apart than keys reach."""
    rnd, texts = random.Random(8), []
    for g in range(200):
        w = [f"g{g}w{i}" for i in range(rnd.randint(15, 200))]
        texts += [" ".join(w), " ".join([*w, *(f"g{g}v{i}" for i in range((len(w) - 4) // 4))])]
    kept = {r["doc_id"] for r in rows(simhash.deduplicate(docs(spark, texts)))}
    assert all(jaccard(shingles(texts[2 * g]), shingles(texts[2 * g + 1])) >= 0.8 for g in range(200))
    assert kept == {2 * g for g in range(200)}


def test_candidates_share_enough_of_their_prefixes(spark):
    """Sets of 100 with prefixes of 21: one shared shingle leaves 80 at most, 89 are needed; twelve shared ones may do."""
    sets = [(bytes([k]), 100, [-1, *range(100 * k, 100 * k + 20)]) for k in range(1, 31)]
    sets += [(bytes([k]), 100, [*range(-20, -8), *range(100 * k, 100 * k + 9)]) for k in (40, 41)]
    marked = simhash.cut(spark.createDataFrame(sets, "key binary, n int, t array<long>"))
    none = spark.createDataFrame([], "node binary, root binary")
    assert [(bytes(r["a"])[0], bytes(r["b"])[0]) for r in rows(simhash._prefix_pairs(marked, none, 0.8))] == [(40, 41)]


def test_forests_hold_together_what_is_near():
    rnd = np.random.default_rng(4)
    lo, hi = (rnd.integers(0, 1 << 62, 5) for _ in range(2))
    lo, hi = np.repeat(lo, 30), np.repeat(hi, 30)
    for k in range(len(lo)):
        for b in rnd.integers(0, 60, rnd.integers(0, 12)):
            lo[k] ^= 1 << int(b)
    far = lambda i, j: int(lo[i] ^ lo[j]).bit_count() + int(hi[i] ^ hi[j]).bit_count()
    for u, v in (simhash._long_forest(lo, hi, 15), simhash._short_forest(np.zeros(len(lo), np.int32), lo, hi, 15)):
        every = sorted((far(i, j), i, j) for i in range(len(lo)) for j in range(i) if far(i, j) <= 15)
        root = list(range(len(lo)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        weight = 0
        for d, i, j in every:
            if find(i) != find(j):
                root[find(i)] = find(j)
                weight += d
        assert sum(far(i, j) for i, j in zip(u, v)) == weight and len(u) == len(lo) - len({find(i) for i in range(len(lo))})


def test_a_shingle_of_many_sets_gives_no_row_a_pair():
    """Postings of a hot shingle go by blocks, a row for every block, and each two of them meet in one group only; a rare one gives pairs."""
    k = 3 * simhash.BLOCK + 5
    w = np.repeat([1, 2, 3], [k, 3, k])
    ids, root = np.arange(len(w)), np.r_[np.arange(k), 7, 8, 8, np.zeros(k, np.int64)]
    columns = [w, ids, root, np.full(len(w), 100, np.int32), np.ones(len(w), bool)]
    table = simhash.pa.table(dict(zip(["w", "id", "root", "n", "early"], columns)))
    got = [r for b in simhash._shared_runs(0.8)(iter(table.to_batches(max_chunksize=100))) for r in b.to_pylist()]
    assert sorted((r["a"], r["b"]) for r in got if r["b"] is not None) == [(k, k + 1), (k, k + 2)]
    many = [r for r in got if r["b"] is None]
    assert len(many) == 4 * k and {r["w"] for r in many} == {1}  # one component alone has nothing to compare
    met = {}
    for r in many:
        met.setdefault((r["i"], r["j"]), []).append(r)
    pairs = [tuple(sorted((x["a"], y["a"]))) for (i, j), g in met.items() for x in g for y in g if x["a"] < y["a"] and (i == j or x["own"] != y["own"])]
    assert len(pairs) == len(set(pairs)) == k * (k - 1) // 2


def test_prefix_pairs_of_families_against_all_pairs(spark, monkeypatch):
    """Families above and below the similarity, over several blocks and widths of bitmaps: no pair whose sets are similar enough is lost."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rnd, sets = random.Random(6), []
    for f in range(12):
        base = [rnd.getrandbits(62) for _ in range(rnd.choice((9, 40, 64, 130, 300)))]
        for _ in range(30):
            own = rnd.sample(base, len(base) - rnd.randint(0, len(base) // 4))
            sets.append(sorted({*own, *(rnd.getrandbits(62) for _ in range(rnd.randint(0, len(base) // 12)))}))
    marked = [(i.to_bytes(2, "big"), len(s), sorted(s)[: len(s) - -(-8 * len(s) // 10) + 1]) for i, s in enumerate(sets)]
    found = [(i.to_bytes(2, "big"), (0).to_bytes(2, "big")) for i in range(1, 20)]
    got = rows(simhash._prefix_pairs(simhash.cut(spark.createDataFrame(marked, "key binary, n int, t array<long>")), spark.createDataFrame(found, "node binary, root binary"), 0.8))
    got = [tuple(int.from_bytes(bytes(r[c]), "big") for c in "ab") for r in got]
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard(set(sets[i]), set(sets[j])) >= 0.8 and j >= 20}
    assert len(want) > 100 and want <= set(got) and len(got) == len(set(got)) and not any(j < 20 for _, j in got)
