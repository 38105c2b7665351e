import numpy as np
import pyarrow as pa

from nuggetry.llm import ann, queries

from .helpers import SF, rows


def plain(ids, x, asked, k=20):
    out = {}
    for q in asked:
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[int(q)] = [int(ids[i]) for i in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(found.get(q, set()) & set(v)) / max(1, len(v)) for q, v in want.items()])


def test_query_recall_and_order(spark):
    base = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in base]), np.array([r.embedding for r in base], float)
    got = rows(queries.op8_ann(spark, SF))
    want = plain(ids, x, [i for i in ids if i % 20 == 0])
    assert recall(got, want) >= 0.95
    for q in want:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        for r in mine[:3]:
            assert np.isclose(r["score"], x[ids == q][0] @ x[ids == r["vec_id"]][0], rtol=1e-12)


def test_recall_with_lengths_and_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.float32(rng.standard_normal((4000, 24)) * rng.uniform(0.3, 2, (4000, 1)))
    ids = np.arange(4000)
    df = frame(spark, ids, x)
    got = rows(ann.search(df, df.where("vec_id % 100 = 0"), block=7))
    assert recall(got, plain(ids, x.astype(float), range(0, 4000, 100))) >= 0.9


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, score string"
    data = [(0, [1.0, 0.0], "x"), (1, [0.5, 0.5], None), (2, [0.5, 0.5], None), (2, [0.5, 0.5], None), (3, None, None), (4, [0.0, 0.0], None), (5, [float("nan"), 1.0], None), (6, [None, 1.0], None), (7, [float("inf"), 1.0], None), (8, [1.0, 2.0, 3.0], None), (None, [1.0, 1.0], None), (20, [0.0, 0.0], None), (40, [-1.0, 0.0], None), (9, [], None)]
    df = spark.createDataFrame(data, schema)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(ann.neighbour_table(df))]
    assert sorted(got) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 2, 0.5), (0, 4, 40, -1.0), (40, 1, 1, -0.5), (40, 2, 2, -0.5), (40, 3, 2, -0.5), (40, 4, 0, -1.0)]
    assert ann.neighbour_table(df.limit(0)).count() == 0


def test_few_rows_are_verified_and_chunks_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((10, 64))[rng.integers(0, 10, 20_000)] + rng.standard_normal((20_000, 64))
    x, ids = np.float32(x / np.linalg.norm(x, axis=1, keepdims=True)), np.arange(20_000)
    flat = pa.array(x.ravel())
    table = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.ListArray.from_arrays(np.arange(20_001, dtype=np.int32) * 64, flat)}))
    got = rows(ann.neighbour_table(table, every=200))
    asked = {r["query_id"]: r["n_verified"] for r in got}
    assert recall(got, plain(ids, x.astype(float), sorted(asked))) >= 0.9
    assert np.mean(list(asked.values())) < 0.1 * len(ids)
    assert sorted(map(str, got)) == sorted(map(str, rows(ann.neighbour_table(table.repartition(7), every=200))))


def test_windows_hold_what_the_definition_says():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((700, 12))
    chunk, q = ann.Chunk(np.arange(700), x, float(np.linalg.norm(x, axis=1).max())), rng.standard_normal((5, 12))
    for row, found in zip(q, chunk.candidates(q)):
        centre = row / np.linalg.norm(row) @ chunk.directions[:-1]
        sets = []
        for level in range(ann.LEVELS):
            start, span = chunk.windows(centre[None], np.array([ann.FIRST * ann.WIDEN**level]))
            ranks = chunk.bucket.astype(int)
            inside = (ranks >= start[0][:, None]) & (ranks <= start[0].astype(int)[:, None] + span[0][:, None])
            sets.append(np.flatnonzero(inside.sum(0) >= np.ceil(ann.COLLIDE * len(ranks))))
        want = next((s for s in sets if len(s) >= ann.LEAST), np.arange(700))
        assert (found == want).all()
