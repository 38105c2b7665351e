"""The most similar vectors by cosine, exactly, from blocks that a bound can rule out.

Vectors go to the nearest of a few pivots, and a pivot's vectors are dealt to blocks of bounded size. A block knows the widest
angle r between its vectors and the pivot; by the triangle inequality on the sphere no vector in it is closer to a query at an
angle a from the pivot than a - r. A query first meets blocks of its own pivot, which gives it ``k`` candidates and
so a least similarity; then only the blocks whose bound reaches that are multiplied.

Queries come in chunks of bounded size too; what meets in one task is one block and one chunk of queries that need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import discard, settle

#: Pivots, at most; vectors of a block and queries of a chunk, about.
PIVOTS, BLOCK, CHUNK = 64, 4096, 1024
#: What rounding may add to a cosine.
SLACK = 1e-9


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector, as doubles, has a finite direction; null, empty, zero and broken ones have none."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where("v IS NOT NULL")
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    return rows.where((norm > 0) & (norm < float("inf")) & ~F.exists("v", lambda x: x.isNull()))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors, a row each; vectors have one width."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if n else x


def _to_pivots(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = _matrix(batch.column(1)) @ pivots.T
            pivot = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(pivot)), pivot], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pivot.astype(np.int32)), pa.array(angle)], names=["id", "v", "pivot", "angle"])

    return run


def _asked(pivots: np.ndarray, blocks: dict[str, np.ndarray], first: bool):
    """Rows (block, chunk, id, v, least) of the blocks that a query has to meet: those of its pivot, or those of other pivots
    whose bound reaches its least similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = np.clip(_matrix(batch.column("v")) @ pivots.T, -1, 1)
            own = cosine.argmax(axis=1)[:, None] == blocks["pivot"][None, :]
            if first:
                meet = own
            else:
                bound = np.cos(np.maximum(np.arccos(cosine[:, blocks["pivot"]]) - blocks["radius"], 0)) + SLACK
                least = batch.column("least").to_numpy(zero_copy_only=False)
                meet = ~own & (bound >= np.nan_to_num(least, nan=-2.0)[:, None])
            row, block = np.nonzero(meet)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(blocks["block"][block]), batch.column("chunk").take(take), batch.column("id").take(take), batch.column("v").take(take)], names=["block", "chunk", "id", "v"])

    return run


def _best(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, own = (t.column("id").to_numpy() for t in (vectors, queries))
        out = [], [], []
        if len(ids) and len(own):
            near = _matrix(queries.column("v").combine_chunks()) @ _matrix(vectors.column("v").combine_chunks()).T
            near[own[:, None] == ids[None, :]] = -np.inf
            for q, row in zip(own, near):
                some = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                some = np.flatnonzero(row >= row[some].min())  # ties at the end are kept
                some = some[np.isfinite(row[some])]
                some = some[np.lexsort((ids[some], -row[some]))][:k]
                for column, values in zip(out, (np.full(len(some), q), ids[some], row[some])):
                    column.append(values)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(c).astype(t) if c else np.empty(0, t)) for c, t in zip(out, kinds)], names=["query_id", "id", "cosine"])

    return run


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "id", vector: str = "vector", block: int = BLOCK, chunk: int = CHUNK, trace: list | None = None) -> DataFrame:
    """``(query_id, pos, id, cosine)``: the ``k`` vectors nearest to each query by cosine, ties by id; a query's own id is not among
    them. Ids are whole numbers, vectors of one width; those without a direction take no part. ``trace`` gets the pairs of a
    query and a block that were multiplied, and all that there are."""
    spark = vectors.sparkSession
    rows = settle(usable(vectors, id_col, vector), "vectors")
    asked = settle(usable(queries, id_col, vector), "queries")
    n, m = rows.count(), asked.count()
    schema = "query_id long, id long, cosine double"
    if not n or not m:
        return spark.createDataFrame([], "query_id long, pos int, id long, cosine double")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toArrow()  # at most PIVOTS rows
    pivots = _matrix(sample.column("v").combine_chunks())
    pivoted = settle(rows.mapInArrow(_to_pivots(pivots), "id long, v array<double>, pivot int, angle double"), "pivots")
    held = dict(pivoted.groupBy("pivot").count().collect())  # a row per pivot
    parts = [max(1, round(held.get(p, 0) / block)) for p in range(len(pivots))]
    of = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("pivot") + 1)
    dealt = pivoted.withColumn("block", (of(np.cumsum(parts) - parts) + F.pmod(F.xxhash64("id"), of(parts))).cast("long"))
    known = dealt.groupBy("block", "pivot").agg(F.max("angle").alias("radius")).toArrow()  # a row per block
    blocks = {c: known.column(c).to_numpy() for c in ("block", "pivot", "radius")}
    numbered = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(max(1, round(m / chunk)))).cast("long"))

    def nearest(asked: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
        met = settle(asked.mapInArrow(_asked(pivots, blocks, first), "block long, chunk long, id long, v array<double>"), "met")
        wanted = met.select("block", "chunk").distinct()
        copies = dealt.select("block", "id", "v").join(wanted, "block").toDF("block", "id", "v", "chunk")  # a block for every chunk of queries that needs it
        return met, settle(met.groupBy("block", "chunk").cogroup(copies.groupBy("block", "chunk")).applyInArrow(_best(k), schema), "nearest")

    met, near = nearest(numbered, True)
    ends = near.groupBy("query_id").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("c")).select("query_id", F.get("c", F.lit(k - 1)).alias("least"))
    more = numbered.join(ends, numbered["id"] == ends["query_id"], "left").select("id", "v", "chunk", "least")
    met_more, near_more = nearest(more, False)
    if trace is not None:
        trace += [met.count() + met_more.count(), m * len(blocks["block"])]
    both = near.unionByName(near_more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    out = settle(both.withColumn("pos", rank).where(F.col("pos") <= k).select("query_id", "pos", "id", "cosine"), "topk")
    for done in (rows, asked, pivoted, met, near, met_more, near_more):
        discard(done)
    return out
