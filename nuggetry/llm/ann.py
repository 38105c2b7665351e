"""Approximate nearest neighbours by collision counting with query-aware windows.

Vectors get one more component that makes all of them equally long, so that the largest inner product is the
smallest distance. Rows are dealt to chunks by a hash of their id; a chunk keeps, for each of ``DIRECTIONS``
orthogonal projections, the sorted order of its vectors, in ``BUCKETS`` buckets of equal size. A query's window on a
projection is centred on the query and widened by virtual rehashing, level by level; a vector collides where its
bucket is in the window. Vectors that collide on at least ``COLLIDE`` of all projections are candidates. The first
level that has enough of them (``SHARE`` of the chunk, ``LEAST`` at least) is found by bisection, since widening only
adds, and they are all verified by their exact inner product.

Windows that tell neighbours from others hold half of a projection and more, so collisions are counted by comparing
all buckets of a chunk, a byte each, which costs less than listing the members of the windows. What the counting
saves is verification: candidates are a few hundredths of the rows.

Queries are a stated set. They pass in blocks of ``BLOCK`` at most, one after the other, each held by the driver and
the workers only while it is searched for; what comes back per partition and query is ``k`` rows, and the best ``k`` of those are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

BLOCK = 4096
CHUNK = 8192
DIRECTIONS = 128
BUCKETS = 256
COLLIDE = 0.75
SHARE, LEAST = 0.04, 200
#: Half-widths of the windows by level, for vectors of length one and projections of unit variance; the last level holds all.
FIRST, WIDEN, LEVELS = 0.3, 1.05, 64
SEED = 5


def usable(vector: Column) -> Column:
    """Whether a vector is there, not zero, and has only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(width: int, n: int = DIRECTIONS) -> np.ndarray:
    """``n`` directions of unit variance: random orthogonal bases side by side."""
    rng = np.random.default_rng(SEED)
    bases = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(ceil(n / width))]
    return np.concatenate(bases, axis=1)[:, :n] * np.sqrt(width)


class Chunk:
    """Sorted projections of some vectors, as the bucket of every vector on each of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.vectors, n = ids, vectors, len(ids)
        unit = vectors / longest
        extra = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))
        self.directions = directions(vectors.shape[1] + 1)
        projected = np.column_stack([unit, extra]) @ self.directions
        order = np.argsort(projected, axis=0, kind="stable")
        bucket = (np.arange(n) * BUCKETS // n).astype(np.uint8)
        self.bucket = np.empty((projected.shape[1], n), np.uint8)
        np.put_along_axis(self.bucket, order.T, bucket[None], axis=1)
        first = np.flatnonzero(np.diff(bucket, prepend=255) != 0)
        self.names = bucket[first]
        self.edges = np.take_along_axis(projected, order[first], axis=0).T.copy()  # least projection of each bucket

    def windows(self, centre: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket and how many follow it, by query and projection."""
        last = len(self.names) - 1
        low = np.stack([np.searchsorted(e, c - half, side="right") - 1 for e, c in zip(self.edges, centre.T)], 1)
        high = np.stack([np.searchsorted(e, c + half, side="right") - 1 for e, c in zip(self.edges, centre.T)], 1)
        low, high = (self.names[np.clip(x, 0, last)] for x in (low, high))
        return low, high - low

    def candidates(self, queries: np.ndarray) -> list[np.ndarray]:
        """Positions of the vectors to verify, for each query."""
        n, m = self.bucket.shape[1], self.bucket.shape[0]
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        centre = unit @ self.directions[:-1]
        enough, need = min(n, max(LEAST, ceil(SHARE * n))), ceil(COLLIDE * m)
        out = [np.arange(n)] * len(queries)
        low_level, high_level = np.zeros(len(queries), np.int64), np.full(len(queries), LEVELS)
        count = np.uint8 if m < 256 else np.uint16
        while len(active := np.flatnonzero(low_level < high_level)):
            level = (low_level + high_level) // 2
            start, span = self.windows(centre[active], FIRST * WIDEN ** level[active].astype(float))
            for i, q in enumerate(active):
                # Unsigned, buckets before the window wrap around to large numbers.
                inside = (self.bucket - start[i][:, None]) <= span[i][:, None]
                hits = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=count) >= need)
                if len(hits) >= enough:
                    out[q], high_level[q] = hits, level[q]
                else:
                    low_level[q] = level[q] + 1
        return out


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk to a row per chunk; a chunk of more than ``CHUNK`` rows becomes several."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows.column("vec_id").to_numpy()
        flat = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        for at in range(0, len(ids), CHUNK):
            values = (ids[at : at + CHUNK].tobytes(), flat[at : at + CHUNK].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["ids", "vectors"])

    for batch in batches:
        chunk, at = batch.column("chunk").to_numpy(), 0
        for to in [*(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]:
            if held and (held[0].column("chunk")[0].as_py() != chunk[at] or sum(map(len, held)) >= CHUNK):
                yield from flush()
                held.clear()
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield from flush()


def _searcher(sent, longest: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = sent.value
        best_id = np.full((len(query_ids), k), -1, np.int64)
        best = np.full((len(query_ids), k), -np.inf)
        verified, width = np.zeros(len(query_ids), np.int64), queries.shape[1]
        for batch in batches:
            for ids, vectors in zip(*batch.columns):
                chunk = Chunk(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, width), longest)
                for q, rows in enumerate(chunk.candidates(queries)):
                    verified[q] += len(rows)
                    rows = rows[chunk.ids[rows] != query_ids[q]]
                    if not len(rows):
                        continue
                    score = chunk.vectors[rows] @ queries[q]
                    if len(rows) > k:
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        rows, score = rows[score >= least], score[score >= least]
                    found, scores = np.concatenate([best_id[q], chunk.ids[rows]]), np.concatenate([best[q], score])
                    order = np.lexsort((found, -scores))[:k]
                    best_id[q], best[q] = found[order], scores[order]
        q, r = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(best_id[q, r]), pa.array(best[q, r]), pa.array(np.where(r == 0, verified[q], 0))], names=["query_id", "vec_id", "score", "verified"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score, n_verified)``: the ``k`` rows of ``vectors(vec_id, embedding)`` with the largest
    inner product for each of ``queries(vec_id, embedding)``, in double precision, ties to the smaller id; and how many
    rows the query was compared with.

    Rows without an id or with an unusable vector take no part, nor do vectors of another width than most
    usable ones (of equally common widths the smaller). All rows with the query's id are its own and are left
    out; a repeated query is asked once, with its smallest vector; repeated rows are found as often as they are there.
    Further columns are left alone. No usable row or no query gives an empty table.
    """
    spark = vectors.sparkSession
    keep = lambda df: df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows, asked = keep(vectors), keep(queries)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    seen = rows.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square")).orderBy(F.desc("n"), "w").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_verified long")
    if not seen:
        return empty
    same = F.size("embedding") == seen["w"]
    rows, asked = rows.where(same).withColumn("vec_id", F.col("vec_id").cast("long")), asked.where(same)
    asked = cut(asked.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding")))
    # Hashing fills chunks unevenly, so they are laid out for a little less than they hold.
    chunks = ceil(seen["n"] / (0.9 * CHUNK)) if seen["n"] > CHUNK else 1
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"), "vec_id", "embedding")
    dealt = cut(dealt.repartition("chunk").sortWithinPartitions("chunk", "vec_id", "embedding").mapInArrow(_deal, "ids binary, vectors binary"))
    parts, found = ceil(asked.count() / block), None
    for b in range(parts):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == b).toArrow()
        if not len(got):
            continue
        ids = got.column("vec_id").to_numpy()
        order = np.argsort(ids)
        wide = got.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, seen["w"])
        sent = spark.sparkContext.broadcast((ids[order], wide[order]))
        some = cut(dealt.mapInArrow(_searcher(sent, float(np.sqrt(seen["square"])), k), "query_id long, vec_id long, score double, verified long"))
        sent.destroy()
        found = some if found is None else found.unionByName(some)
    for done in (asked, dealt):
        discard(done)
    if found is None:
        return empty
    own = Window.partitionBy("query_id")
    found = found.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("score"), "vec_id")), "n_verified": F.sum("verified").over(own)})
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_verified")


def neighbour_table(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The digest: queries are the rows whose id is divisible by ``every``."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
