"""An index of token sets that a stream keeps up, so that a batch meets the postings of its own tokens and not the log.

The index is two tables in the shared folder: the distinct sets, and the rows of their prefixes (``operators.similarity``), dealt to
folders by a bucket of the token. The order of tokens that prefixes need is any fixed one; it is taken from the first batch
and stays. A batch reads the folders of its own prefix tokens, and the sets of the pairs that are left.

A batch writes folders of its own name, so that one that runs again replaces what it wrote before. ``compacted`` copies the batches
into one, for an index of many small files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.similarity import PARITY, candidates, compared, distinct_sets, keyed_sets, magnitudes_of, prefixes, similar, token_counts
from ..sources.work import discard, settle

#: Folders of postings.
FOLDERS = 64
_BATCH = "batch"


class SimilarityIndex:
    """Sets of ``threshold`` or more to a batch, strictly above it, at ``path``. Batches are numbered from 0."""

    def __init__(self, spark: SparkSession, path: str, threshold: float):
        self.spark, self.path, self.threshold = spark, path, threshold

    def _read(self, name: str, schema: str) -> DataFrame:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def sets(self) -> DataFrame:
        return self._read("sets", f"key binary, t array<long>, {_BATCH} long")

    def postings(self) -> DataFrame:
        parity = ", ".join(f"p{i}_b long" for i in range(PARITY))
        return self._read("postings", f"w long, key_b binary, n_b long, pos_b long, {parity}, {_BATCH} long, folder int")

    def _order(self, sets: DataFrame):
        """The order of tokens, written with the first batch."""
        found = self._read("order", "at int, n long")
        if found.isEmpty():
            token_counts(sets).write.mode("overwrite").parquet(f"{self.path}/order")
            found = self._read("order", "at int, n long")
        return magnitudes_of(found)

    def add(self, keyed: DataFrame, batch: int) -> DataFrame:
        """Adds the sets of a batch, (id, key, t), and gives its pairs (left_key, right_key, similarity): sets of the batch with
        those of it and of all before, a set with itself included."""
        new = settle(distinct_sets(keyed), "batch")
        order = self._order(new)
        rows = settle(prefixes(new, order, self.threshold, "_b"), "prefix").withColumn("folder", F.pmod("w", F.lit(FOLDERS)).cast("int"))
        folders = [r[0] for r in rows.select("folder").distinct().collect()]  # FOLDERS at most
        earlier = F.col(_BATCH) < batch
        old = self.postings().where(F.col("folder").isin(folders) & earlier).drop("folder", _BATCH)
        asked = prefixes(new, order, self.threshold, "_a")
        pairs = candidates(asked, old.unionByName(rows.drop("folder")), self.threshold)
        known = self.sets().where(earlier).drop(_BATCH).unionByName(new)
        wanted = settle(pairs, "pairs")
        some = known.join(wanted.select(F.col("right_key").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"])
        out = settle(similar(compared(wanted, new, some), self.threshold, True), "matches")
        new.join(self.sets().where(earlier).select("key"), "key", "left_anti").write.mode("overwrite").parquet(f"{self.path}/sets/{_BATCH}={batch}")
        rows.write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/postings/{_BATCH}={batch}")
        for done in (new, wanted):
            discard(done)
        return out

    def compacted(self, path: str) -> SimilarityIndex:
        """The same index at another path, its batches as one, which counts as that before the first."""
        self.sets().drop(_BATCH).dropDuplicates(["key"]).write.parquet(f"{path}/sets/{_BATCH}=-1")
        self.postings().drop(_BATCH).dropDuplicates(["w", "key_b"]).repartition("folder").write.partitionBy("folder").parquet(f"{path}/postings/{_BATCH}=-1")
        self._read("order", "at int, n long").write.parquet(f"{path}/order")
        return SimilarityIndex(self.spark, path, self.threshold)


def match_stream(suggestions: DataFrame, index: SimilarityIndex, path: str, checkpoint: str):
    """A query that looks every batch of ``suggestions(id, text)`` up in the index, adds it, and writes the pairs (left_key,
    right_key, similarity) to a folder of the batch under ``path``."""

    def step(batch: DataFrame, number: int) -> None:
        found = index.add(keyed_sets(batch.select("id", "text")), number)
        found.write.mode("overwrite").parquet(f"{path}/{_BATCH}={number}")
        discard(found)

    return suggestions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
