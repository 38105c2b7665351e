"""Where intermediate tables and stream checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Broadcasts of tables whose row count is checked first go up to here; beyond, a shuffle join runs.
BROADCAST_ROWS = 100_000
#: Tables of at most so many rows are put in order by one task.
ORDERED_ROWS = 10_000

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset and everything runs in one process (tests), a
    temporary folder serves; on a cluster that would be a folder of one machine, so it is an error.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="nuggetry-"))
    return "file://" + _local[0]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is used several times is computed once, and later plans
    start from files that outlive an executor."""
    path = fresh(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._nuggetry_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    if path := getattr(df, "_nuggetry_path", None):
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows, which a count checks; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly where its files give less than half as many partitions as there are cores, as small
    or badly split files do: what follows would else run on a few of them. Else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def positions(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """``df`` with its position, from 1, in a total order. Rows are sorted in ranges; a range's rows are numbered where
    they are, and the rows of the ranges before it are added. Up to ``ORDERED_ROWS`` rows, which a count checks, are one range,
    and nothing is written; else the sorted table goes with ``discard``."""
    if df.limit(ORDERED_ROWS + 1).count() <= ORDERED_ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    n = F.monotonically_increasing_id()
    rows = settle(df.orderBy(*order).select("*", F.shiftright(n, 33).alias("_range"), n.bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")), "sorted")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))  # a row per task of the sort
    out = rows.join(starts, "_range").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_range", "_nth", "_before")
    out._nuggetry_path = rows._nuggetry_path
    return out
