"""Stages of a run that a later run takes up again.

Each is stored under a fingerprint of the configuration and the contents of the inputs, in a folder that the caller names. A run
that ends half way leaves its finished stages there; the next one with the same fingerprint reads them and makes the
others. A run with another fingerprint removes what is left of earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, is_dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import settle


def contents(df: DataFrame | None) -> str:
    """What tells tables of other rows apart, in whatever order these come: their number, columns, and sums of their hashes."""
    if df is None:
        return "none"
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    row = df.select(h.alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum((F.col("h") % 1_000_003).cast("long"))).first()
    return f"{df.dtypes} {tuple(row)}"


def described(value) -> str:
    """A configuration as text: fields of data classes and attributes of objects by name, functions by theirs."""
    if is_dataclass(value):
        return f"{type(value).__qualname__}({', '.join(f'{f.name}={described(getattr(value, f.name))}' for f in fields(value))})"
    if callable(value):
        return f"{value.__module__}.{value.__qualname__}"
    if isinstance(value, (str, int, float, bool, type(None), tuple, list, dict)):
        return repr(value)
    return f"{type(value).__qualname__}({', '.join(f'{k}={described(v)}' for k, v in sorted(vars(value).items()))})"


def fingerprint(config, *tables: DataFrame | None) -> str:
    return sha256("\n".join([described(config), *map(contents, tables)]).encode()).hexdigest()[:24]


class Stages:
    """Where stages are kept: in the folder's part for the fingerprint, or, without a folder, in tables of the run alone.
    ``made`` lists the stages that this run had to make."""

    def __init__(self, spark: SparkSession, folder: str | None = None, mark: str = ""):
        self.spark, self.folder, self.made = spark, folder and f"{folder.rstrip('/')}/{mark}", []
        if folder:
            top, fs = self._at(folder)
            if fs.exists(top):
                for old in fs.listStatus(top):
                    if old.getPath().getName() != mark:
                        fs.delete(old.getPath(), True)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage of that name, made if it is not there whole."""
        if not self.folder:
            return settle(make(), name)
        path = f"{self.folder}/{name}"
        done, fs = self._at(f"{path}/_SUCCESS")
        if not fs.exists(done):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)
