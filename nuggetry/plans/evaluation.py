"""The full evaluation: one long table of dimension, metric and value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long(table: DataFrame, dimension: str, *metrics: str) -> DataFrame:
    """The metrics of a single-row table as rows."""
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS double)" for m in metrics)
    return table.selectExpr(f"'{dimension}' AS dimension", f"stack({len(metrics)}, {pairs}) AS (metric, value)")


def report(*parts: DataFrame) -> DataFrame:
    """All parts as one table; each stays its own aggregation."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def against_targets(table: DataFrame, targets: dict[str, float], at_most: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with the target of each metric, null where there is none, and whether it is met."""
    target = F.lit(None).cast("double")
    for name, value in targets.items():
        target = F.when(F.col("metric") == name, value).otherwise(target)
    met = F.when(F.col("metric").isin(*at_most), F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    return table.withColumn("target", target).withColumn("met", met)
