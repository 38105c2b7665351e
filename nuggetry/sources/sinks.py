"""Sinks: results, states, metrics and a comparison of systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Adds a batch of results; what is there is not rewritten."""
    df.write.mode("append").parquet(path)


def masked(df: DataFrame) -> Column:
    """A row as JSON in which binary fields read ``<n items>``."""

    def mask(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BinaryType):
            return F.when(c.isNotNull(), F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" items>"))).alias(field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.BinaryType):
            return F.when(c.isNotNull(), F.concat(F.lit("<"), F.size(c).cast("string"), F.lit(" items>"))).alias(field.name)
        return c

    return F.to_json(F.struct(*[mask(f) for f in df.schema.fields]))


def write_states(df: DataFrame, path: str) -> None:
    df.select(masked(df).alias("value")).write.mode("overwrite").text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def comparison(metrics: DataFrame, system: str = "system", metric: str = "metric", value: str = "value", names: list[str] | None = None) -> DataFrame:
    """One row per system, one column per metric; with ``names`` no pass is needed to find them."""
    return metrics.groupBy(system).pivot(metric, names).agg(F.first(value))


def pipeline_results(reviews: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per review: number of suggestions, the top one with its score, and what was expected of it."""
    top = ranked.groupBy("sample_id").agg(F.count(F.lit(1)).alias("num_suggestions"), F.max_by("text", F.struct("score", (-F.col("rank")).alias("r"))).alias("top_suggestion"), F.max("score").alias("top_score"))
    return reviews.join(top, "sample_id", "left").withColumn("num_suggestions", F.coalesce("num_suggestions", F.lit(0)).cast("long"))
