"""Bootstrap by Poisson weights: a row takes part in each resample with a weight drawn from a hash of its key.

Resamples so need no index and no join: one pass makes the weighted sums of all of them, combined map-side.
"""

from __future__ import annotations

from math import exp, factorial, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESAMPLES, SEED = 1000, 42
#: Cumulative Poisson(1) probabilities up to weight 7.
CUMULATIVE = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(8)]


def draw(key: Column, resample: Column, seed: int = SEED) -> Column:
    """A weight of 0 to 8 from 32 bits of the MD5 of seed, resample and key."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), key.cast("string")).cast("binary"))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(u >= c, 1).otherwise(0) for c in CUMULATIVE), F.lit(0))


def resamples(df: DataFrame, key: str, n: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """``df`` once per resample that it is in, with ``resample`` and ``w``."""
    out = df.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return out.withColumn("w", draw(F.col(key), F.col("resample"), seed)).where("w > 0")


def interval(statistic: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval (interpolated) of a statistic over its resamples."""
    a = (1 - level) / 2
    return statistic.agg(F.count(F.lit(1)).alias("resamples"), F.avg(value).alias("mean"), F.percentile(value, F.lit(a)).alias("low"), F.percentile(value, F.lit(1 - a)).alias("high"))


def order_interval(statistic: DataFrame, value: str, n: int = RESAMPLES) -> DataFrame:
    """The same by elements of the sorted statistic: positions 0.025 n, 0.5 n and 0.975 n - 1, from 0."""
    s = F.array_sort(F.collect_list(value))
    at = lambda i: F.try_element_at(s, F.lit(int(i) + 1))
    return statistic.agg(at(0.025 * n).alias("low"), at(0.5 * n).alias("median"), at(0.975 * n - 1).alias("high"))


def mean_statistic(df: DataFrame, key: str, value: str, n: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(resample, stat): the weighted mean of ``value``."""
    r = resamples(df.select(key, value), key, n, seed)
    return r.groupBy("resample").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("stat"))


def f1_statistic(df: DataFrame, key: str, gold: str, pred: str, n: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(resample, stat): detection F1."""
    r = resamples(df.select(key, gold, pred), key, n, seed)
    w = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    g, p = F.col(gold), F.col(pred)
    r = r.groupBy("resample").agg(w(g & p).alias("tp"), w(~g & p).alias("fp"), w(g & ~p).alias("fn"))
    return r.select("resample", F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0)).alias("stat"))


def paired_test(df: DataFrame, key: str, a: str, b: str, n: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """p_value: share of the resamples in which ``a`` is not better than ``b`` on average, and win_rate, one less that."""
    r = mean_statistic(df.select(key, (F.col(a) - F.col(b)).alias("_d")), key, "_d", n, seed)
    return r.agg(F.avg((F.col("stat") <= 0).cast("double")).alias("p_value")).withColumn("win_rate", 1 - F.col("p_value"))


# By cells. The rows of a cell, which share their values, count together in every statistic; the sum of n draws of Poisson(1)
# is one of Poisson(n), so a resample needs a draw per cell, whatever its rows.

#: Cells of at most so many rows are drawn row by row; larger ones by the normal quantile with the correction for skewness.
BY_ROW = 32


def _uniform(name: Column, first: int) -> Column:
    """From 32 bits of the MD5 of a name, at the given hex digit: above 0, up to 1."""
    return (F.conv(F.substring(F.md5(name.cast("binary")), first, 8), 16, 10).cast("double") + 1) / float(1 << 32)


def cell_draw(cell: Column, n: Column, resample: Column, seed: int = SEED) -> Column:
    """How often the ``n`` rows of a cell are in a resample, all together."""
    name = F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), cell)
    z = F.sqrt(-2 * F.ln(_uniform(name, 1))) * F.cos(2 * pi * _uniform(name, 9))
    large = F.greatest(F.lit(0.0), F.floor(n + F.sqrt(n.cast("double")) * z + (z * z - 1) / 6 + 0.5))
    each = F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0), lambda acc, i: acc + draw(F.concat_ws(":", cell, i.cast("string")), resample, seed))
    return F.when(n <= BY_ROW, each).otherwise(large).cast("long")


def cell_resamples(df: DataFrame, *values: str, n: int = 10_000, seed: int = SEED) -> DataFrame:
    """Every cell of the values in every resample: the values, ``resample`` and ``w``, the number of its rows there."""
    cells = df.groupBy(*values).agg(F.count(F.lit(1)).alias("_n"))
    name = F.concat_ws(",", *[F.coalesce(F.col(v).cast("string"), F.lit("null")) for v in values])
    rows = cells.withColumn("_cell", name).withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select(*values, "resample", cell_draw(F.col("_cell"), F.col("_n"), F.col("resample"), seed).alias("w"))


def cell_f1(df: DataFrame, gold: str, pred: str, n: int = 10_000, seed: int = SEED) -> DataFrame:
    """(resample, stat): detection F1, from four cells."""
    w = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    g, p = F.col(gold), F.col(pred)
    r = cell_resamples(df, gold, pred, n=n, seed=seed).groupBy("resample").agg(w(g & p).alias("tp"), w(~g & p).alias("fp"), w(g & ~p).alias("fn"))
    return r.select("resample", F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0)).alias("stat"))


def cell_mean(df: DataFrame, value: str, n: int = 10_000, seed: int = SEED) -> DataFrame:
    """(resample, stat): the mean of a value that takes few different ones; null where no row was drawn."""
    r = cell_resamples(df, value, n=n, seed=seed)
    return r.groupBy("resample").agg(F.try_divide(F.sum(F.col("w") * F.col(value)).cast("double"), F.sum("w").cast("double")).alias("stat"))


def cell_paired_test(df: DataFrame, a: str, b: str, n: int = 10_000, seed: int = SEED) -> DataFrame:
    """paired_test() by the cells of the difference."""
    r = cell_mean(df.select((F.col(a) - F.col(b)).alias("_d")), "_d", n, seed)
    return r.agg(F.avg((F.col("stat") <= 0).cast("double")).alias("p_value")).withColumn("win_rate", 1 - F.col("p_value"))
