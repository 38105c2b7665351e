"""Metrics as aggregations: detection, agreement, ranking, rates, efficiency.

Zero denominators give 0 unless a docstring says otherwise. Nothing is collected; a metric is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dice, token_set


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(gold: Column, pred: Column) -> list[Column]:
    """Counts tp, fp, fn, tn of two boolean columns."""
    return [F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"), F.count_if(~gold & ~pred).alias("tn")]


def scores(counts: DataFrame) -> DataFrame:
    """Counts with precision, recall, f1, mcc, accuracy and balanced_accuracy."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "mcc": F.when(den == 0, 0.0).otherwise((tp * tn - fp * fn) / F.when(den == 0, 1.0).otherwise(den)),
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2,
        }
    )


def detection(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return scores(df.agg(*confusion(F.col(gold), F.col(pred))))


def detection_by(df: DataFrame, slices: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Detection overall and by each slice column, all in one aggregation over grouping sets: slice, value and scores."""
    sets = ", ".join(["()", *[f"(`{c}`)" for c in slices]])
    view = df.select(F.col(gold).alias("_g"), F.col(pred).alias("_p"), *slices)
    keys = ", ".join(f"`{c}`" for c in slices)
    name = "CASE " + " ".join(f"WHEN grouping(`{c}`) = 0 THEN '{c}'" for c in slices) + " ELSE 'overall' END"
    value = "CASE " + " ".join(f"WHEN grouping(`{c}`) = 0 THEN cast(`{c}` AS string)" for c in slices) + " ELSE 'all' END"
    sql = f"""SELECT {name} AS slice, {value} AS value, count_if(_g AND _p) AS tp, count_if(NOT _g AND _p) AS fp, count_if(_g AND NOT _p) AS fn,
              count_if(NOT _g AND NOT _p) AS tn FROM {{df}} GROUP BY GROUPING SETS ({sets})""" + ("" if keys else "")
    return scores(df.sparkSession.sql(sql, df=view))


def upper_median(name: str) -> Column:
    """The middle element of the sorted values of a column, the upper one of two; aggregated as counts of values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def harmonic(a: Column, b: Column) -> Column:
    return ratio(2 * a * b, a + b)


def mining_f1(detected: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Harmonic mean of detection F1 and mean overlap of single-row tables (f1) and (mean_overlap)."""
    return detected.select("f1").join(overlaps.select("mean_overlap")).select("*", harmonic(F.col("f1"), F.col("mean_overlap")).alias("mining_f1"))


def efficiency(log: DataFrame, by: str = "model") -> DataFrame:
    """Calls, mean tokens, mean latency in seconds, mean cost at 3 and 15 per million tokens in and out."""
    cost = (3.0 * F.col("tokens_in") + 15.0 * F.col("tokens_out")) / 1e6
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("tokens_in") + F.col("tokens_out")).alias("avg_tokens"), F.avg(F.col("latency_ms") / 1000).alias("avg_latency_s"), F.avg(cost).alias("avg_cost"))


def means(df: DataFrame, by: str, value: str, condition: Column, order: str, k: int) -> DataFrame:
    """Per group: the mean of all values, of those where ``condition`` holds, and of the first ``k`` by ``order``."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    rows = df.select(by, F.col(value).cast("double").alias("_v"), condition.alias("_c"), nth.alias("_n"))
    return rows.groupBy(by).agg(F.avg("_v").alias("mean"), F.avg(F.when(F.col("_c"), F.col("_v"))).alias("mean_if"), F.avg(F.when(F.col("_n") <= k, F.col("_v"))).alias("mean_first"))


def majority(preds: DataFrame, key: str) -> DataFrame:
    """``(key, pred)`` of the majority of the runs of each key; half is enough from ``n div 2 + 1`` on."""
    return preds.groupBy(key).agg((F.count_if("pred") >= F.floor(F.count(F.lit(1)) / 2) + 1).alias("pred"))


def rate(df: DataFrame, **conditions: Column) -> DataFrame:
    """Share of the rows that meet each condition; 0 without rows."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0)).alias(k) for k, c in conditions.items()])


def grounding(preds: DataFrame, below: float = 0.20) -> DataFrame:
    """Mean grounding (0.5 where unknown), mean pieces, share with two modalities or more, share below a bound."""
    g = F.coalesce("evidence_grounding_score", F.lit(0.5))
    two = F.coalesce(F.size("evidence_modalities"), F.lit(0)) >= 2
    return preds.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(g), F.lit(0.0)).alias("avg_grounding"), F.coalesce(F.avg(F.coalesce("total_evidence_pieces", F.lit(0)).cast("double")), F.lit(0.0)).alias("avg_pieces"),
        F.coalesce(F.avg(two.cast("double")), F.lit(0.0)).alias("multi_modal_coverage"), F.coalesce(F.avg((g < below).cast("double")), F.lit(0.0)).alias("ungrounded"),
    )


def hallucinated(score: Column, pred: Column, source: Column) -> Column:
    """Grounding below 0.20, or, where it is unknown, token F1 with the source below 0.15."""
    return F.when(score.isNotNull(), score < 0.20).otherwise(dice(token_set(pred), token_set(source)) < 0.15)


def false_positive_rate(preds: DataFrame, negatives: DataFrame) -> DataFrame:
    """Share of the predictions whose text, up to case and outer space, is among the rejected ones."""
    key = lambda df: F.btrim(F.lower("text")).alias("_k")
    hit = preds.select(key(preds)).join(negatives.select(key(negatives)).distinct().withColumn("_hit", F.lit(1)), "_k", "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")), F.lit(0.0)).alias("fp_rate"))


def deltas(table: DataFrame, name: str, value: str, baseline: str) -> DataFrame:
    """Each configuration's value less that of the baseline row."""
    base = table.agg(F.max(F.when(F.col(name) == baseline, F.col(value))).alias("_base"))
    return table.join(F.broadcast(base)).withColumn("delta", F.col(value) - F.col("_base")).drop("_base")  # one row


def best_of(table: DataFrame, name: str, value: str) -> DataFrame:
    """The configuration with the largest value, the smallest name of equals."""
    return table.agg(F.max(value).alias("best_value"), F.min_by(name, F.struct((-F.col(value)).alias("v"), name)).alias("best"))


# Agreement


def krippendorff_alpha(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nominal alpha without small-sample correction: 1 - Do / De; 1 where all values agree, 0 without pairs."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) != F.col(b)).alias("d"))
    values = pairs.select(F.explode(F.array(F.col(a), F.col(b))).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    share = values.agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s"), F.sum("c").alias("t"))
    de = 1 - F.col("s") / (F.col("t").cast("double") * F.col("t"))
    return n.join(share).select("n", F.when(F.col("n") == 0, 0.0).when(de == 0, 1.0).otherwise(1 - (F.col("d") / F.when(F.col("n") == 0, 1).otherwise(F.col("n"))) / F.when(de == 0, 1.0).otherwise(de)).alias("alpha"))


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Kappa of two annotators; 1 where chance agreement is complete, 0 without pairs."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agree"))
    left = pairs.groupBy(F.col(a).alias("v")).agg(F.count(F.lit(1)).alias("ca"))
    right = pairs.groupBy(F.col(b).alias("v")).agg(F.count(F.lit(1)).alias("cb"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("ca").cast("double") * F.col("cb")), F.lit(0.0)).alias("s"))
    total = F.when(F.col("n") == 0, 1.0).otherwise(F.col("n").cast("double"))
    po, pe = F.col("agree") / total, F.col("s") / (total * total)
    kappa = F.when(F.col("n") == 0, 0.0).when(pe == 1.0, 1.0).otherwise((po - pe) / F.when(pe == 1.0, 1.0).otherwise(1 - pe))
    return n.join(chance).select("n", po.alias("observed"), pe.alias("expected"), kappa.alias("kappa"))


def labeller_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Kappa over all texts that either labeller has: present or absent on each side."""
    side = lambda df, name: df.select(F.btrim(F.lower("text")).alias("text")).distinct().withColumn(name, F.lit(1))
    both = side(first, "a").join(side(second, "b"), "text", "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return cohen_kappa(both)


# Ranking


def ndcg(predicted: DataFrame, gold: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """NDCG@k with linear gain: ``predicted`` and ``gold`` have (item, pos) from 1; the gain of the gold item at ``pos``
    of n is n - pos + 1, unknown items gain 0. ``by`` is a column of both for several rankings at once."""
    key = [by] if by else []
    g = gold.withColumn("rel", F.count(F.lit(1)).over(Window.partitionBy(*key)) - F.col("pos") + 1)
    got = predicted.where(F.col("pos") <= k).join(g.select(*key, "item", "rel"), [*key, "item"], "left")
    gain = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)) / F.log2(F.col("pos") + 1.0))
    ideal = g.where(F.col("pos") <= k).groupBy(*key).agg(gain("rel").alias("idcg"))
    got = got.groupBy(*key).agg(gain("rel").alias("dcg"))
    both = ideal.join(got, key, "left") if key else ideal.join(got)
    return both.select(*key, (F.coalesce("dcg", F.lit(0.0)) / F.greatest("idcg", F.lit(1e-10))).alias("ndcg"))


def kendall_tau(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Tau over the pairs of common items that either ranking orders; 0 with fewer than two.

    Both rankings are cut into blocks of about the square root of the number of items. Pairs in different blocks of
    both are counted from the grid of block counts by prefix sums, the others by joins within a block, so that n
    items cost n to the power 1.5 and no block is larger than its width.
    """
    both = predicted.select("item", F.col("pos").alias("p")).join(gold.select("item", F.col("pos").alias("g")), "item")
    last = both.agg(F.max(F.greatest("p", "g"))).first()[0]
    width = max(1, int((last or 1) ** 0.5))
    blocks = (last or 1) // width + 1
    both = both.withColumn("a", F.floor(F.col("p") / width)).withColumn("b", F.floor(F.col("g") / width))

    cells = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    spark = both.sparkSession
    grid = spark.range(blocks).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    grid = grid.join(cells, ["a", "b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    along = Window.partitionBy("a")
    low = F.coalesce(F.sum("c").over(along.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = F.coalesce(F.sum("c").over(along.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("low", low).withColumn("high", high)
    before = Window.partitionBy("b").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    far = grid.select("c", F.coalesce(F.sum("low").over(before), F.lit(0)).alias("up"), F.coalesce(F.sum("high").over(before), F.lit(0)).alias("down"))
    far = far.agg(F.sum(F.col("c") * (F.col("up") - F.col("down"))).alias("s"), F.sum(F.col("c") * (F.col("up") + F.col("down"))).alias("t"))

    other = both.select(*[F.col(c).alias(f"{c}2") for c in both.columns])
    sign = F.signum((F.col("p") - F.col("p2")).cast("double") * (F.col("g") - F.col("g2"))).cast("long")
    same_a = both.join(other, (F.col("a") == F.col("a2")) & (F.col("item") < F.col("item2"))).select(sign.alias("x"))
    same_b = both.join(other, (F.col("b") == F.col("b2")) & (F.col("a") != F.col("a2")) & (F.col("item") < F.col("item2"))).select(sign.alias("x"))
    near = same_a.unionByName(same_b).agg(F.sum("x").alias("s"), F.sum(F.abs("x")).alias("t"))
    return far.unionByName(near).agg(ratio(F.sum("s"), F.sum("t")).alias("tau"))


def top_k_precision(predicted: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Share of the predicted top ``k`` items that are in the gold top ``k``."""
    p = predicted.where(F.col("pos") <= k).select("item").distinct()
    g = gold.where(F.col("pos") <= k).select("item").distinct().withColumn("_hit", F.lit(1))
    return p.join(g, "item", "left").agg(ratio(F.sum(F.coalesce("_hit", F.lit(0))), F.greatest(F.count(F.lit(1)), F.lit(1))).alias("precision"))


def legacy_ranking(detected: DataFrame) -> DataFrame:
    """The constant that stands for ranking quality where only detection is known: 1 for every detected positive.
    Kept under its own name; ndcg() measures rankings."""
    n = F.count_if(F.col("gold") & (F.coalesce("num_suggestions", F.lit(0)) > 0))
    one = F.when(n > 0, 1.0).otherwise(0.0)
    return detected.agg(n.alias("n"), one.alias("legacy_ndcg5"), one.alias("legacy_mrr"))


def switch_accuracy(df: DataFrame) -> DataFrame:
    """Whether paths P4 to P6 were SPECIFIC and the other known paths COMMON."""
    specific, common = F.col("extraction_path").isin("P4", "P5", "P6"), F.col("extraction_path").isin("P1", "P2", "P3", "P7", "P8", "XD")
    s, c = specific & (F.col("switch_mode") == "SPECIFIC"), common & (F.col("switch_mode") == "COMMON")
    return df.agg(F.count_if(specific | common).alias("n"), F.count_if(s).alias("specific_correct"), F.count_if(c).alias("common_correct")).withColumn("switch_accuracy", ratio(F.col("specific_correct") + F.col("common_correct"), F.col("n")))
