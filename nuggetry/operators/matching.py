"""Matching predictions with gold texts.

Tables are (grp, pos, text) with the position in its list; matching stays within ``grp``. Pairs come from a join on
shared tokens: texts that share none have similarity 0 and no positive threshold is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import INTENT_STOPWORDS
from ..functions.text import canonical_key, lit_array, token_set
from .metrics import ratio


def _pairs(preds: DataFrame, gold: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(grp, p, g, shared, np, ng) of all pairs of a group that share a token."""
    tokens = lambda: F.array_except(token_set("text"), lit_array(stop or []))
    p = preds.select("grp", F.col("pos").alias("p"), tokens().alias("t")).select("grp", "p", F.size("t").alias("np"), F.explode("t").alias("w"))
    g = gold.select("grp", F.col("pos").alias("g"), tokens().alias("t")).select("grp", "g", F.size("t").alias("ng"), F.explode("t").alias("w"))
    return p.join(g, ["grp", "w"]).groupBy("grp", "p", "g").agg(F.count(F.lit(1)).alias("shared"), F.first("np").alias("np"), F.first("ng").alias("ng"))


def best_gold(preds: DataFrame, gold: DataFrame, intent: bool = False) -> DataFrame:
    """(grp, p, g, score): the gold text most like each prediction, the first of equals; by token F1, or by Jaccard
    without stop words for ``intent``."""
    pairs = _pairs(preds, gold, INTENT_STOPWORDS if intent else None)
    score = F.col("shared") / (F.col("np") + F.col("ng") - F.col("shared")) if intent else 2.0 * F.col("shared") / (F.col("np") + F.col("ng"))
    first = Window.partitionBy("grp", "p").orderBy(F.desc("score"), "g")
    return pairs.withColumn("score", score).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("grp", "p", "g", "score")


def greedy_match(preds: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(grp, p, g, score): each prediction takes its best gold text if no earlier one has; there is no second choice."""
    best = best_gold(preds, gold).where(F.col("score") >= threshold)
    return best.withColumn("_n", F.row_number().over(Window.partitionBy("grp", "g").orderBy("p"))).where("_n = 1").drop("_n")


def _counts(preds: DataFrame, gold: DataFrame, matched: DataFrame) -> DataFrame:
    n = preds.groupBy("grp").agg(F.count(F.lit(1)).alias("n_pred")).join(gold.groupBy("grp").agg(F.count(F.lit(1)).alias("n_gold")), "grp", "full")
    out = n.join(matched.groupBy("grp").agg(F.count(F.lit(1)).alias("tp")), "grp", "left")
    return out.select("grp", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_pred", "n_gold", "tp")])


def _prf(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_gold"))
    return counts.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def extraction_scores(preds: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per group: n_pred, n_gold, tp, precision, recall and f1 of the greedy match."""
    return _prf(_counts(preds, gold, greedy_match(preds, gold, threshold)))


def explicit_scores(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Best match without one-to-one: a prediction is right if its best gold has F1 0.5 or more, so recall can exceed 1;
    with the rate of exact matches (up to case and space) and the mean best F1."""
    best = best_gold(preds, gold)
    exact = preds.select("grp", "pos", canonical_key("text").alias("k")).join(gold.select("grp", canonical_key("text").alias("k")).distinct(), ["grp", "k"]).groupBy("grp").agg(F.count(F.lit(1)).alias("exact"))
    out = _prf(_counts(preds, gold, best.where("score >= 0.5"))).join(exact, "grp", "left").join(best.groupBy("grp").agg(F.sum("score").alias("s")), "grp", "left")
    return out.select("grp", "n_pred", "n_gold", "tp", "precision", "recall", "f1", ratio(F.coalesce("exact", F.lit(0)), F.col("n_pred")).alias("exact_match_rate"), ratio(F.coalesce("s", F.lit(0.0)), F.col("n_pred")).alias("avg_span_f1"))


def implicit_scores(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Best intent match of 0.3 or more counts; gate scores are means over the predictions (grp, pos, text,
    actionability_score, feasibility_score, faithfulness_score, passed)."""
    best = best_gold(preds, gold, intent=True)
    gates = preds.groupBy("grp").agg(
        F.avg("actionability_score").alias("avg_actionability"), F.avg("feasibility_score").alias("avg_feasibility"), F.avg("faithfulness_score").alias("avg_faithfulness"), F.avg(F.col("passed").cast("double")).alias("gate_pass_rate")
    )
    out = _prf(_counts(preds, gold, best.where("score >= 0.3"))).join(best.groupBy("grp").agg(F.sum("score").alias("s")), "grp", "left").join(gates, "grp", "left")
    return out.withColumn("avg_intent_match", ratio(F.coalesce("s", F.lit(0.0)), F.col("n_pred"))).drop("s")


def unified_scores(explicit: DataFrame, implicit: DataFrame) -> DataFrame:
    """Per group, precision, recall and F1 of both kinds weighted by their numbers of predictions."""
    both = explicit.select("grp", "n_pred", "precision", "recall", "f1").unionByName(implicit.select("grp", "n_pred", "precision", "recall", "f1"))
    mean = lambda c: ratio(F.sum(F.col(c) * F.col("n_pred")), F.sum("n_pred")).alias(c)
    return both.groupBy("grp").agg(F.sum("n_pred").alias("n_pred"), mean("precision"), mean("recall"), mean("f1"))


def match_kind(gold: Column, pred: Column) -> Column:
    """exact, partial (one inside the other, or half of the gold tokens) or none; null where there is no gold text."""
    g, p = canonical_key(gold), canonical_key(pred)
    shared = F.size(F.array_intersect(token_set(g), token_set(p))) / F.greatest(F.lit(1), F.size(token_set(g)))
    inside = F.contains(p, g) | F.contains(g, p)
    return F.when(~g.isin("", "—", "nan"), F.when(g == p, "exact").when(inside | ((p != "nan") & (shared >= 0.5)), "partial").otherwise("none"))


def any_match(preds: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of the predictions of each group that match any gold text."""
    hit = best_gold(preds, gold).where(F.col("score") >= threshold).groupBy("grp").agg(F.count(F.lit(1)).alias("hit"))
    n = preds.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return n.join(hit, "grp", "left").select("grp", "n", ratio(F.coalesce("hit", F.lit(0)), F.col("n")).alias("text_match_rate"))
