"""Labels, arbitration, canonical forms, ranking and the human-review gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import SCORER_WEIGHTS
from ..functions.text import canonical_key, overlap_max, segment_weight, token_set
from ..sources.work import settle, small
from .components import components
from .similarity import distinct_sets, links_within, set_key, set_tokens

CONSERVATIVE, LIBERAL, KEEP = 0.80, 0.50, 0.50
#: Similarity of texts that mean the same.
SAME = 0.6
VIEWS = 8
MAX_SCORE = sum(SCORER_WEIGHTS.values())
#: Weights of text, semantic view, image and domain in each switch mode.
MODE_WEIGHTS = {"COMMON": (1.2, 1.2, 1.0, 1.0), "SPECIFIC": (0.8, 1.0, 1.5, 1.3)}


def conservative(labels: DataFrame) -> DataFrame:
    """Explicit labels of high confidence."""
    return labels.where(~F.col("is_implied") & (F.col("confidence") >= CONSERVATIVE))


def liberal(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("confidence") >= LIBERAL)


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both labellers' labels, repeats kept."""
    return first.withColumn("labeller", F.lit("conservative")).unionByName(second.withColumn("labeller", F.lit("liberal")), allowMissingColumns=True)


def tier(score: Column) -> Column:
    return F.when(score >= 8.0, "CRITICAL").when(score >= 6.5, "HIGH").when(score >= 4.5, "MEDIUM").otherwise("LOW")


def arbitrate(labels: DataFrame, accept_all: bool = False) -> DataFrame:
    """One row per sample and text: confidence boosted where modalities agree, kept from 0.5 on, priority and tier.

    ``labels(sample_id, text, confidence, is_implied, source_modality, labeller)``. Text and image agreeing adds
    0.10, sound too 0.05 more. ``accept_all`` keeps everything, as the ablation without arbitration does.
    """
    m = F.sort_array(F.collect_set("source_modality"))
    key = canonical_key("text")
    out = labels.groupBy("sample_id", key.alias("canonical_key")).agg(
        F.min("text").alias("text"), F.max("confidence").alias("_c"), F.min("is_implied").alias("is_implied"), m.alias("supporting_modalities"), F.sort_array(F.collect_set("labeller")).alias("supporting_agents")
    )
    has = lambda name: F.array_contains("supporting_modalities", name)
    boost = F.when(has("text") & has("image"), F.when(has("audio"), 0.15).otherwise(0.10)).otherwise(0.0)
    out = out.withColumn("confidence", F.least(F.lit(1.0), F.col("_c") + boost)).drop("_c")
    out = out.withColumn("accepted", F.lit(True) if accept_all else F.col("confidence") >= KEEP)
    out = out.withColumn("consensus_score", F.size("supporting_agents") / 2.0).withColumn("modality_agreement_score", F.size("supporting_modalities") / 3.0)
    score = 10 * (0.8 * F.col("confidence") + 0.1 * F.col("consensus_score") + 0.1 * F.col("modality_agreement_score"))
    return out.withColumn("priority_score", score).withColumn("priority_tier", tier(score))


def canonicalise(accepted: DataFrame) -> DataFrame:
    """Texts that agree up to case and outer space become one: frequency, best confidence, all forms and modalities."""
    return accepted.groupBy("sample_id", canonical_key("text").alias("canonical_text")).agg(
        F.count(F.lit(1)).alias("frequency"),
        F.max("confidence").alias("confidence"),
        F.sort_array(F.collect_set("text")).alias("original_forms"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("supporting_modalities")))).alias("supporting_modalities"),
    )


def canonical_groups(accepted: DataFrame, threshold: float = SAME) -> DataFrame:
    """The same by meaning: texts of a sample that are similar (Jaccard of tokens, ``threshold`` or more) become one, and so do
    chains of them. The canonical text is the medoid, the form with the largest sum of similarities to the forms it is
    linked with, the first by text of equals; ``n_merged`` counts the forms that canonicalise() keeps apart.

    Links are found by a similarity join in which samples share no token; equal token sets are one node. What meets in one task
    are the forms of one group.
    """
    exact = canonicalise(accepted).withColumn("_t", set_tokens("canonical_text", "sample_id"))
    exact = settle(exact.withColumn("_key", set_key(F.col("_t"))), "canonical")
    sets = settle(distinct_sets(exact.where("_key IS NOT NULL").select(F.col("_key").alias("key"), F.col("_t").alias("t"))), "distinct")
    links = settle(links_within(sets, threshold, strict=False), "links")
    found = components(links.select(F.col("left_key").alias("node"), F.col("right_key").alias("root")))
    texts = exact.where("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    both = links.select(F.col("left_key").alias("_of"), F.col("right_key").alias("_key"), "similarity").unionByName(links.select(F.col("right_key").alias("_of"), F.col("left_key").alias("_key"), "similarity"))
    sums = both.join(texts, "_key").groupBy("_of").agg(F.sum(F.col("similarity") * F.col("_n")).alias("_sum"))
    sums = texts.join(sums, texts["_key"] == F.col("_of"), "left").select("_key", F.round(F.coalesce("_sum", F.lit(0.0)) + F.col("_n") - 1, 9).alias("_weight"))  # texts of one set resemble each other by 1
    member = exact.join(small(found), F.col("_key") == F.col("node"), "left").join(sums, "_key", "left")
    group = F.coalesce("root", "_key", F.encode("canonical_text", "UTF-8")).alias("_group")
    flat = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    out = member.groupBy("sample_id", group).agg(
        F.min(F.struct((-F.coalesce("_weight", F.lit(0.0))).alias("less"), "canonical_text"))["canonical_text"].alias("canonical_text"),
        F.sum("frequency").alias("frequency"),
        F.max("confidence").alias("confidence"),
        flat("original_forms").alias("original_forms"),
        flat("supporting_modalities").alias("supporting_modalities"),
        F.count(F.lit(1)).alias("n_merged"),
    )
    return out.drop("_group")


def reattach(canonical: DataFrame, accepted: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of the accepted suggestion that each canonical one comes from: an exact or original form first, else
    the largest token overlap, the first of equals; nothing where no token is shared. ``accepted`` has ``pos``."""
    a = accepted.select("sample_id", F.col("pos").alias("_pos"), F.lower("text").alias("_t"), *[f for f in fields if f not in canonical.columns])
    both = canonical.join(a, "sample_id", "left")
    exact = (F.col("_t") == F.lower("canonical_text")) | F.array_contains(F.transform("original_forms", F.lower), F.col("_t"))
    score = F.when(exact, 2.0).otherwise(overlap_max(token_set("_t"), token_set("canonical_text")))
    first = Window.partitionBy("sample_id", "canonical_text").orderBy(F.desc("_score"), "_pos")
    best = both.withColumn("_score", F.coalesce(score, F.lit(0.0))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    got = [F.when(F.col("_score") > 0, F.col(f)).alias(f) for f in fields if f not in canonical.columns]
    return best.select(*canonical.columns, *got)


def log_share(n: Column, full: int) -> Column:
    """ln n / ln full, 0 up to one and 1 at most."""
    return F.when(n <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.ln(n.cast("double")) / F.ln(F.lit(float(full)))))


#: Inputs of the scorer and what stands for a missing one.
SCORER_INPUTS = {
    "view_agreement_ratio": 0.0, "modality_agreement_score": 0.5, "semantic_memory_hit": False, "canonical_frequency": 1, "past_approval_rate": 0.5, "cluster_size": 1,
    "avg_confidence": 0.5, "has_urgency_markers": False, "user_segment_importance": 0.7, "modality_alignment": 0.5, "is_implied": False, "grounding_score": 0.5,
    "actionability_score": 3.0, "feasibility_score": 3.0, "faithfulness_score": 0.5, "suggestion_type": "",
}


def linear_score(df: DataFrame, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of 16 features on a scale of 0 to 10; the scale is that of the default weights."""
    w = weights or SCORER_WEIGHTS
    col = lambda n: F.coalesce(F.col(n), F.lit(SCORER_INPUTS[n])) if n in df.columns else F.lit(SCORER_INPUTS[n])
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    terms = {
        "canonical_frequency_norm": log_share(col("canonical_frequency"), 50),
        "cluster_size_norm": log_share(col("cluster_size"), 100),
        "semantic_memory_hit": flag(col("semantic_memory_hit")),
        "has_urgency_markers": flag(col("has_urgency_markers")),
        "explicit_bonus": flag(~col("is_implied")),
        "actionability_norm": col("actionability_score") / 5.0,
        "feasibility_norm": col("feasibility_score") / 5.0,
        "type_bonus": flag(col("suggestion_type") == "explicit"),
    }
    raw = sum((F.lit(w[n]) * (terms[n] if n in terms else col(n)) for n in SCORER_WEIGHTS), F.lit(0.0))
    return F.round(raw / F.lit(MAX_SCORE) * 10, 2)


def rerank_features(df: DataFrame, alignment: str = "overall_alignment", segment: str = "user_segment") -> DataFrame:
    """View agreement of at most eight views, segment weight and alignment, as the scorer takes them."""
    views = F.least(F.coalesce(F.size("supporting_views"), F.lit(0)), F.lit(VIEWS))
    return df.withColumns({"view_agreement_count": views, "view_agreement_ratio": F.round(views / float(VIEWS), 3), "user_segment_importance": segment_weight(segment), "modality_alignment": F.coalesce(alignment, F.lit(0.5))})


def rank(df: DataFrame, by: str = "score", tie: str = "suggestion_id") -> DataFrame:
    """Position within the sample, best first; equal scores by ``tie``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc(by), tie)))


def top_suggestion(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1").select("sample_id", F.col("text").alias("top_suggestion"), F.col("score").alias("top_score"))


def view_weight(modality: Column, mode: Column) -> Column:
    """Weight of a modality (text, semantic, image, domain) in a switch mode; 1 for others."""
    out = F.lit(1.0)
    for m, ws in MODE_WEIGHTS.items():
        for name, w in zip(("text", "semantic", "image", "domain"), ws):
            out = F.when((mode == m) & (modality == name), w).otherwise(out)
    return out


def review_reasons(df: DataFrame) -> Column:
    """Why a human should look: up to six reasons; missing values give none."""
    col = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in df.columns else F.lit(d)
    why = {
        "low_score": col("score", 10.0) < 6.0,
        "novel_suggestion": ~col("memory_hit", True),
        "image_only_no_text_corroboration": (col("dominant_modality", "") == "image") & ~col("text_corroborated", False),
        "cross_modal_contradiction": col("has_contradiction", False),
        "low_grounding_faithfulness": col("grounding_score", 1.0) < 0.40,
        "implicit_low_actionability": (col("suggestion_type", "") == "implicit") & (col("actionability_score", 5.0) < 3.0),
    }
    return F.filter(F.array(*[F.when(c, k) for k, c in why.items()]), lambda r: r.isNotNull())


def review_gate(ranked: DataFrame) -> DataFrame:
    """Suggestions with reasons and needs_review; a sample needs review if any of its suggestions does."""
    out = ranked.withColumn("reasons", review_reasons(ranked))
    return out.withColumn("needs_review", F.size("reasons") > 0)
