"""The mining pipeline: from reviews to ranked suggestions with evidence, memory and a review gate.

Stages are functions of DataFrames; the ablations switch stages by a configuration.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import multimodal_context, short_id, switch_mode
from ..operators import clusters, evidence, memory, ranking, routing
from ..sources.work import settle
from .providers import Provider, RuleProvider
from .stages import Stages, fingerprint


@dataclass(frozen=True)
class Config:
    """What runs. ``tau`` is the alignment from which the modes agree."""

    image: bool = True
    audio: bool = True
    alignment: bool = True  # off: every alignment is 1
    conservative: bool = True  # off: the liberal labels alone
    arbitration: bool = True  # off: everything is accepted
    switch: bool = True
    evidence: bool = True
    memory: bool = True
    merge: bool = False  # on: texts of a sample that mean the same become one, not only equal ones
    tau: float = 0.6
    provider: Provider = field(default_factory=RuleProvider)


@dataclass(frozen=True)
class Memories:
    """The memories as they were before a run; what is left out is empty."""

    decisions: DataFrame | None = None  # decision_id, text, decision, ts
    canonical: DataFrame | None = None  # text
    long_term: DataFrame | None = None  # text; the canonical texts of the store without a threshold
    edits: DataFrame | None = None  # edit_id, original, corrected
    alignments: DataFrame | None = None  # alignment_score, dominant_modality, domain, decision
    patterns: DataFrame | None = None  # as memory.patterns() gives them


_EMPTY = {
    "decisions": "decision_id long, text string, decision string, ts timestamp",
    "canonical": "text string",
    "edits": "edit_id long, original string, corrected string",
    "alignments": "alignment_score double, dominant_modality string, domain string, decision string",
    "patterns": "pattern string, domain_count int, cross_domain_boost double",
}


def remember(s: DataFrame, memories: Memories) -> DataFrame:
    """Suggestions with what the memories say in place of their own text and confidence: ``memory.lookup`` and
    ``memory.apply_memory``; their alignment by sample is that of the sample."""
    tables = {k: getattr(memories, k) if getattr(memories, k) is not None else s.sparkSession.createDataFrame([], kind) for k, kind in _EMPTY.items()}
    s = s.withColumn("id", F.concat_ws("|", "sample_id", "suggestion_id"))
    asked = s.select("id", "text", "confidence", F.col("overall_alignment").alias("alignment_score"), F.col("source_modality").alias("dominant_modality"), F.coalesce("domain", F.lit("general")).alias("domain"))
    said = memory.apply_memory(memory.lookup(settle(asked, "asked"), tables["decisions"], tables["canonical"], tables["edits"], tables["alignments"], tables["patterns"], memories.long_term))
    said = said.select("id", "text", "confidence", "past_approval_rate", "semantic_memory_hit", "is_human_corrected", "cross_domain", "cross_domain_boost", "modal_alignment_score", "similar_forms")
    return s.drop("text", "confidence").join(said, "id").drop("id")


#: One component less each.
ABLATIONS = {
    "full": Config(),
    "no_image": Config(image=False),
    "no_audio": Config(audio=False),
    "no_alignment": Config(alignment=False),
    "no_arbitration": Config(arbitration=False),
    "no_conservative": Config(conservative=False),
    "no_switch": Config(switch=False),
    "no_evidence": Config(evidence=False),
    "no_memory": Config(memory=False),
    "text_only": Config(image=False, audio=False),
}


def prepare(reviews: DataFrame, config: Config) -> DataFrame:
    """Reviews (sample_id, domain, raw_text, image_description, audio_description, overall_alignment, user_segment)
    with what the configuration leaves of them; missing columns read as null."""
    df = reviews
    for c, kind in {"domain": "string", "image_description": "string", "audio_description": "string", "overall_alignment": "double", "user_segment": "string"}.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    if not config.image:
        df = df.withColumn("image_description", F.lit(None).cast("string"))
    if not config.audio:
        df = df.withColumn("audio_description", F.lit(None).cast("string"))
    df = df.withColumn("overall_alignment", F.coalesce("overall_alignment", F.lit(0.5)) if config.alignment else F.lit(1.0))
    return df.withColumn("multimodal_context", multimodal_context("image_description", "audio_description")).withColumn("switch_mode", switch_mode(F.col("overall_alignment"), config.tau))


def run(reviews: DataFrame, config: Config = Config(), decisions: DataFrame | None = None, memories: Memories | None = None, resume: str | None = None, made: list | None = None) -> DataFrame:
    """Ranked suggestions: one row per sample and canonical text with scores, evidence, cluster, memory and reasons.

    Samples without an accepted suggestion have no row; they reappear where results are joined to reviews.
    ``memories`` are those from before; ``decisions(decision_id, text, decision, ts)`` stands for the episodic one alone.
    Image and audio views come from the provider where it has them. Clusters take suggestions in the order of
    ``arrived``, if reviews have that column, then of sample and suggestion. With ``resume``, a folder that all executors
    share, stages are stored there and taken up by a later run with the same configuration and inputs (``stages``);
    ``made`` gets the names of those that this run makes.
    """
    inputs = (reviews, decisions, *(vars(memories).values() if memories else ()))
    stages = Stages(reviews.sparkSession, resume, fingerprint(config, *inputs) if resume else "")
    if made is not None:
        stages.made = made
    df = prepare(reviews, config)
    if config.alignment and (aligned_ := getattr(config.provider, "alignment", lambda _: None)(df)) is not None:
        aligned = stages.keep("alignment", lambda: aligned_.select("sample_id", F.col("overall_alignment").alias("_a"), "dominant_modality", "has_contradiction"))
        given = "overall_alignment" if "overall_alignment" in reviews.columns else F.lit(None).cast("double").alias("overall_alignment")
        known = reviews.select("sample_id", given).join(aligned, "sample_id", "left").select("sample_id", F.coalesce("overall_alignment", "_a").alias("overall_alignment"), "dominant_modality", "has_contradiction")
        df = prepare(reviews.drop("overall_alignment").join(known, "sample_id"), config)
    sents = stages.keep("sentences", lambda: config.provider.sentences(df))
    views = stages.keep("views", lambda: config.provider.text_views(df))
    seen, heard = (getattr(config.provider, f"{kind}_views", lambda _: None)(df) for kind in ("image", "audio"))
    if not isinstance(config.provider, RuleProvider):  # a model is asked once, however often its views are read
        seen, heard = (stages.keep(k, lambda v=v: v) if v is not None else None for k, v in (("seen", seen), ("heard", heard)))

    def arbitrated() -> DataFrame:
        labels = config.provider.labels(df, sents)
        liberal = ranking.liberal(labels)
        merged = ranking.merge(ranking.conservative(labels), liberal) if config.conservative else liberal.withColumn("labeller", F.lit("liberal"))
        return ranking.arbitrate(merged, accept_all=not config.arbitration).where("accepted")

    accepted = stages.keep("accepted", arbitrated)
    canonical = (ranking.canonical_groups if config.merge else ranking.canonicalise)(accepted)

    context = df.select("sample_id", "domain", F.col("raw_text").alias("original_text"), "image_description", "audio_description", "overall_alignment", "user_segment", "switch_mode", *[c for c in ("dominant_modality", "has_contradiction") if c in df.columns])
    s = canonical.join(accepted.select("sample_id", F.col("canonical_key").alias("canonical_text"), "text", "is_implied", "modality_agreement_score"), ["sample_id", "canonical_text"])
    s = s.withColumn("suggestion_id", short_id("canonical_text")).withColumn("source_modality", F.lit("text"))
    s = stages.keep("suggestions", lambda s=s: s.join(context, "sample_id").join(views.select("sample_id", "complaint_frame", "speech_act", "tone", "urgency_score"), "sample_id"))

    if config.evidence:
        asked = s.select("sample_id", "suggestion_id", "text")

        def found() -> DataFrame:
            ev = evidence.text_evidence(asked, df, sents, views.select("sample_id", "complaint_frame", "comparison_frame", "request_frame", "confidence"))
            ev = ev.unionByName(evidence.image_evidence(asked, df.where("image_description <> ''").select("sample_id", F.lit(0).alias("image_index"), F.col("image_description").alias("caption")), seen))
            return ev.unionByName(evidence.audio_evidence(asked, df.where("audio_description <> ''").select("sample_id", F.col("audio_description").alias("transcript")), heard))

        ev = stages.keep("evidence", found)
        ev = ev.unionByName(evidence.cross_modal_evidence(ev, df.select("sample_id", "overall_alignment")))
        s = evidence.enrich(s, ev)
    else:
        s = s.withColumns({"total_evidence_pieces": F.lit(0).cast("long"), "evidence_grounding_score": F.lit(0.5)})

    if config.switch:
        s = routing.switch(s.withColumnRenamed("image_description", "image_context").withColumnRenamed("audio_description", "audio_context")).where("passed_switch")
        s = s.withColumn("suggestion_type", F.col("routed_type"))
    else:
        s = s.withColumns({"suggestion_type": F.when(F.col("is_implied"), "implicit").otherwise("explicit"), "faithfulness_score": F.lit(0.5), "actionability_score": F.lit(0.0), "feasibility_score": F.lit(0.0)})

    came = df.select("sample_id", F.col("arrived").alias("_came")) if "arrived" in df.columns else df.select("sample_id", F.lit(0).alias("_came"))
    turn = F.row_number().over(Window.partitionBy("_domain").orderBy("_came", "sample_id", "suggestion_id")).cast("long")
    s = stages.keep("arrivals", lambda s=s: s.join(came, "sample_id").withColumn("_domain", F.coalesce("domain", F.lit("general"))).withColumn("_seq", turn).drop("_came"))
    members = stages.keep("clusters", lambda: clusters.assign_clusters(s.select(F.col("_domain").alias("domain"), F.col("_seq").alias("seq"), "text", "sample_id", "confidence")))
    members = members.select(F.col("domain").alias("_domain"), F.col("seq").alias("_seq"), "cluster_id", "cluster_size")
    s = s.join(members, ["_domain", "_seq"]).drop("_domain", "_seq")

    if config.memory and (memories or decisions is not None):
        before = s
        s = stages.keep("remembered", lambda: remember(before, memories or Memories(decisions=decisions)))
    else:
        s = s.withColumn("past_approval_rate", F.lit(0.5))

    s = ranking.rerank_features(s.withColumn("supporting_views", F.array(F.lit("semantic"), F.lit("syntactic"), F.lit("pragmatic"))))
    s = s.withColumns({"canonical_frequency": F.col("frequency"), "avg_confidence": F.col("confidence"), "has_urgency_markers": F.col("urgency_score") > 0.7, "grounding_score": F.col("evidence_grounding_score")})
    s = s.withColumn("score", ranking.linear_score(s)).withColumn("weighted_score", F.round(F.col("score") * ranking.view_weight(F.col("source_modality"), F.col("switch_mode")), 2))
    return ranking.review_gate(ranking.rank(s, by="weighted_score"))


def ablation(name: str, **changes) -> Config:
    return replace(ABLATIONS[name], **changes)


def tau_sweep(reviews: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, switch_mode, n): how many reviews fall into each mode at each threshold, in one pass."""
    df = reviews.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    return df.groupBy("tau", switch_mode(F.col("overall_alignment"), F.col("tau")).alias("switch_mode")).agg(F.count(F.lit(1)).alias("n"))
