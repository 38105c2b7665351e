"""The routing switch: explicit and implicit suggestions pass different gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import actionability, explicit_actionable, feasibility, specificity, suggestion_type
from ..functions.text import complaint, implicit_faithfulness, inference_chain, overlap_left, split_action, text, token_set

EXPLICIT_CONFIDENCE, EXPLICIT_FAITH = 0.80, 0.60
GATES = {"actionability": (3.0, 0.15), "feasibility": (3.0, 0.10), "specificity": (2.5, 0.10), "faithfulness": (0.40, 0.20)}
IMPLICIT_CONFIDENCE = 0.60


def explicit_path(df: DataFrame) -> Column:
    """struct: confidence (halved on failure), faithfulness, verb, target, actionable, passed, score."""
    faith = F.round(overlap_left(token_set("text"), token_set("original_text")), 3)
    act = explicit_actionable("text")
    passed = (F.col("confidence") >= EXPLICIT_CONFIDENCE) & (faith >= EXPLICIT_FAITH) & act
    conf = F.when(passed, F.col("confidence")).otherwise(F.col("confidence") * 0.5)
    action = split_action("text")
    return F.struct(
        conf.alias("confidence"), faith.alias("faithfulness"), action["verb"].alias("verb"), action["target"].alias("target"), act.alias("actionable"), F.lit(True).alias("feasible"), passed.alias("passed"),
        F.when(act, conf * 1.1).otherwise(conf * 0.8).alias("score"),
    )


def implicit_path(df: DataFrame) -> Column:
    """struct: confidence less a penalty per failed gate, the gate scores, chain, passed, score. Specificity is
    penalised but not required."""
    said = complaint("original_text", F.col("complaint_frame"))
    evidence = F.concat_ws(" ", F.col("original_text"), F.nullif("image_context", F.lit("")), F.nullif("audio_context", F.lit("")))
    scores = {"actionability": actionability("text"), "feasibility": feasibility("text"), "specificity": specificity("text"), "faithfulness": implicit_faithfulness("text", evidence, said)}
    ok = {k: scores[k] >= least for k, (least, _) in GATES.items()}
    penalty = sum((F.when(ok[k], 0.0).otherwise(p) for k, (_, p) in GATES.items()), F.lit(0.0))
    adjusted = F.greatest(F.lit(0.0), F.col("confidence") - penalty)
    passed = (adjusted >= IMPLICIT_CONFIDENCE) & ok["actionability"] & ok["feasibility"] & ok["faithfulness"]
    conf = F.round(adjusted, 3)
    return F.struct(
        conf.alias("confidence"), *[c.alias(k) for k, c in scores.items()], said.alias("complaint"), inference_chain(said, "text", F.col("source_modality"), "image_context").alias("chain"),
        ok["actionability"].alias("actionable"), ok["feasibility"].alias("feasible"), F.round(penalty, 3).alias("penalty"), passed.alias("passed"), F.when(passed, conf).otherwise(conf * 0.6).alias("score"),
    )


INPUTS = {"is_implied": "boolean", "source_modality": "string", "speech_act": "string", "tone": "string", "complaint_frame": "string", "image_context": "string", "audio_context": "string"}


def switch(suggestions: DataFrame) -> DataFrame:
    """Suggestions with routed_type and what its path gives; ambiguous ones take both and keep the one that passed,
    or else the more confident (explicit on ties).

    Needs text, original_text and confidence; the other inputs are null where a column is missing.
    """
    df = suggestions
    for name, kind in INPUTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    df = df.withColumn("source_modality", F.coalesce("source_modality", F.lit("text"))).withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)))
    df = df.withColumn("_type", suggestion_type("text", F.col("confidence"), F.col("is_implied"), F.col("source_modality"), F.col("speech_act"), F.col("tone")))
    df = df.withColumn("_e", explicit_path(df)).withColumn("_i", implicit_path(df))
    e, i = F.col("_e"), F.col("_i")
    wins = F.when(e["passed"] & ~i["passed"], True).when(i["passed"] & ~e["passed"], False).otherwise(e["confidence"] >= i["confidence"])
    df = df.withColumn("_x", F.when(F.col("_type") == "explicit", True).when(F.col("_type") == "implicit", False).otherwise(wins))
    x = F.col("_x")
    return df.withColumns(
        {
            "classified_type": F.col("_type"),
            "routed_type": F.when(x, "explicit").otherwise("implicit"),
            "routed_confidence": F.when(x, e["confidence"]).otherwise(i["confidence"]),
            "passed_switch": F.when(x, e["passed"]).otherwise(i["passed"]),
            "is_actionable": F.when(x, e["actionable"]).otherwise(i["actionable"]),
            "is_feasible": F.when(x, e["feasible"]).otherwise(i["feasible"]),
            "faithfulness_score": F.when(x, e["faithfulness"]).otherwise(i["faithfulness"]),
            "action_verb": F.when(x, e["verb"]).otherwise(""),
            "action_target": F.when(x, e["target"]).otherwise(""),
            "inference_chain": F.when(x, "").otherwise(i["chain"]),
            "actionability_score": F.when(x, 0.0).otherwise(i["actionability"]),
            "feasibility_score": F.when(x, 0.0).otherwise(i["feasibility"]),
            "specificity_score": F.when(x, 0.0).otherwise(i["specificity"]),
            "type_adjusted_score": F.when(x, e["score"]).otherwise(i["score"]),
        }
    ).drop("_type", "_e", "_i", "_x")


def passed(switched: DataFrame) -> DataFrame:
    return switched.where("passed_switch")


def rejected(switched: DataFrame) -> DataFrame:
    """Text and reason of what failed."""
    return switched.where("NOT passed_switch").select("*", F.concat(F.lit("Failed "), F.col("routed_type"), F.lit(" switch gate")).alias("reason"))


def switch_stats(switched: DataFrame) -> DataFrame:
    """Counts per sample: total_input, explicit_count, implicit_count, passed_count, failed_count."""
    explicit = F.col("routed_type") == "explicit"
    return switched.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("total_input"), F.count_if(explicit).alias("explicit_count"), F.count_if(~explicit).alias("implicit_count"), F.count_if("passed_switch").alias("passed_count"), F.count_if(~F.col("passed_switch")).alias("failed_count")
    )
