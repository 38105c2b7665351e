"""Evidence provenance: which spans of text, image and sound support a suggestion.

Inputs are tables with a ``sample_id``: suggestions(suggestion_id, text), sentences(idx, text, start, end,
span_confidence), captions(image_index, caption), views as structs, segments of transcripts. Every extractor
gives rows of one long table; joins are on ``sample_id``, so the work of a sample stays with the sample.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions import lexicon as lex
from ..functions.rules import emphasis_words, role_view, span_role
from ..functions.text import keywords, locate_words, sentence_index, text
from ..sources.work import settle

COLUMNS = ["sample_id", "suggestion_id", "evidence_type", "pos", "start", "end", "matched_text", "source_view", "evidence_role", "confidence"]
# Pace of speech, least overlap, where segments are cut, colours by kind of evidence.
WORDS_PER_SECOND = 2.5
LEAST_OVERLAP = 0.15
SEGMENT_CUTS = r"[.!?]+\s*|(?:\.{3}|…)\s*|,\s+(?=(?:um|uh|like|so|and)\s)"
COLOURS = {"text": "#3B8BD4", "image": "#1D9E75", "audio": "#D85A30", "cross_modal": "#7F77DD"}
# End of the fixed values.


def _ratio(sugg: Column, other: Column) -> Column:
    return F.size(F.array_intersect(sugg, other)) / F.greatest(F.lit(1), F.size(sugg)).cast("double")


def keyword_evidence(suggestions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences that hold at least 0.15 of a suggestion's keywords, narrowed to the words around them."""
    s = suggestions.select("sample_id", "suggestion_id", keywords("text").alias("_k"))
    t = sentences.select("sample_id", "idx", "text", "start", "span_confidence", keywords("text").alias("_w"))
    both = s.join(t, "sample_id").withColumn("_r", _ratio(F.col("_k"), F.col("_w"))).where(F.col("_r") >= LEAST_OVERLAP)
    at = locate_words("text", F.array_intersect("_k", "_w"))
    both = both.withColumn("_at", at).withColumn("evidence_role", span_role("text"))
    conf = F.round(F.least(F.lit(0.99), F.col("_r") * 0.7 + F.coalesce("span_confidence", F.lit(0.5)) * 0.3), 3)
    begin = F.col("start") + F.col("_at.offset")
    return both.select(
        "sample_id", "suggestion_id", F.lit("text").alias("evidence_type"), F.col("idx").alias("pos"), begin.alias("start"), (begin + F.length("_at.text")).alias("end"),
        F.col("_at.text").alias("matched_text"), role_view(F.col("evidence_role"), lex.KEYWORD_VIEWS).alias("source_view"), "evidence_role", conf.alias("confidence"),
    )


_MATCH = T.ArrayType(T.StructType().add("role", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("matched", T.StringType()))
_PATTERNS = [(role, re.compile(p, re.I)) for role, patterns in lex.ROLE_PATTERNS.items() for p in patterns]


@arrow_udf(_MATCH)
def _role_matches(texts: pa.Array) -> pa.Array:
    """All matches of all role patterns with their offsets, in the order of the patterns."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.string())]))
    return pa.array([[{"role": r, "start": m.start(), "end": m.end(), "matched": m[0]} for r, p in _PATTERNS for m in p.finditer(t or "")] for t in texts.to_pylist()], kind)


def pattern_evidence(suggestions: DataFrame, reviews: DataFrame, sentences: DataFrame, found: DataFrame) -> DataFrame:
    """Role patterns in the whole review that share a keyword with the suggestion (urgency needs none).

    A match inside evidence that is already there, ``found`` or an earlier match, is skipped: a fold over the
    matches of one suggestion, in order.
    """
    have = found.groupBy("sample_id", "suggestion_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"))).alias("_have"))
    sents = sentences.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start", "end"))).alias("_sents"))
    base = suggestions.select("sample_id", "suggestion_id", keywords("text").alias("_k"))
    base = base.join(reviews.select("sample_id", _role_matches("raw_text").alias("_m")), "sample_id").join(have, ["sample_id", "suggestion_id"], "left").join(sents, "sample_id", "left")
    none = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    kept = F.expr("cast(array() as array<struct<role: string, start: int, end: int, matched: string>>)")

    def step(acc: Column, m: Column) -> Column:
        inside = F.exists(acc["have"], lambda x: (x["s"] <= m["start"]) & (x["e"] >= m["end"]))
        relevant = (F.size(F.array_intersect(keywords(m["matched"]), acc["k"])) > 0) | (m["role"] == "urgency_marker")
        more = F.struct(F.array_append(acc["have"], F.struct(m["start"].alias("s"), m["end"].alias("e"))).alias("have"), F.array_append(acc["kept"], m).alias("kept"), acc["k"].alias("k"))
        return F.when(~inside & relevant, more).otherwise(acc)

    start = F.struct(F.coalesce("_have", none).alias("have"), kept.alias("kept"), F.col("_k").alias("k"))
    rows = base.select("sample_id", "suggestion_id", "_sents", F.posexplode(F.aggregate("_m", start, step)["kept"]).alias("_i", "_e"))
    return rows.select(
        "sample_id", "suggestion_id", F.lit("text").alias("evidence_type"), sentence_index(F.col("_e.start"), F.col("_sents")).alias("pos"), F.col("_e.start").alias("start"),
        F.col("_e.end").alias("end"), F.col("_e.matched").alias("matched_text"), role_view(F.col("_e.role"), lex.PATTERN_VIEWS).alias("source_view"), F.col("_e.role").alias("evidence_role"),
        F.when(F.col("_e.role") == "direct_request", 0.7).otherwise(0.6).alias("confidence"),
    )


def _near(query: str, body: str) -> tuple[int, int] | None:
    """Where a phrase stands in a text: as it is, or else the smallest, then first, window of words that holds the
    most of its words, if that is more than half."""
    if (at := body.lower().find(query.lower())) >= 0:
        return at, at + len(query)
    wanted, parts = set(query.lower().split()), body.split()
    bare = [w.lower().strip(".,!?") for w in parts]
    most = len(wanted & set(bare))
    if not wanted or most <= 0.5 * len(wanted):
        return None
    # For each end the latest start from which all of these words are in; the shortest such stretch, but never fewer
    # words than the phrase has, at its first place.
    seen: dict[str, int] = {}
    start, covers = 0, []
    for end, w in enumerate(bare):
        if w in wanted:
            seen[w] = seen.get(w, 0) + 1
        while len(seen) == most and (bare[start] not in wanted or seen[bare[start]] > 1):
            if bare[start] in wanted:
                seen[bare[start]] -= 1
            start += 1
        if len(seen) == most:
            covers.append((start, end))
    size = max(len(wanted), min(end - begin + 1 for begin, end in covers))
    if size > len(parts):
        return None
    first = min(max(0, end - size + 1) for begin, end in covers if max(0, end - size + 1) <= begin)
    at = len(" ".join(parts[:first])) + (1 if first else 0)
    return at, at + len(" ".join(parts[first : first + size]))


_SPAN = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())


@arrow_udf(_SPAN)
def fuzzy_find(queries: pa.Array, bodies: pa.Array) -> pa.Array:
    """struct(start, end) of a phrase in a text, null where it isn't near any."""
    out = [_near(q, b or "") if q else None for q, b in zip(queries.to_pylist(), bodies.to_pylist())]
    return pa.array([{"start": s[0], "end": s[1]} if s else None for s in out], pa.struct([("start", pa.int32()), ("end", pa.int32())]))


FRAMES = (("complaint_frame", "complaint_frame"), ("comparison_frame", "comparison_frame"), ("request_frame", "direct_request"))


def frame_evidence(suggestions: DataFrame, reviews: DataFrame, sentences: DataFrame, views: DataFrame, found: DataFrame) -> DataFrame:
    """The semantic view's frames where they stand in the review; spans that are there already are left out.

    ``views(sample_id, complaint_frame, comparison_frame, request_frame, confidence)``.
    """
    sents = sentences.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start", "end"))).alias("_sents"))
    frames = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).alias("frame"), F.lit(i).alias("i")) for i, (c, role) in enumerate(FRAMES)]))
    rows = views.select("sample_id", frames.alias("f"), F.coalesce("confidence", F.lit(0.7)).alias("confidence")).where("f.frame NOT IN ('', 'null', 'none')")
    rows = rows.join(reviews.select("sample_id", "raw_text"), "sample_id").withColumn("_at", fuzzy_find("f.frame", "raw_text")).where("_at IS NOT NULL")
    first = Window.partitionBy("sample_id", "_at").orderBy("f.i")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").join(sents, "sample_id", "left").join(suggestions.select("sample_id", "suggestion_id"), "sample_id")
    out = rows.select(
        "sample_id", "suggestion_id", F.lit("text").alias("evidence_type"), sentence_index(F.col("_at.start"), F.col("_sents")).alias("pos"), F.col("_at.start").alias("start"),
        F.col("_at.end").alias("end"), F.substring("raw_text", F.col("_at.start") + 1, F.col("_at.end") - F.col("_at.start")).alias("matched_text"), F.lit("semantic").alias("source_view"),
        F.col("f.role").alias("evidence_role"), "confidence",
    )
    return out.join(found.select("sample_id", "suggestion_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")), ["sample_id", "suggestion_id", "start", "end"], "left_anti").select(*COLUMNS)


def text_evidence(suggestions: DataFrame, reviews: DataFrame, sentences: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """All three text strategies."""
    found = settle(keyword_evidence(suggestions, sentences), "evidence")
    found = found.unionByName(pattern_evidence(suggestions, reviews, sentences, found))
    return found.unionByName(frame_evidence(suggestions, reviews, sentences, views, found)) if views is not None else found


def ui_elements(spark) -> DataFrame:
    """The interface elements with region type and default box, a table of ten rows."""
    rows = [(k, t, b) for k, (t, b) in lex.UI_ELEMENTS.items()]
    return spark.createDataFrame(rows, "element string, region_type string, bbox struct<x: double, y: double, w: double, h: double>")


def image_evidence(suggestions: DataFrame, captions: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Captions that share keywords, interface elements shown or missing, error states and implied suggestions.

    ``captions(sample_id, image_index, caption)``; ``views(sample_id, ui_elements_shown, missing_ui_elements,
    error_states_shown, shows_error, implied_suggestion, confidence)`` holds for every image of the sample.
    """
    s = suggestions.select("sample_id", "suggestion_id", keywords("text").alias("_k"))
    both = s.join(captions.select("sample_id", F.col("image_index").alias("pos"), "caption"), "sample_id")
    row = lambda df, what, view, role, conf: df.select("sample_id", "suggestion_id", F.lit("image").alias("evidence_type"), "pos", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), what.alias("matched_text"), F.lit(view).alias("source_view"), role.alias("evidence_role"), conf.alias("confidence"))
    ratio = _ratio(F.col("_k"), keywords("caption"))
    out = row(both.where(ratio > 0), F.col("caption"), "image_semantic", F.lit("shows_problem"), F.round(ratio * 0.8, 3))
    if views is None:
        return out
    seen = both.join(views, "sample_id")
    errors = F.coalesce("error_states_shown", F.expr("cast(array() as array<string>)"))
    shown = seen.select("sample_id", "suggestion_id", "pos", errors.alias("_err"), F.explode(F.concat(F.coalesce("ui_elements_shown", F.expr("cast(array() as array<string>)")), errors)).alias("_e"))
    known = F.broadcast(ui_elements(suggestions.sparkSession).select("element"))  # ten rows
    shown = shown.join(known, F.replace(F.lower("_e"), F.lit(" "), F.lit("_")) == F.col("element"))
    out = out.unionByName(row(shown, F.concat(F.lit("Visible: "), "_e"), "image_syntactic", F.when(F.array_contains("_err", F.col("_e")), "shows_problem").otherwise("ui_context"), F.lit(0.75)))
    missing = seen.select("sample_id", "suggestion_id", "pos", F.explode("missing_ui_elements").alias("_e"))
    out = out.unionByName(row(missing, F.concat(F.lit("Missing from image: "), "_e"), "image_syntactic", F.lit("missing_element"), F.lit(0.70)))
    out = out.unionByName(row(seen.where("shows_error"), F.lit("Image shows error state"), "image_pragmatic", F.lit("error_state"), F.lit(0.85)))
    implied = seen.where(~F.coalesce("implied_suggestion", F.lit("")).isin("", "null") & (F.size(F.array_intersect("_k", keywords("implied_suggestion"))) > 0))
    return out.unionByName(row(implied, F.concat(F.lit("Image implies: "), "implied_suggestion"), "image_semantic", F.lit("visual_proof"), F.coalesce(F.col("confidence"), F.lit(0.7))))


def segments(transcripts: DataFrame) -> DataFrame:
    """``transcripts(sample_id, transcript)`` to segments: idx, text, char_start, char_end, est_start, est_end.

    Cuts are at sentence ends, ellipses and commas before a filler; a segment is looked for from where the one
    before it ended, and takes its words at 2.5 a second.
    """
    parts = F.filter(F.transform(F.split(text("transcript"), SEGMENT_CUTS), lambda s: F.btrim(s)), lambda s: s != "")
    empty = F.expr("cast(array() as array<struct<text: string, char_start: int, char_end: int, t0: double, t1: double>>)")

    def step(acc: Column, s: Column) -> Column:
        at = F.position(s, acc["t"], acc["cursor"] + 1) - 1
        at = F.when(at < 0, acc["cursor"]).otherwise(at)
        t1 = acc["time"] + F.size(F.split(s, r"(?U)\s+")) / F.lit(WORDS_PER_SECOND)
        seg = F.struct(s.alias("text"), at.alias("char_start"), (at + F.length(s)).alias("char_end"), acc["time"].alias("t0"), t1.alias("t1"))
        return F.struct(acc["t"].alias("t"), (at + F.length(s)).alias("cursor"), t1.alias("time"), F.array_append(acc["out"], seg).alias("out"))

    start = F.struct(text("transcript").alias("t"), F.lit(0).alias("cursor"), F.lit(0.0).alias("time"), empty.alias("out"))
    rows = transcripts.select("sample_id", F.posexplode(F.aggregate(parts, start, step)["out"]).alias("idx", "s"))
    return rows.select("sample_id", "idx", "s.text", "s.char_start", "s.char_end", F.round("s.t0", 1).alias("est_start"), F.round("s.t1", 1).alias("est_end"))


def audio_evidence(suggestions: DataFrame, transcripts: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Segments that hold at least 0.15 of the keywords, stronger with stressed words; above an urgency of 0.7 the
    tone of the whole transcript. ``views(sample_id, urgency_score)``."""
    s = suggestions.select("sample_id", "suggestion_id", keywords("text").alias("_k"))
    seg = segments(transcripts).withColumn("_w", keywords("text")).withColumn("_stress", F.size(emphasis_words("text")) > 0)
    both = s.join(seg, "sample_id").withColumn("_r", _ratio(F.col("_k"), F.col("_w"))).where(F.col("_r") >= LEAST_OVERLAP)
    conf = F.round(F.least(F.lit(0.95), F.col("_r") * 0.6 + F.when(F.col("_stress"), 0.2).otherwise(0.0) + 0.2), 3)
    out = both.select(
        "sample_id", "suggestion_id", F.lit("audio").alias("evidence_type"), F.col("idx").alias("pos"), F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.col("text").alias("matched_text"),
        F.when(F.col("_stress"), "audio_pragmatic").otherwise("audio_semantic").alias("source_view"), F.when(F.col("_stress"), "emphasis_word").otherwise("content_mention").alias("evidence_role"), conf.alias("confidence"),
    )
    if views is None:
        return out
    urgent = s.join(transcripts.where("transcript <> ''"), "sample_id").join(views.where("urgency_score > 0.7"), "sample_id")
    return out.unionByName(
        urgent.select(
            "sample_id", "suggestion_id", F.lit("audio").alias("evidence_type"), F.lit(-1).alias("pos"), F.lit(0).alias("start"), F.length("transcript").alias("end"), F.lit("[Overall tone analysis]").alias("matched_text"),
            F.lit("audio_pragmatic").alias("source_view"), F.lit("tone_shift").alias("evidence_role"), F.round("urgency_score", 3).alias("confidence"),
        )
    )


def strongest(evidence: DataFrame, kind: str) -> DataFrame:
    """The most confident evidence of a kind for each suggestion, the first of equals."""
    best = Window.partitionBy("sample_id", "suggestion_id").orderBy(F.desc("confidence"), "pos", "start", "evidence_role", "matched_text")
    return evidence.where(F.col("evidence_type") == kind).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def cross_modal_evidence(evidence: DataFrame, alignment: DataFrame) -> DataFrame:
    """The strongest text evidence paired with the strongest of image and of audio.

    ``alignment(sample_id, overall_alignment)``; text with image takes that (0.5 if unknown), text with audio the
    lesser confidence of the two.
    """
    t = strongest(evidence, "text").select("sample_id", "suggestion_id", F.col("confidence").alias("_t"), F.col("matched_text").alias("_tm"))
    i = strongest(evidence, "image").select("sample_id", "suggestion_id", F.col("matched_text").alias("_m")).join(t, ["sample_id", "suggestion_id"])
    i = i.join(alignment.select("sample_id", "overall_alignment"), "sample_id", "left").withColumn("_c", F.coalesce("overall_alignment", F.lit(0.5))).withColumn("_role", F.lit("text_image_confirmation"))
    a = strongest(evidence, "audio").select("sample_id", "suggestion_id", F.col("confidence").alias("_a"), F.col("matched_text").alias("_m")).join(t, ["sample_id", "suggestion_id"])
    a = a.withColumn("_c", F.least("_t", "_a")).withColumn("_role", F.lit("text_audio_confirmation"))
    both = i.select("sample_id", "suggestion_id", "_tm", "_m", "_role", "_c").unionByName(a.select("sample_id", "suggestion_id", "_tm", "_m", "_role", "_c"))
    none = F.lit(None).cast("int")
    return both.select("sample_id", "suggestion_id", F.lit("cross_modal").alias("evidence_type"), F.lit(0).alias("pos"), none.alias("start"), none.alias("end"), F.concat_ws(" | ", "_tm", "_m").alias("matched_text"), F.lit("fusion").alias("source_view"), F.col("_role").alias("evidence_role"), F.col("_c").alias("confidence"))


def summary(evidence: DataFrame) -> DataFrame:
    """Per suggestion: pieces, sorted modalities, strongest and weakest role, grounding score (mean confidence)."""
    key = F.struct("confidence", (-F.coalesce("pos", F.lit(0))).alias("p"))
    return evidence.groupBy("sample_id", "suggestion_id").agg(
        F.count(F.lit(1)).alias("total_evidence_pieces"),
        F.sort_array(F.collect_set("evidence_type")).alias("evidence_modalities"),
        F.max_by("evidence_role", key).alias("strongest_role"),
        F.min_by("evidence_role", key).alias("weakest_role"),
        F.round(F.avg("confidence"), 3).alias("evidence_grounding_score"),
    )


def enrich(suggestions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Suggestions with their evidence summary; without evidence 0 pieces and grounding 0."""
    out = suggestions.join(summary(evidence), ["sample_id", "suggestion_id"], "left")
    return out.withColumns({"total_evidence_pieces": F.coalesce("total_evidence_pieces", F.lit(0).cast("long")), "evidence_grounding_score": F.coalesce("evidence_grounding_score", F.lit(0.0))})


def highlights(evidence: DataFrame) -> DataFrame:
    """One record for display per piece of evidence, as JSON with the kind's colour."""
    colour = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    record = F.struct(F.col("evidence_type").alias("type"), "start", "end", F.col("matched_text").alias("text"), F.col("evidence_role").alias("role"), "confidence", F.element_at(colour, F.col("evidence_type")).alias("color"))
    return evidence.select("sample_id", "suggestion_id", F.to_json(record).alias("highlight"))
