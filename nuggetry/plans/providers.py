"""Providers: where sentences, views and labels come from.

External language, vision and speech models sit behind ``ModelProvider``, one client per partition; what a model does
not answer is filled in by the rules. The default is ``RuleProvider``, which applies the written scoring bands as
column expressions, offline and repeatably.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from queue import Empty, SimpleQueue
from threading import Thread
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.rules import any_of, emphasis_words, has_any
from ..functions.text import json_object, multimodal_context, starts_with_marker, text, topic_words, without_sentinel
from ..sources.work import settle

#: Span confidence by what a sentence does: request, question or comparison, complaint, neutral, praise.
BANDS = {"request": 0.90, "question": 0.75, "complaint": 0.60, "neutral": 0.40, "praise": 0.20}


#: Words of a description that speak of an error.
ERROR_WORDS = r"\b(?:error|crash\w*|fail\w*|broken)\b"


class Provider(Protocol):
    def sentences(self, reviews: DataFrame) -> DataFrame: ...

    def text_views(self, reviews: DataFrame) -> DataFrame: ...

    def image_views(self, reviews: DataFrame) -> DataFrame | None: ...

    def audio_views(self, reviews: DataFrame) -> DataFrame | None: ...

    def alignment(self, reviews: DataFrame) -> DataFrame | None: ...

    def labels(self, reviews: DataFrame, sentences: DataFrame) -> DataFrame: ...


def sentence_kind(c) -> Column:
    t = F.lower(text(c))
    return (
        F.when(t.rlike(any_of(lex.EXPLICIT_STRONG + lex.EXPLICIT_MODERATE) + "|" + "|".join(lex.ROLE_PATTERNS["direct_request"])), "request")
        .when(t.rlike(any_of(lex.IMPLICIT_SIGNALS["comparison_to_feature"] + lex.IMPLICIT_SIGNALS["rhetorical_question"])) | t.rlike("|".join(lex.ROLE_PATTERNS["comparison_frame"])), "question")
        .when(t.rlike("|".join(lex.ROLE_PATTERNS["complaint_frame"])) | has_any(c, lex.COMPLAINT_MARKERS), "complaint")
        .when(has_any(c, lex.HARD_NEGATIVES["tech_software"]["praise"]), "praise")
        .otherwise("neutral")
    )


def split_sentences(reviews: DataFrame) -> DataFrame:
    """(sample_id, idx, text, start, end) of each review; sentences end after full stop, exclamation or question mark."""
    parts = F.filter(F.transform(F.regexp_extract_all(text("raw_text"), F.lit(r"([^.!?]+[.!?]*)"), 1), lambda s: F.btrim(s)), lambda s: s != "")
    none = F.expr("cast(array() as array<struct<text: string, start: int, end: int>>)")

    def step(acc: Column, s: Column) -> Column:
        at = F.greatest(F.position(s, acc["t"], acc["cursor"] + 1) - 1, acc["cursor"])
        return F.struct(acc["t"].alias("t"), (at + F.length(s)).alias("cursor"), F.array_append(acc["out"], F.struct(s.alias("text"), at.alias("start"), (at + F.length(s)).alias("end"))).alias("out"))

    start = F.struct(text("raw_text").alias("t"), F.lit(0).alias("cursor"), none.alias("out"))
    rows = reviews.select("sample_id", F.posexplode(F.aggregate(parts, start, step)["out"]).alias("idx", "s"))
    return rows.select("sample_id", "idx", "s.text", "s.start", "s.end")


def with_topics(sentences: DataFrame) -> DataFrame:
    """Sentences with shared_entities (topic words that another sentence of the review has, sorted) and
    starts_new_topic (not the first, and a discourse marker or nothing shared); a lone sentence has neither."""
    words = sentences.select("sample_id", "idx", F.explode(topic_words("text")).alias("w"))
    shared = words.groupBy("sample_id", "w").agg(F.collect_set("idx").alias("at")).where(F.size("at") > 1)
    shared = shared.select("sample_id", F.explode("at").alias("idx"), "w").groupBy("sample_id", "idx").agg(F.sort_array(F.collect_set("w")).alias("shared_entities"))
    out = sentences.join(shared, ["sample_id", "idx"], "left").withColumn("shared_entities", F.coalesce("shared_entities", F.expr("cast(array() as array<string>)")))
    return out.withColumn("starts_new_topic", (F.col("idx") > 0) & (starts_with_marker("text") | (F.size("shared_entities") == 0)))


class RuleProvider:
    """The deterministic default."""

    def sentences(self, reviews: DataFrame) -> DataFrame:
        rows = split_sentences(reviews).withColumn("kind", sentence_kind("text"))
        conf = F.lit(BANDS["neutral"])
        for k, v in BANDS.items():
            conf = F.when(F.col("kind") == k, v).otherwise(conf)
        return with_topics(rows.withColumn("span_confidence", conf))

    def text_views(self, reviews: DataFrame) -> DataFrame:
        """(sample_id, complaint_frame, comparison_frame, request_frame, confidence, speech_act, tone, urgency_score)."""
        raw = text("raw_text")
        first = lambda role: F.nullif(F.regexp_extract(raw, "(?i)([^.!?]*(?:" + "|".join(lex.ROLE_PATTERNS[role]) + ")[^.!?]*)", 1), F.lit(""))
        sarcastic = has_any("raw_text", lex.IMPLICIT_SIGNALS["sarcasm_reversal"])
        urgent = F.lower(raw).rlike("|".join(lex.ROLE_PATTERNS["urgency_marker"]))
        return reviews.select(
            "sample_id", F.btrim(first("complaint_frame")).alias("complaint_frame"), F.btrim(first("comparison_frame")).alias("comparison_frame"), F.btrim(first("direct_request")).alias("request_frame"), F.lit(0.7).alias("confidence"),
            F.when(sarcastic, "sarcasm").otherwise("statement").alias("speech_act"), F.when(sarcastic, "sarcastic").otherwise("neutral").alias("tone"), F.when(urgent, 0.8).otherwise(0.3).alias("urgency_score"),
        )

    def image_views(self, reviews: DataFrame) -> DataFrame:
        """(sample_id, ui_elements_shown, missing_ui_elements, error_states_shown, shows_error, implied_suggestion,
        confidence) by what the description names: an element is missing after "no" or "without", else shown."""
        caption, names = F.lower(text("image_description")), [k.replace("_", " ") for k in lex.UI_ELEMENTS]
        array = F.array(*[F.lit(n) for n in names])
        absent = lambda n: F.regexp_like(caption, F.concat(F.lit(r"\b(?:no|without|missing)\s+(?:an?\s+|the\s+|any\s+)?"), n))
        gone = F.filter(array, absent)
        shown = F.filter(array, lambda n: F.contains(caption, n) & ~absent(n))
        wrong = caption.rlike(ERROR_WORDS)
        return reviews.where(caption != "").select(
            "sample_id", shown.alias("ui_elements_shown"), gone.alias("missing_ui_elements"), F.filter(shown, lambda n: n.rlike("error")).alias("error_states_shown"), wrong.alias("shows_error"),
            F.when(F.size(gone) > 0, F.concat(F.lit("add "), F.array_join(gone, ", "))).alias("implied_suggestion"), F.lit(0.7).alias("confidence"),
        )

    def audio_views(self, reviews: DataFrame) -> DataFrame:
        """(sample_id, tone, urgency_score) by the urgency markers and stressed words of the description."""
        said = text("audio_description")
        urgent = F.lower(said).rlike("|".join(lex.ROLE_PATTERNS["urgency_marker"]))
        stressed = F.size(emphasis_words("audio_description")) > 0
        return reviews.where(said != "").select("sample_id", F.when(stressed, "emphatic").otherwise("neutral").alias("tone"), F.when(urgent, 0.8).when(stressed, 0.75).otherwise(0.3).alias("urgency_score"))

    def alignment(self, reviews: DataFrame) -> None:
        """Rules don't compare modalities: reviews keep the alignment that they come with."""

    def labels(self, reviews: DataFrame, sentences: DataFrame) -> DataFrame:
        """Sentences from complaints upwards as labels: (sample_id, idx, text, confidence, is_implied, source_modality)."""
        rows = sentences.where(F.col("kind").isin("request", "question", "complaint"))
        return rows.select("sample_id", "idx", "text", F.col("span_confidence").alias("confidence"), (F.col("kind") != "request").alias("is_implied"), F.lit("text").alias("source_modality"))


#: What a model is asked, each a JSON object in reply; {0} is the review, {1} a description.
PROMPTS = {
    "text": 'Read the review below. Reply with one JSON object with the fields complaint_frame, comparison_frame, request_frame (the words of the review, or null), speech_act, tone (one word each) and urgency_score (0 to 1).\n\n{0}',
    "image": 'Look at the picture that came with a review. Reply with one JSON object with the fields ui_elements_shown, missing_ui_elements, error_states_shown (lists of names), shows_error (true or false), implied_suggestion (or null) and confidence (0 to 1).\n\nReview: {0}\nDescription: {1}',
    "audio": 'Read what was said and how. Reply with one JSON object with the fields tone (one word) and urgency_score (0 to 1).\n\n{1}',
    "alignment": 'Compare what a review says with what was seen or heard with it. Reply with one JSON object with the fields overall_alignment (0 to 1), dominant_modality (text, image or audio) and has_contradiction (true or false).\n\nReview: {0}\nSeen or heard: {1}',
    "labels": 'List the suggestions for improvement that the review below makes or implies. Reply with one JSON object {{"suggestions": [{{"text": ..., "confidence": 0 to 1, "is_implied": true or false}}]}}.\n\n{0}',
}
_FIELDS = {
    "text": "complaint_frame string, comparison_frame string, request_frame string, speech_act string, tone string, urgency_score double",
    "image": "ui_elements_shown array<string>, missing_ui_elements array<string>, error_states_shown array<string>, shows_error boolean, implied_suggestion string, confidence double",
    "audio": "tone string, urgency_score double",
    "alignment": "overall_alignment double, dominant_modality string, has_contradiction boolean",
    "labels": "suggestions array<struct<text: string, confidence: double, is_implied: boolean>>",
}


class ModelProvider:
    """Calls an external model: ``client()`` gives a function from prompt to reply, made once per partition.

    A call has ``timeout`` seconds, its prompt ``max_chars`` characters, and is tried ``retries`` times with growing
    pauses; a prompt whose calls all fail gets a null reply, so that one bad row doesn't lose the partition, and the
    rules' values. Spark may run a task again, so calls should be idempotent. As a ``Provider`` it splits sentences by
    rule and asks for views and labels; ``vision`` is a client of the same kind whose function also takes an image as
    Base64 text: it gets the column ``image_base64`` where reviews have it.
    """

    def __init__(self, client: Callable[[], Callable[[str], str]], retries: int = 3, pause: float = 0.5, timeout: float = 180.0, max_chars: int = 16_000, vision: Callable[[], Callable[[str, str | None], str]] | None = None):
        self.client, self.retries, self.pause, self.timeout, self.max_chars, self.vision = client, retries, pause, timeout, max_chars, vision
        self.rules = RuleProvider()

    def ask(self, prompts: DataFrame, prompt: str = "prompt", image: str | None = None) -> DataFrame:
        """``prompts`` with reply and reply_json (the JSON object in the reply). Filter before asking: nothing is
        reordered across the calls. With ``image``, a column, the vision client is asked."""
        client, retries, pause, timeout, most = self.vision if image else self.client, self.retries, self.pause, self.timeout, self.max_chars

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = client()

            def answer(said: SimpleQueue, *args: str | None) -> None:
                try:
                    said.put((True, call(*args)))
                except Exception:
                    said.put((False, None))

            def once(*args: str | None) -> str | None:
                for i in range(retries):
                    said: SimpleQueue = SimpleQueue()
                    Thread(target=answer, args=(said, *args), daemon=True).start()  # its own thread: a call that hangs keeps no other waiting
                    try:
                        done, reply = said.get(timeout=timeout)
                    except Empty:
                        done = False
                    if done:
                        return reply
                    time.sleep(pause * 2**i)
                return None

            for pdf in frames:
                pictures = pdf[image] if image else [None] * len(pdf)
                yield pdf.assign(reply=[None if p is None else once(p[:most], x) if image else once(p[:most]) for p, x in zip(pdf[prompt], pictures)])

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
        return prompts.mapInPandas(run, f"{kept}, reply string").withColumn("reply_json", json_object("reply"))

    def _answers(self, kind: str, reviews: DataFrame, body: str = "raw_text", image: str | None = None) -> DataFrame:
        """(sample_id, the fields of the kind), null where the model had no valid answer."""
        parts = {"{0}": text("raw_text"), "{1}": text(body)}
        asked = F.concat(*[parts[x] if x in parts else F.lit(x.replace("{{", "{").replace("}}", "}")) for x in re.split(r"(\{[01]\})", PROMPTS[kind]) if x])
        rows = reviews.select("sample_id", asked.alias("prompt"), *([image] if image else []))
        return self.ask(rows, image=image).select("sample_id", F.from_json("reply_json", _FIELDS[kind]).alias("a")).select("sample_id", "a.*")

    def _filled(self, answers: DataFrame, rules: DataFrame) -> DataFrame:
        """The model's fields, and the rules' where it gave none."""
        a = answers.select("sample_id", *[F.col(c).alias(f"_{c}") for c in answers.columns if c != "sample_id"])
        own = [F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in a.columns else F.col(c) for c in rules.columns if c != "sample_id"]
        return rules.join(a, "sample_id", "left").select("sample_id", *own)

    def sentences(self, reviews: DataFrame) -> DataFrame:
        return self.rules.sentences(reviews)

    def text_views(self, reviews: DataFrame) -> DataFrame:
        return self._filled(self._answers("text", reviews), self.rules.text_views(reviews))

    def image_views(self, reviews: DataFrame) -> DataFrame:
        """Views of the descriptions, or of the images themselves where there is a vision client and a column for them."""
        image = "image_base64" if self.vision and "image_base64" in reviews.columns else None
        some = reviews.where(text("image_description") != "")
        return self._filled(self._answers("image", some, "image_description", image), self.rules.image_views(reviews))

    def audio_views(self, reviews: DataFrame) -> DataFrame:
        return self._filled(self._answers("audio", reviews.where(text("audio_description") != ""), "audio_description"), self.rules.audio_views(reviews))

    def alignment(self, reviews: DataFrame) -> DataFrame:
        """(sample_id, overall_alignment, dominant_modality, has_contradiction) of reviews with a description; null where
        the model had no valid answer."""
        both = reviews.withColumn("_context", multimodal_context("image_description", "audio_description")).where(F.col("_context") != "")
        return self._answers("alignment", both, "_context")

    def labels(self, reviews: DataFrame, sentences: DataFrame) -> DataFrame:
        """The model's suggestions, in its order; the rules' labels for samples that it gave no valid answer for."""
        got = settle(self._answers("labels", reviews), "labels")
        rows = got.select("sample_id", F.posexplode("suggestions").alias("idx", "s")).where("s.text IS NOT NULL")
        rows = rows.select("sample_id", "idx", "s.text", F.coalesce("s.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("s.is_implied", F.lit(False)).alias("is_implied"), F.lit("text").alias("source_modality"))
        silent = got.where("suggestions IS NULL").select("sample_id")
        return rows.unionByName(self.rules.labels(reviews, sentences).join(silent, "sample_id", "left_semi"))


#: Zero-shot baselines: what is asked, and the field of the reply that decides.
BASELINES = {
    "short": ('Say whether this review holds a suggestion that could be acted on. Reply with JSON {"is_suggestion": 0 or 1}.\n\nReview: ', "is_suggestion"),
    "detailed": (
        "A suggestion names an improvement, openly (should, could, please add) or through a problem that points to one. Praise, plain facts, complaints without a direction, irony and problems already solved "
        'are none. Think step by step, then reply with JSON {"is_suggestion": 0 or 1, "reasoning": ..., "suggestion": ... or null}.\n\nReview: ',
        "is_suggestion",
    ),
    "entailment": ('Does the text entail that something should be improved? Reply with JSON {"label": 0 or 1}.\n\nText: ', "label"),
}


def zero_shot(provider: ModelProvider, reviews: DataFrame, style: str = "short") -> DataFrame:
    """``reviews`` with pred: the model's answer to one of ``BASELINES``, false where there is none. The detailed one also
    gets ``multimodal_context``, if there is any."""
    head, name = BASELINES[style]
    body = text("raw_text")
    if style == "detailed" and "multimodal_context" in reviews.columns:
        more = without_sentinel("multimodal_context")
        body = F.concat(body, F.when(more != "", F.concat(F.lit("\nWith it came: "), more)).otherwise(""))
    asked = provider.ask(reviews.withColumn("_prompt", F.concat(F.lit(head), body)), "_prompt")
    pred = F.get_json_object("reply_json", f"$.{name}").isin("1", "true", "1.0")
    return asked.withColumn("pred", F.coalesce(pred, F.lit(False))).drop("_prompt", "reply", "reply_json")


def available(client: Callable[[], Callable[[str], str]]) -> bool:
    """Whether a model answers at all; asked once, on the driver."""
    try:
        return bool(client()("ping"))
    except Exception:
        return False


def best_view(views: DataFrame) -> DataFrame:
    """Of several images' views (sample_id, image_index, view, confidence) the most confident, the first of equals."""
    return views.groupBy("sample_id").agg(F.max_by("view", F.struct("confidence", (-F.col("image_index")).alias("first"))).alias("view"), F.max("confidence").alias("confidence"))
