"""Lexicon and rule classifiers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lex
from .automaton import Scan
from .text import lit_array, split_action, text, token_set, word_count, words


def any_of(literals) -> str:
    """One alternation of quoted literals; reads the same in Java and RE2."""
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", w) for w in literals)


def has_any(c, literals) -> Column:
    """Whether the lower-cased text holds any of the literals, inside words too."""
    return F.lower(text(c)).rlike(any_of(literals))


def n_of(c, literals) -> Column:
    """How many different literals the lower-cased text holds."""
    t = F.lower(text(c))
    return F.size(F.filter(lit_array(literals), lambda w: F.contains(t, w)))


def rule_detect(c) -> Column:
    """A suggestion cue or a complaint pattern."""
    t = F.lower(text(c))
    return has_any(c, lex.SUGGESTION_CUES) | t.rlike("|".join(lex.IMPLICIT_COMPLAINTS))


def cue_or_sentiment(c) -> Column:
    """A suggestion cue or a negative word."""
    return has_any(c, lex.SUGGESTION_CUES) | has_any(c, lex.NEGATIVE_WORDS)


#: What the detection rules ask of a text, to be read off one pass over it.
SCAN = Scan({"cues": lex.SUGGESTION_CUES, "negative": lex.NEGATIVE_WORDS}, {"complaints": lex.IMPLICIT_COMPLAINTS, **lex.ROLE_PATTERNS})


def detection(c, hits: Column) -> dict[str, Column]:
    """rule_detect(), cue_or_sentiment() and span_role() of a text from the ``hits`` of ``SCAN`` in it: long texts are
    read once, and patterns are tried where they can match."""
    cue, role = SCAN.has(hits, "cues"), F.lit(lex.DEFAULT_ROLE)
    for name in reversed(lex.ROLE_PATTERNS):
        role = F.when(SCAN.matches(hits, c, name), name).otherwise(role)
    return {"rule": cue | SCAN.matches(hits, c, "complaints"), "cue_or_negative": cue | SCAN.has(hits, "negative"), "role": role}


def best_sentence(c) -> Column:
    """The first sentence that holds the most of the suggestion keywords, trimmed."""
    sents = F.split(text(c), "[.!?]+")
    scored = F.transform(sents, lambda s, i: F.struct(n_of(s, lex.SENTENCE_KEYWORDS).alias("n"), (-i).alias("first"), F.btrim(s).alias("s")))
    return F.array_max(scored)["s"]


def span_role(c) -> Column:
    """The first role, in order, one of whose patterns the lower-cased text matches."""
    t, out = F.lower(text(c)), F.lit(lex.DEFAULT_ROLE)
    for role, patterns in reversed(lex.ROLE_PATTERNS.items()):
        out = F.when(t.rlike("|".join(patterns)), role).otherwise(out)
    return out


def role_view(role: Column, table: dict[str, str]) -> Column:
    out = F.lit(lex.DEFAULT_VIEW)
    for name, view in table.items():
        out = F.when(role == name, view).otherwise(out)
    return out


def suggestion_type(c, confidence: Column, implied: Column, modality: Column, speech_act: Column, tone: Column) -> Column:
    """explicit, implicit or ambiguous, by the first rule that decides: a modality other than text; sarcasm; an explicit
    label of confidence 0.8 with an explicit signal; an implied label; signals on one side or both; confidence."""
    strong, moderate = n_of(c, lex.EXPLICIT_STRONG), n_of(c, lex.EXPLICIT_MODERATE)
    explicit = 2.0 * strong + 1.0 * moderate
    implicit = 1.5 * sum((n_of(c, s) for s in lex.IMPLICIT_SIGNALS.values()), F.lit(0))
    implied = F.coalesce(implied, F.lit(False))
    return (
        F.when(modality.isin("image", "audio", "cross_modal"), "implicit")
        .when((speech_act == "sarcasm") | tone.isin("sarcastic", "ironic"), "implicit")
        .when(~implied & (confidence >= 0.80) & (explicit > 0), "explicit")
        .when(implied, "implicit")
        .when((explicit > 0) & (implicit == 0), "explicit")
        .when((implicit > 0) & (explicit == 0), "implicit")
        .when((explicit > 0) & (implicit > 0), "ambiguous")
        .when(confidence >= 0.80, "explicit")
        .otherwise("implicit")
    )


def explicit_actionable(c) -> Column:
    """An action verb and at least one target word that is neither a stop word nor vague."""
    action = split_action(c)
    target = F.array_except(token_set(action["target"]), lit_array(lex.TARGET_STOPWORDS + lex.VAGUE_TARGETS))
    return (action["verb"] != "") & (F.size(target) >= 1)


def actionability(c) -> Column:
    """1 to 5: verb first 1.5, two other words 1, a specific noun 1, four words 0.5."""
    w = words(F.lower(text(c)))
    first = F.rtrim(F.try_element_at(w, F.lit(1)), F.lit(".,!")).isin(lex.GATE_VERBS)
    target = F.size(F.array_except(w, lit_array(lex.GATE_VERBS + lex.GATE_STOPWORDS))) >= 2
    points = F.when(first, 1.5).otherwise(0.0) + F.when(target, 1.0).otherwise(0.0)
    points += F.when(has_any(c, lex.SPECIFIC_NOUNS), 1.0).otherwise(0.0) + F.when(F.size(w) >= 4, 0.5).otherwise(0.0)
    return F.least(F.lit(5.0), F.round(1.0 + points, 1))


def feasibility(c) -> Column:
    return F.when(has_any(c, lex.INFEASIBLE), 1.5).when(has_any(c, lex.STANDARD_FEATURES), 4.5).otherwise(3.5)


def specificity(c) -> Column:
    n = word_count(c)
    return F.when(n <= 2, 1.5).when(n <= 4, 2.5).when(n <= 7, 3.5).when(n <= 12, 4.0).otherwise(4.5)


def hard_negative(c, domain: Column, kind: str) -> Column:
    """Whether a text holds a hard-negative phrase of its domain; unknown domains read as the first one."""
    out = has_any(c, lex.HARD_NEGATIVES[lex.DOMAINS[0]][kind])
    for name in lex.DOMAINS[1:]:
        out = F.when(domain == name, has_any(c, lex.HARD_NEGATIVES[name][kind])).otherwise(out)
    return out


def emphasis_words(c) -> Column:
    """Words that stress: of the list, or written in capitals (a lone I counts)."""
    in_list = lambda w: F.btrim(F.lower(w), F.lit(".,!?")).isin(lex.EMPHASIS_WORDS)
    return F.filter(words(c), lambda w: in_list(w) | ((w == F.upper(w)) & (w != F.lower(w))))


def tone(a: Column) -> Column:
    """struct(tone, confidence) of acoustic features: pitch_variability, energy_variability, speaking_rate_wpm,
    total_pause_seconds, duration_seconds, pause_count and emphasis_count. The first rule that fits decides."""
    pitch, energy, pace, pauses, emphasis = a["pitch_variability"], a["energy_variability"], a["speaking_rate_wpm"], a["pause_count"], a["emphasis_count"]
    ratio = a["total_pause_seconds"] / F.greatest(a["duration_seconds"], F.lit(0.1))
    is_ = lambda name, conf: F.struct(F.lit(name).alias("tone"), conf.cast("double").alias("confidence"))
    return (
        F.when((pitch > 40) & (energy > 0.04) & (pace > 160) & (emphasis > 2), is_("angry", F.least(F.lit(0.9), 0.5 + pitch / 100)))
        .when((pitch > 25) & (ratio > 0.15) & (emphasis > 0), is_("frustrated", F.least(F.lit(0.85), 0.5 + ratio)))
        .when((pitch < 20) & (pace < 120) & (ratio > 0.2), is_("sarcastic", F.least(F.lit(0.75), 0.4 + 0.2 / F.greatest(pitch, F.lit(1.0)) * 10)))
        .when((energy < 0.02) & (pace < 110) & (pauses > 3), is_("sad", F.least(F.lit(0.8), 0.5 + pauses * 0.05)))
        .when((pitch > 35) & (pace > 170) & (energy > 0.03), is_("enthusiastic", F.least(F.lit(0.85), 0.5 + pace / 300)))
        .otherwise(is_("neutral", F.lit(0.6)))
    )


def acoustic_description(a: Column) -> Column:
    """One sentence on tone, pace, emphasis (three strongest words), pauses, pitch and energy."""
    top = F.slice(F.reverse(F.array_sort(F.transform(a["emphasis"], lambda e, i: F.struct(e["energy_ratio"].alias("r"), (-i).alias("i"), e["word"].alias("w"))))), 1, 3)
    named = F.transform(top, lambda e: e["w"])
    seconds = F.format_string("%.1fs", a["longest_pause_seconds"])
    return F.concat(
        F.lit("Audio: "),
        F.concat_ws(
            ", ",
            F.concat(a["tone"], F.lit(" tone")),
            F.when(a["speaking_rate_wpm"] > 180, "rapid pace").when(a["speaking_rate_wpm"] < 100, "slow deliberate pace").otherwise("normal pace"),
            F.when(F.size(named) > 0, F.concat(F.lit("strong emphasis on "), F.array_join(named, ", "))),
            F.when(a["pause_count"] > 3, F.concat(a["pause_count"].cast("string"), F.lit(" pauses (longest "), seconds, F.lit(")"))).when(
                a["longest_pause_seconds"] > 1.0, F.concat(F.lit("notable pause of "), seconds)
            ),
            F.when(a["pitch_variability"] > 50, "highly variable pitch (emotional)").when(a["pitch_variability"] < 15, "flat monotone pitch"),
            F.when(a["energy_variability"] > 0.05, "volume fluctuates significantly"),
        ),
        F.lit("."),
    )


def acoustic_features(a: Column) -> Column:
    """The same features as figures, for a prompt; five emphasis words at most."""
    return F.concat_ws(
        ", ",
        F.format_string("duration=%.1fs", a["duration_seconds"]),
        F.format_string("rate=%.0f wpm", a["speaking_rate_wpm"]),
        F.format_string("pauses=%d (longest %.1fs)", a["pause_count"], a["longest_pause_seconds"]),
        F.format_string("pitch_var=%.1f", a["pitch_variability"]),
        F.format_string("energy_var=%.3f", a["energy_variability"]),
        F.concat(F.lit("emphasis="), F.array_join(F.transform(F.slice(a["emphasis"], 1, 5), lambda e: e["word"]), "/")),
    )
