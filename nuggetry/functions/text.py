"""Tokens, sets and scalar text functions, all as column expressions.

Whitespace is Unicode whitespace, a token is never empty, and sets are arrays without repeats. Where a set is
empty a similarity is 0 unless its docstring says otherwise; null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lex

SPACE = r"(?U)\s+"


def lit_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.expr("cast(array() as array<string>)")


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


# Tokens


def words(c) -> Column:
    """Whitespace-separated words in order."""
    return F.filter(F.split(text(c), SPACE), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def token_set(c) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(words(F.lower(text(c))))


def keywords(c) -> Column:
    """Content words for evidence: longer than two characters as written, lower-cased, stripped of punctuation,
    without the stop words. A word of punctuation only is not a keyword."""
    long = F.filter(words(c), lambda w: F.length(w) > 2)
    bare = F.transform(long, lambda w: F.btrim(F.lower(w), F.lit(lex.EVIDENCE_STRIP)))
    return F.filter(F.array_except(bare, lit_array(lex.EVIDENCE_STOPWORDS)), lambda w: w != "")


def topic_words(c) -> Column:
    """Words for topic shifts between sentences: stop words are tested before punctuation is stripped."""
    kept = F.filter(words(F.lower(text(c))), lambda w: ~w.isin(lex.TOPIC_STOPWORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.btrim(w, F.lit(".,!?"))))


def stem(w: Column) -> Column:
    """The first of the ordered suffixes that leaves more than two characters is taken off."""
    w = F.lower(w)
    out = w
    for suffix in reversed(lex.SUFFIXES):
        cut = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        out = F.when(w.endswith(suffix) & (F.length(w) > len(suffix) + 2), cut).otherwise(out)
    return out


def stems(c) -> Column:
    """Distinct stems of the words of letters, digits and underscores longer than two characters."""
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.array_distinct(F.transform(F.filter(found, lambda w: F.length(w) > 2), stem))


def plain_tokens(c) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]+)"), 1))


def sentences(c) -> Column:
    """Parts between runs of full stops, exclamation and question marks, as they stand; empty ones count."""
    return F.split(text(c), "[.!?]+")


def starts_with_marker(c) -> Column:
    """Whether the text opens with a discourse marker."""
    t = F.btrim(F.lower(text(c)))
    return F.exists(lit_array(lex.DISCOURSE_MARKERS), lambda m: F.startswith(t, m))


def normalised(c) -> Column:
    """Lower case, no outer space, single spaces within."""
    return F.regexp_replace(F.btrim(F.lower(text(c))), SPACE, " ")


def canonical_key(c) -> Column:
    return F.btrim(F.lower(text(c)))


# Similarities of sets


def _share(shared: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(shared).cast("double"), whole.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return _share(F.array_intersect(a, b), F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    """F1 of two token sets."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def intent_match(a, b) -> Column:
    """Jaccard of the tokens that are no stop words; 0 if either side has none."""
    x, y = (F.array_except(token_set(c), lit_array(lex.INTENT_STOPWORDS)) for c in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), jaccard(x, y)).otherwise(0.0)


def overlap_max(a: Column, b: Column) -> Column:
    return _share(F.array_intersect(a, b), F.greatest(F.size(a), F.size(b)))


def overlap_left(a: Column, b: Column) -> Column:
    """Share of ``a`` that is in ``b``."""
    return _share(F.array_intersect(a, b), F.size(a))


def overlap_min(a: Column, b: Column) -> Column:
    return _share(F.array_intersect(a, b), F.least(F.size(a), F.size(b)))


def implicit_faithfulness(suggestion, evidence, complaint) -> Column:
    """0.6 of the suggestion's share in the evidence plus 0.4 of the complaint's share in the suggestion, rounded to 3."""
    stop = lit_array(lex.FAITHFULNESS_STOPWORDS)
    s, e, c = (F.array_except(token_set(x), stop) for x in (suggestion, evidence, complaint))
    topic = F.try_divide(F.size(F.array_intersect(s, e)).cast("double"), F.size(s).cast("double"))
    relevance = F.size(F.array_intersect(s, c)) / F.greatest(F.lit(1), F.size(c)).cast("double")
    return F.when(F.size(s) > 0, F.round(F.least(F.lit(1.0), 0.6 * topic + 0.4 * relevance), 3)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def span_f1(a: Column, b: Column) -> Column:
    """F1 of the characters that two lists of spans (struct start, end; end exclusive) cover; two empty ones agree."""
    chars = lambda s: F.array_distinct(F.flatten(F.transform(F.filter(s, lambda x: x["end"] > x["start"]), lambda x: F.sequence(x["start"], x["end"] - 1))))
    x, y = chars(a), chars(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(dice(x, y))


# Spans


def locate_words(sentence, found: Column) -> Column:
    """The part of a sentence around the words in ``found`` (bare, lower-cased): struct of offset and text.

    One word of margin on either side; the whole sentence where no word is found or the hits spread over more
    than 0.6 of its words.
    """
    w = words(sentence)
    at = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(found, F.btrim(F.lower(x), F.lit(lex.EVIDENCE_STRIP))), i)), lambda i: i.isNotNull())
    first, last = F.array_min(at), F.array_max(at)
    begin = F.greatest(F.lit(0), first - 1)
    part = F.array_join(F.slice(w, begin + 1, F.least(F.size(w), last + 2) - begin), " ")
    before = F.when(begin > 0, F.length(F.array_join(F.slice(w, F.lit(1), begin), " ")) + 1).otherwise(0)
    whole = F.struct(F.lit(0).alias("offset"), text(sentence).alias("text"))
    narrow = F.struct(before.alias("offset"), part.alias("text"))
    return F.when((F.size(at) == 0) | (last - first > 0.6 * F.size(w)), whole).otherwise(narrow)


def sentence_index(position: Column, sents: Column) -> Column:
    """Index of the first sentence (struct with start and end, both inclusive) that holds a position, 0 if none does."""
    return F.greatest(F.array_position(F.transform(sents, lambda s: (s["start"] <= position) & (position <= s["end"])), True) - 1, F.lit(0)).cast("int")


def split_action(c) -> Column:
    """struct(verb, target): the first word if it is an action verb, else the first such word anywhere, and what follows;
    without one an empty verb and the whole text."""
    w = words(c)
    at = F.array_position(F.transform(w, lambda x: F.rtrim(F.lower(x), F.lit(",.:;")).isin(lex.SPLIT_VERBS)), True).cast("int")
    rest = F.array_join(F.slice(w, at + 1, F.greatest(F.size(w), F.lit(1))), " ")
    found = F.struct(F.element_at(w, F.greatest(at, F.lit(1))).alias("verb"), rest.alias("target"))
    none = F.struct(F.lit("").alias("verb"), F.when(F.size(w) > 0, text(c)).otherwise("").alias("target"))
    return F.when(F.size(w) == 0, none).when(at > 0, F.when(F.size(w) > 0, found)).otherwise(none)


def inference_chain(complaint, fix, modality: Column, image) -> Column:
    image = F.col(image) if isinstance(image, str) else image
    seen = F.when((modality == "image") & (F.coalesce(image, F.lit("")) != ""), F.concat(F.lit("Image evidence: '"), image, F.lit("'")))
    seen = F.when(modality == "cross_modal", F.lit("Cross-modal signal: text + image combine to reveal issue")).otherwise(seen)
    return F.concat_ws(" → ", F.concat(F.lit("User complaint: '"), text(complaint), F.lit("'")), seen, F.concat(F.lit("Inferred fix: '"), text(fix), F.lit("'")))


def short_id(c) -> Column:
    return F.substring(F.md5(text(c).cast("binary")), 1, 8)


def complaint(original, frame: Column) -> Column:
    """The complaint frame unless it says nothing, else the first sentence with a complaint marker, else the first 200 characters."""
    sents = F.split(text(original), r"\.")
    marked = F.filter(sents, lambda s: F.exists(lit_array(lex.COMPLAINT_MARKERS), lambda m: F.contains(F.lower(s), m)))
    given = F.when(~F.coalesce(frame, F.lit("")).isin("", "null", "none"), frame)
    return F.coalesce(given, F.btrim(F.try_element_at(marked, F.lit(1))), F.substring(text(original), 1, 200))


# JSON


def json_object(c) -> Column:
    """The first JSON object of a model's reply as text, null without a valid one.

    Fences are taken off; the widest brace pair is tried, then the whole, then the first balanced object, then
    a list of bare suggestion objects. Braces are balanced by a fold over the characters.
    """
    raw = F.regexp_replace(F.regexp_replace(F.btrim(text(c)), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    valid = lambda s: F.when(_is_object(s), s)
    wide = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    fold = F.aggregate(
        F.split(raw, ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("from"), F.lit(0).alias("to")),
        lambda s, ch: F.struct(
            (s["at"] + 1).alias("at"),
            (s["depth"] + F.when(ch == "{", 1).when((ch == "}") & (s["depth"] > 0), -1).otherwise(0)).alias("depth"),
            F.when((s["from"] == 0) & (ch == "{"), s["at"] + 1).otherwise(s["from"]).alias("from"),
            F.when((s["to"] == 0) & (ch == "}") & (s["depth"] == 1), s["at"] + 1).otherwise(s["to"]).alias("to"),
        ),
    )
    balanced = F.when(fold["to"] > 0, F.substring(raw, fold["from"], fold["to"] - fold["from"] + 1))
    parts = F.filter(F.regexp_extract_all(raw, F.lit(r'(\{"text":\s*"[^"]+",\s*"confidence":[^}]+\})'), 1), _is_object)
    listed = F.when(F.size(parts) > 0, F.concat(F.lit('{"suggestions": ['), F.array_join(parts, ", "), F.lit("]}")))
    return F.coalesce(valid(wide), valid(raw), valid(balanced), listed)


def _is_object(s: Column) -> Column:
    """Whether a string is one JSON object and nothing else; the parser alone would let something follow it."""
    v = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    return F.coalesce(v.cast("string").startswith("[{"), F.lit(False)) & F.try_variant_get(v, "$[1]", "string").isNull()


def flat_json(c, field: str) -> Column:
    """A field of the first brace pair without nesting, as text."""
    return F.get_json_object(F.regexp_extract(text(c), r"\{[^}]+\}", 0), f"$.{field}")


# Record fields


def parse_bool(c) -> Column:
    """true, 1, 1.0 and yes in any case are true; everything else, null included, is false."""
    return F.lower(F.btrim(text(c))).isin(lex.TRUE_WORDS)


def without_sentinel(c) -> Column:
    """Trimmed text; spellings of a missing value become empty."""
    t = F.btrim(text(c))
    return F.when(t.isin(lex.NULL_SENTINELS), "").otherwise(t)


def multimodal_context(image, audio) -> Column:
    part = lambda name, c: F.when(without_sentinel(c) != "", F.concat(F.lit(f"{name}: "), without_sentinel(c)))
    return F.concat_ws(" | ", part("Image", image), part("Audio", audio))


def audio_hint(context) -> Column:
    """Whether a context speaks of sound: any of the hint words as a substring."""
    t = F.lower(text(context))
    return ~text(context).isin("", "—") & F.exists(lit_array(lex.AUDIO_HINTS), lambda h: F.contains(t, h))


def audio_description(context) -> Column:
    """What follows the first ``Audio:`` (or ``audio:``) up to a second one, else the whole context; null without a hint."""
    t = text(context)
    after = lambda mark: F.btrim(F.element_at(F.split(t, mark), 2))
    return F.when(audio_hint(context), F.when(F.contains(t, F.lit("Audio:")), after("Audio:")).when(F.contains(t, F.lit("audio:")), after("audio:")).otherwise(t))


def known_domain(c) -> Column:
    d = F.col(c) if isinstance(c, str) else c
    return F.when(d.isin(lex.DOMAINS), d).otherwise(lex.DOMAINS[0])


def segment_weight(c) -> Column:
    s = F.col(c) if isinstance(c, str) else c
    out = F.lit(lex.SEGMENT_WEIGHTS["regular"])
    for name, w in lex.SEGMENT_WEIGHTS.items():
        out = F.when(s == name, w).otherwise(out)
    return out


def switch_mode(alignment: Column, tau: Column | float = 0.6, zero_as_common: bool = False) -> Column:
    """COMMON from ``tau`` on, else SPECIFIC; a missing alignment is COMMON. ``zero_as_common`` treats 0 as missing."""
    a = F.nullif(alignment, F.lit(0.0)) if zero_as_common else alignment
    return F.when(F.coalesce(a, F.lit(1.0)) >= tau, "COMMON").otherwise("SPECIFIC")


def mime_type(path) -> Column:
    """By the extension; JPEG where it is unknown."""
    ext = F.lower(F.regexp_extract(text(path), r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in lex.IMAGE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("image/jpeg"))
