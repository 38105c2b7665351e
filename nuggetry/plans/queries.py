"""The registered queries of the operators, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import rules, text
from ..operators import bootstrap, clusters, cosine, evidence, matching, memory, metrics, ml, ranking, routing, similarity
from ..sources import media, readers, sinks
from ..sources.work import fresh, positions, settle, spread
from ..streaming import memory as streaming
from . import evaluation, fixtures, pipeline
from .providers import BANDS, BASELINES, ModelProvider, RuleProvider, sentence_kind, split_sentences, with_topics, zero_shot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under the function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


# SQL fragments that mirror the column functions


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qlist(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def s_words(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '\\s+'), lambda w: w <> '')"


def s_set(c: str) -> str:
    return f"list_distinct({s_words(f'lower(coalesce({c}, {q(str())}))')})"


def s_minus(a: str, words) -> str:
    return f"list_filter({a}, lambda w: NOT list_contains({qlist(words)}, w))"


def s_inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def s_ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"


def s_jaccard(a: str, b: str) -> str:
    return s_ratio(s_inter(a, b), f"len(list_distinct(list_concat({a}, {b})))")


def s_dice(a: str, b: str) -> str:
    return s_ratio(f"2.0 * {s_inter(a, b)}", f"len({a}) + len({b})")


def s_stem(w: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{x}') AND length({w}) > {len(x) + 2} THEN left({w}, length({w}) - {len(x)})" for x in lex.SUFFIXES) + f" ELSE {w} END"


def s_stems(c: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2), lambda w: {s_stem('w')}))"


def s_any(c: str, words) -> str:
    return f"regexp_matches(lower(coalesce({c}, '')), {q(rules.any_of(words))})"


def s_count(c: str, words) -> str:
    return f"len(list_filter({qlist(words)}, lambda w: contains(lower(coalesce({c}, '')), w)))"


def s_keywords(c: str) -> str:
    bare = f"list_transform(list_filter({s_words(c)}, lambda w: length(w) > 2), lambda w: trim(lower(w), {q(lex.EVIDENCE_STRIP)}))"
    return f"list_filter(list_distinct({bare}), lambda w: w <> '' AND NOT list_contains({qlist(lex.EVIDENCE_STOPWORDS)}, w))"


def s_act(c: str) -> str:
    w = s_words(f"lower({c})")
    rest = f"list_filter(list_distinct({w}), lambda x: NOT list_contains({qlist(lex.GATE_VERBS + lex.GATE_STOPWORDS)}, x))"
    return (
        f"least(5.0, round(1.0 + CASE WHEN list_contains({qlist(lex.GATE_VERBS)}, rtrim(({w})[1], '.,!')) THEN 1.5 ELSE 0 END + CASE WHEN len({rest}) >= 2 THEN 1.0 ELSE 0 END"
        f" + CASE WHEN {s_any(c, lex.SPECIFIC_NOUNS)} THEN 1.0 ELSE 0 END + CASE WHEN len({w}) >= 4 THEN 0.5 ELSE 0 END, 1))::DOUBLE"
    )


def s_feas(c: str) -> str:
    return f"(CASE WHEN {s_any(c, lex.INFEASIBLE)} THEN 1.5 WHEN {s_any(c, lex.STANDARD_FEATURES)} THEN 4.5 ELSE 3.5 END)::DOUBLE"


def s_spec(c: str) -> str:
    n = f"len({s_words(c)})"
    return f"(CASE WHEN {n} <= 2 THEN 1.5 WHEN {n} <= 4 THEN 2.5 WHEN {n} <= 7 THEN 3.5 WHEN {n} <= 12 THEN 4.0 ELSE 4.5 END)::DOUBLE"


def s_prf(tp: str, fp: str, fn: str, tn: str) -> str:
    d = lambda x: f"({x})::DOUBLE"
    den = f"sqrt({d(f'{tp}+{fp}')} * {d(f'{tp}+{fn}')} * {d(f'{tn}+{fp}')} * {d(f'{tn}+{fn}')})"
    return (
        f"{s_ratio(tp, f'{tp}+{fp}')} AS precision, {s_ratio(tp, f'{tp}+{fn}')} AS recall, {s_ratio(f'2*{tp}', f'2*{tp}+{fp}+{fn}')} AS f1, "
        f"CASE WHEN {den} = 0 THEN 0 ELSE ({d(tp)} * {d(tn)} - {d(fp)} * {d(fn)}) / {den} END AS mcc, {s_ratio(f'{tp}+{tn}', f'{tp}+{fp}+{fn}+{tn}')} AS accuracy, "
        f"({s_ratio(tp, f'{tp}+{fn}')} + {s_ratio(tn, f'{tn}+{fp}')}) / 2 AS balanced_accuracy"
    )


# Tokens and scalars


@query(f"SELECT doc_id, len({s_words('text')})::INT AS word_count, len({s_set('text')})::INT AS n_tokens, trim(lower(text)) = trim(lower(trim(text))) AS same_key FROM documents")
def token_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count("text").alias("word_count"), F.size(text.token_set("text")).alias("n_tokens"), (text.canonical_key("text") == text.canonical_key(F.btrim("text"))).alias("same_key"))


@query(f"SELECT doc_id, md5(array_to_string(list_sort({s_keywords('text')}), ' ')) AS keywords, md5(array_to_string(list_sort({s_stems('text')}), ' ')) AS stems, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INT AS n_plain FROM documents")
def keyword_sets(spark, d):
    joined = lambda a: F.md5(F.array_join(F.array_sort(a), " ").cast("binary"))
    return table(spark, d, "documents").select("doc_id", joined(text.keywords("text")).alias("keywords"), joined(text.stems("text")).alias("stems"), F.size(text.plain_tokens("text")).alias("n_plain"))


_TURNS = "t AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _turns(spark, d):
    c = table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return c.select("conv_id", "turn", F.col("text").alias("x")).join(b, ["conv_id", "turn"])


_ix, _iy = s_minus(s_set("x"), lex.INTENT_STOPWORDS), s_minus(s_set("y"), lex.INTENT_STOPWORDS)


@query(f"""WITH {_TURNS} SELECT conv_id, turn, {s_jaccard(s_set('x'), s_set('y'))} AS jaccard, {s_dice(s_set('x'), s_set('y'))} AS dice,
  {s_ratio(s_inter(s_set('x'), s_set('y')), f"greatest(len({s_set('x')}), len({s_set('y')}))")} AS overlap_max, {s_ratio(s_inter(s_set('x'), s_set('y')), f"len({s_set('x')})")} AS overlap_left,
  {s_ratio(s_inter(s_stems('x'), s_stems('y')), f"least(len({s_stems('x')}), len({s_stems('y')}))")} AS stem_overlap,
  CASE WHEN len({_ix}) > 0 AND len({_iy}) > 0 THEN {s_jaccard(_ix, _iy)} ELSE 0.0 END AS intent FROM t""")
def turn_similarities(spark, d):
    x, y = text.token_set("x"), text.token_set("y")
    return _turns(spark, d).select(
        "conv_id", "turn", text.jaccard(x, y).alias("jaccard"), text.dice(x, y).alias("dice"), text.overlap_max(x, y).alias("overlap_max"), text.overlap_left(x, y).alias("overlap_left"),
        text.overlap_min(text.stems("x"), text.stems("y")).alias("stem_overlap"), text.intent_match("x", "y").alias("intent"),
    )


@query(f"""SELECT conv_id, turn, list_bool_or(list_transform({qlist(lex.DISCOURSE_MARKERS + ['the '])}, lambda m: starts_with(trim(lower(text)), m))) AS marked,
  md5(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS normal, substr(md5(text), 1, 8) AS short_id, len(string_split_regex(text, '[.!?]+'))::INT AS n_sentences FROM conversations""")
def turn_scalars(spark, d):
    t = F.btrim(F.lower("text"))
    marked = text.starts_with_marker("text") | F.startswith(t, F.lit("the "))
    return table(spark, d, "conversations").select("conv_id", "turn", marked.alias("marked"), F.md5(text.normalised("text").cast("binary")).alias("normal"), text.short_id("text").alias("short_id"), F.size(text.sentences("text")).alias("n_sentences"))


@query("""SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))
  > 0.1 AS near FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", (text.cosine(F.col("embedding"), F.col("other")) > 0.1).alias("near"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
  p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(q.v, e.v) AS c FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) SELECT query_id, pos::INT AS pos, id, round(c, 9) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS pos FROM p) WHERE pos <= 10""")
def cosine_topk(spark, d):
    """The ten nearest of every hundredth vector, among all."""
    e = table(spark, d, "embeddings")
    return cosine.cosine_topk(e.where("vec_id % 100 = 0"), e, 10, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 9))


_SPANS = """p AS (SELECT conv_id, turn, (turn * 7) % 20 AS s1, (turn * 7) % 20 + length(text) % 15 AS e1, (turn * 11) % 20 AS s2, (turn * 11) % 20 + length(text) % 9 AS e2 FROM conversations)"""


@query(f"""WITH {_SPANS}, r AS (SELECT *, greatest(0, least(e1, e2) - greatest(s1, s2)) AS shared FROM p)
  SELECT conv_id, turn, CASE WHEN e1 = s1 AND e2 = s2 THEN 1.0 ELSE {s_ratio('2.0 * shared', '(e1 - s1) + (e2 - s2)')} END AS span_f1 FROM r""")
def span_agreement(spark, d):
    one = lambda k, m: F.array(F.struct(((F.col("turn") * k) % 20).alias("start"), ((F.col("turn") * k) % 20 + F.length("text") % m).alias("end")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.span_f1(one(7, 15), one(11, 9)).alias("span_f1"))


@query("SELECT event_id, CAST(props->>'k' AS INT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", text.flat_json("props", "k").cast("int").alias("k"))


#: Replies of a model in several states, about each document, and what the rule makes of them: fences off, the widest object, the
#: first balanced one, bare suggestions.
_REPLY = {
    0: (["```json\n", 1, "\n```"], [1]),
    1: (["Sure! ", 1, " Done."], [1]),
    2: (["no json about ", 0], None),
    3: ([1, " and ", 2], [1]),
    4: ([""], None),
    5: (['broken {"x": [ ', 3, " , ", 4], ['{"suggestions": [', 3, ", ", 4, "]}"]),
}
_PIECES = {0: ["", "lang"], 1: ['{"a": {"b": ', "doc_id", "}}"], 2: ['{"c": ', "n_chars", "}"], 3: ['{"text": "Add ', "source", '", "confidence": 0.9}'], 4: ['{"text": "Fix ', "doc_id", '", "confidence": 0.5}']}
_COLUMNS = ("doc_id", "n_chars", "lang", "source")


def _flat(parts: list) -> list[str]:
    return [x for p in parts for x in (_PIECES[p] if isinstance(p, int) else [p])]


def _s_joined(parts: list | None) -> str:
    return "NULL" if parts is None else " || ".join(f"{x}::VARCHAR" if x in _COLUMNS else q(x) for x in _flat(parts))


@query(f"SELECT doc_id, CASE doc_id % 6 {' '.join(f'WHEN {k} THEN {_s_joined(want)}' for k, (_, want) in _REPLY.items())} END AS json FROM documents")
def json_replies(spark, d):
    docs, reply = table(spark, d, "documents"), F.lit(None).cast("string")
    for k, (said, _) in _REPLY.items():
        parts = [F.col(x).cast("string") if x in _COLUMNS else F.lit(x) for x in _flat(said)]
        reply = F.when(F.col("doc_id") % 6 == k, F.concat(*parts)).otherwise(reply)
    return docs.select("doc_id", text.json_object(reply).alias("json"))


_RECORD = """r AS (SELECT conv_id, turn, role, text, CASE turn % 5 WHEN 0 THEN 'nan' WHEN 1 THEN ' Image of it ' WHEN 2 THEN '—' WHEN 3 THEN '' END AS img,
  CASE turn % 3 WHEN 0 THEN 'flat tone' WHEN 1 THEN 'None' END AS aud, CASE turn % 4 WHEN 0 THEN 'True' WHEN 1 THEN '1.0' WHEN 2 THEN 'no' END AS flag, (turn % 10) / 10.0 AS alignment FROM conversations)"""


@query(f"""WITH {_RECORD}, c AS (SELECT *, CASE WHEN trim(coalesce(img, '')) IN ('', 'nan', 'None', '—') THEN '' ELSE trim(img) END AS i, CASE WHEN trim(coalesce(aud, '')) IN ('', 'nan', 'None', '—') THEN '' ELSE trim(aud) END AS a FROM r)
  SELECT conv_id, turn, concat_ws(' | ', CASE WHEN i <> '' THEN 'Image: ' || i END, CASE WHEN a <> '' THEN 'Audio: ' || a END) AS context, lower(trim(coalesce(flag, ''))) IN ('true', '1', '1.0', 'yes') AS flag,
  CASE WHEN alignment >= 0.6 THEN 'COMMON' ELSE 'SPECIFIC' END AS mode, CASE WHEN alignment >= 0.6 OR alignment = 0 THEN 'COMMON' ELSE 'SPECIFIC' END AS legacy_mode,
  CASE role WHEN 'user' THEN 0.9 WHEN 'system' THEN 0.5 ELSE 0.7 END AS weight, 'tech_software' AS domain FROM c""")
def record_fields(spark, d):
    t = F.col("turn")
    c = table(spark, d, "conversations").withColumns(
        {
            "img": F.when(t % 5 == 0, "nan").when(t % 5 == 1, " Image of it ").when(t % 5 == 2, "—").when(t % 5 == 3, ""),
            "aud": F.when(t % 3 == 0, "flat tone").when(t % 3 == 1, "None"),
            "flag": F.when(t % 4 == 0, "True").when(t % 4 == 1, "1.0").when(t % 4 == 2, "no"),
            "alignment": (t % 10) / 10.0,
        }
    )
    segment = F.when(F.col("role") == "user", "power_user").when(F.col("role") == "system", "casual").otherwise("other")
    return c.select(
        "conv_id", "turn", text.multimodal_context("img", "aud").alias("context"), text.parse_bool("flag").alias("flag"), text.switch_mode(F.col("alignment")).alias("mode"), text.switch_mode(F.col("alignment"), zero_as_common=True).alias("legacy_mode"),
        text.segment_weight(segment).alias("weight"), text.known_domain("role").alias("domain"),
    )


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Audio: ' || text WHEN 1 THEN 'Image: x | audio: calm' WHEN 2 THEN 'a stone wall' ELSE '—' END AS mc FROM conversations)
  SELECT conv_id, turn, CASE WHEN mc <> '—' AND regexp_matches(lower(mc), 'audio:|tone|voice|frustrated|monotone|sarcastic|emphatic|resigned|agitated|disappointed') THEN CASE WHEN contains(mc, 'Audio:') THEN md5(trim(string_split(mc, 'Audio:')[2]))
  WHEN contains(mc, 'audio:') THEN md5(trim(string_split(mc, 'audio:')[2])) ELSE md5(mc) END END AS described FROM c""")
def audio_hints(spark, d):
    t = F.col("turn") % 4
    c = table(spark, d, "conversations").withColumn("mc", F.when(t == 0, F.concat(F.lit("Audio: "), "text")).when(t == 1, "Image: x | audio: calm").when(t == 2, "a stone wall").otherwise("—"))
    return c.select("conv_id", "turn", F.md5(text.audio_description("mc").cast("binary")).alias("described"))


# Rules


_TEXTS = f"""{fixtures.values(*fixtures.numbered(fixtures.TEXTS, fixtures.TEXT_COLUMNS), "fixed")},
  t AS (SELECT conv_id * 1000 + turn AS id, fixed.text || CASE WHEN turn % 2 = 1 THEN ' ' || c.text ELSE '' END AS text, domain FROM conversations c JOIN fixed ON i = (conv_id + turn) % {len(fixtures.TEXTS)})"""


def _texts(spark, d):
    """Our sentences dealt to the turns, before the words of every second one."""
    c = table(spark, d, "conversations").withColumnRenamed("text", "said")
    out = fixtures.dealt(c, F.col("conv_id") + F.col("turn"), fixtures.TEXTS, fixtures.TEXT_COLUMNS)
    said = F.concat("text", F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" "), "said")).otherwise(""))
    return out.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), said.alias("text"), "domain")


_ROLE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), {q('|'.join(p))}) THEN '{r}'" for r, p in lex.ROLE_PATTERNS.items()) + f" ELSE '{lex.DEFAULT_ROLE}' END"
_RULE = f"({s_any('text', lex.SUGGESTION_CUES)} OR regexp_matches(lower(coalesce(text, '')), {q('|'.join(lex.IMPLICIT_COMPLAINTS))}))"


def _hard(kind: str) -> str:
    return f"CASE WHEN domain = 'restaurant' THEN {s_any('text', lex.HARD_NEGATIVES['restaurant'][kind])} ELSE {s_any('text', lex.HARD_NEGATIVES['tech_software'][kind])} END AS {kind}"


@query(f"""WITH {_TEXTS} SELECT id, {_RULE} AS rule, {s_any('text', lex.SUGGESTION_CUES)} OR {s_any('text', lex.NEGATIVE_WORDS)} AS cue_or_negative, {_ROLE_CASE} AS role, {', '.join(_hard(k) for k in lex.HARD_NEGATIVES['restaurant'])} FROM t""")
def rule_detect_fixture(spark, d):
    t = _texts(spark, d)
    return t.select("id", rules.rule_detect("text").alias("rule"), rules.cue_or_sentiment("text").alias("cue_or_negative"), rules.span_role("text").alias("role"), *[rules.hard_negative("text", F.col("domain"), k).alias(k) for k in lex.HARD_NEGATIVES["restaurant"]])


_NATIVE = ["the", "and", "of", "with", "der", "que"]


@query(f"SELECT doc_id, {_RULE} AS rule, {s_any('text', lex.SUGGESTION_CUES)} OR {s_any('text', lex.NEGATIVE_WORDS)} AS cue_or_negative, {s_count('text', _NATIVE)}::INT AS native, {_ROLE_CASE} AS role FROM documents")
def rule_detect_docs(spark, d):
    t = table(spark, d, "documents").withColumn("_hits", rules.SCAN.hits("text"))
    found = rules.detection("text", F.col("_hits"))
    return t.select("doc_id", *[c.alias(k) for k, c in found.items()], rules.n_of("text", _NATIVE).alias("native"))


@query(f"""WITH {_TEXTS}, s AS (SELECT id, unnest(string_split_regex(text, '[.!?]+')) AS part, generate_subscripts(string_split_regex(text, '[.!?]+'), 1) AS i FROM t)
  SELECT id, trim(part) AS best FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {s_count('part', lex.SENTENCE_KEYWORDS)} DESC, i) AS n FROM s) WHERE n = 1""")
def best_sentence(spark, d):
    return _texts(spark, d).select("id", rules.best_sentence("text").alias("best"))


_TONES = [
    ("angry", "p > 40 AND e > 0.04 AND w > 160 AND k > 2", "least(0.9, 0.5 + p / 100)"), ("frustrated", "p > 25 AND r > 0.15 AND k > 0", "least(0.85, 0.5 + r)"), ("sarcastic", "p < 20 AND w < 120 AND r > 0.2", "least(0.75, 0.4 + 0.2 / greatest(p, 1.0) * 10)"),
    ("sad", "e < 0.02 AND w < 110 AND n > 3", "least(0.8, 0.5 + n * 0.05)"), ("enthusiastic", "p > 35 AND w > 170 AND e > 0.03", "least(0.85, 0.5 + w / 300)"),
]
_TONE_SQL = f"""SELECT l_orderkey, l_linenumber, CASE {' '.join(f"WHEN {when} THEN '{name}'" for name, when, _ in _TONES)} ELSE 'neutral' END AS tone, round((CASE {' '.join(f"WHEN {when} THEN {sure}" for _, when, sure in _TONES)} ELSE 0.6 END)::DOUBLE, 9) AS confidence FROM
  (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS p, l_discount::DOUBLE AS e, (l_partkey % 200)::DOUBLE AS w, l_linenumber::DOUBLE AS n, l_suppkey % 4 AS k, (l_linenumber * 1.0)::DOUBLE / greatest((l_orderkey % 20)::DOUBLE, 0.1) AS r FROM lineitem)"""


@query(_TONE_SQL)
def acoustic_tone(spark, d):
    a = F.struct(
        F.col("l_quantity").cast("double").alias("pitch_variability"), F.col("l_discount").cast("double").alias("energy_variability"), (F.col("l_partkey") % 200).cast("double").alias("speaking_rate_wpm"), F.col("l_linenumber").cast("double").alias("total_pause_seconds"),
        (F.col("l_orderkey") % 20).cast("double").alias("duration_seconds"), F.col("l_linenumber").alias("pause_count"), (F.col("l_suppkey") % 4).alias("emphasis_count"),
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.tone(a)["tone"].alias("tone"), F.round(rules.tone(a)["confidence"], 9).alias("confidence"))


# Routing


_SUGG = f"""{fixtures.values(*fixtures.numbered(fixtures.SUGGESTIONS, fixtures.SUGGESTION_COLUMNS), "fixed")},
  f AS (SELECT fixed.* REPLACE (conv_id || '-' || sample_id AS sample_id, turn || suggestion_id AS suggestion_id, original_text || CASE WHEN turn % 2 = 1 THEN ' ' || c.text ELSE '' END AS original_text) FROM conversations c JOIN fixed ON i = (conv_id + 5 * turn) % {len(fixtures.SUGGESTIONS)})"""


def _suggestions(spark, d):
    """Our suggestions dealt to the turns; their review goes on in the words of every second one."""
    c = table(spark, d, "conversations").withColumnRenamed("text", "said")
    out = fixtures.dealt(c, F.col("conv_id") + 5 * F.col("turn"), fixtures.SUGGESTIONS, fixtures.SUGGESTION_COLUMNS)
    more = F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" "), "said")).otherwise("")
    names = {"sample_id": F.concat_ws("-", "conv_id", "sample_id"), "suggestion_id": F.concat(F.col("turn").cast("string"), "suggestion_id"), "original_text": F.concat("original_text", more)}
    return out.withColumns(names).select(*[c.split()[0] for c in fixtures.SUGGESTION_COLUMNS.split(", ")])


_EXP = f"(2.0 * {s_count('text', lex.EXPLICIT_STRONG)} + {s_count('text', lex.EXPLICIT_MODERATE)})"
_IMP = "(1.5 * (" + " + ".join(s_count("text", s) for s in lex.IMPLICIT_SIGNALS.values()) + "))"
_TYPE = f"""CASE WHEN source_modality IN ('image', 'audio', 'cross_modal') THEN 'implicit' WHEN speech_act = 'sarcasm' OR tone IN ('sarcastic', 'ironic') THEN 'implicit' WHEN NOT is_implied AND confidence >= 0.8 AND {_EXP} > 0 THEN 'explicit'
  WHEN is_implied THEN 'implicit' WHEN {_EXP} > 0 AND {_IMP} = 0 THEN 'explicit' WHEN {_IMP} > 0 AND {_EXP} = 0 THEN 'implicit' WHEN {_EXP} > 0 AND {_IMP} > 0 THEN 'ambiguous' WHEN confidence >= 0.8 THEN 'explicit' ELSE 'implicit' END"""
_STOP = qlist(lex.FAITHFULNESS_STOPWORDS)


def _without_stop(c: str) -> str:
    return s_minus(s_set(c), lex.FAITHFULNESS_STOPWORDS)


_ROUTE = f"""
c AS (SELECT *, {_TYPE} AS classified_type, {s_words('text')} AS w, list_position(list_transform({s_words('text')}, lambda x: list_contains({qlist(lex.SPLIT_VERBS)}, rtrim(lower(x), ',.:;'))), true) AS pos1,
  CASE WHEN coalesce(complaint_frame, '') NOT IN ('', 'null', 'none') THEN complaint_frame ELSE coalesce(trim(list_filter(string_split(original_text, '.'), lambda s: len(list_filter({qlist(lex.COMPLAINT_MARKERS)}, lambda m: contains(lower(s), m))) > 0)[1]),
  substr(original_text, 1, 200)) END AS said, concat_ws(' ', original_text, nullif(image_context, ''), nullif(audio_context, '')) AS ev FROM f),
g AS (SELECT *, round({s_ratio(s_inter(s_set('text'), s_set('original_text')), f"len({s_set('text')})")}, 3) AS e_faith, CASE WHEN pos1 > 0 THEN w[pos1] ELSE '' END AS verb,
  CASE WHEN len(w) = 0 THEN '' WHEN pos1 > 0 THEN array_to_string(w[pos1 + 1:], ' ') ELSE text END AS target,
  {s_act('text')} AS act, {s_feas('text')} AS feas, {s_spec('text')} AS spec, CASE WHEN len({_without_stop('text')}) > 0 THEN round(least(1.0, 0.6 * ({s_inter(_without_stop('text'), _without_stop('ev'))}::DOUBLE / len({_without_stop('text')})::DOUBLE)
  + 0.4 * ({s_inter(_without_stop('text'), _without_stop('said'))} / greatest(1, len({_without_stop('said')}))::DOUBLE)), 3) ELSE 0.0 END AS faith FROM c),
h AS (SELECT *, verb <> '' AND len({s_minus(s_set('target'), lex.TARGET_STOPWORDS + lex.VAGUE_TARGETS)}) >= 1 AS e_act, greatest(0.0, confidence - (CASE WHEN act >= 3 THEN 0.0 ELSE 0.15::DOUBLE END + CASE WHEN feas >= 3 THEN 0.0 ELSE 0.1::DOUBLE END + CASE WHEN spec >= 2.5 THEN 0.0 ELSE 0.1::DOUBLE END
  + CASE WHEN faith >= 0.4 THEN 0.0 ELSE 0.2::DOUBLE END)) AS adj FROM g),
i AS (SELECT *, confidence >= 0.8 AND e_faith >= 0.6 AND e_act AS e_pass, adj >= 0.6 AND act >= 3 AND feas >= 3 AND faith >= 0.4 AS i_pass FROM h),
j AS (SELECT *, CASE WHEN e_pass THEN confidence ELSE confidence * 0.5::DOUBLE END AS e_conf, round(adj, 3) AS i_conf FROM i),
k AS (SELECT *, CASE classified_type WHEN 'explicit' THEN true WHEN 'implicit' THEN false ELSE CASE WHEN e_pass AND NOT i_pass THEN true WHEN i_pass AND NOT e_pass THEN false ELSE e_conf >= i_conf END END AS x FROM j)
"""


@query(f"""WITH {_SUGG}, {_ROUTE} SELECT sample_id, suggestion_id, classified_type, CASE WHEN x THEN 'explicit' ELSE 'implicit' END AS routed_type, CASE WHEN x THEN e_conf ELSE i_conf END AS routed_confidence, CASE WHEN x THEN e_pass ELSE i_pass END AS passed_switch,
  CASE WHEN x THEN e_act ELSE act >= 3 END AS is_actionable, CASE WHEN x THEN e_faith ELSE faith END AS faithfulness_score, CASE WHEN x THEN verb ELSE '' END AS action_verb, CASE WHEN x THEN target ELSE '' END AS action_target, CASE WHEN x THEN 0.0 ELSE act END AS actionability_score,
  CASE WHEN x THEN 0.0 ELSE feas END AS feasibility_score, CASE WHEN x THEN 0.0 ELSE spec END AS specificity_score, CASE WHEN x THEN e_conf * CASE WHEN e_act THEN 1.1::DOUBLE ELSE 0.8::DOUBLE END ELSE i_conf * CASE WHEN i_pass THEN 1.0 ELSE 0.6::DOUBLE END END AS type_adjusted_score FROM k""")
def suggestion_switch(spark, d):
    out = routing.switch(_suggestions(spark, d))
    return out.select(
        "sample_id", "suggestion_id", "classified_type", "routed_type", "routed_confidence", "passed_switch", "is_actionable", "faithfulness_score", "action_verb", "action_target", "actionability_score", "feasibility_score", "specificity_score", "type_adjusted_score"
    )


@query(f"""WITH {_SUGG}, {_ROUTE} SELECT sample_id, count(*) AS total_input, count(*) FILTER (WHERE x) AS explicit_count, count(*) FILTER (WHERE NOT x) AS implicit_count, count(*) FILTER (WHERE CASE WHEN x THEN e_pass ELSE i_pass END) AS passed_count,
  count(*) FILTER (WHERE NOT CASE WHEN x THEN e_pass ELSE i_pass END) AS failed_count FROM k GROUP BY sample_id""")
def switch_summary(spark, d):
    return routing.switch_stats(routing.switch(_suggestions(spark, d)))


@query(f"SELECT conv_id, turn, {s_act('text')} AS actionability, {s_feas('text')} AS feasibility, {s_spec('text')} AS specificity FROM conversations")
def gate_scores(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", rules.actionability("text").alias("actionability"), rules.feasibility("text").alias("feasibility"), rules.specificity("text").alias("specificity"))


_APOS = "chr(39)"


@query(f"""WITH {_SUGG}, {_ROUTE} SELECT sample_id, suggestion_id, CASE WHEN x THEN '' ELSE concat_ws(' → ', 'User complaint: ' || {_APOS} || coalesce(said, '') || {_APOS}, CASE WHEN source_modality = 'cross_modal' THEN 'Cross-modal signal: text + image combine to reveal issue'
  WHEN source_modality = 'image' AND coalesce(image_context, '') <> '' THEN 'Image evidence: ' || {_APOS} || image_context || {_APOS} END, 'Inferred fix: ' || {_APOS} || coalesce(text, '') || {_APOS}) END AS inference_chain FROM k""")
def inference_chains(spark, d):
    return routing.switch(_suggestions(spark, d)).select("sample_id", "suggestion_id", "inference_chain")


# Evidence


def _reviews(spark, d):
    """A review for every conversation: one of ours, which goes on in the words of the first turn."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("said"))
    out = fixtures.dealt(c, F.col("conv_id"), fixtures.REVIEWS, fixtures.REVIEW_COLUMNS)
    names = {"sample_id": F.concat(F.lit("c"), F.col("conv_id").cast("string")), "raw_text": F.concat_ws(" ", "raw_text", "said"), "overall_alignment": F.coalesce("overall_alignment", (F.col("conv_id") % 10) / 10.0)}
    return out.withColumns(names).select(*[c.split()[0] for c in fixtures.REVIEW_COLUMNS.split(", ")])


def _review_parts(spark, d):
    r = settle(_reviews(spark, d), "reviews")
    p = RuleProvider()
    s = settle(p.sentences(r), "sentences")
    labels = p.labels(r, s).select("sample_id", text.short_id("text").alias("suggestion_id"), "text")
    return r, s, labels, settle(p.text_views(r), "views")


@query()
def evidence_rows(spark, d):
    r, s, labels, views = _review_parts(spark, d)
    ev = evidence.text_evidence(labels, r, s, views.select("sample_id", "complaint_frame", "comparison_frame", "request_frame", "confidence"))
    ev = ev.unionByName(evidence.image_evidence(labels, r.select("sample_id", F.lit(0).alias("image_index"), text.without_sentinel("image_description").alias("caption"))))
    ev = ev.unionByName(evidence.audio_evidence(labels, r.select("sample_id", text.without_sentinel("audio_description").alias("transcript"))))
    ev = settle(ev, "evidence")
    return ev.unionByName(evidence.cross_modal_evidence(ev, r.select("sample_id", "overall_alignment")))


@query()
def evidence_summary(spark, d):
    r, s, labels, _ = _review_parts(spark, d)
    return evidence.enrich(labels, evidence_rows(spark, d))


_EVD = f"""s AS (SELECT a.conv_id, a.turn AS s_turn, b.turn AS t_turn, {s_keywords('a.text')} AS k, {s_keywords('b.text')} AS w FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.role = 'user' AND b.role <> 'user')"""


@query(f"""WITH {_EVD}, r AS (SELECT conv_id, s_turn, t_turn, {s_inter('k', 'w')} / greatest(1, len(k))::DOUBLE AS r FROM s)
  SELECT conv_id AS sample_id, s_turn AS suggestion_id, t_turn AS pos, round(least(0.99::DOUBLE, r * 0.7::DOUBLE + 0.5::DOUBLE * 0.3::DOUBLE), 3) AS confidence FROM r WHERE r >= 0.15""")
def evidence_keywords(spark, d):
    c = table(spark, d, "conversations")
    asked = c.where("role = 'user'").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("suggestion_id"), "text")
    sents = c.where("role <> 'user'").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("idx"), "text", F.lit(0).alias("start"), F.lit(0.5).alias("span_confidence"))
    return evidence.keyword_evidence(asked, sents).select("sample_id", "suggestion_id", "pos", "confidence")


_SEGMENTS = r"""p AS (SELECT conv_id || '-' || turn AS sample_id, text AS t, list_filter(list_transform(string_split_regex(regexp_replace(text, ',\s+((?:um|uh|like|so|and)\s)', chr(1) || '\1', 'g'), '[.!?]+\s*|(?:\.{3}|…)\s*|\x01'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM conversations),
  r AS (SELECT sample_id, 0::BIGINT AS k, 0::BIGINT AS c, 0.0::DOUBLE AS t1, NULL::VARCHAR AS s, NULL::BIGINT AS a, NULL::DOUBLE AS t0 FROM p UNION ALL
    SELECT sample_id, k + 1, a + length(s), was + len(string_split_regex(s, '\s+')) / 2.5::DOUBLE, s, a, was FROM (SELECT sample_id, k, parts[k + 1] AS s, r.t1 AS was, c + greatest(strpos(substr(t, c + 1), parts[k + 1]) - 1, 0) AS a FROM r JOIN p USING (sample_id) WHERE k < len(parts)))"""


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT sample_id, (k - 1)::INT AS idx, s AS text, a::INT AS char_start, c::INT AS char_end, round(t0, 1) AS est_start, round(t1, 1) AS est_end FROM r WHERE k > 0")
def transcript_segments(spark, d):
    c = table(spark, d, "conversations")
    return evidence.segments(c.select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), F.col("text").alias("transcript")))


_TOPIC = f"list_distinct(list_transform(list_filter({s_words('lower(text)')}, lambda w: NOT list_contains({qlist(lex.TOPIC_STOPWORDS)}, w)), lambda w: trim(w, '.,!?')))"


@query(f"""WITH w AS (SELECT conv_id, turn, unnest({_TOPIC}) AS w FROM conversations), n AS (SELECT conv_id, w FROM w GROUP BY conv_id, w HAVING count(DISTINCT turn) > 1),
  e AS (SELECT conv_id, turn, count(*) AS n FROM w JOIN n USING (conv_id, w) GROUP BY conv_id, turn)
  SELECT c.conv_id, c.turn, coalesce(e.n, 0)::INT AS n_shared, c.turn > 0 AND (list_bool_or(list_transform({qlist(lex.DISCOURSE_MARKERS)}, lambda m: starts_with(trim(lower(c.text)), m))) OR coalesce(e.n, 0) = 0) AS starts_new_topic
  FROM conversations c LEFT JOIN e USING (conv_id, turn)""")
def topic_shifts(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("idx"), "text")
    return with_topics(c).select(F.col("sample_id").alias("conv_id"), F.col("idx").alias("turn"), F.size("shared_entities").alias("n_shared"), "starts_new_topic")


# Ranking


_FEATURES = """x AS (SELECT doc_id, (doc_id % 9) / 8.0::DOUBLE AS view_agreement_ratio, (doc_id % 4) / 3.0::DOUBLE AS modality_agreement_score, doc_id % 3 = 0 AS semantic_memory_hit, n_chars % 70 AS canonical_frequency, (doc_id % 11) / 10.0::DOUBLE AS past_approval_rate,
  n_chars % 130 AS cluster_size, (doc_id % 7) / 6.0::DOUBLE AS avg_confidence, doc_id % 5 = 0 AS has_urgency_markers, doc_id % 2 = 0 AS is_implied, (doc_id % 6) / 5.0::DOUBLE AS grounding_score, (doc_id % 6)::DOUBLE AS actionability_score, lang FROM documents)"""


def _features(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", "source", ((i % 9) / 8.0).alias("view_agreement_ratio"), ((i % 4) / 3.0).alias("modality_agreement_score"), (i % 3 == 0).alias("semantic_memory_hit"), (F.col("n_chars") % 70).alias("canonical_frequency"), ((i % 11) / 10.0).alias("past_approval_rate"),
        (F.col("n_chars") % 130).alias("cluster_size"), ((i % 7) / 6.0).alias("avg_confidence"), (i % 5 == 0).alias("has_urgency_markers"), (i % 2 == 0).alias("is_implied"), ((i % 6) / 5.0).alias("grounding_score"), (i % 6).cast("double").alias("actionability_score"),
        F.when(F.col("lang") == "en", "explicit").otherwise("implicit").alias("suggestion_type"),
    )


def _log_share(c: str, full: int) -> str:
    return f"CASE WHEN {c} <= 1 THEN 0.0 ELSE least(1.0, ln({c}::DOUBLE) / ln({full}.0::DOUBLE)) END"


_W = {k: f"{v}::DOUBLE" for k, v in lex.SCORER_WEIGHTS.items()}
_SCORE = f"""({_W['view_agreement_ratio']} * view_agreement_ratio + {_W['modality_agreement_score']} * modality_agreement_score + {_W['semantic_memory_hit']} * semantic_memory_hit::INT + {_W['canonical_frequency_norm']} * {_log_share('canonical_frequency', 50)} + {_W['past_approval_rate']} * past_approval_rate
  + {_W['cluster_size_norm']} * {_log_share('cluster_size', 100)} + {_W['avg_confidence']} * avg_confidence + {_W['has_urgency_markers']} * has_urgency_markers::INT + {_W['user_segment_importance']} * 0.7::DOUBLE + {_W['modality_alignment']} * 0.5::DOUBLE + {_W['explicit_bonus']} * (NOT is_implied)::INT
  + {_W['grounding_score']} * grounding_score + {_W['actionability_norm']} * (actionability_score / 5.0) + {_W['feasibility_norm']} * (3.0 / 5.0)::DOUBLE + {_W['faithfulness_score']} * 0.5::DOUBLE + {_W['type_bonus']} * (lang = 'en')::INT) / {ranking.MAX_SCORE!r}::DOUBLE * 10"""


@query(f"WITH {_FEATURES} SELECT doc_id, round({_SCORE}, 2) AS score FROM x")
def linear_rank(spark, d):
    f = _features(spark, d)
    return f.select("doc_id", ranking.linear_score(f).alias("score"))


@query(f"""WITH {_FEATURES}, s AS (SELECT doc_id, lang, round({_SCORE}, 2) AS score FROM x), r AS (SELECT s.*, source, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s JOIN documents USING (doc_id))
  SELECT source, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 3""")
def top_by_source(spark, d):
    f = _features(spark, d)
    f = f.withColumn("score", ranking.linear_score(f)).withColumn("sample_id", F.col("source"))
    return ranking.rank(f, tie="doc_id").where("rank <= 3").select("source", "doc_id", "score", "rank")


@query(f"""WITH {_FEATURES}, s AS (SELECT *, round({_SCORE}, 2) AS score FROM x), r AS (SELECT doc_id, list_filter([CASE WHEN score < 6.0 THEN 'low_score' END, CASE WHEN NOT semantic_memory_hit THEN 'novel_suggestion' END, CASE WHEN grounding_score < 0.4 THEN 'low_grounding_faithfulness' END,
  CASE WHEN lang <> 'en' AND actionability_score < 3 THEN 'implicit_low_actionability' END], lambda z: z IS NOT NULL) AS reasons FROM s) SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS needs_review FROM r""")
def review_gate(spark, d):
    f = _features(spark, d)
    f = f.withColumn("score", ranking.linear_score(f)).withColumn("memory_hit", F.col("semantic_memory_hit"))
    return ranking.review_gate(f).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "needs_review")


_LABELS = """l AS (SELECT conv_id AS sample_id, text, CASE WHEN turn % 3 = 0 THEN 0.85 WHEN turn % 3 = 1 THEN 0.55 ELSE 0.42 END::DOUBLE AS confidence, turn % 2 = 1 AS is_implied, CASE WHEN role = 'user' THEN 'text' WHEN turn % 4 = 1 THEN 'image' ELSE 'audio' END AS source_modality FROM conversations),
  c AS (SELECT *, 'conservative' AS labeller FROM l WHERE NOT is_implied AND confidence >= 0.8), b AS (SELECT *, 'liberal' AS labeller FROM l WHERE confidence >= 0.5), m AS (SELECT * FROM c UNION ALL SELECT * FROM b)"""


def _labels(spark, d):
    t = F.col("turn")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("sample_id"), "text", F.when(t % 3 == 0, 0.85).when(t % 3 == 1, 0.55).otherwise(0.42).alias("confidence"), (t % 2 == 1).alias("is_implied"), F.when(F.col("role") == "user", "text").when(t % 4 == 1, "image").otherwise("audio").alias("source_modality")
    )


@query(f"""WITH {_LABELS}, g AS (SELECT sample_id, trim(lower(text)) AS k, max(confidence) AS c, bool_and(is_implied) AS is_implied, count(DISTINCT labeller) AS agents, list_distinct(list(source_modality)) AS mods FROM m GROUP BY ALL),
  h AS (SELECT *, least(1.0, c + CASE WHEN list_contains(mods, 'text') AND list_contains(mods, 'image') THEN CASE WHEN list_contains(mods, 'audio') THEN 0.15 ELSE 0.1 END ELSE 0.0 END::DOUBLE) AS confidence FROM g)
  SELECT sample_id, md5(k) AS key, confidence, is_implied, confidence >= 0.5 AS accepted, agents / 2.0 AS consensus_score FROM h""")
def arbitrate_labels(spark, d):
    l = _labels(spark, d)
    out = ranking.arbitrate(ranking.merge(ranking.conservative(l), ranking.liberal(l)))
    return out.select("sample_id", F.md5(F.col("canonical_key").cast("binary")).alias("key"), "confidence", "is_implied", "accepted", "consensus_score")


@query("SELECT source AS sample_id, md5(trim(lower(text))) AS canonical, count(*) AS frequency, count(DISTINCT text)::INT AS n_forms FROM documents GROUP BY source, trim(lower(text))")
def canonical_forms(spark, d):
    s = table(spark, d, "documents").select(F.col("source").alias("sample_id"), "text", F.lit(0.5).alias("confidence"), F.array(F.lit("text")).alias("supporting_modalities"))
    return ranking.canonicalise(s).select("sample_id", F.md5(F.col("canonical_text").cast("binary")).alias("canonical"), "frequency", F.size("original_forms").alias("n_forms"))


def s_meet(a: str, b: str) -> str:
    """Jaccard of two token lists as a fraction of doubles."""
    return f"len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE"


_MEANING = f"""c AS (SELECT conv_id AS sample_id, trim(lower(text)) AS k, count(*) AS frequency, count(DISTINCT text) AS n_forms, max((turn % 7) / 10.0)::DOUBLE AS confidence, list_distinct(list(role)) AS mods FROM conversations GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (ORDER BY sample_id, k) AS i, {s_set('k')} AS t FROM c), w AS (SELECT sample_id, i, len(t) AS n, unnest(t) AS w FROM n),
  e AS (SELECT a.i AS i, b.i AS j, count(*)::DOUBLE / (max(a.n) + max(b.n) - count(*))::DOUBLE AS s FROM w a JOIN w b ON a.sample_id = b.sample_id AND a.w = b.w AND a.i <> b.i GROUP BY a.i, b.i HAVING count(*)::DOUBLE / (max(a.n) + max(b.n) - count(*))::DOUBLE >= 0.6),
  r AS (SELECT i, i AS root FROM n UNION SELECT e.j, r.root FROM r JOIN e USING (i)), g AS (SELECT i, min(root) AS root FROM r GROUP BY i), v AS (SELECT n.i, round(coalesce(sum(s), 0), 9) AS v FROM n LEFT JOIN e USING (i) GROUP BY n.i)"""


@query(f"""WITH RECURSIVE {_MEANING} SELECT sample_id, md5(first(k ORDER BY v DESC, k)) AS canonical, sum(frequency)::BIGINT AS frequency, sum(n_forms)::INT AS n_forms, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(flatten(list(mods)))), ',') AS modalities, count(*) AS n_merged
  FROM n JOIN g USING (i) JOIN v USING (i) GROUP BY sample_id, root""")
def canonical_groups(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "text", ((F.col("turn") % 7) / 10.0).alias("confidence"), F.array("role").alias("supporting_modalities"))
    out = ranking.canonical_groups(c)
    return out.select("sample_id", F.md5(F.col("canonical_text").cast("binary")).alias("canonical"), "frequency", F.size("original_forms").alias("n_forms"), "confidence", F.array_join("supporting_modalities", ",").alias("modalities"), "n_merged")


# Memory


def s_pairs(a: str, b: str, threshold: float) -> str:
    """Pairs of two token tables (id, t) above a Jaccard threshold, by joining on tokens."""
    return f"""pa AS (SELECT id, len(t) AS n, unnest(t) AS w FROM {a}), pb AS (SELECT id, len(t) AS n, unnest(t) AS w FROM {b}),
      pairs AS (SELECT pa.id AS left_id, pb.id AS right_id, count(*)::DOUBLE / (max(pa.n) + max(pb.n) - count(*))::DOUBLE AS similarity FROM pa JOIN pb USING (w) GROUP BY ALL HAVING count(*)::DOUBLE / (max(pa.n) + max(pb.n) - count(*))::DOUBLE > {threshold})"""


@query(f"""WITH a AS (SELECT item_id AS id, {s_set('text')} AS t FROM benchmark), b AS (SELECT doc_id AS id, {s_set('text')} AS t FROM documents), {s_pairs('a', 'b', 0.1)} SELECT left_id, right_id, similarity FROM pairs""")
def jaccard_neighbours(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.similar_pairs(a, b, 0.1)


@query(f"""WITH a AS (SELECT item_id AS id, {s_set('text')} AS t FROM benchmark), b AS (SELECT DISTINCT text AS id, {s_set('text')} AS t FROM conversations), {s_pairs('a', 'b', 0.05)}
  SELECT left_id AS id, md5(right_id) AS form, similarity, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS pos FROM pairs) WHERE pos <= 3""")
def semantic_topk(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    out = memory.similar_forms(a, table(spark, d, "conversations").select("text"), threshold=0.05)
    return out.select("id", F.md5(F.col("canonical_text").cast("binary")).alias("form"), "similarity", "pos")


_DECIDE = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'accept' ELSE 'reject' END"


@query(f"""WITH a AS (SELECT doc_id AS id, {s_set('text')} AS t FROM documents), {s_pairs('a', 'a', 0.55)}, r AS (SELECT left_id, avg((right_id % 3 = 0)::INT) AS r FROM pairs GROUP BY left_id)
  SELECT doc_id, round(coalesce(r, 0.5), 3) AS past_approval_rate, least(0.99::DOUBLE, round(0.6::DOUBLE + 0.2::DOUBLE * (round(coalesce(r, 0.5), 3) - 0.5::DOUBLE), 3)) AS boosted FROM documents LEFT JOIN r ON left_id = doc_id""")
def approval_rate(spark, d):
    docs = table(spark, d, "documents")
    log = docs.select(F.col("doc_id").alias("decision_id"), "text", F.when(F.col("doc_id") % 3 == 0, "accept").otherwise("reject").alias("decision"))
    out = memory.approval_rate(docs.select(F.col("doc_id").alias("id"), "text"), log)
    return out.select(F.col("id").alias("doc_id"), "past_approval_rate", memory.boosted_confidence(F.lit(0.6), F.col("past_approval_rate")).alias("boosted"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS")
def recent_decisions(spark, d):
    return memory.recent(table(spark, d, "events"), days=10).select("event_id")


@query(f"""SELECT date_trunc('day', ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE {_DECIDE} = 'accept') AS accepted, count(*) FILTER (WHERE {_DECIDE} = 'accept') / count(*)::DOUBLE AS approval_rate FROM events GROUP BY 1""")
def rolling_approval(spark, d):
    e = table(spark, d, "events").select("ts", F.when(F.col("event_type").isin("purchase", "signup"), "accept").otherwise("reject").alias("decision"))
    return streaming.rolling_approval(e).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""WITH m AS (SELECT max(value) AS m FROM events), e AS (SELECT event_id, event_type, user_id % 5 AS domain, value / m AS a, {_DECIDE} AS decision, user_id FROM events, m), q AS (SELECT * FROM e),
  r AS (SELECT q.event_id, count(*) AS n, avg((e.user_id % 2 = 0)::INT) AS r FROM q JOIN e ON q.event_type = e.event_type AND q.domain = e.domain AND abs(e.a - q.a) < 0.02 GROUP BY q.event_id)
  SELECT q.event_id AS id, CASE WHEN n >= 3 THEN round(r, 3) ELSE 0.5 END AS modal_expected_acceptance FROM q LEFT JOIN r USING (event_id)""")
def band_expectation(spark, d):
    e = table(spark, d, "events")
    top = F.broadcast(e.agg(F.max("value").alias("m")))  # one row
    log = e.join(top).select(F.col("event_id").alias("id"), F.col("event_type").alias("dominant_modality"), (F.col("user_id") % 5).alias("domain"), (F.col("value") / F.col("m")).alias("alignment_score"), F.when(F.col("user_id") % 2 == 0, "accept").otherwise("reject").alias("decision"))
    return memory.expected_acceptance(log.drop("decision"), log.drop("id"), band=0.02).select("id", "modal_expected_acceptance")


@query("""SELECT md5(trim(lower(text))) AS pattern, count(*) AS count, count(*) FILTER (WHERE n_chars % 2 = 0) AS accepted_count, count(DISTINCT source)::INT AS domain_count, round(count(*) FILTER (WHERE n_chars % 2 = 0) / count(*)::DOUBLE, 3) AS acceptance_rate,
  least(0.1::DOUBLE, (count(DISTINCT source) - 1) * 0.03::DOUBLE) AS cross_domain_boost FROM documents GROUP BY trim(lower(text))""")
def cross_domain_patterns(spark, d):
    r = table(spark, d, "documents").select("text", F.col("source").alias("domain"), (F.col("n_chars") % 2 == 0).alias("accepted"))
    return memory.patterns(r).select(F.md5(F.col("pattern").cast("binary")).alias("pattern"), "count", "accepted_count", "domain_count", "acceptance_rate", "cross_domain_boost")


_SHARED = f"""a AS (SELECT doc_id AS id, {s_set('text')} AS t FROM documents), {s_pairs('a', 'a', 0.4)}"""


@query(f"""WITH {_SHARED}, r AS (SELECT left_id, round(avg((right_id % 3 = 0)::INT), 3) AS r FROM pairs WHERE similarity > 0.55 GROUP BY left_id), h AS (SELECT left_id, max(similarity) AS h FROM pairs GROUP BY left_id),
  c AS (SELECT left_id, arg_min(right_id, (-similarity, right_id)) AS edit FROM pairs WHERE similarity > 0.75 GROUP BY left_id), p AS (SELECT trim(lower(text)) AS k, count(DISTINCT source) AS n FROM documents GROUP BY 1),
  n AS (SELECT source, (doc_id % 10) AS a, count(*) AS n FROM documents GROUP BY ALL), e AS (SELECT x.source, x.a, sum(y.n) AS n FROM n x JOIN n y ON x.source = y.source AND abs(x.a - y.a) <= 1 GROUP BY ALL)
  SELECT d.doc_id AS id, d.text, 0.6::DOUBLE AS confidence, (d.doc_id % 10) / 10.0::DOUBLE AS alignment_score, 'text' AS dominant_modality, d.source AS domain, coalesce(r, 0.5) AS past_approval_rate, coalesce(h > 0.75, false) AS semantic_memory_hit, coalesce(replace(upper(o.text), 'ẞ', 'SS'), d.text) AS corrected_text,
  coalesce(replace(upper(o.text), 'ẞ', 'SS'), d.text) <> d.text AS is_human_corrected, p.n >= 2 AS cross_domain, least(0.1::DOUBLE, (p.n - 1) * 0.03::DOUBLE) AS cross_domain_boost, CASE WHEN e.n >= 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS modal_expected_acceptance,
  least(0.99::DOUBLE, least(0.99::DOUBLE, round(0.6::DOUBLE + 0.2::DOUBLE * (coalesce(r, 0.5) - 0.5::DOUBLE), 3)) + least(0.1::DOUBLE, (p.n - 1) * 0.03::DOUBLE)) AS boosted_confidence
  FROM documents d LEFT JOIN r ON r.left_id = d.doc_id LEFT JOIN h ON h.left_id = d.doc_id LEFT JOIN c ON c.left_id = d.doc_id LEFT JOIN documents o ON o.doc_id = c.edit JOIN p ON p.k = trim(lower(d.text)) JOIN e ON e.source = d.source AND e.a = d.doc_id % 10""")
def memory_lookup(spark, d):
    docs = table(spark, d, "documents")
    s = docs.select(F.col("doc_id").alias("id"), "text", F.lit(0.6).alias("confidence"), ((F.col("doc_id") % 10) / 10.0).alias("alignment_score"), F.lit("text").alias("dominant_modality"), F.col("source").alias("domain"))
    log = docs.select(F.col("doc_id").alias("decision_id"), "text", F.when(F.col("doc_id") % 3 == 0, "accept").otherwise("reject").alias("decision"), F.timestamp_millis(F.col("doc_id") * 1000).alias("ts"))
    edits = docs.select(F.col("doc_id").alias("edit_id"), F.col("text").alias("original"), F.upper("text").alias("corrected"))
    align = s.select("alignment_score", "dominant_modality", "domain", F.lit("accept").alias("decision"))
    known = memory.patterns(docs.select("text", F.col("source").alias("domain"), F.lit(True).alias("accepted")))
    return memory.lookup(s, log, docs.select("text"), edits, align, known).drop("similar_forms")


@query(f"""WITH a AS (SELECT doc_id AS id, {s_set('text')} AS t FROM documents), {s_pairs('a', 'a', 0.55)}, r AS (SELECT left_id, round(avg((right_id % 3 = 0)::INT), 3) AS r FROM pairs WHERE right_id BETWEEN left_id - 360 AND left_id - 1 GROUP BY left_id)
  SELECT doc_id, coalesce(r, 0.5) AS past_approval_rate FROM documents LEFT JOIN r ON left_id = doc_id""")
def approval_as_of(spark, d):
    """Documents come every six hours; each meets the decisions on those of the 90 days before it."""
    docs = table(spark, d, "documents").withColumn("ts", F.timestamp_seconds(F.col("doc_id") * 21600))
    log = docs.select(F.col("doc_id").alias("decision_id"), "text", F.when(F.col("doc_id") % 3 == 0, "accept").otherwise("reject").alias("decision"), "ts")
    return memory.approval_as_of(docs.select(F.col("doc_id").alias("id"), "text", "ts"), log).select(F.col("id").alias("doc_id"), "past_approval_rate")


@query(f"""WITH a AS (SELECT item_id AS id, {s_set('text')} AS t FROM benchmark), f AS (SELECT DISTINCT text, 0.4 AS least FROM conversations UNION SELECT DISTINCT text, 0.0 FROM documents), b AS (SELECT text AS id, {s_set('text')} AS t FROM (SELECT DISTINCT text FROM f)), {s_pairs('a', 'b', 0.0)},
  n AS (SELECT DISTINCT left_id, right_id, similarity FROM pairs JOIN f ON right_id = f.text WHERE similarity > least)
  SELECT left_id AS id, md5(right_id) AS form, similarity, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS pos FROM n) WHERE pos <= 3""")
def forms_of_both_stores(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    out = memory.forms_of_both_stores(a, table(spark, d, "conversations").select("text"), table(spark, d, "documents").select("text"))
    return out.select("id", F.md5(F.col("canonical_text").cast("binary")).alias("form"), "similarity", "pos")


def s_greedy(rows: str) -> str:
    """Greedy clustering row by row: the clusters of a domain are a list that each step of the recursion copies on. ``m`` has
    what each row came to; ``rows`` gives domain, seq, text and confidence."""
    return f"""a AS ({rows}), b AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS n, {s_set('text')} AS t FROM a), u AS (SELECT domain, n, len(t) AS m, unnest(t) AS w FROM b),
  p AS (SELECT x.domain, x.n, y.n AS j, count(*)::DOUBLE / (max(x.m) + max(y.m) - count(*))::DOUBLE AS s FROM u x JOIN u y ON x.domain = y.domain AND x.w = y.w AND y.n < x.n GROUP BY ALL HAVING count(*)::DOUBLE / (max(x.m) + max(y.m) - count(*))::DOUBLE >= 0.72),
  q AS (SELECT domain, n, list(struct_pack(j := j, s := s)) AS nb FROM p GROUP BY ALL), o AS (SELECT b.domain, b.n, seq, text, confidence, coalesce(nb, []) AS nb FROM b LEFT JOIN q USING (domain, n)),
  r AS (SELECT DISTINCT domain, 0::BIGINT AS n, []::STRUCT(j BIGINT, c DOUBLE, size BIGINT, seq BIGINT)[] AS cl, NULL::BIGINT AS spot FROM b UNION ALL
    SELECT domain, n, CASE WHEN best IS NULL THEN list_append(cl, struct_pack(j := n, c := confidence, size := 1::BIGINT, seq := seq)) ELSE list_transform(cl, lambda x, i: CASE WHEN i = best.i THEN struct_pack(j := CASE WHEN confidence > x.c THEN n ELSE x.j END, c := greatest(confidence, x.c), size := x.size + 1, seq := x.seq) ELSE x END) END, coalesce(best.i, len(cl) + 1)
    FROM (SELECT o.domain, o.n, o.seq, o.confidence, cl, list_sort(list_filter(list_transform(cl, lambda x, i: struct_pack(s := -(list_filter(nb, lambda y: y.j = x.j)[1]).s, i := i)), lambda z: z.s IS NOT NULL))[1] AS best FROM r JOIN o ON r.domain = o.domain AND o.n = r.n + 1)),
  m AS (SELECT r.domain, o.seq, 'cluster_' || r.domain || '_' || cl[spot].seq AS cluster_id, cl[spot].size AS cluster_size FROM r JOIN o ON r.domain = o.domain AND r.n = o.n)"""


_TURN_ROWS = "SELECT role AS domain, conv_id * 1000 + turn AS seq, text, 0.5::DOUBLE AS confidence FROM conversations"


@query(f"WITH RECURSIVE {s_greedy('SELECT lang AS domain, doc_id AS seq, text, (doc_id % 10) / 10.0::DOUBLE AS confidence FROM documents')} SELECT domain, seq, cluster_id, cluster_size FROM m")
def greedy_clusters(spark, d):
    s = table(spark, d, "documents").select(F.col("lang").alias("domain"), F.col("doc_id").alias("seq"), "text", F.col("doc_id").alias("sample_id"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"))
    return clusters.assign_clusters(s).select("domain", "seq", "cluster_id", "cluster_size")


# Metrics


_GOLD = "g AS (SELECT d.doc_id, lang, source, quality = 1 AS gold, toxic = 0 AS pred FROM labels l JOIN documents d USING (doc_id))"
_C = "count(*) FILTER (WHERE gold AND pred) AS tp, count(*) FILTER (WHERE NOT gold AND pred) AS fp, count(*) FILTER (WHERE gold AND NOT pred) AS fn, count(*) FILTER (WHERE NOT gold AND NOT pred) AS tn"


def _gold(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("gold"), (F.col("toxic") == 0).alias("pred"))


@query(f"WITH {_GOLD}, c AS (SELECT {_C} FROM g) SELECT tp, fp, fn, tn, {s_prf('tp', 'fp', 'fn', 'tn')} FROM c")
def detection_metrics(spark, d):
    return metrics.detection(_gold(spark, d))


@query(f"""WITH {_GOLD}, c AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS slice, CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source ELSE 'all' END AS value, {_C}
  FROM g GROUP BY GROUPING SETS ((), (lang), (source))) SELECT slice, value, tp, fp, fn, tn, {s_prf('tp', 'fp', 'fn', 'tn')} FROM c""")
def detection_by_slice(spark, d):
    return metrics.detection_by(_gold(spark, d), ["lang", "source"])


@query(f"""WITH {_GOLD}, c AS (SELECT CASE WHEN starts_with(source, 'src1') THEN 'generated' ELSE 'seed' END AS value, {_C} FROM g GROUP BY 1) SELECT value, tp, fp, fn, tn, {s_prf('tp', 'fp', 'fn', 'tn')} FROM c""")
def seed_vs_generated(spark, d):
    g = _gold(spark, d).withColumn("origin", F.when(F.col("source").startswith("src1"), "generated").otherwise("seed"))
    return metrics.detection_by(g, ["origin"]).where("slice = 'origin'").drop("slice")


@query("SELECT lang, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median_chars, avg(n_chars) AS mean_chars FROM documents GROUP BY lang")
def overlap_median(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(metrics.upper_median("n_chars").cast("long").alias("median_chars"), F.avg("n_chars").alias("mean_chars"))


@query("""SELECT role AS model, count(*) AS n, avg(length(text) // 4 + turn) AS avg_tokens, sum(length(text))::DOUBLE / count(*) / 1000 AS avg_latency_s, round(sum(3 * (length(text) // 4) + 15 * turn) / count(*)::DOUBLE / 1e6, 12) AS avg_cost FROM conversations GROUP BY role""")
def efficiency(spark, d):
    log = table(spark, d, "conversations").select(F.col("role").alias("model"), F.floor(F.length("text") / 4).alias("tokens_in"), F.col("turn").alias("tokens_out"), F.length("text").alias("latency_ms"))
    return metrics.efficiency(log).withColumns({"avg_latency_s": F.round("avg_latency_s", 9), "avg_cost": F.round("avg_cost", 12)})


ORACLE["efficiency"] = ORACLE["efficiency"].replace("sum(length(text))::DOUBLE / count(*) / 1000", "round(sum(length(text))::DOUBLE / count(*) / 1000, 9)")


@query("SELECT doc_id, (CASE WHEN quality = 1 THEN 1 ELSE 0 END + CASE WHEN toxic = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) >= 2 AS pred FROM labels")
def majority_vote(spark, d):
    runs = table(spark, d, "labels").select("doc_id", F.explode(F.array(F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 2 == 0)).alias("pred"))
    return metrics.majority(runs, "doc_id")


_KAPPA = """n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS agree FROM p), s AS (SELECT coalesce(sum(x.c::DOUBLE * y.c), 0) AS s FROM (SELECT a AS v, count(*) AS c FROM p GROUP BY a) x JOIN (SELECT b AS v, count(*) AS c FROM p GROUP BY b) y USING (v))
  SELECT n, agree / n::DOUBLE AS observed, s / (n::DOUBLE * n) AS expected, CASE WHEN s / (n::DOUBLE * n) = 1 THEN 1.0 ELSE (agree / n::DOUBLE - s / (n::DOUBLE * n)) / (1 - s / (n::DOUBLE * n)) END AS kappa FROM n, s"""


@query(f"WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), {_KAPPA}")
def cohen_kappa(spark, d):
    return metrics.cohen_kappa(table(spark, d, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")))


@query("""WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), v AS (SELECT a AS v FROM p UNION ALL SELECT b FROM p), c AS (SELECT v, count(*) AS c FROM v GROUP BY v), s AS (SELECT 1 - sum(c::DOUBLE * c) / (sum(c)::DOUBLE * sum(c)) AS de FROM c)
  SELECT count(*) AS n, 1 - (count(*) FILTER (WHERE a <> b) / count(*)::DOUBLE) / max(de) AS alpha FROM p, s""")
def krippendorff_alpha(spark, d):
    return metrics.krippendorff_alpha(table(spark, d, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")))


@query(f"""WITH x AS (SELECT DISTINCT trim(lower(text)) AS t FROM documents WHERE doc_id % 3 <> 0), y AS (SELECT DISTINCT trim(lower(text)) AS t FROM documents WHERE doc_id % 5 <> 0),
  p AS (SELECT (x.t IS NOT NULL)::INT AS a, (y.t IS NOT NULL)::INT AS b FROM x FULL JOIN y ON x.t = y.t), {_KAPPA}""")
def labeller_agreement(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return metrics.labeller_agreement(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 5 <> 0"))


_RANKINGS = """s AS (SELECT l_suppkey AS item, sum(l_quantity) AS a, count(*) AS b FROM lineitem GROUP BY 1), p AS (SELECT item, row_number() OVER (ORDER BY a DESC, item) AS pos FROM s), g AS (SELECT item, row_number() OVER (ORDER BY b DESC, item) AS pos FROM s)"""


def _rankings(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("item")).agg(F.sum("l_quantity").alias("a"), F.count(F.lit(1)).alias("b"))
    by = lambda c: positions(s.select("item", c), F.desc(c), "item").select("item", "pos")
    return by("a"), by("b")


@query(f"""WITH {_RANKINGS}, r AS (SELECT item, pos, (SELECT count(*) FROM g) - pos + 1 AS rel FROM g), d AS (SELECT sum(coalesce(rel, 0) / log2(p.pos + 1.0)) AS d FROM p LEFT JOIN r USING (item) WHERE p.pos <= 10),
  i AS (SELECT sum(rel / log2(pos + 1.0)) AS i FROM r WHERE pos <= 10) SELECT round(d / i, 9) AS ndcg FROM d, i""")
def ndcg_at_10(spark, d):
    p, g = _rankings(spark, d)
    return metrics.ndcg(p, g, 10).select(F.round("ndcg", 9).alias("ndcg"))


@query(f"""WITH {_RANKINGS}, b AS (SELECT item, p.pos AS p, g.pos AS g FROM p JOIN g USING (item)) SELECT sum(sign((x.p - y.p) * (x.g - y.g)))::DOUBLE / sum(abs(sign((x.p - y.p) * (x.g - y.g))))::DOUBLE AS tau FROM b x JOIN b y ON x.item < y.item""")
def kendall_tau(spark, d):
    return metrics.kendall_tau(*_rankings(spark, d))


@query(f"WITH {_RANKINGS} SELECT count(g.item)::DOUBLE / count(*)::DOUBLE AS precision FROM (SELECT item FROM p WHERE pos <= 10) p LEFT JOIN (SELECT item FROM g WHERE pos <= 10) g USING (item)")
def topk_precision(spark, d):
    return metrics.top_k_precision(*_rankings(spark, d), 10)


#: Ways of extraction, dealt to the rated documents.
_WAYS = ["P1", "P4", "P5", "HN_1", "P8", "XD", "P6", "P2", "P7"]
_PATHS = f"""r AS (SELECT doc_id::VARCHAR AS entry_id, {qlist(_WAYS)}[doc_id % {len(_WAYS)} + 1] AS extraction_path, CASE WHEN (doc_id // 3) % 3 > 0 THEN 'COMMON' ELSE 'SPECIFIC' END AS switch_mode, quality = 1 AS gold, CASE WHEN doc_id % 5 < 4 THEN doc_id % 5 END AS num_suggestions FROM labels)"""


def _results(spark, d):
    i = F.col("doc_id")
    way = F.element_at(F.array(*[F.lit(w) for w in _WAYS]), (i % len(_WAYS) + 1).cast("int"))
    return table(spark, d, "labels").select(
        i.cast("string").alias("entry_id"), way.alias("extraction_path"), F.when(F.floor(i / 3) % 3 > 0, "COMMON").otherwise("SPECIFIC").alias("switch_mode"), (F.col("quality") == 1).alias("gold"), F.when(i % 5 < 4, i % 5).alias("num_suggestions")
    )




@query(f"""WITH {_PATHS} SELECT count(*) FILTER (WHERE extraction_path IN ('P4', 'P5', 'P6', 'P1', 'P2', 'P3', 'P7', 'P8', 'XD')) AS n, count(*) FILTER (WHERE extraction_path IN ('P4', 'P5', 'P6') AND switch_mode = 'SPECIFIC') AS specific_correct,
  count(*) FILTER (WHERE extraction_path IN ('P1', 'P2', 'P3', 'P7', 'P8', 'XD') AND switch_mode = 'COMMON') AS common_correct, count(*) FILTER (WHERE (extraction_path IN ('P4', 'P5', 'P6') AND switch_mode = 'SPECIFIC') OR (extraction_path IN ('P1', 'P2', 'P3', 'P7', 'P8', 'XD') AND switch_mode = 'COMMON'))::DOUBLE
  / count(*) FILTER (WHERE extraction_path IN ('P4', 'P5', 'P6', 'P1', 'P2', 'P3', 'P7', 'P8', 'XD'))::DOUBLE AS switch_accuracy FROM r""")
def switch_accuracy(spark, d):
    return metrics.switch_accuracy(_results(spark, d))


@query(f"WITH {_PATHS} SELECT count(*) FILTER (WHERE gold AND coalesce(num_suggestions, 0) > 0) AS n, 1.0::DOUBLE AS legacy_ndcg5, 1.0::DOUBLE AS legacy_mrr FROM r")
def legacy_ranking(spark, d):
    return metrics.legacy_ranking(_results(spark, d))


@query(f"""WITH {_TURNS}, s AS (SELECT *, {s_dice(s_set('y'), s_set('x'))} AS f FROM t) SELECT count(*) AS n, avg((f < 0.15)::INT) AS ungrounded, avg((length(x) > 50)::INT) AS long_source FROM s""")
def grounding_rates(spark, d):
    return metrics.rate(_turns(spark, d), ungrounded=metrics.hallucinated(F.lit(None).cast("double"), F.col("y"), F.col("x")), long_source=F.length("x") > 50)


@query("""WITH n AS (SELECT DISTINCT trim(lower(text)) AS k FROM documents WHERE source = 'src0') SELECT count(*) AS n, avg((n.k IS NOT NULL)::INT) AS fp_rate FROM documents d LEFT JOIN n ON trim(lower(d.text)) = n.k WHERE d.source <> 'src0'""")
def false_positive_rate(spark, d):
    docs = table(spark, d, "documents").select("source", "text")
    return metrics.false_positive_rate(docs.where("source <> 'src0'"), docs.where("source = 'src0'"))


@query("""WITH m AS (SELECT lang AS config, avg(quality) AS v FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT config, v, v - (SELECT v FROM m WHERE config = 'en') AS delta FROM m""")
def config_deltas(spark, d):
    m = _gold(spark, d).groupBy(F.col("lang").alias("config")).agg(F.avg(F.col("gold").cast("int")).alias("v"))
    return metrics.deltas(m, "config", "v", "en")


@query("""WITH m AS (SELECT lang AS config, avg(quality) AS v FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT max(v) AS best_value, (SELECT config FROM m ORDER BY v DESC, config LIMIT 1) AS best FROM m""")
def best_config(spark, d):
    m = _gold(spark, d).groupBy(F.col("lang").alias("config")).agg(F.avg(F.col("gold").cast("int")).alias("v"))
    return metrics.best_of(m, "config", "v")


@query("SELECT tau, CASE WHEN (doc_id % 10) / 10.0 >= tau THEN 'COMMON' ELSE 'SPECIFIC' END AS switch_mode, count(*) AS n FROM documents, (SELECT unnest([0.3, 0.5, 0.6, 0.8])::DOUBLE AS tau) GROUP BY ALL")
def tau_sweep(spark, d):
    return pipeline.tau_sweep(table(spark, d, "documents").select(((F.col("doc_id") % 10) / 10.0).alias("overall_alignment")), [0.3, 0.5, 0.6, 0.8])


# Matching


_MATCH = f"""p AS (SELECT conv_id AS grp, turn AS p, {s_set('text')} AS t FROM conversations WHERE role = 'user'), g AS (SELECT conv_id AS grp, turn AS g, {s_set('text')} AS t FROM conversations WHERE role <> 'user'),
  b AS (SELECT grp, p, g, {s_dice('p.t', 'g.t')} AS score FROM p JOIN g USING (grp)), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, p ORDER BY score DESC, g) AS n FROM b WHERE score > 0) WHERE n = 1)"""


def _pred_gold(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), "role", "text")
    return c.where("role = 'user'").drop("role"), c.where("role <> 'user'").drop("role")


@query(f"WITH {_MATCH} SELECT grp, p, g, score FROM (SELECT *, row_number() OVER (PARTITION BY grp, g ORDER BY p) AS m FROM f WHERE score >= 0.2) WHERE m = 1")
def greedy_match(spark, d):
    return matching.greedy_match(*_pred_gold(spark, d), threshold=0.2)


@query(f"""WITH {_MATCH}, m AS (SELECT grp, count(*) AS tp FROM f WHERE score >= 0.5 GROUP BY grp), n AS (SELECT grp, np, ng FROM (SELECT grp, count(*) AS np FROM p GROUP BY grp) FULL JOIN (SELECT grp, count(*) AS ng FROM g GROUP BY grp) USING (grp)), s AS (SELECT grp, sum(score) AS s FROM f GROUP BY grp),
  e AS (SELECT a.conv_id AS grp, count(*) AS x FROM conversations a WHERE role = 'user' AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.role <> 'user' AND trim(lower(a.text)) = trim(lower(b.text))) GROUP BY 1),
  c AS (SELECT n.grp, coalesce(np, 0) AS n_pred, coalesce(ng, 0) AS n_gold, coalesce(tp, 0) AS tp, coalesce(s, 0) AS s, coalesce(x, 0) AS x FROM n LEFT JOIN m USING (grp) LEFT JOIN s USING (grp) LEFT JOIN e USING (grp))
  SELECT grp, n_pred, n_gold, tp, {s_ratio('tp', 'n_pred')} AS precision, {s_ratio('tp', 'n_gold')} AS recall, {s_ratio(f"2 * {s_ratio('tp', 'n_pred')} * {s_ratio('tp', 'n_gold')}", f"{s_ratio('tp', 'n_pred')} + {s_ratio('tp', 'n_gold')}")} AS f1, {s_ratio('x', 'n_pred')} AS exact_match_rate, round({s_ratio('s', 'n_pred')}, 9) AS avg_span_f1 FROM c""")
def explicit_scores(spark, d):
    return matching.explicit_scores(*_pred_gold(spark, d)).withColumn("avg_span_f1", F.round("avg_span_f1", 9))


def unified_scores(spark, d):
    p, g = _pred_gold(spark, d)
    gates = p.withColumns({"actionability_score": rules.actionability("text"), "feasibility_score": rules.feasibility("text"), "faithfulness_score": F.lit(0.5), "passed": F.col("pos") % 2 == 0})
    out = matching.unified_scores(matching.explicit_scores(p, g), matching.implicit_scores(gates, g))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"WITH {_MATCH}, n AS (SELECT grp, count(*) AS n FROM p GROUP BY grp), h AS (SELECT grp, count(*) AS h FROM f WHERE score >= 0.2 GROUP BY grp) SELECT grp, n, coalesce(h, 0) / n::DOUBLE AS text_match_rate FROM n LEFT JOIN h USING (grp)")
def any_match(spark, d):
    return matching.any_match(*_pred_gold(spark, d), threshold=0.2)


@query(f"""WITH {_TURNS}, k AS (SELECT conv_id, turn, trim(lower(x)) AS g, trim(lower(y)) AS p FROM t) SELECT conv_id, turn, CASE WHEN g NOT IN ('', '—', 'nan') THEN CASE WHEN g = p THEN 'exact' WHEN contains(p, g) OR contains(g, p)
  OR (p <> 'nan' AND {s_inter(s_set('g'), s_set('p'))} / greatest(1, len({s_set('g')}))::DOUBLE >= 0.5) THEN 'partial' ELSE 'none' END END AS kind FROM k""")
def match_kinds(spark, d):
    return _turns(spark, d).select("conv_id", "turn", matching.match_kind(F.col("x"), F.col("y")).alias("kind"))


# Bootstrap


_DRAW = "list_sum(list_transform([" + ", ".join(f"{c!r}::DOUBLE" for c in bootstrap.CUMULATIVE) + "], lambda c: (u >= c)::INT))"


def _boot(n: int) -> str:
    return f"u AS (SELECT g.*, r.r AS resample, ('0x' || substr(md5('42:' || r.r || ':' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM g, (SELECT unnest(range(1, {n + 1})) AS r) r), w AS (SELECT *, {_DRAW} AS w FROM u)"


@query(f"""WITH {_GOLD}, {_boot(100)}, s AS (SELECT resample, coalesce(sum(w) FILTER (WHERE gold AND pred), 0) AS tp, coalesce(sum(w) FILTER (WHERE NOT gold AND pred), 0) AS fp, coalesce(sum(w) FILTER (WHERE gold AND NOT pred), 0) AS fn FROM w GROUP BY resample),
  f AS (SELECT {s_ratio('2 * tp', '2 * tp + fp + fn')} AS f FROM s) SELECT count(*) AS resamples, round(avg(f), 9) AS mean, round(quantile_cont(f, 0.025), 9) AS low, round(quantile_cont(f, 0.975), 9) AS high FROM f""")
def bootstrap_f1(spark, d):
    out = bootstrap.interval(bootstrap.f1_statistic(_gold(spark, d), "doc_id", "gold", "pred", n=100), "stat")
    return out.select("resamples", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {_GOLD}, {_boot(100)}, s AS (SELECT resample, sum(w * (gold::INT - pred::INT))::DOUBLE / sum(w) AS s FROM w GROUP BY resample) SELECT avg((s <= 0)::INT) AS p_value, 1 - avg((s <= 0)::INT) AS win_rate FROM s""")
def paired_bootstrap(spark, d):
    g = _gold(spark, d).select("doc_id", F.col("gold").cast("int").alias("a"), F.col("pred").cast("int").alias("b"))
    return bootstrap.paired_test(g, "doc_id", "a", "b", n=100)


@query(f"""WITH {_GOLD}, {_boot(1000)}, s AS (SELECT resample, coalesce(sum(w) FILTER (WHERE gold AND pred), 0) AS tp, coalesce(sum(w) FILTER (WHERE NOT gold AND pred), 0) AS fp, coalesce(sum(w) FILTER (WHERE gold AND NOT pred), 0) AS fn FROM w GROUP BY resample),
  l AS (SELECT list_sort(list({s_ratio('2 * tp', '2 * tp + fp + fn')})) AS l FROM s) SELECT l[26] AS low, l[501] AS median, l[975] AS high FROM l""")
def bootstrap_order_interval(spark, d):
    return bootstrap.order_interval(bootstrap.f1_statistic(_gold(spark, d), "doc_id", "gold", "pred", n=1000), "stat")


def _cells(cells: str, n: int) -> str:
    """``c``: cells (cell, n and their values) drawn in n resamples, as w."""
    name = "'42:' || resample || ':' || cell"
    u = lambda first: f"(('0x' || substr(md5({name}), {first}, 8))::BIGINT::DOUBLE + 1) / 4294967296.0::DOUBLE"
    z = f"sqrt(-2::DOUBLE * ln({u(1)})) * cos(2 * pi() * {u(9)})"
    one = "list_sum(list_transform([" + ", ".join(f"{c!r}::DOUBLE" for c in bootstrap.CUMULATIVE) + "], lambda c: (('0x' || substr(md5('42:' || resample || ':' || cell || ':' || i), 1, 8))::BIGINT::DOUBLE / 4294967296.0 >= c)::INT))"
    each = f"list_sum(list_transform(range(1, n + 1), lambda i: {one}))"
    return f"""x AS (SELECT *, {z} AS z FROM ({cells}), (SELECT unnest(range(1, {n + 1})) AS resample)),
  c AS (SELECT *, (CASE WHEN n <= {bootstrap.BY_ROW} THEN {each} ELSE greatest(0.0, floor(n + sqrt(n::DOUBLE) * z + (z * z - 1) / 6 + 0.5)) END)::BIGINT AS w FROM x)"""


@query(f"""WITH {_GOLD}, {_cells("SELECT gold, pred, gold || ',' || pred AS cell, count(*) AS n FROM g GROUP BY gold, pred", 10_000)}, s AS (SELECT resample, coalesce(sum(w) FILTER (WHERE gold AND pred), 0) AS tp, coalesce(sum(w) FILTER (WHERE NOT gold AND pred), 0) AS fp, coalesce(sum(w) FILTER (WHERE gold AND NOT pred), 0) AS fn FROM c GROUP BY resample),
  f AS (SELECT {s_ratio('2 * tp', '2 * tp + fp + fn')} AS f FROM s) SELECT count(*) AS resamples, round(avg(f), 9) AS mean, round(quantile_cont(f, 0.025), 9) AS low, round(quantile_cont(f, 0.975), 9) AS high FROM f""")
def bootstrap_cells_f1(spark, d):
    out = bootstrap.interval(bootstrap.cell_f1(_gold(spark, d), "gold", "pred"), "stat")
    return out.select("resamples", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {_GOLD}, {_cells("SELECT gold::INT - pred::INT AS d, (gold::INT - pred::INT)::VARCHAR AS cell, count(*) AS n FROM g GROUP BY 1, 2", 10_000)}, s AS (SELECT resample, sum(w * d)::DOUBLE / nullif(sum(w), 0)::DOUBLE AS s FROM c GROUP BY resample) SELECT avg((s <= 0)::INT) AS p_value, 1 - avg((s <= 0)::INT) AS win_rate FROM s""")
def paired_cells_bootstrap(spark, d):
    g = _gold(spark, d).select(F.col("gold").cast("int").alias("a"), F.col("pred").cast("int").alias("b"))
    return bootstrap.cell_paired_test(g, "a", "b")


# Joins, sets, samples, sinks


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def results_joined(spark, d):
    l = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").fillna(0)


_SIDES = "x AS (SELECT trim(lower(text)) AS t FROM documents WHERE lang = 'en'), y AS (SELECT trim(lower(text)) AS t FROM documents WHERE lang IS DISTINCT FROM 'en' UNION ALL SELECT trim(lower(text)) FROM conversations)"


@query(f"""WITH {_SIDES} SELECT 'union' AS op, count(*) AS n FROM (SELECT t FROM x UNION SELECT t FROM y) UNION ALL SELECT 'intersect', count(*) FROM (SELECT t FROM x INTERSECT SELECT t FROM y) UNION ALL SELECT 'except', count(*) FROM (SELECT t FROM x EXCEPT SELECT t FROM y)
  UNION ALL SELECT 'union_all', count(*) FROM (SELECT t FROM x UNION ALL SELECT t FROM y)""")
def text_set_operations(spark, d):
    """English documents on one side, all other texts on the other."""
    docs, key = table(spark, d, "documents"), text.canonical_key("text").alias("t")
    english = F.col("lang").eqNullSafe("en")
    a, b = docs.where(english).select(key), docs.where(~english).select(key).unionByName(table(spark, d, "conversations").select(key))
    named = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union_all": a.union(b)}
    out = None
    for k, v in named.items():
        row = v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n")
        out = row if out is None else out.union(row)
    return out


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_slices(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct().orderBy("lang", "source")


@query("SELECT doc_id, lang, '' AS annotator_label FROM (SELECT doc_id, lang, md5('42:' || doc_id) AS h FROM documents) ORDER BY h, doc_id LIMIT 50")
def annotation_sample(spark, d):
    s = readers.seeded_sample(table(spark, d, "documents"), 50, "doc_id")
    return readers.annotation_sheet(s, ["doc_id", "lang"], ["annotator_label"])


@query(f"""WITH {_GOLD}, c AS (SELECT lang AS system, {_C} FROM g GROUP BY lang) SELECT system, {s_ratio('2*tp', '2*tp+fp+fn')} AS f1, {s_ratio('tp', 'tp+fp')} AS precision, {s_ratio('tp', 'tp+fn')} AS recall FROM c""")
def comparison_table(spark, d):
    m = metrics.detection_by(_gold(spark, d), ["lang"]).where("slice = 'lang'")
    long = m.selectExpr("value AS system", "stack(3, 'f1', f1, 'precision', precision, 'recall', recall) AS (metric, value)")
    return sinks.comparison(long, names=["f1", "precision", "recall"])


_MEDIA = """m AS (SELECT 'GEN-' || page_id AS entry_id, CASE page_id % 5 WHEN 0 THEN 'pics/One' || page_id || '.JPG' WHEN 3 THEN 'gone.png' END AS image_path, CASE page_id % 5 WHEN 2 THEN url WHEN 4 THEN 'nan' END AS image_description, page_id % 5 <> 4 AS has_image FROM pages),
  p AS (SELECT CASE page_id % 5 WHEN 0 THEN 'file:/m/one' || page_id || '.jpg' WHEN 1 THEN 'file:/m/gen_' || page_id || '.png' ELSE 'file:/m/other' || page_id || '.wav' END AS path FROM pages),
  f AS (SELECT path, lower(string_split(path, '/')[-1]) AS name FROM p), n AS (SELECT m.*, (SELECT min(path) FROM f WHERE name = lower(string_split(coalesce(image_path, ''), '/')[-1])) AS a, (SELECT min(path) FROM f WHERE regexp_replace(name, '\\.[^.]+$', '') = replace(lower(entry_id), '-', '_')) AS b FROM m),
  r AS (SELECT entry_id, has_image, coalesce(a, b) AS media_path, CASE WHEN a IS NOT NULL THEN 'file' WHEN b IS NOT NULL THEN 'entry_id' WHEN trim(coalesce(image_description, '')) NOT IN ('', 'nan', 'None', '—') THEN 'description' ELSE 'none' END AS media_source FROM n)"""


def _with_media(spark, d):
    """A review for every page, and files as they may lie beside it: named by it, by its entry, or neither."""
    i, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    p = table(spark, d, "pages")
    rows = p.select(
        F.concat(F.lit("GEN-"), n).alias("entry_id"), F.when(i == 0, F.concat(F.lit("pics/One"), n, F.lit(".JPG"))).when(i == 3, "gone.png").alias("image_path"), F.when(i == 2, F.col("url")).when(i == 4, "nan").alias("image_description"), (i != 4).alias("has_image")
    )
    path = F.when(i == 0, F.concat(F.lit("one"), n, F.lit(".jpg"))).when(i == 1, F.concat(F.lit("gen_"), n, F.lit(".png"))).otherwise(F.concat(F.lit("other"), n, F.lit(".wav")))
    files = media.with_names(p.select(F.concat(F.lit("file:/m/"), path).alias("path"), F.octet_length("html").cast("long").alias("length")))
    return media.resolve(rows, files, "image_path", "image_description")


@query(f"WITH {_MEDIA} SELECT entry_id, media_path, media_source FROM r")
def media_resolution(spark, d):
    return _with_media(spark, d).select("entry_id", "media_path", "media_source")


@query("SELECT page_id, to_json({page_id: page_id, url: url, raw: '<' || strlen(html) || ' items>'})::VARCHAR AS state FROM pages")
def state_dump(spark, d):
    p = table(spark, d, "pages").withColumn("raw", F.col("html").cast("binary"))
    return p.select("page_id", sinks.masked(p.drop("html")).alias("state"))


# Whole pipeline, models, streams


@query()
def mine_reviews(spark, d):
    return pipeline.run(settle(_reviews(spark, d), "reviews")).select("sample_id", "canonical_text", "suggestion_type", "score", "rank", F.array_join("reasons", ",").alias("reasons"))


def _train(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))


def _held_out():
    """A fifth of the rows, by the hash of their id, on which models are tried."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query()
def tfidf_logreg(spark, d):
    t = _train(spark, d)
    return ml.predict(ml.logistic(t.where(~_held_out())), t.where(_held_out())).select("doc_id", F.col("label").cast("int").alias("label"), "pred")


@query()
def tfidf_svm(spark, d):
    t = _train(spark, d)
    return ml.predict(ml.svm(t.where(~_held_out())), t.where(_held_out())).select("doc_id", F.col("label").cast("int").alias("label"), "pred")


@query()
def gbt_scorer(spark, d):
    f = _features(spark, d)
    rated = f.where(~_held_out()).withColumn("rating", ranking.linear_score(f))
    return ml.learned_score(ml.learned_scorer(rated), f.where(_held_out())).select("doc_id", "score")


def _replay(spark, rows: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows written to a folder, read as a file stream until it is exhausted, and the stream's result read back."""
    source, out = fresh(spark, "stream-in"), fresh(spark, "stream-out")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    streaming.append_incrementally(transform(stream), out, fresh(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out)


@query(f"SELECT * FROM ({ORACLE['rolling_approval']}) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_decisions(spark, d):
    """Windows that the watermark has closed; the last day of the table stays open."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type").isin("purchase", "signup"), "accept").otherwise("reject").alias("decision"))
    return _replay(spark, e, streaming.rolling_approval).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"SELECT event_id AS decision_id, {_DECIDE} AS decision FROM events")
def stream_short_term(spark, d):
    """Every row of the table comes twice, as from a source that sends again; every decision is kept once."""
    e = table(spark, d, "events").select(F.col("event_id").alias("decision_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type").isin("purchase", "signup"), "accept").otherwise("reject").alias("decision"))
    twice = e.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    return _replay(spark, twice, streaming.short_term).select("decision_id", "decision")


@query(f"""SELECT event_id AS decision_id, coalesce(round(avg(({_DECIDE} = 'accept')::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 3), 0.5) AS past_approval_rate FROM events""")
def stream_approval(spark, d):
    """Each decision meets those on the same text of the ten days before it; the state holds no older ones."""
    e = table(spark, d, "events").select(F.col("event_id").alias("decision_id"), F.concat(F.lit("Item "), F.col("user_id").cast("string")).alias("text"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type").isin("purchase", "signup"), "accept").otherwise("reject").alias("decision"))
    return _replay(spark, e, lambda s: streaming.stream_approval(s, 10))


@query("""SELECT md5(trim(lower(text))) AS pattern, count(*) AS count, count(*) FILTER (WHERE n_chars % 2 = 0) AS accepted_count, count(DISTINCT source)::INT AS domain_count FROM documents GROUP BY trim(lower(text))""")
def stream_patterns(spark, d):
    """Counts per pattern after the last batch of a stream in complete mode."""
    r = table(spark, d, "documents").select("text", F.col("source").alias("domain"), (F.col("n_chars") % 2 == 0).alias("accepted"))
    source, out = fresh(spark, "stream-in"), fresh(spark, "stream-out")
    r.write.parquet(source)
    counts = streaming.running_patterns(spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 3).parquet(source))
    streaming.keep_complete(counts, out, fresh(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select(F.md5(F.col("pattern").cast("binary")).alias("pattern"), "count", "accepted_count", F.size("domains").alias("domain_count"))


@query(f"WITH RECURSIVE {s_greedy(_TURN_ROWS)} SELECT domain, seq, cluster_id, cluster_size FROM m")
def stream_clusters(spark, d):
    s = table(spark, d, "conversations").select(F.col("role").alias("domain"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text", F.col("conv_id").cast("string").alias("sample_id"), F.lit(0.5).alias("confidence"))
    return _replay(spark, s, streaming.stream_clusters).select("domain", "seq", "cluster_id", "cluster_size")


# The rest of the inventory


@query(f"""SELECT conv_id, turn, len(list_filter({s_words('text')}, lambda w: list_contains({qlist(lex.EMPHASIS_WORDS)}, trim(lower(w), '.,!?')) OR (w = upper(w) AND w <> lower(w))))::INT AS n_stressed FROM conversations""")
def stressed_words(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(rules.emphasis_words("text")).alias("n_stressed"))


_SPLIT = f"""c AS (SELECT id, text, {s_words('text')} AS w, list_position(list_transform({s_words('text')}, lambda x: list_contains({qlist(lex.SPLIT_VERBS)}, rtrim(lower(x), ',.:;'))), true) AS pos1 FROM t)"""


@query(f"""WITH {_TEXTS}, {_SPLIT} SELECT id, CASE WHEN pos1 > 0 THEN w[pos1] ELSE '' END AS verb, CASE WHEN len(w) = 0 THEN '' WHEN pos1 > 0 THEN array_to_string(w[pos1 + 1:], ' ') ELSE text END AS target FROM c""")
def action_targets(spark, d):
    return _texts(spark, d).select("id", text.split_action("text").alias("a")).select("id", "a.verb", "a.target")


@query(f"""WITH {_TEXTS} SELECT id, coalesce(trim(list_filter(string_split(text, '.'), lambda s: len(list_filter({qlist(lex.COMPLAINT_MARKERS)}, lambda m: contains(lower(s), m))) > 0)[1]), substr(text, 1, 200)) AS complaint FROM t""")
def complaints(spark, d):
    return _texts(spark, d).select("id", text.complaint("text", F.lit(None).cast("string")).alias("complaint"))


_KIND = f"""CASE WHEN regexp_matches(lower(text), {q(rules.any_of(lex.EXPLICIT_STRONG + lex.EXPLICIT_MODERATE) + '|' + '|'.join(lex.ROLE_PATTERNS['direct_request']))}) THEN 'request'
  WHEN regexp_matches(lower(text), {q(rules.any_of(lex.IMPLICIT_SIGNALS['comparison_to_feature'] + lex.IMPLICIT_SIGNALS['rhetorical_question']) + '|' + '|'.join(lex.ROLE_PATTERNS['comparison_frame']))}) THEN 'question'
  WHEN regexp_matches(lower(text), {q('|'.join(lex.ROLE_PATTERNS['complaint_frame']) + '|' + rules.any_of(lex.COMPLAINT_MARKERS))}) THEN 'complaint' WHEN {s_any('text', lex.HARD_NEGATIVES['tech_software']['praise'])} THEN 'praise' ELSE 'neutral' END"""


@query(f"""WITH {_TEXTS}, k AS (SELECT id, {_KIND} AS kind FROM t) SELECT id, kind, CASE kind {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in BANDS.items())} END AS span_confidence FROM k""")
def sentence_bands(spark, d):
    band = F.create_map(*[F.lit(x) for kv in BANDS.items() for x in kv])
    return _texts(spark, d).select("id", sentence_kind("text").alias("kind")).withColumn("span_confidence", band[F.col("kind")])


@query("""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS s FROM documents) SELECT doc_id, count(*) AS n_sentences, max(length(s))::INT AS longest FROM s GROUP BY doc_id""")
def document_sentences(spark, d):
    s = split_sentences(table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("raw_text")))
    return s.groupBy(F.col("sample_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("text")).alias("longest"))


_INTENT = f"""p AS (SELECT conv_id AS grp, turn AS p, text, {s_minus(s_set('text'), lex.INTENT_STOPWORDS)} AS t FROM conversations WHERE role = 'user'), g AS (SELECT conv_id AS grp, turn AS g, {s_minus(s_set('text'), lex.INTENT_STOPWORDS)} AS t FROM conversations WHERE role <> 'user'),
  b AS (SELECT grp, p, max({s_jaccard('p.t', 'g.t')}) AS s FROM p JOIN g USING (grp) GROUP BY grp, p), m AS (SELECT grp, sum(s) AS s, count(*) FILTER (WHERE s >= 0.3) AS tp FROM b GROUP BY grp),
  n AS (SELECT * FROM (SELECT grp, count(*) AS np, avg({s_act('text')}) AS a, avg({s_feas('text')}) AS f, avg((p % 2 = 0)::INT) AS gates FROM p GROUP BY grp) FULL JOIN (SELECT grp, count(*) AS ng FROM g GROUP BY grp) USING (grp))"""


@query(f"""WITH {_INTENT}, c AS (SELECT n.grp, coalesce(np, 0) AS n_pred, coalesce(ng, 0) AS n_gold, coalesce(tp, 0) AS tp, coalesce(s, 0) AS s, a, f, gates FROM n LEFT JOIN m USING (grp))
  SELECT grp, n_pred, n_gold, tp, {s_ratio('tp', 'n_pred')} AS precision, {s_ratio('tp', 'n_gold')} AS recall, {s_ratio(f"2 * {s_ratio('tp', 'n_pred')} * {s_ratio('tp', 'n_gold')}", f"{s_ratio('tp', 'n_pred')} + {s_ratio('tp', 'n_gold')}")} AS f1,
  round({s_ratio('s', 'n_pred')}, 9) AS avg_intent_match, round(a, 9) AS avg_actionability, round(f, 9) AS avg_feasibility, gates AS gate_pass_rate FROM c""")
def implicit_scores(spark, d):
    p, g = _pred_gold(spark, d)
    gates = p.withColumns({"actionability_score": rules.actionability("text"), "feasibility_score": rules.feasibility("text"), "faithfulness_score": F.lit(0.5), "passed": F.col("pos") % 2 == 0})
    out = matching.implicit_scores(gates, g).drop("avg_faithfulness")
    return out.withColumns({c: F.round(c, 9) for c in ("avg_intent_match", "avg_actionability", "avg_feasibility")})


query(f"""WITH b AS (SELECT grp, n_pred, precision, recall, f1 FROM ({ORACLE['explicit_scores']}) UNION ALL SELECT grp, n_pred, precision, recall, f1 FROM ({ORACLE['implicit_scores']}))
  SELECT grp, sum(n_pred)::BIGINT AS n_pred, round({s_ratio('sum(precision * n_pred)', 'sum(n_pred)')}, 9) AS precision, round({s_ratio('sum(recall * n_pred)', 'sum(n_pred)')}, 9) AS recall, round({s_ratio('sum(f1 * n_pred)', 'sum(n_pred)')}, 9) AS f1 FROM b GROUP BY grp""")(unified_scores)


@query(f"""WITH d AS (SELECT f1 FROM ({ORACLE['detection_metrics']})), o AS (SELECT avg(stem_overlap) AS mean_overlap FROM ({ORACLE['turn_similarities']})) SELECT f1, round(mean_overlap, 9) AS mean_overlap, round({s_ratio('2 * f1 * mean_overlap', 'f1 + mean_overlap')}, 9) AS mining_f1 FROM d, o""")
def mining_f1(spark, d):
    out = metrics.mining_f1(detection_metrics(spark, d), turn_similarities(spark, d).agg(F.avg("stem_overlap").alias("mean_overlap")))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_overlap", "mining_f1")})


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def last_decisions(spark, d):
    return memory.last_decisions(table(spark, d, "events").select("event_id", "ts"), 20, tie="event_id")


@query(f"SELECT * FROM ({ORACLE['cross_domain_patterns']}) ORDER BY domain_count DESC, count DESC, pattern LIMIT 10")
def top_patterns(spark, d):
    return memory.top_patterns(cross_domain_patterns(spark, d))


@query("""WITH p AS (SELECT trim(lower(text)) AS k, count(DISTINCT source) AS n FROM documents GROUP BY 1) SELECT doc_id, n >= 2 AS cross_domain, least(0.1::DOUBLE, (n - 1) * 0.03::DOUBLE) AS cross_domain_boost FROM documents JOIN p ON trim(lower(text)) = k""")
def cross_domain(spark, d):
    docs = table(spark, d, "documents")
    known = memory.patterns(docs.select("text", F.col("source").alias("domain"), F.lit(True).alias("accepted")))
    return memory.cross_domain(docs.select(F.col("doc_id").alias("id"), "text"), known).select(F.col("id").alias("doc_id"), "cross_domain", "cross_domain_boost")


@query(f"""WITH a AS (SELECT doc_id AS id, {s_set('text')} AS t FROM documents), e AS (SELECT doc_id AS id, {s_set("regexp_replace(text, '\\s+\\S+$', '')")} AS t FROM documents), {s_pairs('a', 'e', 0.75)}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS n FROM pairs) WHERE n = 1)
  SELECT doc_id, coalesce(right_id, -1) AS edit_id FROM documents LEFT JOIN b ON left_id = doc_id""")
def corrections(spark, d):
    """Every text was edited before its last word was written."""
    docs = table(spark, d, "documents")
    edits = docs.select(F.col("doc_id").alias("edit_id"), F.regexp_replace("text", r"\s+\S+$", "").alias("original"), F.col("doc_id").cast("string").alias("corrected"))
    out = memory.corrections(docs.select(F.col("doc_id").alias("id"), "text"), edits)
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("corrected_text") == F.col("text"), -1).otherwise(F.expr("try_cast(corrected_text AS bigint)")).alias("edit_id"))


_FORMS = f"""c AS (SELECT DISTINCT conv_id, trim(lower(text)) AS k FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'user'),
  r AS (SELECT c.conv_id, k, turn, CASE WHEN lower(text) = k THEN 2.0 ELSE {s_ratio(s_inter(s_set('text'), s_set('k')), f"greatest(len({s_set('text')}), len({s_set('k')}))")} END AS score FROM c LEFT JOIN a USING (conv_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY coalesce(score, 0) DESC, turn) AS n FROM r)"""


@query(f"WITH {_FORMS} SELECT conv_id AS sample_id, md5(k) AS canonical, CASE WHEN coalesce(score, 0) > 0 THEN turn ELSE -1 END AS source_turn FROM n WHERE n = 1")
def reattached_fields(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", "role", "text")
    canonical = c.where("role = 'user'").select("sample_id", text.canonical_key("text").alias("canonical_text")).distinct().withColumn("original_forms", F.array("canonical_text"))
    accepted = c.where("role <> 'user'").select("sample_id", F.col("turn").alias("pos"), "text", F.col("turn").alias("source_turn"))
    return ranking.reattach(canonical, accepted, ["source_turn"]).select("sample_id", F.md5(F.col("canonical_text").cast("binary")).alias("canonical"), F.coalesce("source_turn", F.lit(-1)).alias("source_turn"))


@query("""SELECT conv_id, turn, least(turn % 11, 8)::INT AS view_agreement_count, round(least(turn % 11, 8) / 8.0::DOUBLE, 3) AS view_agreement_ratio, CASE WHEN turn % 2 = 0 THEN 0.9 ELSE 0.7 END AS user_segment_importance,
  CASE WHEN (turn % 10) / 10.0 >= 0.6 THEN 1.2 ELSE 0.8 END AS text_weight, CASE WHEN (turn % 10) / 10.0 >= 0.6 THEN 1.0 ELSE 1.5 END AS image_weight FROM conversations""")
def rerank_features(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.slice(F.sequence(F.lit(0), F.lit(10)), F.lit(1), (F.col("turn") % 11).cast("int")).alias("supporting_views"), ((F.col("turn") % 10) / 10.0).alias("overall_alignment"), F.when(F.col("turn") % 2 == 0, "power_user").alias("user_segment"))
    mode = text.switch_mode(F.col("overall_alignment"))
    out = ranking.rerank_features(c)
    return out.select("conv_id", "turn", "view_agreement_count", "view_agreement_ratio", "user_segment_importance", ranking.view_weight(F.lit("text"), mode).alias("text_weight"), ranking.view_weight(F.lit("image"), mode).alias("image_weight"))


@query(f"""WITH {_GOLD}, {_boot(100)}, s AS (SELECT resample, sum(w * pred::INT)::DOUBLE / sum(w) AS s FROM w GROUP BY resample) SELECT count(*) AS resamples, round(avg(s), 9) AS mean, round(quantile_cont(s, 0.025), 9) AS low, round(quantile_cont(s, 0.975), 9) AS high FROM s""")
def bootstrap_mean(spark, d):
    g = _gold(spark, d).select("doc_id", F.col("pred").cast("int").alias("v"))
    out = bootstrap.interval(bootstrap.mean_statistic(g, "doc_id", "v", n=100), "stat")
    return out.select("resamples", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {_FEATURES} SELECT count(*) AS n, round(avg(grounding_score), 9) AS avg_grounding, round(avg(doc_id % 6)::DOUBLE, 9) AS avg_pieces, avg((doc_id % 3 >= 2)::INT) AS multi_modal_coverage, avg((grounding_score < 0.2)::INT) AS ungrounded FROM x""")
def grounding_summary(spark, d):
    f = _features(spark, d).select(F.col("grounding_score").alias("evidence_grounding_score"), (F.col("doc_id") % 6).alias("total_evidence_pieces"), F.slice(F.array(F.lit("text"), F.lit("image")), F.lit(1), (F.col("doc_id") % 3).cast("int")).alias("evidence_modalities"))
    return metrics.grounding(f).withColumns({c: F.round(c, 9) for c in ("avg_grounding", "avg_pieces")})


@query(f"SELECT round(sum(exact_match_rate * n_pred) / sum(n_pred), 9) AS exact_match_rate, round(sum(avg_span_f1 * n_pred) / sum(n_pred), 9) AS avg_span_f1 FROM ({ORACLE['explicit_scores']})")
def explicit_totals(spark, d):
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n_pred")) / F.sum("n_pred"), 9).alias(c)
    return explicit_scores(spark, d).agg(mean("exact_match_rate"), mean("avg_span_f1"))


@query(f"SELECT avg(needs_review::INT) AS needs_review FROM ({ORACLE['review_gate']})")
def review_rate(spark, d):
    return review_gate(spark, d).agg(F.avg(F.col("needs_review").cast("int")).alias("needs_review"))


@query(f"SELECT max(f1) - min(f1) AS gap FROM ({ORACLE['detection_by_slice']}) WHERE slice = 'lang'")
def segment_gap(spark, d):
    return detection_by_slice(spark, d).where("slice = 'lang'").agg((F.max("f1") - F.min("f1")).alias("gap"))


def _part(name: str, dimension: str, *columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{dimension}' AS dimension, '{c}' AS metric, {c}::DOUBLE AS value FROM ({ORACLE[name]})" for c in columns)


@query(" UNION ALL ".join([_part("detection_metrics", "detection", "precision", "recall", "f1", "mcc"), _part("cohen_kappa", "agreement", "kappa"), _part("krippendorff_alpha", "agreement", "alpha"), _part("ndcg_at_10", "ranking", "ndcg"), _part("kendall_tau", "ranking", "tau"), _part("mining_f1", "extraction", "mining_f1"),
  _part("explicit_totals", "unified", "exact_match_rate", "avg_span_f1"), _part("grounding_summary", "grounding", "avg_grounding", "multi_modal_coverage", "ungrounded"), _part("grounding_rates", "hallucination", "ungrounded"),
  _part("false_positive_rate", "false positives", "fp_rate"), _part("topk_precision", "ranking", "precision"), _part("review_rate", "human review", "needs_review"), _part("segment_gap", "gap", "gap")]))
def full_evaluation(spark, d):
    return evaluation.report(
        evaluation.long(detection_metrics(spark, d), "detection", "precision", "recall", "f1", "mcc"), evaluation.long(cohen_kappa(spark, d), "agreement", "kappa"), evaluation.long(krippendorff_alpha(spark, d), "agreement", "alpha"),
        evaluation.long(ndcg_at_10(spark, d), "ranking", "ndcg"), evaluation.long(kendall_tau(spark, d), "ranking", "tau"), evaluation.long(mining_f1(spark, d), "extraction", "mining_f1"),
        evaluation.long(explicit_totals(spark, d), "unified", "exact_match_rate", "avg_span_f1"), evaluation.long(grounding_summary(spark, d), "grounding", "avg_grounding", "multi_modal_coverage", "ungrounded"), evaluation.long(grounding_rates(spark, d), "hallucination", "ungrounded"),
        evaluation.long(false_positive_rate(spark, d), "false positives", "fp_rate"), evaluation.long(topk_precision(spark, d), "ranking", "precision"), evaluation.long(review_rate(spark, d), "human review", "needs_review"), evaluation.long(segment_gap(spark, d), "gap", "gap"),
    )


@query(f"""WITH RECURSIVE {s_greedy(_TURN_ROWS)}, z AS (SELECT cluster_id, count(*) AS size FROM m GROUP BY cluster_id)
  SELECT count(*) AS total_clusters, sum(size)::BIGINT AS total_assignments, round(avg(size), 2) AS avg_cluster_size, max(size) AS max_cluster_size, count(*) FILTER (WHERE size = 1) AS singletons FROM z""")
def cluster_overview(spark, d):
    s = table(spark, d, "conversations").select(F.col("role").alias("domain"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text", F.col("conv_id").alias("sample_id"), F.lit(0.5).alias("confidence"))
    return clusters.cluster_stats(clusters.clusters(clusters.assign_clusters(s)))


@query(f"""WITH {_MEDIA} SELECT count(*) FILTER (WHERE has_image) AS need, count(*) FILTER (WHERE has_image AND media_path IS NOT NULL) AS have, count(*) FILTER (WHERE has_image AND media_path IS NULL) AS missing,
  array_to_string(list_sort(list(entry_id) FILTER (WHERE has_image AND media_path IS NULL)), ',') AS missing_ids FROM r""")
def media_audit(spark, d):
    return media.completeness(_with_media(spark, d), "has_image").withColumn("missing_ids", F.array_join("missing_ids", ","))


_ON_TURNS = f"""{_TURNS}, f AS (SELECT conv_id::VARCHAR AS sample_id, turn::VARCHAR AS suggestion_id, x AS text, y AS original_text, (turn % 10) / 10.0::DOUBLE AS confidence, turn % 2 = 1 AS is_implied, CASE turn % 5 WHEN 0 THEN 'image' ELSE 'text' END AS source_modality,
  CASE turn % 7 WHEN 3 THEN 'sarcasm' END AS speech_act, NULL::VARCHAR AS tone, CASE turn % 3 WHEN 0 THEN x END AS complaint_frame, NULL::VARCHAR AS image_context, NULL::VARCHAR AS audio_context FROM t)"""


@query(f"""WITH {_ON_TURNS}, {_ROUTE} SELECT sample_id, suggestion_id, classified_type, CASE WHEN x THEN 'explicit' ELSE 'implicit' END AS routed_type, CASE WHEN x THEN e_pass ELSE i_pass END AS passed_switch, CASE WHEN x THEN e_faith ELSE faith END AS faithfulness_score,
  CASE WHEN x THEN 0.0 ELSE act END AS actionability_score FROM k""")
def switch_on_turns(spark, d):
    t = F.col("turn")
    s = _turns(spark, d).select(
        F.col("conv_id").cast("string").alias("sample_id"), t.cast("string").alias("suggestion_id"), F.col("x").alias("text"), F.col("y").alias("original_text"), ((t % 10) / 10.0).alias("confidence"), (t % 2 == 1).alias("is_implied"),
        F.when(t % 5 == 0, "image").otherwise("text").alias("source_modality"), F.when(t % 7 == 3, "sarcasm").alias("speech_act"), F.when(t % 3 == 0, F.col("x")).alias("complaint_frame"),
    )
    return routing.switch(s).select("sample_id", "suggestion_id", "classified_type", "routed_type", "passed_switch", "faithfulness_score", "actionability_score")


_SEEN = f"""s AS (SELECT conv_id, turn, {s_keywords('text')} AS k FROM conversations WHERE role = 'user'), c AS (SELECT conv_id, turn AS pos, text, {s_keywords('text')} AS w FROM conversations WHERE role <> 'user'),
  v AS (SELECT conv_id, {s_keywords('min(text)')} AS iw FROM conversations WHERE role = 'user' GROUP BY conv_id), b AS (SELECT s.conv_id, s.turn, c.pos, k, w, iw, {s_inter('k', 'w')} / greatest(1, len(k))::DOUBLE AS r FROM s JOIN c USING (conv_id) JOIN v USING (conv_id))"""


@query(f"""WITH {_SEEN}, e AS (SELECT conv_id, turn, 'shows_problem' AS evidence_role, round(r * 0.8, 3) AS confidence FROM b WHERE r > 0 UNION ALL SELECT conv_id, turn, 'ui_context', 0.75 FROM b UNION ALL SELECT conv_id, turn, 'shows_problem', 0.75 FROM b
  UNION ALL SELECT conv_id, turn, 'missing_element', 0.7 FROM b UNION ALL SELECT conv_id, turn, 'error_state', 0.85 FROM b WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, 'visual_proof', 0.6 FROM b WHERE {s_inter('k', 'iw')} > 0)
  SELECT conv_id AS sample_id, turn AS suggestion_id, evidence_role, count(*) AS n, round(sum(confidence), 6) AS confidence FROM e GROUP BY ALL""")
def image_view_evidence(spark, d):
    """Evidence of captions with views: elements shown and missing, error states, what the image implies."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", "role", "text")
    asked = c.where("role = 'user'").select("sample_id", F.col("turn").alias("suggestion_id"), "text")
    captions = c.where("role <> 'user'").select("sample_id", F.col("turn").alias("image_index"), F.col("text").alias("caption"))
    one = lambda *names: F.array(*[F.lit(n) for n in names])
    views = c.where("role = 'user'").groupBy("sample_id").agg(F.min("text").alias("implied_suggestion")).select(
        "sample_id", one("Progress Bar", "sundial").alias("ui_elements_shown"), one("undo").alias("missing_ui_elements"), one("Error Dialog").alias("error_states_shown"), (F.col("sample_id") % 2 == 0).alias("shows_error"), "implied_suggestion", F.lit(0.6).alias("confidence")
    )
    ev = evidence.image_evidence(asked, captions, views)
    return ev.groupBy("sample_id", "suggestion_id", "evidence_role").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query("""WITH u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), t AS (SELECT conv_id, text, (conv_id % 10) / 10.0 AS urgency FROM conversations WHERE role <> 'user' AND text <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)
  SELECT conv_id AS sample_id, turn AS suggestion_id, length(text)::INT AS chars, round(urgency, 3)::DOUBLE AS confidence FROM u JOIN t USING (conv_id) WHERE urgency > 0.7""")
def tone_evidence(spark, d):
    """The tone of whole transcripts above an urgency of 0.7."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", "role", "text")
    asked = c.where("role = 'user'").select("sample_id", F.col("turn").alias("suggestion_id"), "text")
    first = c.where("role <> 'user' AND text <> ''").groupBy("sample_id").agg(F.min_by(F.struct("text", "turn"), "turn").alias("f")).select("sample_id", F.col("f.text").alias("transcript"), F.col("f.turn").alias("turn"))
    views = first.select("sample_id", ((F.col("sample_id") % 10) / 10.0).alias("urgency_score"))
    ev = evidence.audio_evidence(asked, first.select("sample_id", "transcript"), views).where("evidence_role = 'tone_shift'")
    return ev.select("sample_id", "suggestion_id", F.col("end").alias("chars"), "confidence")


@query("SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
def csv_round_trip(spark, d):
    """Texts with quotes, commas and line breaks, written as CSV and read back with a declared schema."""
    path = fresh(spark, "csv")
    sinks.write_csv(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    back = readers.read_csv(spark, path, "conv_id long, turn long, role string, text string")
    return back.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT l.doc_id::VARCHAR AS id, md5(replace(text, chr(10), ' ')) AS text, quality AS label FROM labels l JOIN documents USING (doc_id)")
def labelled_csv(spark, d):
    """Rows without a text or a whole-number label are dropped when a headerless file is read."""
    path = fresh(spark, "csv")
    said = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    rows = table(spark, d, "labels").join(said, "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("quality").cast("string").alias("label"))
    odd = rows.limit(3).select("id", F.lit(None).cast("string").alias("text"), "label").unionByName(rows.limit(3).withColumn("label", F.lit("x")))
    rows.unionByName(odd).write.option("escape", '"').csv(path)
    return readers.read_labelled(spark, path).select("id", F.md5(F.col("text").cast("binary")).alias("text"), "label")


@query("SELECT count(*) AS entries FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)")
def stored_entries(spark, d):
    return memory.stored_entries(table(spark, d, "conversations"), table(spark, d, "documents"))


@query("SELECT 'alignments' AS name, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS accepted FROM documents UNION ALL SELECT 'decisions', count(*), count(*) FILTER (WHERE doc_id % 3 = 0) FROM documents UNION ALL SELECT 'gold', count(*), count(*) FILTER (WHERE doc_id % 3 = 0) FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'patterns', count(*), count(*) FILTER (WHERE doc_id % 3 = 0) FROM documents")
def recorded_decisions(spark, d):
    """What a batch of judged suggestions appends to each memory, and the gold labels among its decisions."""
    i = F.col("doc_id")
    judged = table(spark, d, "documents").select("text", F.when(i % 3 == 0, "accept").otherwise("reject").alias("decision"), (i % 2 == 0).alias("human_approved"), ((i % 10) / 10.0).alias("alignment_score"), F.lit("text").alias("dominant_modality"), F.col("source").alias("domain"))
    made = memory.decision_rows(judged, "2024-01-01 00:00:00")
    tables = {"alignments": made["alignments"], "decisions": made["decisions"], "gold": memory.gold_labels(made["decisions"]), "patterns": made["patterns"].withColumn("decision", F.when(F.col("accepted"), "accept").otherwise("reject"))}
    out = None
    for name, rows in tables.items():
        row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "accept").alias("accepted")).select(F.lit(name).alias("name"), "n", "accepted")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH a AS (SELECT item_id AS id, {s_set('text')} AS t FROM benchmark), b AS (SELECT DISTINCT text AS id, {s_set('text')} AS t FROM conversations), {s_pairs('a', 'b', 0.0)}
  SELECT left_id AS id, md5(right_id) AS form, similarity, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS pos FROM pairs) WHERE pos <= 3""")
def long_term_forms(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    out = memory.long_term_forms(a, table(spark, d, "conversations").select("text"))
    return out.select("id", F.md5(F.col("canonical_text").cast("binary")).alias("form"), "similarity", "pos")


@query("""WITH r AS (SELECT source, n_chars::DOUBLE AS v, lang = 'en' AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
  SELECT source, round(avg(v), 6) AS mean, round(avg(v) FILTER (WHERE c), 6) AS mean_if, round(avg(v) FILTER (WHERE n <= 5), 6) AS mean_first FROM r GROUP BY source""")
def conditional_means(spark, d):
    out = metrics.means(table(spark, d, "documents"), "source", "n_chars", F.col("lang") == "en", "doc_id", 5)
    return out.select("source", *[F.round(c, 6).alias(c) for c in ("mean", "mean_if", "mean_first")])


@query("""WITH r AS (SELECT conv_id, text, (turn % 7)::DOUBLE AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 7 DESC, turn) AS rank FROM conversations WHERE role = 'user')
  SELECT c.conv_id AS sample_id, (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) AS num_suggestions, (SELECT md5(text) FROM r WHERE r.conv_id = c.conv_id AND rank = 1) AS top_suggestion, (SELECT score FROM r WHERE r.conv_id = c.conv_id AND rank = 1) AS top_score FROM (SELECT DISTINCT conv_id FROM conversations) c""")
def results_per_review(spark, d):
    """Reviews that gave no suggestion reappear with 0 of them."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", "role", "text")
    ranked = ranking.rank(c.where("role = 'user'").withColumn("score", (F.col("turn") % 7).cast("double")), tie="turn")
    out = sinks.pipeline_results(c.select("sample_id").distinct(), ranked)
    return out.select("sample_id", "num_suggestions", F.md5(F.col("top_suggestion").cast("binary")).alias("top_suggestion"), "top_score")


#: What an evaluation should reach.
TARGETS = {"precision": 0.5, "recall": 0.8, "f1": 0.6, "kappa": 0.4, "ndcg": 0.7, "tau": 0.3, "fp_rate": 0.1, "ungrounded": 0.2}


@query(f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in TARGETS.items())}) v(metric, target))
  SELECT dimension, metric, value, target, CASE WHEN metric IN ('fp_rate', 'ungrounded') THEN value <= target ELSE value >= target END AS met FROM ({ORACLE['full_evaluation']}) LEFT JOIN t USING (metric)""")
def evaluation_targets(spark, d):
    """The whole evaluation against what it should reach."""
    return evaluation.against_targets(full_evaluation(spark, d), TARGETS, at_most=("fp_rate", "ungrounded"))


def _stub_client():
    """Stands for a model: what it is asked it answers from the words of the prompt alone."""

    def answer(prompt: str) -> str:
        said = prompt.rpartition("\n\n")[2].partition(": ")[2]
        yes = int(" the " in said or " und " in said)
        return "Here it is:\n```json\n" + json.dumps({"is_suggestion": yes, "label": 1 - yes, "reasoning": "words"}) + "\n```"

    return answer


_HEADS = {style: len(head) for style, (head, _) in BASELINES.items()}


@query(" UNION ALL ".join(f"SELECT doc_id, '{style}' AS style, (contains(left(text, 16000 - {n}), ' the ') OR contains(left(text, 16000 - {n}), ' und ')) {'= false' if style == 'entailment' else ''} AS pred FROM documents" for style, n in _HEADS.items()))
def zero_shot_baselines(spark, d):
    """The three prompts put to a client, replies with prose and fences around the JSON."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_text"))
    out = None
    for style in BASELINES:
        part = zero_shot(ModelProvider(_stub_client, retries=1, pause=0.0), docs, style).select("doc_id", F.lit(style).alias("style"), "pred")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT lang AS system, precision, recall, f1 FROM (" + ORACLE["detection_by_slice"].replace("SELECT slice, value,", "SELECT slice, value AS lang,") + ") WHERE slice = 'lang'")
def metrics_json(spark, d):
    """Metrics written as JSON and read back."""
    path = fresh(spark, "metrics")
    sinks.write_metrics(metrics.detection_by(_gold(spark, d), ["lang"]).where("slice = 'lang'").select(F.col("value").alias("system"), "precision", "recall", "f1"), path)
    return spark.read.schema("system string, precision double, recall double, f1 double").json(path)


@query("""SELECT 'R' || conv_id || '-' || turn AS entry_id, md5(text) AS raw_text, turn % 3 = 0 AS has_image, turn % 2 = 0 AS is_suggestion, CASE turn % 3 WHEN 0 THEN 'a picture' ELSE '' END AS image_description FROM conversations""")
def review_csv(spark, d):
    """Reviews of a CSV file, with flags as people write them and marks for what is missing."""
    path, t = fresh(spark, "csv"), F.col("turn")
    c = table(spark, d, "conversations")
    names = {"entry_id": F.concat(F.lit("R"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string")), "raw_text": F.col("text"), "has_image": F.when(t % 3 == 0, "Yes").otherwise("no"), "has_audio": F.lit("0"), "is_suggestion": F.when(t % 2 == 0, "1.0").otherwise("False")}
    names |= {"image_description": F.when(t % 3 == 0, " a picture ").when(t % 3 == 1, "nan").otherwise("—"), "audio_description": F.lit("None")}
    missing = [F.lit("x").alias(x) for x in readers.REQUIRED if x not in names]
    sinks.write_csv(c.select(*[v.alias(k) for k, v in names.items()], *missing), path)
    return readers.read_reviews(spark, path).select("entry_id", F.md5(F.col("raw_text").cast("binary")).alias("raw_text"), "has_image", "is_suggestion", "image_description")
