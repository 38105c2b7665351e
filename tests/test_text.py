import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nuggetry.functions import lexicon as lex
from nuggetry.functions import rules, text

STRIP = ".,!?;:'\"()-"
sample = st.lists(st.text(st.sampled_from("abAB .,!?é_s-'"), max_size=24), min_size=1, max_size=8)


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def keywords(t):
    return {w for w in {x.lower().strip(STRIP) for x in t.split() if len(x) > 2} - set(lex.EVIDENCE_STOPWORDS) if w}


def stem(w):
    for s in lex.SUFFIXES:
        if w.endswith(s) and len(w) > len(s) + 2:
            return w[: -len(s)]
    return w


@given(sample)
@settings(max_examples=20, deadline=None)
def test_tokens_against_python(spark, texts):
    got = column(spark, texts, F.struct(text.token_set("t"), text.keywords("t"), text.stems("t"), text.word_count("t"), text.normalised("t")))
    for t, (tokens, keys, stems, n, normal) in zip(texts, got):
        assert set(tokens) == set(t.lower().split()) and len(tokens) == len(set(tokens))
        assert set(keys) == keywords(t)
        assert set(stems) == {stem(w) for w in re.findall(r"\w+", t.lower()) if len(w) > 2}
        assert n == len(t.split()) and normal == re.sub(r"\s+", " ", t.lower().strip())


@given(st.lists(st.tuples(*[st.text(st.sampled_from("abc "), max_size=9)] * 2), min_size=1, max_size=8))
@settings(max_examples=20, deadline=None)
def test_similarities(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    a, b = text.token_set("a"), text.token_set("b")
    rows = df.orderBy("i").select(text.jaccard(a, b), text.jaccard(b, a), text.dice(a, b), text.overlap_min(a, b)).collect()
    for (x, y), (j, k, f, m) in zip(pairs, rows):
        x, y = set(x.split()), set(y.split())
        assert j == k and 0 <= j <= 1
        assert abs(j - (len(x & y) / len(x | y) if x | y else 0)) < 1e-12
        assert abs(f - (2 * len(x & y) / (len(x) + len(y)) if x or y else 0)) < 1e-12
        assert abs(m - (len(x & y) / min(len(x), len(y)) if x and y else 0)) < 1e-12


def test_action_split(spark):
    texts = ["Add a cancel button", "the team should fix: the map", "Nothing here", "", "  improve,", "MAKE it"]
    got = [tuple(r) for r in column(spark, texts, text.split_action("t"))]
    assert got == [("Add", "a cancel button"), ("fix:", "the map"), ("", "Nothing here"), ("", ""), ("improve,", ""), ("MAKE", "it")]


def test_complaint(spark):
    texts = ["All fine. It is SLOW today. Never mind", "x" * 300, ""]
    assert column(spark, texts, text.complaint("t", F.lit("null"))) == ["It is SLOW today", "x" * 200, ""]
    assert column(spark, ["a"], text.complaint("t", F.lit("given"))) == ["given"]


def test_json_replies(spark):
    texts = ['```json\n{"a": 1}\n```', 'ok {"a": {"b": "}"}} end', "none", '{"a": 1} and {"b": 2}', '{"x": [ {"text": "T", "confidence": 0.9} , {"text": "U", "confidence": 0.5}', "[1, 2]"]
    assert column(spark, texts, text.json_object("t")) == ['{"a": 1}', '{"a": {"b": "}"}}', None, '{"a": 1}', '{"suggestions": [{"text": "T", "confidence": 0.9}, {"text": "U", "confidence": 0.5}]}', None]


def test_narrowing_and_sentence_index(spark):
    found = F.array(F.lit("button"))
    rows = column(spark, ["Please add a button to this very long screen", "nothing at all", "button x x x x x x x x button"], text.locate_words("t", found))
    assert [tuple(r) for r in rows] == [(11, "a button to"), (0, "nothing at all"), (0, "button x x x x x x x x button")]
    sents = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end")), F.struct(F.lit(6).alias("start"), F.lit(9).alias("end")))
    assert spark.range(1).select(text.sentence_index(F.lit(5), sents), text.sentence_index(F.lit(7), sents), text.sentence_index(F.lit(50), sents)).first()[:] == (0, 1, 0)


def test_emphasis_and_features(spark):
    assert column(spark, ["I REALLY mean it, very. ok"], rules.emphasis_words("t")) == [["I", "REALLY", "very."]]
    a = F.struct(
        F.lit("angry").alias("tone"), F.lit(190.0).alias("speaking_rate_wpm"), F.array(*[F.struct(F.lit(w).alias("word"), F.lit(r).alias("energy_ratio")) for w, r in (("a", 1.5), ("b", 1.9), ("c", 1.5), ("d", 1.4))]).alias("emphasis"),
        F.lit(4).alias("pause_count"), F.lit(1.25).alias("longest_pause_seconds"), F.lit(60.0).alias("pitch_variability"), F.lit(0.01).alias("energy_variability"), F.lit(9.0).alias("duration_seconds"),
    )
    said = spark.range(1).select(rules.acoustic_description(a), rules.acoustic_features(a)).first()
    assert said[0].startswith("Audio: angry tone, rapid pace, strong emphasis on b, a, c, 4 pauses (longest 1.") and said[0].endswith("highly variable pitch (emotional).")
    assert "emphasis=a/b/c/d" in said[1]


def test_one_pass_finds_what_the_patterns_find(spark):
    """Needed literals stand in every match, and the rules by one pass are the rules one by one."""
    import random
    import re

    from nuggetry.functions import lexicon as lex
    from nuggetry.functions import rules
    from nuggetry.functions.automaton import needed

    assert needed(r"keeps?\s+(?:crash|freez)") == {"crash", "freez"} and needed(r"[!]{2,}") == {"!"} and needed(r"\w+") is None and needed("(a|bc)d?") == {"a", "bc"} and needed("x*") is None
    rnd = random.Random(1)
    words = "please add can you like it does has this that keeps crashing so slow too big always never going better than the would love wish there doesn't work !! urgent lost I need to other apps offers compared to cant use anymore ÄRGER Bad SHOULD".split(" ")
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 9))) for _ in range(600)] + [None, ""]
    for patterns in [*lex.ROLE_PATTERNS.values(), lex.IMPLICIT_COMPLAINTS]:
        for t in texts[:-2]:
            if (must := needed("|".join(patterns))) is not None and re.search("|".join(patterns), t.lower()):
                assert any(w in t.lower() for w in must)
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", rules.SCAN.hits("text"))
    found = rules.detection("text", F.col("h"))
    one = {"rule": rules.rule_detect("text"), "cue_or_negative": rules.cue_or_sentiment("text"), "role": rules.span_role("text")}
    bad = df.where(~sum(((c.eqNullSafe(one[k])).cast("int") for k, c in found.items()), F.lit(0)).eqNullSafe(3))
    assert bad.count() == 0
    counted = df.select((rules.SCAN.count(F.col("h"), "cues") == rules.n_of("text", lex.SUGGESTION_CUES)).alias("same"))
    assert counted.where("same").count() == len(texts)
