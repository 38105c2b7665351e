"""Small tables and plain counterparts that the tests of this folder share."""

import re

from pyspark.sql import Row

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = re.compile("[^\x20\x09-\x0d]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def docs(spark, texts, **columns):
    """A documents table of these texts, ids from 0."""
    n = len(texts)
    lang, source = columns.get("lang", ["en"] * n), columns.get("source", ["s"] * n)
    ids = columns.get("doc_id", range(n))
    rows = [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in zip(ids, texts, lang, source)]
    return spark.createDataFrame(rows, DOC)


def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = "word " * 60_000 + "end"
    rows = [(1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (2, "a b c", None, None, None), (3, "", "en", "x", 0), (4, None, None, "y", None), (None, "lost id here", "fr", "y", 12), (5, long, "en", None, len(long)), (6, long, "en", "z", len(long)), (7, " \t\n", "de", "z", 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def clashing(df):
    """The same rows with columns named like outputs, in other cases too."""
    from pyspark.sql import functions as F

    names = ("Size", "target", "FOUND", "shard", "score", "spans", "fp", "key", "component_id", "lang_pred", "grade")
    return df.select("*", *[F.lit("clash").alias(n) for n in names])


def rows(df):
    return [r.asDict() if isinstance(r, Row) else r for r in df.collect()]
