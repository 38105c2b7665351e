"""Our own sentences, for rules that the synthetic tables never trigger. Tests take them as they are; the registered queries
deal them to the rows of the given tables, so that their work grows with these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUGGESTION_COLUMNS = "sample_id string, suggestion_id string, text string, original_text string, confidence double, is_implied boolean, source_modality string, speech_act string, tone string, complaint_frame string, image_context string, audio_context string"
SUGGESTIONS = [
    ("r1", "a", "Add a cancel button to the upload screen", "Please add a cancel button to the upload screen, it takes forever.", 0.92, False, "text", None, None, None, None, None),
    ("r1", "b", "Fix everything", "Please fix everything now", 0.95, False, "text", None, None, "null", None, None),
    ("r1", "c", "Reduce upload time", "The upload is so slow. I gave up.", 0.81, True, "text", None, None, None, "a spinner over the upload page", None),
    ("r2", "a", "Enable dark mode", "You should enable dark mode", 0.79, False, "text", None, None, None, None, None),
    ("r2", "b", "Add offline search like Spotify does", "I want offline search, like spotify has. Terrible without it.", 0.7, False, "text", None, None, None, None, None),
    ("r2", "c", "never crash", "It always crashes.", 0.9, True, "audio", None, None, "It always crashes", None, "it crashes ALL the time"),
    ("r3", "a", "Show prices", "Oh great, another menu without prices", 0.85, False, "text", "sarcasm", None, None, None, None),
    ("r3", "b", "Include a filter for spicy dishes", "Could you include a filter for spicy dishes? Unlike other apps you have none.", 0.6, False, "text", None, None, None, None, None),
    ("r3", "c", "", "", 0.5, False, "text", None, None, None, None, None),
    ("r4", "a", "Optimize: battery use", "The battery use is frustrating. Optimize battery use please.", 0.88, False, "text", None, None, None, None, None),
    ("r4", "b", "improve the font size of the page and the layout of the menu for older readers", "The font size is too small and the layout is awful.", 0.93, True, "cross_modal", None, "ironic", None, "tiny font size", None),
    ("r5", "a", "Ünterstützung für Export hinzufügen", "Export fehlt.", 0.8, False, "text", None, None, None, None, None),
]

TEXT_COLUMNS = "id int, text string, domain string"
TEXTS = [
    (1, "Please add an export button.", "tech_software"),
    (2, "The app keeps freezing. It is broken! I wish it were faster; it should be.", "tech_software"),
    (3, "Absolutely love it, works perfectly.", "tech_software"),
    (4, "The soup was cold. They fixed it on the second visit.", "restaurant"),
    (5, "But the terror of the menu remains: too small to read", "restaurant"),
    (6, "don't touch the menu. Much better now", "restaurant"),
    (7, "", "tech_software"),
    (8, "However nice, can't find the door", "unknown"),
    (9, "Oh great, what a feature. If you say so", "tech_software"),
    (10, "A disappointing, mediocre and inconvenient evening", None),
    (11, "Könnte man das Menü größer drucken? Would be nice.", "restaurant"),
]

REVIEW_COLUMNS = "sample_id string, domain string, raw_text string, image_description string, audio_description string, overall_alignment double, user_segment string"
REVIEWS = [
    ("v1", "tech_software", "Please add a progress bar to the upload page. The upload is so slow. I love the colours.", "upload page without a progress bar", "—", 0.8, "power_user"),
    ("v2", "tech_software", "It keeps crashing when I search. Unlike other apps it has no undo. You should add an undo button!", None, "It keeps CRASHING, um, when I search", 0.4, "casual"),
    ("v3", "restaurant", "Lovely evening, the soup was perfect.", None, None, 0.9, None),
    ("v4", "restaurant", "The menu is terrible to read. Could you include a larger font size on the menu?", "a dark menu with tiny font size", "the menu is really terrible to read", 0.0, "regular"),
    ("v5", "restaurant", "", None, None, None, None),
]

MEDIA_ROWS = [("GEN-1", "pics/One.JPG", None, True), ("GEN-2", None, None, True), ("GEN-3", None, "a red button", True), ("GEN-4", "gone.png", None, True), ("GEN-5", None, "nan", False)]
MEDIA_FILES = [("file:/m/one.jpg", 10), ("file:/m/gen_2.png", 30 << 20), ("file:/m/other.wav", 5)]


def reviews(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REVIEWS, REVIEW_COLUMNS)


def numbered(rows: list[tuple], schema: str) -> tuple[list[tuple], str]:
    """The rows with a first column i, from 0."""
    return [(i, *r) for i, r in enumerate(rows)], f"i int, {schema}"


def dealt(rows: DataFrame, nth: Column, fixed: list[tuple], schema: str) -> DataFrame:
    """``rows`` with the columns of the fixed row that the number ``nth`` comes to, round and round."""
    f = rows.sparkSession.createDataFrame(*numbered(fixed, schema))
    return rows.withColumn("_i", nth % len(fixed)).join(F.broadcast(f), F.col("_i") == F.col("i")).drop("_i", "i")  # the few rows of this module


def values(rows: list[tuple], schema: str, name: str) -> str:
    """The same rows as a SQL common table expression."""
    columns, kinds = zip(*(c.strip().split(" ") for c in schema.split(",")))

    def literal(v, kind: str) -> str:
        body = "NULL" if v is None else str(v) if kind != "string" else "'" + v.replace("'", "''") + "'"
        return f"CAST({body} AS {'VARCHAR' if kind == 'string' else kind})"

    body = ", ".join("(" + ", ".join(literal(v, k) for v, k in zip(r, kinds)) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"
