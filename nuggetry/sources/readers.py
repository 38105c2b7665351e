"""Readers: review and result tables from CSV with declared schemas, and from spreadsheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_bool, without_sentinel
from .work import small

REVIEWS = "entry_id string, domain string, raw_text string, has_image string, image_description string, has_audio string, audio_description string, modality_combo string, is_suggestion string, extraction_path string, suggestion_text string, suggestion_type string"
REQUIRED = ["entry_id", "domain", "raw_text", "has_image", "image_description", "has_audio", "audio_description", "modality_combo", "is_suggestion", "extraction_path"]
TEXT_COLUMNS = ["raw_text", "text", "review_text"]


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """Quoted CSV whose fields may hold commas, quotes and line breaks. Without a schema every column is a string."""
    reader = spark.read.option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """The same with types inferred, at the price of a second pass."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", True).csv(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Headerless (id, text, label); rows without a text or a whole-number label are dropped."""
    rows = read_csv(spark, path, "id string, text string, label string", header=False)
    return rows.withColumn("label", F.expr("try_cast(label AS int)")).dropna(subset=["text", "label"])


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    """Position, from 0, of the column of a cell reference such as AB12."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, values as text) of a sheet of an Office Open XML workbook; cells that are left out are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if e.tag == _SHEET + "si":
                    shared.append("".join(t.text or "" for t in e.iter(_SHEET + "t")))
                    e.clear()
        for _, e in ElementTree.iterparse(book.open(f"xl/worksheets/sheet{sheet}.xml")):
            if e.tag != _SHEET + "row":
                continue
            values: list[str | None] = []
            for i, c in enumerate(e.iter(_SHEET + "c")):
                at = _column(c.get("r")) if c.get("r") else i
                values += [None] * (at + 1 - len(values))
                kind, v = c.get("t"), c.find(_SHEET + "v")
                if kind == "inlineStr":
                    values[at] = "".join(t.text or "" for t in c.iter(_SHEET + "t"))
                elif v is not None and v.text is not None:
                    values[at] = shared[int(v.text)] if kind == "s" else {"0": "False", "1": "True"}.get(v.text, v.text) if kind == "b" else v.text
            yield int(e.get("r") or 0), values
            e.clear()


def read_sheet(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """The rows of a sheet of each workbook at ``path``, as text, named by the first row of the first workbook. A workbook
    is read by one task, so large tables should come as other files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                rows = list(sheet_rows(content.as_py(), sheet))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.string()))], names=["path", "row", "values"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row int, values array<string>")
    first = rows.orderBy("path", "row").first()
    if first is None:
        raise ValueError("the workbook has no rows")
    head = rows.groupBy("path").agg(F.min("row").alias("_head"))
    body = rows.join(small(head), "path").where(F.col("row") > F.col("_head"))
    return body.select(*[F.get("values", F.lit(i)).alias(name) for i, name in enumerate(first["values"]) if name])


def require_columns(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """``df``, or an error that names the missing columns."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def text_column(df: DataFrame, candidates: list[str] = TEXT_COLUMNS) -> str:
    """The first of the candidate columns that is there."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {', '.join(candidates)} is a column")


def read_reviews(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Reviews with booleans and missing descriptions normalised; ``limit`` takes the first by entry_id."""
    df = require_columns(read_csv(spark, path))
    for c in ("has_image", "has_audio", "is_suggestion"):
        df = df.withColumn(c, parse_bool(c))
    for c in ("image_description", "audio_description"):
        df = df.withColumn(c, without_sentinel(c))
    return df.orderBy("entry_id").limit(limit) if limit else df


#: A few labelled sentences of our own for a first run without files.
INLINE = [
    ("Please add a way to export my notes as plain text.", 1), ("It would help if the map remembered my last route.", 1), ("The ferry left on time and the sea was calm.", 0), ("You should let us mute single threads.", 1),
    ("I finished the puzzle in two evenings.", 0), ("Why not offer a smaller plate for lunch?", 1), ("The waiter told us about the harbour.", 0), ("The timer keeps freezing whenever a call comes in.", 1),
    ("We walked home along the canal.", 0), ("Consider putting the sizes next to the prices.", 1),
]


def inline_labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INLINE, "text string, label int")


def annotation_sheet(df: DataFrame, columns: list[str], blank: list[str]) -> DataFrame:
    """The columns to annotate with empty ones to fill in."""
    return df.select(*columns, *[F.lit("").alias(b) for b in blank])


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows, the same in every run: the first in the order of a seeded hash of the key."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).orderBy("_h", key).limit(n).drop("_h")
