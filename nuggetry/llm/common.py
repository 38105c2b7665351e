"""What the operators of this subpackage share: cutting lineage, word splitting, column hygiene."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import discard, positions, settle, small, spread  # noqa: F401

#: Words of the contracts that split on ASCII whitespace.
WHITE_WORD = r"[^\x20\x09-\x0D]+"

_DELIM = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
WORD_TABLE = bytes.maketrans(_DELIM + bytes(range(65, 91)), b" " * len(_DELIM) + bytes(range(97, 123)))
#: Lower-cases A-Z only.
LOWER_TABLE = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The six ASCII whitespace characters of WHITE_WORD, as one space each.
SPACE_TABLE = bytes.maketrans(b"\t\n\v\f\r", b"     ")

def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at files that outlive an executor."""
    return settle(df, "cut")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns (matched as Spark matches them, by case-insensitive name) that an operator adds."""
    low = {n.lower() for n in names}
    return df.drop(*[df[f"`{c}`"] for c in df.columns if c.lower() in low]) if low & {c.lower() for c in df.columns} else df


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and whole rows as ``_row``: what an operator adds on the way can't touch columns of that name."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def white_words(text: Column) -> Column:
    """Number of whitespace-separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WHITE_WORD)), F.lit(0)).cast("long")


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]


def slices(texts: pa.Array, most: int = 2 << 20):
    """``texts`` in runs of rows of about ``most`` bytes (at least a row each), so that memory stays bounded by
    the longest text instead of by rows times the longest text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    width = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends, at = np.cumsum(width), 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield texts.slice(at, to - at)
        at = to
