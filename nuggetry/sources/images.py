"""Images made fit to be sent: decoded by Spark's image source, averaged down and written as PNG, in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mime_type
from .media import IMAGE_EXTENSIONS, LARGEST, with_names

#: Fixed value: the longest side of an image that is sent.
LONGEST_SIDE = 1568
#: Most files that are named one by one.
NAMED = 10_000


def _averaged(x: np.ndarray, size: int) -> np.ndarray:
    """``x`` along its first axis in ``size`` equal parts, each the mean of what it covers, parts of rows by their share."""
    edges = np.linspace(0, len(x), size + 1)
    out = np.empty((size, *x.shape[1:]))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        first, last = int(a), min(len(x), int(np.ceil(b - 1e-9)))
        share = np.minimum(np.arange(first, last) + 1, b) - np.maximum(np.arange(first, last), a)
        out[i] = np.tensordot(share / share.sum(), x[first:last].astype(float), 1)
    return out


def shrunk(image: np.ndarray, longest: int = LONGEST_SIDE) -> np.ndarray:
    """An image (height, width, channels) of bytes whose longest side is ``longest`` at most, in the same proportions."""
    height, width = image.shape[:2]
    if max(height, width) <= longest:
        return image
    h, w = (max(1, round(s * longest / max(height, width))) for s in (height, width))
    small = _averaged(_averaged(image, h).swapaxes(0, 1), w).swapaxes(0, 1)
    return np.clip(np.rint(small), 0, 255).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """The bytes of a PNG file of an image of 1, 3 or 4 channels (grey, red green blue, and opacity)."""
    height, width, channels = image.shape

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    lines = np.concatenate((np.zeros((height, 1), np.uint8), image.reshape(height, -1)), axis=1)  # each after the number of its filter, none
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _shrink(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, height, width, channels, data in zip(*batch.columns):
                image = np.frombuffer(data.as_buffer(), np.uint8).reshape(height.as_py(), width.as_py(), channels.as_py())
                image = shrunk(image, longest)
                image = image[:, :, [2, 1, 0, 3][: image.shape[2]]] if image.shape[2] > 1 else image  # the source gives blue first
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([image.shape[1]], pa.int32()), pa.array([image.shape[0]], pa.int32()), pa.array([png(np.ascontiguousarray(image))], pa.binary())], names=["path", "width", "height", "content"])

    return run


def resized(spark: SparkSession, paths: list[str] | str, longest: int = LONGEST_SIDE) -> DataFrame:
    """(path, width, height, content): the images at ``paths`` as PNG files whose longest side is ``longest`` at most. Files that
    the source can't decode are left out. An image at a time is held."""
    decoded = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(paths).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return decoded.mapInArrow(_shrink(longest), "path string, width int, height int, content binary")


def _plain(path: str):
    """A path without the empty host that some sources write."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def sendable(spark: SparkSession, folder: str, largest: int = LARGEST, longest: int = LONGEST_SIDE) -> DataFrame:
    """(path, mime_type, content) of all images below ``folder``: files up to ``largest`` bytes as they are, larger ones as smaller
    PNG files; of those, what can't be decoded is left out. Up to ``NAMED`` large files are decoded by name; if there are more,
    all of the folder are decoded and the large ones taken."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    known = with_names(files).where(F.col("extension").isin(IMAGE_EXTENSIONS))
    as_is = known.where(F.col("length") <= largest).select("path", mime_type("path").alias("mime_type"), "content")
    large = known.where(F.col("length") > largest).select("path")
    named = [r[0] for r in large.limit(NAMED + 1).collect()]
    if not named:
        return as_is
    smaller = resized(spark, named if len(named) <= NAMED else folder, longest).withColumn("path", _plain("path"))
    smaller = smaller.join(large.select(_plain("path").alias("path")), "path", "left_semi")
    return as_is.unionByName(smaller.select("path", F.lit("image/png").alias("mime_type"), "content"))
