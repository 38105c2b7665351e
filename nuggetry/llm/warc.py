"""Merkle fixity audit of WARC archives.

A record is hashed with SHA-256. Records of a file are put into ranges of ``RANGE`` bytes by their offset; the
hash of a range covers offset, length and hash of its records in order; ``FANOUT`` neighbouring nodes make the
node above, up to a root per file. An audit compares the roots of two replicas and follows only differing
nodes down, level by level, to the records.

Trees are groupings of a record table without payloads; every level is computed once, from the level below, and
written in the order of the files. The descent reads of a level what stands below open nodes: up to ``NAMED`` open files
are named in the filter, which skips the pages of the others; more are found by a semi join. A node holds at most
``FANOUT`` children, and a range only as many records as fit into its bytes, so that no group grows with the archive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from math import ceil, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard

RANGE = 1 << 16
FANOUT = 16
PAGES_PER_FILE = 1000
NAMED = 1000


def file_hex(pages: int) -> int:
    """Hex digits of a file's name, by one rule at every size: a file has about ``PAGES_PER_FILE`` records; two at least."""
    return max(2, ceil(log(max(1, pages / PAGES_PER_FILE), 16)))


def record_bytes(uri: F.Column, body: F.Column) -> F.Column:
    """One WARC resource record as text; null is empty."""
    body, uri = F.coalesce(body, F.lit("")), F.coalesce(uri, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, digits: int | None = None, **others: F.Column) -> DataFrame:
    """The record table of an archive of ``pages(page_id, url, html)``: file, offset, length, page_id, digest; and by
    name the digests of ``others``, such as a replica's record of the same page.

    Files are buckets of the MD5 of the id, records lie in them by id, and rows that agree in id by hash, so
    that equal rows are interchangeable; rows without an id go by their url. Payloads are hashed where they are read and
    not shuffled; null html and url are empty; further columns are left alone.
    """
    digits = digits or file_hex(pages.count())
    record = record_bytes(F.col("url"), F.col("html")).cast("binary")
    slim = pages.select(
        F.concat(F.lit("part-"), F.substring(_id_md5(F.col("url")), 1, digits)).alias("file"),
        F.octet_length(record).cast("long").alias("length"),
        "page_id",
        F.sha2(record, 256).alias("digest"),
        *[F.sha2(c.cast("binary"), 256).alias(n) for n, c in others.items()],
    )
    upto = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    return slim.select("file", (F.sum("length").over(upto) - F.col("length")).alias("offset"), "length", "page_id", "digest", *others)


def _id_md5(*otherwise: F.Column) -> F.Column:
    """MD5 of the id, of what stands for a null one, or of nothing."""
    return F.md5(F.coalesce(F.col("page_id").cast("string"), *otherwise, F.lit("")).cast("binary"))


#: Bytes within which the head of a record ends.
HEAD = 1 << 16
_HEAD_END = re.compile(rb"\r\n\r\n")
_START = re.compile(rb"(?<=\r\n\r\n)WARC/")


def parse(data: memoryview | bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, uri) of the records of a file, one after the other, which cover it whole.

    Where no record starts that has a head and a whole number as Content-Length (names in any case), what follows up to the
    next start counts as one record, so that a broken head hides none but its own.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        head_end = _HEAD_END.search(view, at, at + HEAD) if bytes(view[at : at + 5]) == b"WARC/" else None
        lines = bytes(view[at : head_end.start()]).split(b"\r\n")[1:] if head_end else []
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in reversed(lines))}
        size = head.get(b"content-length", b"")
        if head_end and size.isdigit() and len(size) < 19:
            end = min(len(view), head_end.end() + int(size) + 4)
        else:
            following = _START.search(view, at + 1)
            end = following.start() if following else len(view)
        yield at, end, head.get(b"warc-target-uri", b"").decode(errors="replace")
        at = end


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*batch.columns):
            view, name = memoryview(content.as_buffer()), path.as_py().rpartition("/")[2]
            rows = [(name, start, end - start, uri, sha256(view[start:end]).hexdigest()) for start, end, uri in parse(view)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "offset", "length", "uri", "digest"])


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """The record table of uncompressed WARC files (under 2 GB each) at ``path``: file, offset, length, page_id (null),
    digest, and uri. Bytes in which no record starts, or one with a broken head, count as one record up to the next start."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse, "file string, offset long, length long, uri string, digest string").select("file", "offset", "length", F.lit(None).cast("long").alias("page_id"), "digest", "uri")


def _hash(items: F.Column) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(items)), "\n").cast("binary"), 256)


def tree(recs: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (file, node, hash) from the ranges, level 0, to the roots, each written once."""
    place = F.lpad(F.col("offset").cast("string"), 20, "0")
    ranges = recs.groupBy("file", F.floor(F.col("offset") / RANGE).alias("node")).agg(_hash(F.concat_ws(" ", place, F.col("length").cast("string"), "digest")).alias("hash"))
    out = [cut(ranges.sortWithinPartitions("file", "node"))]
    for _ in range(levels - 1):
        child = F.concat_ws(" ", F.lpad(F.col("node").cast("string"), 20, "0"), "hash")
        above = out[-1].groupBy("file", F.floor(F.col("node") / FANOUT).alias("up")).agg(_hash(child).alias("hash")).withColumnRenamed("up", "node")
        out.append(cut(above.sortWithinPartitions("file", "node")))
    return out


def _below(df: DataFrame, up: F.Column, open_nodes: DataFrame, names: list[str] | None) -> DataFrame:
    """The rows of ``df`` whose node above is open."""
    df = df.where(F.col("file").isin(names)) if names is not None else df
    return df.withColumn("_up", up).join(open_nodes.withColumnRenamed("node", "_up"), ["file", "_up"], "left_semi").drop("_up")


def audit(ours: DataFrame, theirs: DataFrame, trace: list | None = None) -> DataFrame:
    """Records in which two replicas differ: file, offset, page_id, expected, found and fault.

    ``ours`` and ``theirs`` are record tables (file, offset, length, page_id, digest) that are read several times:
    write them first. Faults are ``altered`` (other bytes or length at the offset), ``missing`` and ``extra``. Equal
    archives, and two empty ones, give no row. Records that repeat an offset are matched in the order of digest and
    length; further columns of the tables are left alone. ``trace`` gets a row per level, roots first: nodes
    compared and nodes found open; then the same of records.
    """
    furthest = ours.select("offset").unionByName(theirs.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = 1 + ceil(log(max(1, furthest // RANGE + 1), FANOUT) - 1e-9)
    left, right = tree(ours, levels), tree(theirs, levels)
    open_nodes, names = None, None
    for a, b in zip(reversed(left), reversed(right)):
        if open_nodes is not None:
            a, b = (_below(x, F.floor(F.col("node") / FANOUT), open_nodes, names) for x in (a, b))
        both = a.join(b.withColumnRenamed("hash", "other"), ["file", "node"], "full")
        open_nodes = cut(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node"))
        found = [r[0] for r in open_nodes.select("file").distinct().limit(NAMED + 1).collect()]
        names = found if len(found) <= NAMED else None
        if trace is not None:
            trace.append((both.count(), open_nodes.count()))

    nth = F.row_number().over(Window.partitionBy("file", "offset").orderBy("digest", "length"))
    up = F.floor(F.col("offset") / RANGE)
    a, b = (_below(x.select("file", "offset", "length", "page_id", "digest"), up, open_nodes, names).withColumn("_n", nth) for x in (ours, theirs))
    a = a.withColumnRenamed("digest", "expected")
    b = b.select("file", "offset", "_n", F.col("length").alias("_l"), F.col("page_id").alias("_p"), F.col("digest").alias("found"))
    both = a.join(b, ["file", "offset", "_n"], "full")
    fault = F.when(F.col("expected").isNull(), "extra").when(F.col("found").isNull(), "missing").otherwise("altered")
    differ = ~(F.col("expected").eqNullSafe(F.col("found")) & F.col("length").eqNullSafe(F.col("_l")))
    out = cut(both.where(differ).select("file", "offset", F.coalesce("page_id", "_p").alias("page_id"), "expected", "found", fault.alias("fault")))
    if trace is not None:
        trace.append((both.count(), out.count()))
    for done in (*left, *right, open_nodes):
        discard(done)
    return out


def audit_drill(pages: DataFrame) -> DataFrame:
    """Archive ``pages``, and audit a replica with known damage, which is hashed from its own bytes: by the MD5 of the
    id, one page in 97 has a changed byte at its end and one in 101 is gone; the rest lies at the same offset."""
    html, mark = F.coalesce("html", F.lit("")), F.conv(F.substring(_id_md5(), 1, 8), 16, 10).cast("long")
    rotten = F.concat(F.substring(html, 1, F.greatest(F.lit(0), F.length(html) - 1)), F.lit("\x01"))
    copy = record_bytes(F.col("url"), F.when(mark % 97 == 0, rotten).otherwise(html))
    both = cut(records(pages, copied=copy))
    theirs = both.where(mark % 101 != 1).select("file", "offset", "length", "page_id", F.col("copied").alias("digest"))
    return audit(both.drop("copied"), theirs)
