"""Merkle dataset manifest with a proof for every row.

A row's leaf is the hash of its columns. Leaves of a group stand in order, runs of ``arity`` neighbours make the node
above, the last run being what is left, up to the group's root; the roots make a tree of their own.

Trees grow by events. A node that arrives is put into its parent's slot by its index; once a parent holds as many
children as the group's size says it has, its digest is an event of its own, up to the highest ancestor that can be
told. Partial parents are combined where the rows lie first, in windows of bounded size, so that of a window of
neighbours only the few subtrees at its ends are left; this frontier is dealt out anew by the ancestor that covers
``STRIDE`` more levels, until it is roots. Every node keeps a reverse link: the highest ancestor it led to, and
the siblings on the way. Links of one round join those of the next to whole proofs.

Texts are hashed where they are read; only digests are sorted and shuffled. What meets in one task is one window
of leaves, or the frontier below one ancestor, both of a size that does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, positions, small

ARITY = 2
#: Leaves in one window of the first round, and windows that a later round puts below one ancestor.
WINDOW, STRIDE = 1 << 13, 1 << 10
#: Rows of proofs that are broadcast at most; beyond, proofs join in a shuffle.
PROOF_ROWS = 20_000
SALT = 29

_LINK = "tree long, n long, level int, pos long, top_level int, top_pos long, top binary, path array<struct<l: binary, r: binary>>"
_PATH = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))
_KINDS = {"tree": pa.int64(), "n": pa.int64(), "level": pa.int32(), "pos": pa.int64(), "top_level": pa.int32(), "top_pos": pa.int64(), "top": pa.binary(), "path": _PATH}

Node = tuple[int, int, int, int, bytes]


def node_digest(children: list[bytes]) -> bytes:
    """The digest of a run of children: SHA-256 of their hex digests one after the other."""
    return sha256(b"".join(children).hex().encode()).digest()


class Forest:
    """The nodes of a window, with partial parents: (tree, level, position) to the children that have arrived, by index."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.digests: dict[tuple[int, int, int], bytes] = {}
        self.partial: dict[tuple[int, int, int], dict[int, bytes]] = {}
        self.whole: dict[tuple[int, int, int], list[bytes]] = {}

    def add(self, tree: int, n: int, level: int, pos: int, digest: bytes) -> None:
        """One event, and those that follow from it."""
        width = n
        for _ in range(level):
            width = -(-width // self.arity)
        self.digests[tree, level, pos] = digest
        while width > 1:
            level, index, pos = level + 1, pos % self.arity, pos // self.arity
            slot = self.partial.setdefault((tree, level, pos), {})
            slot[index] = digest
            if len(slot) < min(self.arity, width - self.arity * pos):
                return
            del self.partial[tree, level, pos]
            children = [slot[i] for i in range(len(slot))]
            self.whole[tree, level, pos] = children
            digest = self.digests[tree, level, pos] = node_digest(children)
            width = -(-width // self.arity)

    def link(self, tree: int, level: int, pos: int) -> tuple[int, int, bytes, list[dict[str, bytes]]]:
        """The highest ancestor of a node that can be told, its digest, and the siblings left and right on the way."""
        path = []
        while children := self.whole.get((tree, level + 1, pos // self.arity)):
            i = pos % self.arity
            path.append({"l": b"".join(children[:i]), "r": b"".join(children[i + 1 :])})
            level, pos = level + 1, pos // self.arity
        return level, pos, self.digests[tree, level, pos], path


def _links(nodes: list[Node], arity: int) -> list[pa.Array]:
    forest = Forest(arity)
    for node in nodes:
        forest.add(*node)
    tops = [forest.link(tree, level, pos) for tree, _, level, pos, _ in nodes]
    columns = [[x[i] for x in nodes] for i in range(4)] + [[t[i] for t in tops] for i in range(4)]
    return [pa.array(c, k) for c, k in zip(columns, _KINDS.values())]


def _windows(arity: int, window: int):
    """Links of some leaves at a time, ``row`` carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, window):
                held.append(batch.slice(at, window))
                n += held[-1].num_rows
                if n >= window:
                    yield linked(held)
                    held, n = [], 0
        if held:
            yield linked(held)

    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        some = pa.Table.from_batches(held).combine_chunks()
        tree, n, pos, digest = (some.column(c).to_pylist() for c in ("tree", "n", "pos", "digest"))
        out = _links(list(zip(tree, n, [0] * len(pos), pos, digest)), arity)
        rows = some.column("row")
        return pa.RecordBatch.from_arrays([*out, rows.chunk(0) if rows.num_chunks else pa.array([], rows.type)], names=[*_KINDS, "row"])

    return run


def _together(arity: int):
    def run(group: pa.Table) -> pa.Table:
        columns = (group.column(c).to_pylist() for c in ("tree", "n", "level", "pos", "digest"))
        return pa.Table.from_arrays(_links(list(zip(*columns)), arity), names=list(_KINDS))

    return run


def _levels(count: int, arity: int) -> int:
    """The least power of the arity that reaches ``count``."""
    level = 0
    while arity**level < count:
        level += 1
    return level


def grow(leaves: DataFrame, arity: int = ARITY, window: int = WINDOW, stride: int = STRIDE, trace: list | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The proofs of ``leaves(tree, n, pos, digest, row)``, positions from 0 in a tree of n leaves: (tree, pos, path, root,
    row); and the tables that they are read from, to be discarded once they have been.

    The path has the digests on either side of a node's own on each level up to the root, so that ``fold`` gives the
    root again. Leaves may come in any order, neighbours best together; ``row`` is any struct; an empty table gives an empty
    one. ``trace`` gets the number of nodes of each round.
    """
    rowtype = leaves.schema["row"].dataType.simpleString()
    n, count = leaves.agg(F.max("n"), F.count(F.lit(1))).first()
    rounds = [cut(leaves.select("tree", "n", "pos", "digest", "row").mapInArrow(_windows(arity, window), f"{_LINK}, row {rowtype}"))]
    if trace is not None:
        trace.append(count)
    height, covered = _levels(n or 0, arity), _levels(window, arity)
    while height and (len(rounds) == 1 or covered < height):
        covered += _levels(stride, arity)
        tops = rounds[-1].groupBy("tree", F.col("top_level").alias("level"), F.col("top_pos").alias("pos")).agg(F.max("n").alias("n"), F.max("top").alias("digest"))
        above = F.floor(F.col("pos") / F.pow(F.lit(float(arity)), F.greatest(F.lit(covered) - F.col("level"), F.lit(0)))).cast("long")
        rounds.append(cut(tops.groupBy("tree", above.alias("above")).applyInArrow(_together(arity), _LINK)))
        if trace is not None:
            trace.append(rounds[-1].count())
    proofs = rounds[-1].withColumnRenamed("top", "root")
    for below in reversed(rounds[:-1]):
        upper = small(proofs.select("tree", "level", "pos", "path", "root"), PROOF_ROWS).toDF("tree", "top_level", "top_pos", "_rest", "root")
        proofs = below.join(upper, ["tree", "top_level", "top_pos"]).withColumn("path", F.concat("path", "_rest"))
    return proofs.select("tree", "pos", "path", "root", "row"), rounds


def leaf(*columns: Column) -> Column:
    """The hash of a row: of every value its bytes in UTF-8, counted, and ``-`` for a null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def fold(path: Column, start: Column) -> Column:
    """The root that a proof leads to from a leaf (hex)."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(_hex(s["l"]), acc, _hex(s["r"])).cast("binary"), 256))


def proof_text(path: Column) -> Column:
    """The siblings of a proof, level by level, left to right, in hex."""
    return F.array_join(F.transform(path, lambda s: F.concat(_hex(s["l"]), _hex(s["r"]))), "")


def manifest(leaves: DataFrame, trees: str = "lang", order: str = "doc_id", **how) -> tuple[DataFrame, list[DataFrame]]:
    """``leaves(<trees>, <order>, leaf, ...)``, a written table, with subroot, root and path (the proof from the leaf to the
    root); and the tables behind it.

    Leaves of a tree stand by ``order``, nulls first, and by digest where that repeats, so that equal rows are
    interchangeable; subroots stand by the name of their tree, null first. A tree of a lone leaf is that leaf.
    """
    name, by = F.col(f"`{trees}`"), F.col(f"`{order}`")
    placed = positions(leaves, name.asc_nulls_first(), by.asc_nulls_first(), "leaf", F.rand(SALT), name="_at")
    sizes = cut(placed.groupBy(name.alias("_name")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")))
    named = cut(positions(sizes, F.col("_name").asc_nulls_first(), name="tree"))
    row = F.struct(*[F.col(f"`{c}`") for c in leaves.columns])
    dealt = placed.join(small(named), name.eqNullSafe(F.col("_name")))
    dealt = cut(dealt.select(F.col("tree").cast("long"), "n", (F.col("_at") - F.col("_first")).cast("long").alias("pos"), F.unhex("leaf").alias("digest"), row.alias("row")))
    lower, below = grow(dealt, **how)
    roots = lower.where("pos = 0").select("tree", F.col("root").alias("digest"))
    total = named.count()
    tops = cut(roots.select(F.lit(0).cast("long").alias("tree"), F.lit(total).cast("long").alias("n"), (F.col("tree") - 1).alias("pos"), "digest", F.struct("tree").alias("row")))
    upper, above = grow(tops, **how)
    ends = small(upper.select((F.col("pos") + 1).alias("tree"), F.col("path").alias("_rest"), F.col("root").alias("_root")), PROOF_ROWS)
    out = lower.join(ends, "tree").select("row.*", _hex(F.col("root")).alias("subroot"), _hex(F.col("_root")).alias("root"), F.concat("path", "_rest").alias("path"))
    return out, [placed, sizes, named, dealt, tops, *below, *above]


def manifest_table(docs: DataFrame, **how) -> DataFrame:
    """The digest, with an audit: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    Where 7 divides the CRC-32 of the id, the row is altered (n_chars plus 1) before its leaf is folded with the proof of
    the original; rows without an id or n_chars stay. Null values, empty and very long texts, repeated rows and ids have
    leaves like any other; a null lang is a tree of its own; further columns are left alone; an empty table gives an empty one.
    """
    c = {x: F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")}
    altered = F.when(F.crc32(c["doc_id"].cast("string").cast("binary")) % 7 == 0, c["n_chars"].cast("long") + 1).otherwise(c["n_chars"].cast("long"))
    rows = cut(docs.select("doc_id", "lang", leaf(*c.values()).alias("leaf"), leaf(*(c | {"n_chars": altered}).values()).alias("_now")))
    out, behind = manifest(rows, **how)
    folded = fold(F.col("path"), F.col("_now"))
    out = cut(out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root")))
    for done in (rows, *behind):
        discard(done)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
