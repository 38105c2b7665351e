"""Sharding by minimax contiguous partition.

Documents with equal texts are an atomic group. Groups are ordered by the MD5 of their text. A binary search finds the
smallest shard capacity for which a greedy pass needs no more shards than there are; the cuts are then made under
that capacity, each shard closing as near to an equal part of what is left as the capacity allows.

The ordered list stays bounded at any corpus size: it starts as 4096 units, the groups of one prefix of three hex digits.
A greedy pass that may cut a unit of several groups anywhere gives a lower bound of the capacity. The units that it cuts,
and those next to them, are refined by two digits, and so on: once it cuts none, its bound is a partition, and so
the smallest capacity over the groups themselves.

Slots number the documents of a shard without gaps in a seeded order of their ids: counts per (shard, bucket
of that order) give the offsets, and a window numbers the rows of a bucket. Buckets are of ids and texts, so that neither a
text nor an id that a third of all rows share is one bucket's.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, without
from .mixing import order_key

#: Hex digits of a unit at first, digits that refine it, and units on either side of a cut that are refined with it.
UNIT_HEX, REFINE_HEX, BESIDE = 3, 2, 3
SHARDS = 16
ROWS_PER_BUCKET = 20_000
SEED = "slot-23:"


def _solved(units: DataFrame, shards: int, widest: int, known: int = 0) -> DataFrame:
    """``units(unit string, bytes long, single boolean)``, a list that fits one row, to that row: ``u``, the smallest
    ``capacity`` for which units that aren't single may be cut anywhere, and ``open``, the units to refine; no rows give no row.

    ``widest`` is the largest group's bytes, ``known`` a lower bound of the capacity. The search gallops from the bound
    before it bisects, since refining units seldom moves it far.
    """
    one = units.agg(F.array_sort(F.collect_list(F.struct("unit", "bytes", "single"))).alias("u")).where(F.size("u") > 0)
    one = one.selectExpr("u", "aggregate(u, 0L, (a, x) -> a + x.bytes) AS total")

    def greedy(c: str, start: str, more: str, end: str) -> str:
        # What of a unit is over the capacity goes to as many further shards as it fills.
        over = f"(g.load + x.bytes - {c})"
        filled = f"(({over} + {c} - 1) div {c})"
        return f"""aggregate(u, named_struct('n', 1L, 'load', 0L{start}), (g, x) -> if(g.load + x.bytes <= {c}, named_struct('n', g.n, 'load', g.load + x.bytes{more.format('false')}),
            if(x.single, named_struct('n', g.n + 1L, 'load', x.bytes{more.format('false')}), named_struct('n', g.n + {filled}, 'load', {over} - ({filled} - 1) * {c}{more.format('true')}))), g -> {end})"""

    # With the mean part plus the widest group a greedy pass never needs more shards than there are.
    least = f"greatest({widest}L, {known}L, (total + {shards - 1}) div {shards})"
    tried = "if(s.step < 0, (s.lo + s.hi) div 2, least(s.lo + s.step, s.hi - 1))"
    search = f"""aggregate(sequence(1, 128), named_struct('lo', {least}, 'hi', {least} + {widest}L, 'step', 0L),
        (s, i) -> if(s.lo >= s.hi, s, if({greedy(f"({tried})", "", "", f"g.n <= {shards}")},
            named_struct('lo', s.lo, 'hi', {tried}, 'step', -1L), named_struct('lo', {tried} + 1, 'hi', s.hi, 'step', if(s.step < 0, -1L, 2 * s.step + 1)))), s -> s.lo)"""
    one = one.withColumn("capacity", F.expr(search))
    nothing = "cast(array() as array<int>)"
    cut_at = greedy("capacity", f", 'i', 0, 'at', {nothing}", ", 'i', g.i + 1, 'at', if({}, array_append(g.at, g.i), g.at)", "g.at")
    return one.withColumn("cut_at", F.expr(cut_at)).withColumn("open", F.expr(f"array_distinct(flatten(transform(cut_at, k -> transform(filter(slice(u, greatest(k + 1 - {BESIDE}, 1), {2 * BESIDE + 1}), x -> not x.single), x -> x.unit))))"))


def _starts(one: DataFrame, shards: int) -> DataFrame:
    """The row with ``starts``, the first unit of each shard under ``capacity``."""
    # Starts of the shards when packed from the right: how many a suffix needs at least.
    one = one.withColumn(
        "back",
        F.expr("""aggregate(reverse(u), named_struct('at', cast(array() as array<string>), 'load', 0L, 'last', cast(null as string)),
            (g, x) -> if(g.last is null or g.load + x.bytes <= capacity,
                named_struct('at', g.at, 'load', g.load + x.bytes, 'last', x.unit),
                named_struct('at', array_append(g.at, g.last), 'load', x.bytes, 'last', x.unit)),
            g -> array_append(g.at, g.last))"""),
    )
    return one.withColumn(
        "starts",
        F.expr(f"""aggregate(u, named_struct('at', cast(array() as array<string>), 'load', 0L, 'rest', total),
            (g, x) -> if(size(g.at) = 0, named_struct('at', array(x.unit), 'load', x.bytes, 'rest', total),
                if(g.load + x.bytes > capacity
                   or ((2 * g.load + x.bytes) * ({shards} - size(g.at) + 1) >= 2 * g.rest
                       and 1 + size(filter(back, b -> b > x.unit)) <= {shards} - size(g.at)),
                    named_struct('at', array_append(g.at, x.unit), 'load', x.bytes, 'rest', g.rest - g.load),
                    named_struct('at', g.at, 'load', g.load + x.bytes, 'rest', g.rest))),
            g -> g.at)"""),
    )


def minimax_cuts(units: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``units(unit string, bytes long)``, atomic groups in a list that fits one row, to ``(unit, shard, capacity)``."""
    widest = units.agg(F.max("bytes")).first()[0] or 0
    one = _starts(_solved(units.select("unit", "bytes", F.lit(True).alias("single")), shards, widest), shards)
    rows = one.select("capacity", F.explode(F.expr("transform(u, x -> named_struct('unit', x.unit, 'shard', cast(size(filter(starts, s -> s <= x.unit)) - 1 as int)))")).alias("x"))
    return rows.select("x.unit", "x.shard", "capacity")


def partition(groups: DataFrame, shards: int = SHARDS) -> tuple[list[str], int]:
    """``groups(md5 string, bytes long)``, atomic and of any number, to the prefixes at which shards start and the
    smallest capacity. ``groups`` is read once per round; what is open gets fewer in each."""

    def units(df: DataFrame, digits: int) -> DataFrame:
        return df.groupBy(F.substring("md5", 1, digits).alias("unit")).agg(F.sum("bytes").alias("bytes"), (F.min("md5") == F.max("md5")).alias("single"))

    widest = groups.agg(F.max("bytes")).first()[0]
    if widest is None:
        return [], 0
    now, capacity = cut(units(groups, UNIT_HEX)), 0
    while True:
        solved = _solved(now, shards, widest, capacity)
        names, capacity = solved.select("open", "capacity").first()
        if not names:
            break
        by_length: dict[int, list[str]] = {}
        for name in names:
            by_length.setdefault(len(name), []).append(name)
        parts = now.where(~F.col("unit").isin(names))
        for digits, some in by_length.items():
            parts = parts.unionByName(units(groups.where(F.substring("md5", 1, digits).isin(some)), digits + REFINE_HEX))
        old, now = now, cut(parts.coalesce(1))
        discard(old)
    starts = _starts(solved, shards).select("starts").first()[0]
    discard(now)
    return starts, capacity


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with size, text_crc32, law (``bytes``), shard, slot and grown_shard (null under this law).

    Null text has size 1, no checksum, and goes with the empty texts; ties in the order of slots are broken by
    id, size and checksum, so only rows that agree in all of them may swap; an empty table gives an empty one;
    columns named as the outputs are replaced; a text of any length is one group and never cut.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "_md5", "_key", "_bucket")
    base = (
        without(docs, *added)
        .withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"))
        .withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))
        .withColumn("_md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    )
    base = base.withColumn("_key", F.concat(order_key(F.col("doc_id"), SEED), "_md5"))
    groups = cut(base.groupBy(F.col("_md5").alias("md5")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    n = groups.agg(F.sum("n")).first()[0] or 0
    starts, _ = partition(groups.select("md5", "bytes"), shards)
    discard(groups)
    digits = max(2, math.ceil(math.log(max(1, n / (shards * ROWS_PER_BUCKET)), 16)))
    started = F.array(*[F.lit(s) for s in starts]) if starts else F.array(F.lit(""))
    shard = (F.size(F.filter(started, lambda s: s <= F.col("_md5"))) - 1).cast("int")
    # Buckets by id and text together; the order of slots is that of ids, then texts, within the bucket.
    placed = base.withColumn("shard", shard).withColumn("_bucket", F.substring(F.md5(F.col("_key").cast("binary")), 1, digits))

    counts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_key", "doc_id", "size", "text_crc32"))
    out = placed.withColumn("_nth", nth).join(offsets, ["shard", "_bucket"])
    out = out.withColumn("slot", F.col("_before") + F.col("_nth") - 1).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select(*[c for c in base.columns if not c.startswith("_") or c in docs.columns and c not in added], "law", "shard", "slot", "grown_shard")
