"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a cap of ``max_epochs`` times its own size. The budget is poured in proportion
to the weights; sources above their cap are clamped there and the excess goes to the others by weight, until
none is above. The plan is then carried out with whole repetitions of every document plus one fractional
repetition: in a seeded order within the source, documents are taken once more until the rest of the target
is reached, so that a source misses its target by half a document at most.

All of it is DataFrame expressions. Only sums per (source, bucket of the seeded order) are shuffled; texts
never are, and a source that holds most rows is cut into up to 4096 buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, packed, positions, small, white_words, without

#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MAX_EPOCHS, SEED = 1.5, 2.0, "mix-17:"
BUCKET_HEX = 3


def order_key(id_col: Column, seed: str = SEED, *more: Column) -> Column:
    """Place in the seeded order by the id and what else is given: 32 hex digits. Nulls are empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (id_col, *more)]
    return F.md5(F.concat(F.lit(seed), F.concat_ws(":", *parts)).cast("binary"))


def _document_key(docs: DataFrame) -> Column:
    """Rows that share an id, or have none, have places of their own by their texts."""
    return order_key(docs["doc_id"], SEED, F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))


def allocate(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS, weights=WEIGHTS) -> DataFrame:
    """``sources(source, source_size)``, one row each, with ``weight`` and ``target``.

    Ranks are by code point of the name, null last. The table has a row per source, and each round of the
    water-filling is one single-row aggregate over it; rounds end when no further source is clamped.
    """
    ranked = positions(sources, F.col("source").asc_nulls_last(), name="_rank")
    ranked = cut(
        ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
        .drop("_rank")
    )
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = (total[0] or 0) * share
    level, clamped = budget / total[1] if total[1] else 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("_cap")
        n, full, open_weight = ranked.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == clamped or not open_weight:
            break
        level, clamped = (budget - full) / open_weight, n
    over = F.lit(level) * F.col("weight") > F.col("_cap")
    return ranked.withColumn("target", F.when(over, F.col("_cap")).otherwise(F.lit(level) * F.col("weight"))).drop("_cap")


def plan(sized: DataFrame, **how) -> DataFrame:
    """The mix of ``sized(source, size, key)``: a row per source with source_size, target, whole (repetitions
    that every document gets), cut_key (documents up to this place in the order get one more) and cut_rows (if only so many of
    that place do, else null)."""
    bucket = F.substring("key", 1, BUCKET_HEX)
    by_bucket = cut(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket")))
    alloc = allocate(by_bucket.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), **how)
    alloc = alloc.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    alloc = small(cut(alloc.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))))

    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = by_bucket.withColumn("_to", F.sum("in_bucket").over(running))
    split = placed.join(alloc, placed.source.eqNullSafe(alloc.source)).where(F.col("_to") > F.col("rest"))
    split = split.groupBy(placed.source.alias("source")).agg(F.min(F.struct("bucket", (F.col("_to") - F.col("in_bucket")).alias("before"))).alias("at"))
    split = cut(split.select(F.col("source").alias("_s"), F.col("at.bucket").alias("_b"), "at.before"))

    # Only the bucket that the cut falls into is put in order document by document; rows of one place are equal.
    edge = sized.withColumn("bucket", bucket).join(small(split), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    edge = edge.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("before").alias("before"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("_from", F.col("before") + upto - F.col("size")).withColumnRenamed("source", "_s")
    # Of n rows of one place those are taken whose middle is within the rest.
    fits = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("_from")) * F.col("n") / F.col("size") + 0.5)).when(F.col("_from") <= F.col("rest"), F.col("n"))
    edge = edge.join(alloc, edge._s.eqNullSafe(alloc.source)).withColumn("_fits", F.least(fits, "n")).where("_fits > 0")
    edge = edge.groupBy("_s").agg(F.max(F.struct("key", "_fits", "n")).alias("last"))
    at = split.select(F.col("_s").alias("_split"), "_b")
    out = alloc.join(at, alloc.source.eqNullSafe(at._split), "left").join(edge, alloc.source.eqNullSafe(edge._s), "left")
    # Without a document in the cut bucket, everything before that bucket is taken; without a rest, nothing is once more.
    cut_key = F.when(F.col("rest") > 0, F.coalesce("last.key", "_b", F.lit(""))).otherwise("")
    some = F.when((F.col("rest") > 0) & (F.col("last._fits") < F.col("last.n")), F.col("last._fits"))
    out = out.select("source", "source_size", "target", "whole", cut_key.alias("cut_key"), some.alias("cut_rows"))
    done = cut(out)
    for old in (by_bucket, split):
        discard(old)
    return done


def repetitions(sized: DataFrame, mix: DataFrame) -> DataFrame:
    """``sized`` with source_size, target and ``times``, how often the mix takes each row. Where a cut falls among rows of
    one place, which are equal, these are numbered; other rows are not."""
    p = small(mix).withColumnRenamed("source", "_source")
    joined = sized.join(p, F.col("source").eqNullSafe(F.col("_source")), "left")
    shared = F.col("cut_rows").isNotNull() & (F.col("key") == F.col("cut_key"))
    more = F.col("key") <= F.col("cut_key")
    if mix.where("cut_rows IS NOT NULL").isEmpty():
        joined = joined.withColumn("_more", more)
    else:
        nth = F.row_number().over(Window.partitionBy("_source").orderBy("key"))
        some = joined.where(shared).withColumn("_more", nth <= F.col("cut_rows"))
        joined = joined.where(~shared).withColumn("_more", more).unionByName(some)
    return joined.withColumn("times", F.col("whole") + F.col("_more").cast("long")).drop("_source", "whole", "cut_key", "cut_rows", "_more")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the columns size, source_size, target and taken (words that the mix takes of the row).

    Null text has size 0; null source is a source of its own, ranked last; rows that share an id, or have none, are taken each
    by its own text, and of equal rows as many as fit; an empty table gives an empty one; columns named as the outputs are replaced.
    """
    base = without(docs, "size", "source_size", "target", "taken", "times", "key")
    sized = base.withColumn("size", white_words(F.col("text"))).withColumn("key", _document_key(base))
    mix = plan(sized.select("source", "size", "key"), **how)
    return repetitions(sized, mix).withColumn("taken", F.col("size") * F.col("times")).drop("key")


def mix_table(docs: DataFrame, **how) -> DataFrame:
    """The digest of the mix: doc_id, size, source_size, target, taken. Texts are read once."""
    slim = cut(docs.select("doc_id", "source", white_words(F.col("text")).alias("size"), _document_key(docs).alias("key")))
    mix = plan(slim, **how)
    return repetitions(slim, mix).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``.

    No row comes more than ``max_epochs`` times (rounded up), empty and null texts included; a source without words
    gives nothing. Rows that share an id, or have none, are taken each by its own text. Texts of any length are whole.
    """
    out = mix_sources(packed(docs, "doc_id", "source", "text"), **how)
    return out.select("_row", F.explode(F.expr("array_repeat(1, cast(times as int))"))).select("_row.*")
