"""Spelling variants by two-dimensional range reporting.

Two words are near if one inserted, deleted or replaced code point turns one into the other: around the edit they share
what stands before and after it. Sorted forward, the words with a given prefix are an interval; sorted by their reversal,
so are those with a given suffix. A wavelet tree over the reverse ranks in forward order reports the words in both, for
every word and every position of the edit; lengths settle which edit it was.

Words meet in groups. A group holds the words of one length, and those one shorter, that agree outside a range of positions in
which the edit lies. It starts as all words of a length; while its characters exceed ``GROUP`` it is split into its
halves, each asking for agreement in the other half as well, so that a pair stays together in the half that holds its edit, however
many words begin or end alike. Down to a single position a group holds no more words than there are letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, slices, small

#: Least code points of a word and least number of its occurrences; one run in ``DROPS`` loses a code point; a form occurs
#: ``TIMES`` times as often as its variant at least.
LENGTH, OCCURS, DROPS, TIMES = 6, 5, 199, 5
#: Characters of a group that stays whole, and of the groups that one wavelet tree covers.
GROUP = 1 << 17

#: Latin-1 bytes of letters, A-Z lower-cased; all others are spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> Counter[bytes]:
    """The maximal runs of letters up to U+00FF, A-Z lower-cased, in Latin-1, which has a byte for each."""
    return Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of words, summed over some megabytes of text."""
    for batch in batches:
        done = 0
        for part in slices(batch.column(1), 8 << 20):
            total: Counter[bytes] = Counter()
            for doc_id, text in zip(batch.column(0).slice(done, len(part)).to_pylist(), part.to_pylist()):
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs(text or "").items():
                    if len(run) >= LENGTH:
                        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % DROPS == 0:
                            run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        total[run] += n
            done += len(part)
            kept = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])


def words(docs: DataFrame) -> DataFrame:
    """``(word, n)``: the words of all texts with the occurrences that make them count."""
    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURS)


class WaveletTree:
    """Points (i, ranks[i]), ranks being a permutation, as bits by level from the highest, zeros before ones."""

    def __init__(self, ranks: np.ndarray):
        self.levels = []
        for bit in reversed(range(max(1, int(len(ranks) - 1).bit_length()))):
            ones = (ranks >> bit) & 1
            zeros_before = np.concatenate(([0], np.cumsum(1 - ones)))
            self.levels.append((bit, zeros_before, int(zeros_before[-1])))
            ranks = np.concatenate((ranks[ones == 0], ranks[ones == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of rectangles [lo, hi) x [low, high), all at once: the rectangle's number, and the point's rank."""
        who, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for bit, zeros_before, zeros in self.levels:
            a, b = zeros_before[lo], zeros_before[hi]
            who, value = np.concatenate((who, who)), np.concatenate((value, value | (1 << bit)))
            lo, hi = np.concatenate((a, lo - a + zeros)), np.concatenate((b, hi - b + zeros))
            kept = (lo < hi) & (value < high[who]) & (value + (1 << bit) > low[who])
            who, value, lo, hi = who[kept], value[kept], lo[kept], hi[kept]
        return who, value


def _intervals(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ``keys`` (four bytes that number the group, then ``width`` letters): the sorted order, and for each sorted row
    after the first how many letters it shares with the one before it, -1 in another group."""
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")
    differs = keys[order[1:]] != keys[order[:-1]]
    return order, np.concatenate(([-1], np.maximum(differs.argmax(axis=1) - 4, -1)))


def _bounds(order: np.ndarray, shared: np.ndarray, members_before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """By row, the interval of members that agree with it in the first ``length`` letters."""
    new = shared < length
    starts = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    lo, hi = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    lo[order], hi[order] = members_before[starts][which], members_before[np.append(starts[1:], len(order))][which]
    return lo, hi


def near_in_groups(group: np.ndarray, mids: list[bytes], before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``mids`` that are one edit apart within their group: each (row, member) once, members being those of ``width``
    letters; the others have one less. ``before`` has the letter before each, which tells repeated letters' first place."""
    n = len(mids)
    member = np.fromiter((len(m) == width for m in mids), bool, n)
    letters = np.frombuffer(b"".join(m.ljust(width, b"\0") for m in mids), np.uint8).reshape(n, width)
    turned = np.frombuffer(b"".join(m[::-1].ljust(width, b"\0") for m in mids), np.uint8).reshape(n, width)
    number = group.astype(">u4").view(np.uint8).reshape(n, 4)
    (forward, shared), (reverse, turned_shared) = (_intervals(np.hstack((number, x)), width) for x in (letters, turned))
    upto = [np.concatenate(([0], np.cumsum(member[order]))) for order in (forward, reverse)]
    by_rank = reverse[member[reverse]]
    rank = np.empty(n, np.int64)
    rank[by_rank] = np.arange(len(by_rank))
    tree = WaveletTree(rank[forward[member[forward]]])
    rows, found = [], []
    for at in range(width):
        lo, hi = _bounds(forward, shared, upto[0], at)
        low, high = _bounds(reverse, turned_shared, upto[1], width - 1 - at)
        ask = np.flatnonzero((hi - lo > member) & (high - low > member))  # a member is in its own intervals
        who, value = tree.report(lo[ask], hi[ask], low[ask], high[ask])
        row, other = ask[who], by_rank[value]
        first = (before[other] if at == 0 else letters[other, at - 1]) != letters[other, at]
        kept = (row != other) & (member[row] | first)
        rows.append(row[kept])
        found.append(other[kept])
    return np.concatenate(rows), np.concatenate(found)


_PAIR = "word string, near string, near_n long"


def _windows(limit: int):
    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        """``rows`` of whole groups: (width, group, prefix, suffix, mid, n)."""
        out: list[tuple[str, str, int]] = []
        for width in {r[0] for r in rows}:
            some = [r for r in rows if r[0] == width]
            mids = [r[4].encode("latin-1") for r in some]
            group = np.fromiter((r[1] for r in some), np.int64, len(some))
            before = np.fromiter((ord(r[2][-1]) if r[2] else 0 for r in some), np.int64, len(some))
            for a, b in zip(*near_in_groups(group, mids, before, width)):
                x, y = some[a], some[b]
                one, other = x[2] + x[4] + x[3], y[2] + y[4] + y[3]
                out.append((one, other, y[5]))
                if len(x[4]) < width:
                    out.append((other, one, x[5]))
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 3, kinds)], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters, number, last = [], 0, 0, None
        for batch in batches:
            for m, a, b, prefix, suffix, mid, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (key := (m, a, b, prefix, suffix)) != last:
                    if letters > limit:
                        yield pairs(held)
                        held, letters, number = [], 0, 0
                    number, last = number + 1, key
                held.append((b - a, number, prefix, suffix, mid, n))
                letters += b - a
        if held:
            yield pairs(held)

    return run


_KEY = ("m", "a", "b", "prefix", "suffix")


def _halves(groups: DataFrame) -> DataFrame:
    """The rows of groups, each in both halves of its range."""
    half = F.floor((F.col("b") - F.col("a")) / 2).cast("int")
    rows = groups.withColumn("half", half).withColumn("less", (F.col("b") - F.col("a") - F.length("mid")).cast("int"))
    mid, c = F.col("mid"), F.col("a") + F.col("half")
    split = F.col("half") - F.col("less")  # where the left half of the middle ends if the edit lies in it
    rest = lambda at: F.substring(mid, at + 1, F.length(mid))
    left = F.struct("m", "a", c.alias("b"), "prefix", F.concat(rest(split), "suffix").alias("suffix"), F.substring(mid, F.lit(1), split).alias("mid"), "n")
    right = F.struct("m", c.alias("a"), "b", F.concat("prefix", F.substring(mid, F.lit(1), F.col("half"))).alias("prefix"), "suffix", rest(F.col("half")).alias("mid"), "n")
    return rows.select(F.explode(F.array(left, right)).alias("x")).select("x.*")


def near_words(vocabulary: DataFrame, limit: int = GROUP) -> DataFrame:
    """``(word, near, near_n)`` of all ordered pairs of ``vocabulary(word, n)``, a written table of distinct words of letters up
    to U+00FF, that are one edit apart; near_n is the n of ``near``. Words of any length; an empty table gives an empty one."""
    size = F.length("word")
    both = vocabulary.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    rows = both.select("m", F.lit(0).alias("a"), F.col("m").alias("b"), F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.col("word").alias("mid"), "n")
    done, settled = [], []
    while True:
        held = F.count_if(F.length("mid") == F.col("b") - F.col("a"))
        sizes = rows.groupBy(*_KEY).agg(F.sum(F.length("mid") + 1).alias("letters"), held.alias("members"), F.count(F.lit(1)).alias("all"))
        sizes = cut(sizes.where("members > 0 AND all > 1").select(*_KEY, ((F.col("letters") > limit) & (F.col("b") - F.col("a") > 1)).alias("large")))
        whole = rows.join(sizes.where("NOT large").drop("large"), list(_KEY), "left_semi")
        settled.append(sizes)
        done.append(whole)
        if sizes.where("large").isEmpty():
            break
        rows = cut(_halves(rows.join(sizes.where("large").drop("large"), list(_KEY), "left_semi")))
        settled.append(rows)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    together = every.repartition(*_KEY).sortWithinPartitions(*_KEY).select(*_KEY, "mid", "n")
    out = cut(together.mapInArrow(_windows(limit), _PAIR))
    for old in settled:
        discard(old)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``, which lead to no circle: links are doubled until all end at a word without a form."""
    links = forms.toDF("word", "root")
    while True:
        onward = links.toDF("_at", "_next")
        joined = links.join(onward, links.root == F.col("_at"), "left")
        longer = cut(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        discard(links)
        links = longer.drop("_moved")
        links._nuggetry_path = longer._nuggetry_path
        if longer.where("_moved").isEmpty():
            return links


def variant_table(docs: DataFrame, **how) -> DataFrame:
    """The digest: word, form, root, n, n_near and form_n of every word of the texts.

    Null and empty texts have no words; rows are taken as they come, repeated ones count again; a null id
    stands as an empty string where one run in ``DROPS`` loses a code point; texts of any length are read whole; further
    columns are left alone; an empty table gives an empty one.
    """
    vocabulary = cut(words(docs))
    near = near_words(vocabulary, **how)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = vocabulary.join(best, "word", "left")
    leads = -F.col("best.less") >= TIMES * F.col("n")
    rows = cut(rows.select("word", F.when(leads, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, -F.col("best.less")).alias("form_n")))
    ends = roots(cut(rows.where("form IS NOT NULL").select("word", "form")))
    for done in (vocabulary, near):
        discard(done)
    return rows.join(small(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
