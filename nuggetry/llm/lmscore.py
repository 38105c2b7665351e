"""Language-model scoring by cross-entropy difference.

Two bigram models over words, of a target (documents rated good and not toxic) and of the background (all
documents, the target among them), share one vocabulary, which is the corpus's, and one smoothing. A document's score
is the mean over its tokens of target loss minus background loss: below zero, it is closer to the target.

The counts grow with the corpus. Blocks of documents send each distinct n-gram once to its bucket, a range of keys,
where the counts of all blocks meet, and get back the counts that differ from their own. Words are taken as they are
written; n-grams are known by 48-bit hashes, which travel as sorted differences, byte by byte.

A block is cut into ``FAN`` ranges at most, and no more than about ``FAN`` blocks meet in one. A larger corpus goes up in tiers of
one fan, the smallest that reaches all buckets and blocks: the runs of one range and one set of blocks are merged and cut into finer
ranges, which meet those of the other sets, until a range is a bucket and its set has all blocks; the counts come back the same way.
As many blocks meet as ranges are cut, so a group holds about the n-grams of a block or a bucket, however large the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, slices, utf8

#: Pseudo-counts that a longer history gives to the prediction of the next shorter one.
CONCENTRATION = 8.0
#: Text bytes of a block of documents, and n-grams that a bucket of counts is laid out for.
BLOCK, BUCKET = 8 << 20, 1_000_000
KEY_BITS = 48
#: Ranges that a run of counts is cut into at most, and runs that are merged at a time, about.
FAN = 4096
#: A word is a CJK character, a run of ASCII letters, digits and other non-ASCII characters, or one other visible byte.
_WORD = re.compile(rb"[\xe3-\xed][\x80-\xbf]{2}|(?:[0-9A-Za-z]|[\xc2-\xe2\xee-\xf4][\x80-\xbf]+)+|[^\x00-\x20\x7f]")


def _marked(docs: DataFrame, target_ids: DataFrame, rows: int) -> DataFrame:
    ids = target_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.col("_id").isNotNull().alias("target"))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts by number, each text closed by the edge, which is 0; the hashes of the numbered words;
    how many words each text has, its end included."""
    known = _Ids({b"": 0})
    line, size = [], []
    for t in texts:
        found = _WORD.findall(t)
        found.append(b"")
        line.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
        size.append(len(found))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in known), np.uint64, len(known))
    return np.concatenate(line), hashes >> np.uint64(64 - KEY_BITS), np.array(size, np.int64)


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = before * np.uint64(0x9E3779B97F4A7C15) + word
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(29)
    return key >> np.uint64(64 - KEY_BITS)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as planes of their bytes, the lowest first, without the planes that are all zero."""
    raw = []
    for c in columns:
        width = (int(c.max(initial=0)).bit_length() + 7) // 8
        raw += [bytes([width]), c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    line = b"".join(raw)
    return len(line).to_bytes(8, "little") + pa.compress(line, codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    """The ``columns`` of ``n`` numbers that _pack() was given."""
    line, out, at = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), [], 0
    for _ in range(columns):
        width = line[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(line, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(wide.reshape(-1).view("<u8"))
        at += 1 + n * width
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


_BLOCK = "block long, docs binary, n int, tokens binary, n_vocabulary int, vocabulary binary, n_target long, n_all long"


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to blocks, a row each: ids, sizes and sides of its documents, its words by number, its vocabulary."""
    held, width, n = [], 0, TaskContext.get().partitionId() << 32

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        texts = rows.column("text").combine_chunks()
        line, hashes, size = word_ids(utf8(texts))
        full = np.asarray(pc.is_valid(texts))
        target = np.asarray(rows.column("target")) & full
        length = pc.add(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), 1)
        docs = pa.table({"doc_id": rows.column("doc_id"), "n_tokens": length, "n_words": pa.array(size), "target": pa.array(target), "full": pa.array(full)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(docs)
        values = (n, sink.getvalue().to_pybytes(), len(line), _pack(line), len(hashes), _pack(hashes), int(size[target].sum()), int(size[full].sum()))
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        names = ["block", "docs", "n", "tokens", "n_vocabulary", "vocabulary", "n_target", "n_all"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        done = 0
        for part in slices(batch.column("text"), BLOCK // 4):
            held.append(batch.slice(done, len(part)))
            done += len(part)
            width += pc.sum(pc.binary_length(part)).as_py() or 0
            if width >= BLOCK * 3 // 4:
                yield flush()
                held, width, n = [], 0, n + 1
    if held:
        yield flush()


def _counted(docs: bytes, n: int, tokens: bytes, n_vocabulary: int, vocabulary: bytes) -> tuple:
    """Of one block: its documents, the keys of its words and bigrams in order, where each token, its bigram and the
    word before it stand in them, and its own counts of target and background."""
    rows = pa.ipc.open_stream(docs).read_all()
    size, (hashes,) = np.asarray(rows.column("n_words")), _unpack(vocabulary, n_vocabulary, 1)
    word = _unpack(tokens, n, 1)[0].astype(np.int32)
    before = np.empty_like(word)
    before[0], before[1:] = 0, word[:-1]
    code, pair = np.unique(before.astype(np.int64) * len(hashes) + word, return_inverse=True)
    keys = np.concatenate([hashes, _pair_keys(hashes[code // len(hashes)], hashes[code % len(hashes)])])
    order = np.argsort(keys)
    keys, place = keys[order], np.empty(len(keys), np.int32)
    place[order] = np.arange(len(keys), dtype=np.int32)
    own = []
    for side in ("target", "full"):
        mine = np.repeat(np.asarray(rows.column(side)), size)
        counts = np.concatenate([np.bincount(word[mine], minlength=len(hashes)), np.bincount(pair[mine], minlength=len(code))])
        own.append(counts[order])
    return rows, size, keys, place[word], place[len(hashes) + pair], place[before], *own


def _range_starts(keys: np.ndarray, buckets: int, width: int, first: int, ranges: int) -> np.ndarray:
    """Where each range of ``width`` buckets starts in sorted ``keys``, ``ranges`` of them from the number ``first`` on, and the end."""
    bucket = (keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(bucket // np.uint64(width), np.arange(first, first + ranges + 1, dtype=np.uint64))


_SENT = "bucket long, grp long, block long, n int, data binary"
_PARTS = ("docs", "n", "tokens", "n_vocabulary", "vocabulary")


def _sent(buckets: list, groups: list, blocks: list, n: list, data: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((buckets, groups, blocks, n, data), kinds)], names=["bucket", "grp", "block", "n", "data"])


def _cut(keys: np.ndarray, target: np.ndarray, every: np.ndarray, start: np.ndarray, first: int, group: int, block: int) -> pa.RecordBatch:
    """A run as rows of its ranges that are not empty."""
    some = np.nonzero(np.diff(start))[0]
    cuts = [slice(start[b], start[b + 1]) for b in some]
    return _sent(some + first, [group] * len(some), [block] * len(some), [c.stop - c.start for c in cuts], [_pack(_steps(keys[c]), target[c], every[c]) for c in cuts])


def _send(buckets: int, width: int, groups: int):
    """Blocks to rows of the first tier, their blocks dealt to so many groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                _, _, keys, *_, target, every = _counted(*(batch.column(c)[i].as_py() for c in _PARTS))
                start = _range_starts(keys, buckets, width, 0, -(-buckets // width))
                yield _cut(keys, target, every, start, 0, xxhash.xxh64_intdigest(block.to_bytes(8, "little")) % groups, block)

    return run


def _together(sent: pa.Table) -> tuple:
    """The runs of a group: their sizes, own counts one after the other, the distinct keys, where each stands among these, and
    the summed counts of these."""
    n = sent.column("n").to_pylist()
    parts = [_unpack(d.as_py(), m, 3) for d, m in zip(sent.column("data"), n)]
    keys = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts])
    own = [np.concatenate([x[k] for x in parts]) for k in (1, 2)]
    keys, at = np.unique(keys, return_inverse=True)
    return n, own, keys, at, [np.bincount(at, weights=x, minlength=len(keys)).astype(np.uint64) for x in own]


def _merge(buckets: int, width: int, fan: int):
    """A group's runs as one, cut into the ranges of the next tier, whose ``width`` is given."""

    def run(sent: pa.Table) -> pa.Table:
        bucket, group = sent.column("bucket")[0].as_py(), sent.column("grp")[0].as_py()
        _, _, keys, _, (target, every) = _together(sent)
        start = _range_starts(keys, buckets, width, bucket * fan, fan)
        return pa.Table.from_batches([_cut(keys, target, every, start, bucket * fan, group // fan, group)])

    return run


def _answered(sent: pa.Table, n: list, own: list, at: np.ndarray, whole: list) -> pa.Table:
    """The whole counts, back to each run where they differ from its own."""
    both = [x[at] for x in whole]
    changed, out, done = (both[0] != own[0]) | (both[1] != own[1]), [], 0
    for m in n:
        where = np.nonzero(changed[done : done + m])[0]
        out.append((len(where), _pack(_steps(where), both[0][done + where], both[1][done + where])))
        done += m
    bucket, group, block = (sent.column(c).to_pylist() for c in ("bucket", "grp", "block"))
    return pa.Table.from_batches([_sent(bucket, group, block, [x[0] for x in out], [x[1] for x in out])])


def _meet(sent: pa.Table) -> pa.Table:
    """The counts of one bucket over all blocks, back to each run."""
    n, own, _, at, whole = _together(sent)
    return _answered(sent, n, own, at, whole)


def _apply(back: pa.Table, start: np.ndarray, first: int, target: np.ndarray, every: np.ndarray) -> None:
    """Puts the counts that came back for the ranges of a run into its own."""
    for b, m, data in zip(back.column("bucket").to_pylist(), back.column("n").to_pylist(), back.column("data")):
        where, t, e = _unpack(data.as_py(), m, 3)
        place = start[b - first] + np.cumsum(where).astype(np.int64)
        target[place], every[place] = t, e


def _pass_on(buckets: int, width: int, fan: int):
    """What came back for a merged run, to the runs that it was merged from; ``width`` is that of its ranges."""

    def run(sent: pa.Table, back: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return sent.slice(0, 0)
        bucket = sent.column("bucket")[0].as_py()
        n, own, keys, at, whole = _together(sent)
        _apply(back, _range_starts(keys, buckets, width, bucket * fan, fan), bucket * fan, *whole)
        return _answered(sent, n, own, at, whole)

    return run


def _rate(buckets: int, width: int, n_target: int, n_all: int, n_words: int, schema: pa.Schema):
    def run(blocks: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        for held in zip(*(blocks.column(c) for c in _PARTS)):
            rows, size, keys, word, pair, before, target, every = _counted(*(x.as_py() for x in held))
            _apply(back, _range_starts(keys, buckets, width, 0, -(-buckets // width)), 0, target, every)
            first, mean = np.cumsum(size) - size, []
            for counts, n in ((target, n_target), (every, n_all)):
                p = (counts[word] + CONCENTRATION / n_words) / (n + CONCENTRATION)
                loss = -np.log((counts[pair] + CONCENTRATION * p) / (counts[before] + CONCENTRATION))
                mean.append(np.add.reduceat(loss, first) / size)
            ours, all_ = mean
            none = np.full(len(size), not n_target)
            diff = np.where(none, 0.0, ours - all_)
            columns = [rows.column("doc_id"), rows.column("n_tokens"), rows.column("n_words"), pa.array(ours, mask=none), pa.array(all_), pa.array(diff)]
            out.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def whole_counts(parts: DataFrame, buckets: int, blocks: int, fan: int = FAN, trace: list | None = None, loads: list | None = None) -> tuple[DataFrame, int]:
    """The rows that go back to each block, and how many buckets make a range of theirs. ``trace`` gets, by tier, the most
    rows that a run is cut into and the most that meet in a group, ``loads`` the most n-grams that do."""
    tiers, most_of_both = 1, max(buckets, blocks)
    while fan**tiers < most_of_both:
        tiers += 1
    fan = next(f for f in range(2, fan + 1) if f**tiers >= most_of_both) if tiers > 1 else fan
    widths, sent = [fan ** (tiers - t) for t in range(1, tiers + 1)], []
    for t, width in enumerate(widths):
        if not t:
            rows = parts.mapInArrow(_send(buckets, width, 1 if tiers == 1 else -(-blocks // fan)), _SENT)
        else:
            rows = sent[-1].groupBy("bucket", "grp").applyInArrow(_merge(buckets, width, fan), _SENT)
        sent.append(rows if tiers == 1 else cut(rows))
        if trace is not None:
            child = F.struct("block", F.floor(F.col("bucket") / fan)) if t else F.col("block")
            most = lambda *by: rows.groupBy(*by).count().agg(F.max("count")).first()[0]  # noqa: B023, E731
            trace.append((most(child), most("bucket", "grp")))
        if loads is not None:
            loads.append(rows.groupBy("bucket", "grp").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0])
    back = sent[-1].groupBy("bucket").applyInArrow(_meet, _SENT)
    for rows, width in zip(reversed(sent[:-1]), reversed(widths[1:])):
        ours = back.select(F.floor(F.col("bucket") / fan).alias("_run"), F.col("block").alias("_grp"), "bucket", "n", "data")
        back = rows.groupBy("bucket", "grp").cogroup(ours.groupBy("_run", "_grp")).applyInArrow(_pass_on(buckets, width, fan), _SENT)
    return back, widths[0]


def word_scores(docs: DataFrame, target_ids: DataFrame, rows: int = 500_000, fan: int = FAN) -> DataFrame:
    """``(doc_id, n_tokens, n_words, target_xent, background_xent, xent_diff)`` of every row: its bytes and one, its
    words and one for its end, and the mean loss over the latter of both models, in nats, and their difference.

    ``target_ids(doc_id)`` names the target documents; up to ``rows`` of them, which a count checks, are broadcast,
    more are joined by shuffle. A bigram's probability is smoothed by its word's, that by 1 / vocabulary of the corpus.
    Null text trains nothing and scores as empty text; repeated rows count as often as they are there; where the
    target has no text its loss is null and every difference 0. A very long text is a block by itself.
    """
    marked = _marked(docs, target_ids, rows)
    blocks = cut(marked.mapInArrow(_blocked, _BLOCK))
    n_target, n_all, n_blocks = (x or 0 for x in blocks.agg(F.sum("n_target"), F.sum("n_all"), F.count(F.lit(1))).first())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, v in zip(*batch.columns):
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(v.as_py(), n.as_py(), 1)[0].astype(np.int64))], names=["word"])

    parts = blocks.select("block", *_PARTS)
    n_words = blocks.select("n_vocabulary", "vocabulary").mapInArrow(listed, "word long").distinct().count()
    buckets = max(64, 2 * n_all // BUCKET)
    back, width = whole_counts(parts, buckets, n_blocks, fan)
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType())])
    for name in ("target_xent", "background_xent", "xent_diff"):
        kind = kind.add(name, T.DoubleType())
    rate = _rate(buckets, width, n_target, n_all, n_words, to_arrow_schema(kind))
    return parts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(rate, kind)


def lm_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest, of ``word_scores``. The target is what is rated good and not toxic."""
    good = labels.where("quality >= 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return word_scores(docs, good)
