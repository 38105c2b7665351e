"""Near-duplicates by SimHash, found by Golay-code fuzzy hashing.

A fingerprint has 64 bits: 23 + 23 + 18 (the last one filled up with zeros to 23). The binary Golay code of
length 23 is perfect: every 23-bit word is within distance 3 of one codeword. The indices of all codewords
within distance 4 (one, or six for words at distance 3) are the fuzzy keys of a segment; two segments that
differ in at most two bits share one, since the word half-way between them has a codeword within 3. Of four
differing bits at most two fall into the best two of three segments, so two linked fingerprints share a pair
of keys on at least one pair of segments. That pair is the join key: up to 36 for each of 3 segment pairs.

Equal fingerprints are one node. Nodes are dealt by key and every key's nodes are compared exactly (at most
``bits`` differing), but what leaves a key is a star of each of its components, never its pairs: output and
memory stay linear in the nodes of the key. Stars are joined to components by large-star/small-star rounds.

``deduplicate`` asks for a similarity instead: texts are linked whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Texts at 0.8 differ in 15 % of the bits, beyond what 64 bits can find; so it takes 128, of
which five segments give keys, and a key's nodes leave it as the shortest edges that hold them together (a minimum
spanning forest by differing bits). Every edge is then verified on the shingles themselves. Keys miss some pairs, so what
lies between the components that they give is found by a prefix join on the shingles, which misses none: of two sets
as similar as asked, ordered rare ones first, the first n - ceil(0.8 n) + 1 of each have one in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..operators.components import components
from ..operators.similarity import BUCKETS, SAMPLE, magnitudes_of, sets_once, token_counts
from .common import LOWER_TABLE, cut, discard, slices, small, utf8, without

BITS = 4
WORDS = 4
SEED = 42
#: Of deduplicate(): words of a shingle, least Jaccard similarity.
WIDE_WORDS, SIMILARITY = 5, 0.8
#: Fixed value: generator polynomial of the (23, 12) Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
WIDE_SEGMENTS = tuple((23 * i, 23) for i in range(5))
#: Runs of one key up to this length are compared pair by pair across all runs of a batch at once.
SHORT_RUN = 64
#: Of deduplicate(): postings of a shingle that meet those of another block in one task, and pairs compared in one go.
BLOCK, PAIRS = 256, 1 << 17
RUNS = ["w", "i", "j", "own", "early", "a", "b"]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the word shingles of one UTF-8 text, in order, repeats included; of the whole sequence if it has fewer words."""
    parts = text.translate(LOWER_TABLE).split()
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, SEED)] if parts else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words]))
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none give 0."""
    if not len(h):
        return 0
    total, octets = np.zeros(64, np.int64), h.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(h), 65_536):
        total += np.unpackbits(octets[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of one UTF-8 text: majority of the XXH64 bits of its word shingles; no words give 0."""
    return majority(shingle_hashes(text, words))


@arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    out = [fingerprint(t) for part in slices(texts) for t in utf8(part)]
    return pa.array(np.array(out, np.uint64).view(np.int64))


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and by syndrome the error patterns up to weight 4 (-1: none)."""
    one = []
    for i in range(23):
        x = 1 << i
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        one.append(x)
    spread = lambda basis: np.array([np.bitwise_xor.reduce([b for j, b in enumerate(basis) if v >> j & 1] or [0]) for v in range(1 << len(basis))], np.int64)
    errors: list[list[int]] = [[] for _ in range(2048)]
    for w in range(5):
        for at in combinations(range(23), w):
            s = 0
            for i in at:
                s ^= one[i]
            errors[s].append(sum(1 << i for i in at))
    table = np.full((2048, max(map(len, errors))), -1, np.int64)
    for s, e in enumerate(errors):
        table[s, : len(e)] = e
    return spread(one[:12]), spread(one[12:]), table


_tables: list = []


def segment_keys(segment: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4 of each 23-bit word; -1 where there are fewer."""
    if not _tables:
        _tables.extend(_golay())
    low, high, errors = _tables
    e = errors[low[segment & 4095] ^ high[segment >> 12]]
    return np.where(e < 0, -1, (segment[:, None] ^ e) >> 11)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in ``fp``) for every key of every fingerprint."""
    parts = [segment_keys(((fp >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64)) for a, w in SEGMENTS]
    keys, rows = [], []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        left, right = parts[i][:, :, None], parts[j][:, None, :]
        r, a, b = np.nonzero((left >= 0) & (right >= 0))
        keys.append((p << 24) | (parts[i][r, a] << 12) | parts[j][r, b])
        rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(every), 4096):
            fp = every[at : at + 4096]
            key, row = fuzzy_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[row])], names=["key", "fp"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= BITS


def _short_runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components within runs of equal key: (node, root) with node != root."""
    label, at, lag, left, right = np.arange(len(fp)), np.arange(len(fp)), 0, [], []
    while True:
        lag += 1
        at = at[at + lag < len(fp)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        hit = at[_close(fp[at], fp[at + lag])]
        left.append(hit)
        right.append(hit + lag)
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    while len(u):
        low = np.minimum(label[u], label[v])
        was = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == was).all():
            break
    node = np.nonzero(label != np.arange(len(fp)))[0]
    return fp[node], fp[label[node]]


def _long_run(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for one long run, breadth first: whatever is reached is not compared again."""
    left = fp
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            now, frontier = frontier[:16], frontier[16:]
            near = np.zeros(len(left), bool)
            for x in now:
                near |= _close(left, x)
            if near.any():
                new = left[near]
                yield new, np.full(len(new), root)
                frontier, left = np.concatenate([frontier, new]), left[~near]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to stars; a run may go on over several batches."""
    out = lambda n, r: pa.RecordBatch.from_arrays([pa.array(n), pa.array(r)], names=["node", "root"])
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.empty(0, np.int64)
        width = np.diff(np.r_[start, len(key)])
        if len(brief := np.repeat(width <= SHORT_RUN, width)) and brief.any():
            yield out(*_short_runs(key[brief], fp[brief]))
        for s, w in zip(start[width > SHORT_RUN], width[width > SHORT_RUN]):
            for pair in _long_run(fp[s : s + w]):
                yield out(*pair)

    for batch in batches:
        key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(key):
            continue
        if held and held[0][0][0] == key[-1]:
            held.append((key, fp))
            continue
        last = int(np.searchsorted(key, key[-1]))
        held.append((key[:last], fp[:last]))
        yield from flush(*(np.concatenate(x) for x in zip(*held)))
        held = [(key[last:], fp[last:])]
    if held:
        yield from flush(*(np.concatenate(x) for x in zip(*held)))


def near_components(ids: DataFrame) -> DataFrame:
    """``ids(doc_id, fp)`` to ``(fp, component_id)``, a row per distinct fingerprint."""
    nodes = cut(ids.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    keys = nodes.select("fp").mapInArrow(_emit_keys, "key int, fp long")
    stars = keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link, "node long, root long")
    found = cut(_grouped(components(stars)))
    least = small(cut(found.join(nodes, found.node == nodes.fp).groupBy("root").agg(F.min("least_id").alias("component_id"))))
    linked = found.join(least, "root").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked"))
    return nodes.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"))


def _grouped(found: DataFrame) -> DataFrame:
    """``found(node, root)`` with a row for every root too."""
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``.

    Null and wordless texts have fingerprint 0 and link with each other; repeated rows share fingerprint and
    component; null ids never name a component unless it has no other; an empty table gives an empty one.
    """
    ids = cut(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    # Written first, so that the rows of a fingerprint that many share are met by a broadcast or split.
    return ids.join(small(cut(near_components(ids))), "fp").select("doc_id", "fp", "component_id")


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _second(h: np.ndarray) -> np.ndarray:
    """64 further bits of each hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(text: bytes, words: int = WIDE_WORDS) -> tuple[int, int]:
    """Low and high 64 bits of the fingerprint of the distinct shingles."""
    h = np.unique(shingle_hashes(text, words))
    return majority(h), majority(_second(h))


def reach(similarity: float, bits: int = 128) -> int:
    """Differing bits that all but 3 % of the pairs with this Jaccard similarity stay within: the share of differing
    bits is the angle between the sets by pi, and its spread that of independent bits."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + 2 * np.sqrt(bits * p * (1 - p))))


def wide_keys(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) for every two segments: the codeword nearest to one and every codeword near the other, either way."""
    parts = []
    for a, w in WIDE_SEGMENTS:
        low = lo >> np.uint64(a) if a < 64 else hi >> np.uint64(a - 64)
        if a < 64 < a + w:
            low = low | hi << np.uint64(64 - a)
        parts.append(segment_keys((low & np.uint64((1 << w) - 1)).astype(np.int64)))
    keys, rows = [], []
    for p, (i, j) in enumerate(permutations(range(len(parts)), 2)):
        r, b = np.nonzero(parts[j] >= 0)
        keys.append((p << 24) | (parts[i][r, 0] << 12) | parts[j][r, b])
        rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


def _emit_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lo, hi = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for at in range(0, len(lo), 2048):
            a, b = lo[at : at + 2048], hi[at : at + 2048]
            key, row = wide_keys(a.view(np.uint64), b.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(a[row]), pa.array(b[row])], names=["key", "lo", "hi"])


def _apart(lo: np.ndarray, hi: np.ndarray, lo2, hi2) -> np.ndarray:
    """Differing bits of fingerprints."""
    return np.bitwise_count((lo ^ lo2).view(np.uint64)).astype(np.int64) + np.bitwise_count((hi ^ hi2).view(np.uint64))


def _forest(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of the edges of a minimum spanning forest of ``n`` nodes, by rounds in which every tree takes its
    shortest edge outwards; ties go to the earlier edge."""
    label, left, taken = np.arange(n), np.arange(len(u)), []
    order = d * max(1, len(u)) + np.arange(len(u))
    while True:
        left = left[label[u[left]] != label[v[left]]]
        if not len(left):
            return np.unique(np.concatenate(taken)) if taken else np.empty(0, np.int64)
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, label[u[left]], order[left])
        np.minimum.at(best, label[v[left]], order[left])
        pick = np.unique(best[best < np.iinfo(np.int64).max]) % max(1, len(u))
        taken.append(pick)
        while True:
            low, was = np.minimum(label[u[pick]], label[v[pick]]), label.copy()
            np.minimum.at(label, was[u[pick]], low)
            np.minimum.at(label, was[v[pick]], low)
            label = label[label]
            if (label == was).all():
                break


def _short_forest(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) that hold together what is near within runs of equal key."""
    at, lag, left, right, far = np.arange(len(key)), 0, [], [], []
    while True:
        lag += 1
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        d = _apart(lo[at], hi[at], lo[at + lag], hi[at + lag])
        near = d <= most
        left.append(at[near])
        right.append(at[near] + lag)
        far.append(d[near])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, v, d = (np.concatenate(x) for x in (left, right, far))
    kept = _forest(len(key), u, v, d)
    return u[kept], v[kept]


def _long_forest(lo: np.ndarray, hi: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long run, node by node: the nearest one outside the tree joins it."""
    rest, near, m, u, v = np.arange(1, len(lo)), np.zeros(len(lo) - 1, np.int64), len(lo) - 1, [], []
    a, b = lo[1:].copy(), hi[1:].copy()
    dist = _apart(a, b, lo[0], hi[0])
    while m:
        i = int(np.argmin(dist[:m]))
        new = rest[i]
        if dist[i] <= most:
            u.append(new)
            v.append(near[i])
        m -= 1  # the last one takes the place of the one that joined
        for x in (rest, near, a, b, dist):
            x[i] = x[m]
        d = _apart(a[:m], b[:m], lo[new], hi[new])
        closer = d < dist[:m]
        near[:m][closer], dist[:m][closer] = new, d[closer]
    return np.array(u, np.int64), np.array(v, np.int64)


def _link_wide(most: int):
    """Rows sorted by key to edges; a run may go on over several batches."""

    def flush(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
        width = np.diff(np.r_[start, len(key)])
        brief = np.repeat(width <= SHORT_RUN, width)
        runs = [(np.nonzero(brief)[0], None)] if brief.any() else []
        runs += [(np.arange(s, s + w), w) for s, w in zip(start[width > SHORT_RUN], width[width > SHORT_RUN])]
        for own, long in runs:
            a, b = lo[own], hi[own]
            u, v = _long_forest(a, b, most) if long else _short_forest(key[own], a, b, most)
            # The smaller fingerprint first, so that the same edge of another key is the same row.
            swap = (a[u] > a[v]) | ((a[u] == a[v]) & (b[u] > b[v]))
            u, v = np.where(swap, v, u), np.where(swap, u, v)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[u], b[u], a[v], b[v])], names=["lo", "hi", "lo2", "hi2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if held and last == 0 and held[0][0][-1] == columns[0][-1]:
                held.append(columns)
                continue
            held.append([c[:last] for c in columns])
            if whole := [np.concatenate(x) for x in zip(*held)]:
                if len(whole[0]):
                    yield from flush(*whole)
            held = [[c[last:] for c in columns]]
        if held:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def _shingles(words: int):
    """(key, text) to (key, s), the shingles of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, texts in _by_slices(batch):
                yield pa.RecordBatch.from_arrays([key, _lists([np.unique(shingle_hashes(t, words)) for t in texts])], names=["key", "s"])

    return run


def _by_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The rows of (what names a text, text), a few at a time."""
    at = 0
    for part in slices(batch.column(1)):
        yield batch.column(0).slice(at, len(part)), utf8(part)
        at += len(part)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))


def _bucket_counts(words: int):
    """Texts to (at, n): how many shingles of the task are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                for text in utf8(part):
                    np.add.at(n, (np.unique(shingle_hashes(text, words)) & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["at", "n"])

    return run


def _marks(magnitudes, words: int, similarity: float):
    """What is kept of a text: fingerprint, the name of its set of shingles and their number, and its prefix: the shingles
    of which a set as similar as asked shares one, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _by_slices(batch):
                sets = [np.unique(shingle_hashes(t, words)) for t in texts]
                lo, hi = (pa.array(np.array([majority(f(h)) for h in sets], np.uint64).view(np.int64)) for f in (lambda h: h, _second))
                key = pa.array([xxhash.xxh3_128_digest(h.tobytes(), SEED) for h in sets], pa.binary())
                n = np.array([len(h) for h in sets], np.int64)
                kept = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
                first = [h[np.lexsort((h, magnitudes.value[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]))[:k]] for h, k in zip(sets, kept)]
                yield pa.RecordBatch.from_arrays([row, lo, hi, key, pa.array(n.astype(np.int32)), _lists(first)], names=["row", "lo", "hi", "key", "n", "t"])

    return run


def _verified(docs: DataFrame, pairs: DataFrame, first: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(node, root)``, written: of ``pairs(a, b)`` of keys, those whose sets of shingles are as similar as asked. ``first(key, row)``
    says which of ``docs(row, text)`` to read for a key."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    asked = small(first.join(small(cut(ends)), "key"))
    sets = cut(docs.join(asked, "row").groupBy("key").agg(F.min("text").alias("text")).mapInArrow(_shingles(words), "key binary, s array<long>"))
    one, two = (sets.select(F.col("key").alias(n), F.col("s").alias(f"s{n}")) for n in "ab")
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    linked = cut(both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select(F.col("a").alias("node"), F.col("b").alias("root")))
    discard(sets)
    return linked


def _fingerprint_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``, written: keys of ``nodes(key, lo, hi)`` of equal fingerprints, or of near ones that keys bring together."""
    prints = cut(nodes.groupBy("lo", "hi").agg(F.min("key").alias("key")))
    keys = prints.select("lo", "hi").mapInArrow(_emit_wide, "key int, lo long, hi long")
    near = keys.repartition("key").sortWithinPartitions("key", "lo", "hi").mapInArrow(_link_wide(reach(similarity)), "lo long, hi long, lo2 long, hi2 long")
    near = cut(near.distinct())
    named = lambda end, *at: prints.select(F.col("lo").alias(at[0]), F.col("hi").alias(at[1]), F.col("key").alias(end))
    apart = near.join(named("a", "lo", "hi"), ["lo", "hi"]).join(named("b", "lo2", "hi2"), ["lo2", "hi2"]).select("a", "b")
    same = nodes.join(prints.withColumnRenamed("key", "a"), ["lo", "hi"]).where("key <> a").select("a", F.col("key").alias("b"))
    pairs = cut(apart.unionByName(same))
    discard(prints)
    discard(near)
    return pairs


def _shared_least(m: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that the prefixes of two sets of these sizes share at least, if the sets are as similar as asked: what sets
    share outside their prefixes comes after the end of the prefix that ends first, so it is no more than the rest of its set."""
    rest = np.ceil(similarity * np.maximum(m, n) - 1e-9) - 1
    return (np.ceil(similarity / (1 + similarity) * (m + n) - 1e-9) - rest).astype(np.int64)


def _may_pair(m, n, root, root2, early, early2, similarity: float) -> np.ndarray:
    """Pairs of two components whose sizes fit and whose shared shingle stands early enough in the smaller set."""
    fits = (n >= similarity * m - 1e-9) & (m >= similarity * n - 1e-9)
    return fits & (root != root2) & np.where(m <= n, early, early2) & np.where(n <= m, early2, early)


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of parities (a row each, 64-bit words) as narrower ones."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, root, n, t) with the number of shingles in the prefix t and the bitmap of their parity, sixteen bits or more a shingle, instead of them."""
    for batch in batches:
        bits = []
        for t in batch.column(4):
            t = t.values.to_numpy(zero_copy_only=False).view(np.uint64)
            width = max(256, 1 << int(16 * len(t) - 1).bit_length())
            bits.append(np.packbits(np.bincount((_second(t) % np.uint64(width)).astype(np.int64), minlength=width).astype(np.uint8) & 1).tobytes())
        held = batch.column(4).value_lengths()
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], held, pa.array(bits, pa.binary())], names=["key", "id", "root", "n", "held", "bits"])


def _shared_runs(similarity: float):
    """Postings (w, id, root, n, early) sorted by shingle to what two components share of them: short runs give their pairs
    (a, b); of longer ones each posting goes, as a, to the pairs (i, j) of blocks of ``BLOCK`` postings that its own one is in."""

    def pairs(w, ids, root, n, early) -> pa.RecordBatch:
        at, lag, left, right = np.arange(len(w)), 0, [], []
        while True:
            lag += 1
            at = at[at + lag < len(w)]
            at = at[w[at] == w[at + lag]]
            if not len(at):
                break
            hit = at[_may_pair(n[at], n[at + lag], root[at], root[at + lag], early[at], early[at + lag], similarity)]
            left.append(ids[hit])
            right.append(ids[hit + lag])
        u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
        both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        none = [pa.nulls(len(both), t) for t in (pa.int64(), *[pa.int32()] * 3, pa.bool_())]
        return pa.RecordBatch.from_arrays([*none, pa.array(both[:, 0]), pa.array(both[:, 1])], names=RUNS)

    def blocks(w: int, ids, early) -> Iterator[pa.RecordBatch]:
        own, count = np.arange(len(ids)) // BLOCK, -(-len(ids) // BLOCK)
        for other in range(count):
            i, j = np.minimum(own, other), np.maximum(own, other)
            columns = [np.full(len(ids), w), *(x.astype(np.int32) for x in (i, j, own)), early, ids]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(ids), pa.int64())], names=RUNS)

    def flush(w, ids, root, n, early) -> Iterator[pa.RecordBatch]:
        start = np.nonzero(np.r_[True, w[1:] != w[:-1]])[0]
        width = np.diff(np.r_[start, len(w)])
        brief = np.repeat((width > 1) & (width <= SHORT_RUN // 4), width)
        if brief.any():
            yield pairs(*(c[brief] for c in (w, ids, root, n, early)))
        for s, k in zip(start[width > SHORT_RUN // 4], width[width > SHORT_RUN // 4]):
            if (root[s : s + k] != root[s]).any():
                yield from blocks(w[s], ids[s : s + k], early[s : s + k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if last or held and held[-1][0][-1] != columns[0][-1]:
                held.append([c[:last] for c in columns])
                yield from flush(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append([c[last:] for c in columns])
        if held:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def _apart_at_most(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows i and j of bitmaps differ in no more bits than ``most``."""
    at, apart = np.nonzero(most >= 0)[0], np.zeros(len(i), np.int64)
    for k in range(0, left.shape[1], 4):
        apart[at] += np.bitwise_count(left[i[at], k : k + 4] ^ right[j[at], k : k + 4]).sum(axis=1, dtype=np.int64)
        at = at[apart[at] <= most[at]]
    return at


def _block_pairs(similarity: float):
    """The postings of two blocks of a shingle to the pairs (a, b) of ids whose prefixes may share enough by their bitmaps."""

    def run(group: pa.Table) -> pa.Table:
        i, j, block, early, ids, root, n, held = (group.column(c).to_numpy() for c in ("i", "j", "own", "early", "id", "root", "n", "held"))
        bits, wide = group.column("bits").to_pylist(), pc.binary_length(group.column("bits")).to_numpy() // 8
        found = [np.empty((0, 2), np.int64)]
        for width in np.unique(wide):
            own, other = np.nonzero(wide == width)[0], np.nonzero((wide == width) | (wide == 2 * width))[0]
            left = np.frombuffer(b"".join(bits[x] for x in own), np.uint64).reshape(len(own), -1)
            right = np.concatenate([_folded(np.frombuffer(bits[x], np.uint64).reshape(1, -1), width) for x in other])
            step = max(1, PAIRS // len(other))
            for at in range(0, len(own), step):
                x, y = own[at : at + step, None], other[None, :]
                ok = ((block[x] != block[y]) | (i[0] == j[0])) & ((wide[y] > width) | (x < y))
                r, c = np.nonzero(ok & _may_pair(n[x], n[y], root[x], root[y], early[x], early[y], similarity))
                p, q = own[r + at], other[c]
                near = _apart_at_most(left, right, r + at, c, held[p].astype(np.int64) + held[q] - 2 * np.maximum(0, _shared_least(n[p], n[q], similarity)))
                found.append(np.stack([np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])], axis=1)[near])
        both = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    return run


def _near_pairs(similarity: float):
    """Pairs with the sizes and bitmaps of both, to those whose prefixes may share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n, held, held2 = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "n2", "held", "held2"))
            most = held + held2 - 2 * np.maximum(0, _shared_least(m, n, similarity))
            wide, wide2 = (pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) // 8 for c in ("bits", "bits2"))
            for w, w2 in np.unique(np.stack([wide, wide2], axis=1), axis=0):
                every, step = np.nonzero((wide == w) & (wide2 == w2))[0], max(1, (1 << 18) // max(w, w2))
                for at in range(0, len(every), step):
                    some = pa.array(every[at : at + step])
                    left, right = (_folded(np.frombuffer(b"".join(batch.column(c).take(some).to_pylist()), np.uint64).reshape(len(some), -1), min(w, w2)) for c in ("bits", "bits2"))
                    row = np.arange(len(some))
                    near = some.take(pa.array(_apart_at_most(left, right, row, row, most[every[at : at + step]])))
                    yield pa.RecordBatch.from_arrays([batch.column("a").take(near), batch.column("b").take(near)], names=["a", "b"])

    return run


def _prefix_pairs(marked: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``, written: keys of ``marked(key, n, t)`` that may be as similar as asked by their sizes and by the number of shingles
    that their prefixes share, less those that ``found(node, root)`` holds together already.

    A shingle that many sets share, as a family of texts below the similarity does, never gives a row a pair: blocks of
    its sets meet in tasks, where bitmaps of the prefixes, which differ in no more bits than the prefixes in shingles,
    tell what shares too few.
    """
    sets = sets_once(marked, "n").where("n > 0").join(small(found), F.col("key") == F.col("node"), "left")
    sets = sets.select("key", F.xxhash64("key").alias("id"), F.xxhash64(F.coalesce("root", "key")).alias("root"), "n", "t")
    nodes = cut(sets.mapInArrow(_sketches, "key binary, id long, root long, n int, held int, bits binary"))
    # As the smaller set of a pair, a set is found by half of its prefix, as sets share t / (1 + t) of both sizes or more.
    early = F.col("pos") <= F.col("n") - F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("n") - 1e-9)
    rows = sets.select("id", "root", "n", F.posexplode("t").alias("pos", "w")).select("w", "id", "root", "n", early.alias("early"))
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, so that work is not dealt by bytes
    runs = rows.repartition(parts, "w").sortWithinPartitions("w").mapInArrow(_shared_runs(similarity), "w long, i int, j int, own int, early boolean, a long, b long")
    runs = cut(runs)
    many = runs.where("b IS NULL").join(nodes.drop("key"), F.col("a") == F.col("id")).select("w", "i", "j", "own", "early", "id", "root", "n", "held", "bits")
    many = many.repartition(parts, "w", "i", "j").groupBy("w", "i", "j").applyInArrow(_block_pairs(similarity), "a long, b long")
    few = runs.where("b IS NOT NULL").select("a", "b").distinct()
    one = nodes.select(F.col("id").alias("a"), "n", "held", "bits")
    two = nodes.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("n", "held", "bits")])
    few = few.join(one, "a").join(two, "b").mapInArrow(_near_pairs(similarity), "a long, b long")
    pairs = cut(many.unionByName(few).distinct())
    one, two = (nodes.select(F.col("id").alias(c), F.col("key").alias(f"key_{c}")) for c in "ab")
    named = cut(pairs.join(one, "a").join(two, "b").select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")))
    for done in (nodes, runs, pairs):
        discard(done)
    return named


def similar_components(docs: DataFrame, marked: DataFrame, words: int = WIDE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``marked``, a written table of the _marks() of ``docs(row, text)``, to ``(node, root)``: by the key of a set of shingles, that
    of its component. Nodes without a link are left out.

    Texts of one set are one node, which its least row stands for. What fingerprints bring together comes first, and holds
    large groups together by few edges; then shared prefixes find the pairs between its components, without loss. An
    edge is one only if the shingles are as similar as asked.
    """
    nodes = cut(marked.groupBy("key").agg(F.min("row").alias("row"), F.any_value("lo").alias("lo"), F.any_value("hi").alias("hi")))
    first = nodes.select("key", "row")
    near = _fingerprint_pairs(nodes, similarity)
    found = cut(components(_verified(docs, near, first, words, similarity)))
    rest = _prefix_pairs(marked, found, similarity)
    more = _verified(docs, rest, first, words, similarity)
    if not more.isEmpty():
        found = components(found.unionByName(more))
    for done in (nodes, near, rest):
        discard(done)
    return found


def deduplicate(docs: DataFrame, words: int = WIDE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest id; columns stay as they are.

    Rows, not ids, are kept or go: of rows that share an id or have none, each is judged by its own text. Null ids come
    last; among equal ids the hash of the row decides; of rows that are equal in all columns one stays. Null and
    wordless texts are one group. An empty table gives an empty one. Very long texts count with all their shingles.
    """
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    same = F.xxhash64(F.lit(SEED), *hashable)
    base = docs.select("doc_id", "text", same.alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_h").alias("h")).alias("row")
    n = docs.count()
    sample = base.where(F.pmod(F.xxhash64("_h"), F.lit(max(1, n // SAMPLE))) == 0).select("text").mapInArrow(_bucket_counts(words), "at int, n long")
    magnitudes = magnitudes_of(sample.groupBy("at").agg(F.sum("n").alias("n")).where("n > 1"))
    schema = T.StructType([base.select(row).schema["row"]]).add("lo", T.LongType()).add("hi", T.LongType()).add("key", T.BinaryType()).add("n", T.IntegerType()).add("t", T.ArrayType(T.LongType()))
    slim = cut(base.select(row, "text").mapInArrow(_marks(magnitudes, words, similarity), schema))
    found = small(similar_components(base.select(row, "text"), slim, words, similarity))
    node = slim.select("row", "key").join(found, F.col("key") == F.col("node"), "left").select("row", F.coalesce("root", "key").alias("group"))
    node = cut(node.groupBy("group", "row").agg(F.count(F.lit(1)).alias("n")))
    first = node.groupBy("group").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    gone = small(cut(node.join(small(cut(first)), "group").where(F.col("row") != F.col("first")).select("row.*")))
    key = lambda df: (base["doc_id"].eqNullSafe(df["id"])) & (base["_h"] == df["h"])
    again = node.where("n > 1").select("row.*").distinct()
    kept = base.join(gone, key(gone), "left_anti")
    if again.limit(1).count():
        again = small(again)
        repeated = kept.join(again, key(again), "left_semi").dropDuplicates(["doc_id", "_h"])
        kept = kept.join(again, key(again), "left_anti").unionByName(repeated)
    discard(slim)
    return kept.select("_row.*")
