"""Benchmark decontamination with a generalised suffix automaton.

All benchmark items, normalised to words, go into one suffix automaton of word ids; every state knows the
items in which its strings occur. Training texts stream through it: after each word the automaton holds the
longest suffix that occurs in some item. A suffix of ``window`` words or more marks its last ``window`` words
as hit and names the items of the state on its suffix path that holds strings of that length; items shorter
than a window are found on the suffix path as a whole.

A text word that no item has, or a pair of neighbours that no item has, ends every match, so the automaton
runs only over stretches whose pairs all pass a bitmap of the items' pairs. That skips nothing.

Benchmarks are cut into blocks of at most ``BLOCK_WORDS`` words, which bounds automaton and broadcast; texts
pass the blocks one after the other, each adding to what the blocks before it found. After ``PASS`` blocks what was
found is written and they are given up, so that a worker never holds more of them.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import WORD_TABLE, cut, packed, slices, utf8, without

WINDOW = 10
BLOCK_WORDS = 100_000
PASS = 4
#: Words of the shortest span that decontaminate() removes; shorter benchmark items are too common to be leaks.
MIN_SPAN = 5
PAIR_BITS = 20
FOUND = (
    T.StructType()
    .add("n_words", T.LongType())
    .add("starts", T.ArrayType(T.IntegerType()))
    .add("ends", T.ArrayType(T.IntegerType()))
    .add("items", T.ArrayType(T.StringType()))
    .add("clean", T.StringType())
)
_FOUND = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("clean", pa.string())])
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all non-ASCII characters."""
    return text.translate(WORD_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over the words of ``items``, pairs of id and words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        self.items: list[set[str]] = [set() for _ in self.next]
        self.whole: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for name, word_ids in coded:
            at = 0
            for w in word_ids:
                at = up = self.next[at][w]
                while up > 0 and name not in self.items[up]:
                    self.items[up].add(name)
                    up = self.link[up]
            if len(word_ids) < window:
                self.whole[at].append((len(word_ids), name))
        self.shortest = min((min(len(x), window) for _, x in coded), default=window)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, x in coded:
            a = np.array(x, np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True
        self._path: dict[int, tuple[int, list[tuple[int, str]]]] = {}

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 40_503 + b * 7_919 + (b >> 7)) & ((1 << PAIR_BITS) - 1)

    def _clone(self, p: int, w: int, q: int) -> int:
        """A state for the strings of ``q`` up to one word more than ``p``."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: int) -> int:
        """Append word ``w`` to the item that stands at state ``last``."""
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new, p = len(self.next), last
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _suffixes(self, state: int) -> tuple[int, list[tuple[int, str]]]:
        """The state on the suffix path that holds strings of ``window`` words (-1: none), and whole short items above."""
        if state not in self._path:
            wide, up = -1, state
            while up > 0 and self.length[up] >= self.window:
                wide, up = up, self.link[up]
            above, up = [], self.link[state]
            while up > 0:
                above += self.whole[up]
                up = self.link[up]
            self._path[state] = wide, above
        return self._path[state]

    def scan(self, word_ids: list[int], base: int, starts: list[int], ends: list[int], items: set[str]) -> None:
        """Stream words, the first at position ``base``; add hit ranges (end exclusive) and items."""
        state = length = 0
        for i, w in enumerate(word_ids, base + 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(w)) is None:
                continue
            state, length = to, length + 1
            wide, above = self._suffixes(state)
            if length >= self.window:
                starts.append(i - self.window)
                ends.append(i)
                items |= self.items[wide]
            for n, name in above:
                starts.append(i - n)
                ends.append(i)
                items.add(name)
            for n, name in self.whole[state]:
                if n <= length:
                    starts.append(i - n)
                    ends.append(i)
                    items.add(name)

    def stretches(self, word_ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of positions that can hold a match; -1 stands for a word of no item and between texts."""
        known = word_ids >= 0
        if self.shortest > 1:
            known[:-1] &= known[1:] & self.pairs[self._pair(word_ids[:-1], word_ids[1:])]
            known[-1:] = False
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        a, b = edge[::2], edge[1::2] + (self.shortest > 1)
        long_enough = b - a >= self.shortest
        return list(zip(a[long_enough].tolist(), b[long_enough].tolist()))


def _merge(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The union of ranges, in order; ranges that touch become one."""
    a: list[int] = []
    b: list[int] = []
    for s, e in sorted(zip(starts, ends)):
        if a and s <= b[-1]:
            b[-1] = max(b[-1], e)
        else:
            a.append(s)
            b.append(e)
    return a, b


def _without(text: bytes, starts: list[int], ends: list[int]) -> str:
    """A text without the words of these ranges and what stands between them."""
    text = text.decode()
    spans = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for s, e in zip(starts, ends):
        kept.append(text[at : spans[s][0]])
        at = spans[e - 1][1]
    return "".join([*kept, text[at:]]).strip()


def _finder(automaton: Broadcast, first: bool, min_span: int | None):
    """The UDF of one block: (text, found so far) to found. With ``min_span``, texts that have ranges of so many
    words get a clean text without them."""

    def run(texts: pa.Array, before: pa.Array | None) -> pa.Array:
        sam, out, done = automaton.value, [], 0
        get = sam.vocabulary.get
        for part in slices(texts):
            raw = utf8(part)
            docs = [words_of(t) for t in raw]
            sizes = np.array([len(d) for d in docs], np.int64)
            # A -1 after every text keeps matches from running over into the next one.
            ids = np.concatenate([np.fromiter(map(get, (*d, b""), repeat(-1)), np.int64, len(d) + 1) for d in docs])
            begin = np.concatenate(([0], np.cumsum(sizes + 1)))
            seen = before.slice(done, len(docs)).to_pylist() if before is not None else [None] * len(docs)
            rows = [{"n_words": int(n), "starts": b["starts"] if b else [], "ends": b["ends"] if b else [], "items": b["items"] if b else []} for n, b in zip(sizes, seen)]
            new: dict[int, tuple[list[int], list[int], set[str]]] = {}
            for a, b in sam.stretches(ids):
                d = int(np.searchsorted(begin, a, side="right")) - 1
                sam.scan(ids[a:b].tolist(), a - int(begin[d]), *new.setdefault(d, ([], [], set())))
            for d, (s, e, names) in new.items():
                rows[d]["starts"], rows[d]["ends"] = _merge(rows[d]["starts"] + s, rows[d]["ends"] + e)
                rows[d]["items"] = sorted(names.union(rows[d]["items"]))
            if min_span is not None:
                for r, t in zip(rows, raw):
                    if long := [(s, e) for s, e in zip(r["starts"], r["ends"]) if e - s >= min_span]:
                        r["clean"] = _without(t, *zip(*long))
            out.append(pa.array(rows, _FOUND))
            done += len(docs)
        return pa.concat_arrays(out) if out else pa.array([], _FOUND)

    if first:

        @arrow_udf(FOUND)
        def find(texts: pa.Array) -> pa.Array:
            return run(texts, None)
    else:

        @arrow_udf(FOUND)
        def find(texts: pa.Array, before: pa.Array) -> pa.Array:
            return run(texts, before)

    return find.asNondeterministic()  # else a filter on the result would run it a second time


def _blocks(items: DataFrame, block_words: int):
    """Items in blocks of at most ``block_words`` words, or a single item where that has more."""
    block, held = [], 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator()
    for name, text in rows:
        words = words_of((text or "").encode())
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((name, words))
        held += len(words)
    yield block


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, min_span: int | None = None) -> DataFrame:
    """``docs`` with the column ``found``: n_words, merged hit ranges in words (starts, ends exclusive), item ids, and
    with ``min_span`` the clean text of rows that have ranges of so many words.

    ``items(item_id, text)`` is the benchmark, a stated query set. Null and wordless texts have no words and no
    hits; items without words never occur; items that share an id count once; a null item id reads ``null``;
    an empty benchmark hits nothing; a column named ``found`` is replaced.
    """
    out, blocks = without(docs, "found"), _blocks(items, block_words)
    block, first, held = next(blocks), True, []
    while block is not None:
        if len(held) == PASS:
            out = cut(out)
            for old in held:
                old.unpersist()
            held = []
        sent, block = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window)), next(blocks, None)
        held.append(sent)
        find = _finder(sent, first, min_span if block is None else None)
        out = out.withColumn("found", find(F.col("text")) if first else find(F.col("text"), F.col("found")))
        first = False
    return out


def n_hit(least: int = 1) -> F.Column:
    """Words in hit ranges of ``least`` words or more."""
    return F.expr(f"aggregate(zip_with(found.starts, found.ends, (a, b) -> cast(if(b - a >= {least}, b - a, 0) as bigint)), 0L, (s, x) -> s + x)")


def contamination_table(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The digest: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = find_contamination(docs.select("doc_id", "text"), items, **how)
    out = out.select("doc_id", "found.n_words", n_hit().alias("n_hit"), F.array_sort("found.items").alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, min_span: int = MIN_SPAN, max_coverage: float = 0.5, **how) -> DataFrame:
    """``docs`` without benchmark passages: hit ranges of at least ``min_span`` words are removed from the texts, and
    documents of which such ranges are more than ``max_coverage`` of the words go as a whole. Columns stay; n_chars
    follows the text. Null and wordless texts stay as they are; repeated rows fare alike; ids play no part; an empty
    benchmark or table changes nothing; very long texts are streamed whole."""
    out = find_contamination(packed(docs, "text"), items, min_span=min_span, **how)
    out = out.where(n_hit(min_span) <= F.col("found.n_words") * F.lit(max_coverage))
    clean = F.col("found.clean")
    own = {c: F.col("_row").getField(c) for c in docs.columns} | {"text": F.coalesce(clean, F.col("text"))}
    if "n_chars" in own:
        own["n_chars"] = F.coalesce(F.length(clean).cast(docs.schema["n_chars"].dataType), own["n_chars"])
    return out.select(*[v.alias(c) for c, v in own.items()])
