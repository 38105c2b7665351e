"""All word lists in one pass over a text.

An automaton of the literals of many lists reads a text once, in Arrow batches, and says which literals it holds; what a list
asks is then a test on the found numbers. A pattern that is no literal is only tried where one of the literals that
each of its matches must hold was found; these are read off the pattern itself.
"""

from __future__ import annotations

import re._constants as k
import re._parser as parser
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .text import text


def _of_item(op, value) -> set[str] | None:
    """Literals one of which stands in every match of a part of a pattern; None where that can't be told."""
    if op is k.SUBPATTERN:
        return _of_sequence(value[3])
    if op is k.BRANCH:
        parts = [_of_sequence(p) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if op in (k.MAX_REPEAT, k.MIN_REPEAT) and value[0] >= 1:
        return _of_sequence(value[2])
    return None


def _of_sequence(items) -> set[str] | None:
    found, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is k.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append({run})
        run = ""
        if op is not None and (more := _of_item(op, value)):
            found.append(more)
    return max(found, key=lambda s: min(map(len, s)), default=None)


def needed(pattern: str) -> set[str] | None:
    """Literals one of which every match of ``pattern`` holds, as long as can be; None if there are none."""
    return _of_sequence(parser.parse(pattern))


class Scan:
    """The literals of ``lists`` and those that the patterns of ``groups`` (name to patterns) need."""

    def __init__(self, lists: dict[str, list[str]], groups: dict[str, list[str]] | None = None):
        self.patterns = {name: "|".join(p) for name, p in (groups or {}).items()}
        self.words = {name: set(w) for name, w in lists.items()}
        for name, pattern in self.patterns.items():
            if (words := needed(pattern)) is not None:
                self.words[name] = words
        self.number = {w: i for i, w in enumerate(sorted(set().union(*self.words.values())))}

    def hits(self, c) -> Column:
        """The numbers of the literals that the lower-cased text holds, each once."""
        return _finder(tuple(self.number))(F.lower(text(c)))

    def has(self, hits: Column, name: str) -> Column:
        """Whether a literal of the list was found."""
        return F.exists(hits, lambda i: i.isin([self.number[w] for w in self.words[name]]))

    def count(self, hits: Column, name: str) -> Column:
        """How many different literals of the list were found."""
        return F.size(F.filter(hits, lambda i: i.isin([self.number[w] for w in self.words[name]])))

    def matches(self, hits: Column, c, name: str) -> Column:
        """Whether the lower-cased text matches one of the patterns of the group."""
        match = F.lower(text(c)).rlike(self.patterns[name])
        return F.when(self.has(hits, name), match).otherwise(False) if name in self.words else match


@lru_cache(maxsize=16)
def _finder(words: tuple[str, ...]):
    @arrow_udf(T.ArrayType(T.IntegerType()))
    def find(texts: pa.Array) -> pa.Array:
        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(w, i)
        automaton.make_automaton()
        return pa.array([[] if t is None else sorted({i for _, i in automaton.iter(t)}) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return find
