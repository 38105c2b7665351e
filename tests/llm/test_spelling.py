import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from nuggetry.llm import queries, spelling

from .helpers import SF, clashing, docs, lower, odd, rows


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(table):
    n = Counter()
    for doc_id, text in table:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = lower(run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    by = {w: [] for w in n}
    for w in n:  # the deletions of a word find all that are near it
        for i in range(len(w)):
            by.setdefault(("del", w[:i], w[i + 1 :]), []).append(w)
    out, links = {}, {w: set() for w in n}
    for k, group in by.items():
        if isinstance(k, tuple):
            for a, b in combinations(set(group), 2):
                links[a].add(b), links[b].add(a)
            if (short := k[1] + k[2]) in n:
                for w in group:
                    links[w].add(short), links[short].add(w)
    for w in n:
        assert all(near(w, v) for v in links[w])
        best = min(links[w], key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = {"word": w, "form": form, "n": n[w], "n_near": len(links[w]), "form_n": n[form] if form else None}
    for w, r in out.items():
        at = w
        while out[at]["form"]:
            at = out[at]["form"]
        r["root"] = at
    return out


def test_query(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got, want = {r["word"]: r for r in rows(queries.op12_spelling(spark, SF))}, plain(table)
    assert got == want and sum(r["form"] is not None for r in want.values()) > 5


WORDS = st.lists(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=60, unique=True)


@given(WORDS)
@settings(max_examples=200, deadline=None)
def test_near_words_of_one_group(words):
    for width in {len(w) for w in words} | {len(w) + 1 for w in words}:
        some = [w for w in words if len(w) in (width, width - 1)]
        a, b = spelling.near_in_groups(np.zeros(len(some), np.int64), [w.encode("latin-1") for w in some], np.zeros(len(some), np.int64), width)
        got = sorted((some[i], some[j]) for i, j in zip(a, b))
        assert got == sorted((x, y) for x in some for y in some if len(y) == width and near(x, y))


@given(st.permutations(range(23)), st.lists(st.tuples(*[st.integers(0, 23)] * 4), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_rectangles(ranks, boxes):
    boxes = [(min(a, b), max(a, b), min(c, d), max(c, d)) for a, b, c, d in boxes]
    who, value = spelling.WaveletTree(np.array(ranks)).report(*(np.array(x, np.int64) for x in zip(*boxes)))
    want = [(i, r) for i, (a, b, c, d) in enumerate(boxes) for r in ranks[a:b] if c <= r < d]
    assert sorted(zip(who.tolist(), value.tolist())) == sorted(want)


def test_splitting_groups_loses_nothing(spark):
    words = sorted({a + b + c for a in ("haus", "maus", "hause", "h") for b in ("a", "b", "ab", "ba", "") for c in ("tür", "tur", "tuer", "t" * 40, "t" * 41, "")} - {""})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    want = sorted((x, y, words.index(y)) for x in words for y in words if near(x, y))
    for limit in (1, 8, 60, 1 << 19):
        assert sorted(tuple(r) for r in spelling.near_words(table, limit).collect()) == want


def test_chains_of_forms(spark):
    texts = ["abcdefg " * 3200 + "abcdefh " * 640 + "abcdeih " * 128 + "abcdjih " * 25 + "abckjih " * 5 + "unrelated " * 7]
    got = {r["word"]: r for r in rows(spelling.variant_table(docs(spark, texts, doc_id=[1])))}
    assert got == plain([(1, texts[0])])
    assert got["abckjih"]["root"] == "abcdefg" and got["unrelated"]["root"] == "unrelated"


def test_odd_rows(spark):
    assert spelling.variant_table(odd(spark).limit(0)).count() == 0
    got = {r["word"]: r for r in rows(spelling.variant_table(clashing(odd(spark))))}
    assert got == plain([(r.doc_id, r.text) for r in odd(spark).collect()])
    long = ["x" * 30_000 + " " + "x" * 29_999 + "y × ÷×÷×÷×÷ Ĳabcdefĳ ÀÈÌÒÙÉ"] * 5 + [None, ""]
    df = docs(spark, long, doc_id=[None, None, 1, 2, 3, 4, 5])
    got = {r["word"]: r for r in rows(spelling.variant_table(df))}
    assert got == plain([(r.doc_id, r.text) for r in df.collect()]) and got["x" * 30_000]["n_near"] == 1
