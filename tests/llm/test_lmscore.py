import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from nuggetry.llm import lmscore, queries

from .helpers import SF, clashing, docs, odd, rows


def test_query(spark):
    got = rows(queries.op9_lmscore(spark, SF))
    base = {r.doc_id: len(r.text.encode()) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == base
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality >= 1 AND toxic = 0").collect()}
    vocabulary = len({w for _, t in texts for w in lmscore._WORD.findall(t.encode())}) + 1
    target, background = plain_word_loss([t for i, t in texts if i in good], vocabulary), plain_word_loss([t for _, t in texts], vocabulary)
    text_of = dict(texts)
    for r in got[::5]:
        want = target(text_of[r["doc_id"]]).mean(), background(text_of[r["doc_id"]]).mean()
        assert math.isclose(r["target_xent"], want[0], abs_tol=1e-9) and math.isclose(r["background_xent"], want[1], abs_tol=1e-9)
        assert math.isclose(r["xent_diff"], want[0] - want[1], abs_tol=1e-9)
    again = {r["doc_id"]: r["xent_diff"] for r in rows(queries.op9_lmscore(spark, SF))}
    assert again == {r["doc_id"]: r["xent_diff"] for r in got}


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert len(rows(lmscore.lm_table(clashing(odd(spark)), labels))) == 10
    none = rows(lmscore.lm_table(odd(spark), labels.limit(0)))
    assert {r["xent_diff"] for r in none} == {0.0}
    assert lmscore.lm_table(odd(spark).limit(0), labels).count() == 0


def plain_word_loss(texts, vocabulary):
    """-log p of a word after another, straight from the definition."""
    split = lambda t: ["", *[m.decode() for m in lmscore._WORD.findall(t.encode())], ""]
    one = Counter(w for t in texts for w in split(t)[1:])
    two = Counter(p for t in texts for p in zip(split(t), split(t)[1:]))
    c, n = lmscore.CONCENTRATION, sum(one.values())
    return lambda t: np.array([-math.log((two[h, w] + c * (one[w] + c / vocabulary) / (n + c)) / (one[h] + c)) for h, w in zip(split(t), split(t)[1:])])


def test_words_against_the_definition(spark):
    texts = ["The river runs.", "runs The river.", "Река течёт быстро, 42", "река течёт 43", "川が流れる", "the river runs.", "", None, "the stones of the river"]
    df = docs(spark, texts).repartition(3)
    good = spark.createDataFrame([(0, 1, 0), (4, 1, 0), (8, 1, None), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(lmscore.lm_table(df, good))}
    known = [t for t in texts if t is not None]
    vocabulary = len({w for t in known for w in lmscore._WORD.findall(t.encode())}) + 1
    target, background = plain_word_loss([texts[0], texts[4], texts[8]], vocabulary), plain_word_loss(known, vocabulary)
    for i, t in enumerate(texts):
        want = target(t or "") - background(t or "")
        assert got[i]["n_words"] == len(want) and math.isclose(got[i]["xent_diff"], want.mean(), abs_tol=1e-9)
    assert got[0]["xent_diff"] != got[1]["xent_diff"] != got[5]["xent_diff"] and got[2]["xent_diff"] != got[3]["xent_diff"]
    assert got[4]["n_words"] == 6


def test_counts_that_go_up_in_tiers_are_the_same(spark):
    """64 buckets by 4 are three tiers; no run is cut into more rows, and few blocks meet in a group."""
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(13, "doc_id")
    good = df.where("doc_id % 3 = 0").select("doc_id")
    one, three = ({r["doc_id"]: r for r in rows(lmscore.word_scores(df, good, fan=f))} for f in (lmscore.FAN, 4))
    assert one == three and len(one) == 200
    trace = []
    blocks = lmscore.cut(lmscore._marked(df, good, 1000).mapInArrow(lmscore._blocked, lmscore._BLOCK))
    lmscore.whole_counts(blocks.select("block", *lmscore._PARTS), 64, blocks.count(), 4, trace)
    assert len(trace) == 3 and all(cut_into <= 4 and meet <= 12 for cut_into, meet in trace)


def test_groups_of_every_tier_stay_small(spark):
    """Just above one tier: what meets is no larger than a few blocks, though few ranges of the widest fan would do."""
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(13, "doc_id")
    blocks = lmscore.cut(lmscore._marked(df, df.select("doc_id"), 1000).mapInArrow(lmscore._blocked, lmscore._BLOCK))
    for fan, n_blocks in ((60, 13), (16, 13)):
        loads = []
        lmscore.whole_counts(blocks.select("block", *lmscore._PARTS), 64, n_blocks, fan, loads=loads)
        whole = sum(lmscore._counted(*[r[c] for c in lmscore._PARTS])[2].size for r in blocks.collect())
        assert len(loads) == 2 and max(loads) <= whole / 4


@given(st.lists(st.tuples(st.integers(0, 2**48 - 1), st.integers(0, 300), st.just(0)), max_size=40))
@settings(deadline=None)
def test_packed_columns_come_back(rows):
    columns = [np.array(c, np.uint64) for c in zip(*rows)] or [np.empty(0, np.uint64)] * 3
    assert all((a == b).all() for a, b in zip(columns, lmscore._unpack(lmscore._pack(*columns), len(rows), 3)))
