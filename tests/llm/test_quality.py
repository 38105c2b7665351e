import random

import numpy as np

from nuggetry.llm import quality, queries

from .helpers import SF, clashing, docs, odd, rows


def corpus(n=900):
    rnd = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        words = [rnd.choice(["river", "stone", "house", "light", "green", "walk", "table"]) + str(rnd.randrange(60)) for _ in range(rnd.randint(20, 80))]
        kind = i % 3
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            words[3] = words[9] = rnd.choice(["nasty", "vile", "rotten"])
        texts.append(" ".join(words))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return texts, labels


def test_grades_are_separated_and_ordered(spark):
    texts, labels = corpus()
    df = docs(spark, texts)
    rated = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(quality.quality_table(df, rated))}
    want = [0, 1, 2]
    right = sum(np.argmin([abs(got[i]["expected_grade"] - g) for g in want]) == i % 3 for i in range(600, 900))
    assert right > 290
    assert sum(got[i]["accepted"] for i in range(600, 900) if i % 3 == 2) >= 98
    assert sum(got[i]["accepted"] for i in range(600, 900) if i % 3 != 2) <= 2
    kept = quality.accepted_documents(df, rated)
    assert kept.columns == df.columns and kept.count() == sum(r["accepted"] for r in got.values())


def test_gradient_is_that_of_the_likelihood():
    rnd = np.random.default_rng(0)
    ids = [np.unique(rnd.integers(0, 40, 12)) for _ in range(400)]
    grade = np.array([min(2, int(np.sum(x < 8))) for x in ids])
    model = quality.fit(ids, grade, np.ones(400), 3)
    assert model.thresholds == sorted(model.thresholds)

    def loss(w, t):
        total = 0
        for x, g in zip(ids, grade):
            z = w[x].sum()
            tail = [1, *(1 / (1 + np.exp(u - z)) for u in t), 0]
            total -= np.log(tail[g] - tail[g + 1])
        return total

    best = loss(model.weights.astype(float), model.thresholds)
    for k in (0, 1):
        for d in (-0.05, 0.05):
            t = list(model.thresholds)
            t[k] += d
            assert loss(model.weights.astype(float), t) > best - 0.5


def test_query(spark):
    got = rows(queries.op3_quality(spark, SF))
    assert len(got) == 200 and all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got if r["tail"] is not None)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, None, 1), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted((r["doc_id"], r["grade"]) for r in rows(quality.grades(labels))) == [(1, 0), (5, 2)]
    assert len(rows(quality.quality_table(clashing(odd(spark)), labels))) == 10
    none = rows(quality.quality_table(odd(spark), labels.limit(0)))
    assert all(r["accepted"] and r["tail"] is None for r in none) and len(none) == 10
    assert quality.quality_table(odd(spark).limit(0), labels).count() == 0
    assert quality.accepted_documents(clashing(odd(spark)), labels.limit(0)).count() == 10


def test_few_ratings_select_nothing_or_by_what_they_show(spark):
    """Without ratings enough there is no model and nothing goes; the cut-offs follow the size of the sample."""
    texts, labels = corpus(120)
    df = docs(spark, texts)
    for n in (0, 1, 5, 10):
        rated = spark.createDataFrame(labels[:n], "doc_id long, quality int, toxic int")
        got = rows(quality.quality_table(df, rated))
        assert len(got) == 120 and all(r["accepted"] for r in got)
        assert quality.accepted_documents(df, rated).count() == 120
    got = rows(quality.quality_table(df, spark.createDataFrame(labels[:87], "doc_id long, quality int, toxic int")))
    poor = [r for r in got if r["doc_id"] % 3 == 0]
    assert sum(not r["accepted"] for r in poor) >= 38 and sum(r["accepted"] for r in got if r["doc_id"] % 3 == 2) >= 36
    assert len({r["score"] for r in rows(queries.op3_quality(spark, SF))}) > 1


def test_ratings_without_the_grade_asked_for(spark):
    texts, labels = corpus(90)
    worse = spark.createDataFrame([x for x in labels if x[0] % 3 != 2], "doc_id long, quality int, toxic int")
    assert quality.train(docs(spark, texts), worse) is None and quality.train(docs(spark, texts), worse, grade=1) is not None


def test_fit_against_a_plain_refit(spark):
    """The penalised likelihood at the fitted model is within a little of the best that plain coordinate steps find."""
    rnd = np.random.default_rng(3)
    ids = [np.unique(rnd.integers(0, 12, 5)) for _ in range(300)]
    grade = np.array([min(2, int(np.sum(x < 4))) for x in ids])
    model = quality.fit(ids, grade, np.ones(300), 3, ridge=1e-2)
    kept = np.nonzero(model.weights)[0]

    def loss(par):
        w, t = par[:-2], par[-2:]
        z = np.array([w[np.isin(kept, x)].sum() for x in ids])
        tail = np.stack([np.ones(300), *(1 / (1 + np.exp(u - z)) for u in t), np.zeros(300)])
        k = np.arange(300)
        return -np.log(np.maximum(tail[grade, k] - tail[grade + 1, k], 1e-12)).mean() + 1e-2 * (w**2).sum() / 2

    found = np.array([*model.weights[kept].astype(float), *model.thresholds])
    best, step = np.zeros(len(found)), 1.0
    best[-2:] = -0.5, 0.5
    while step > 1e-4:
        moved = False
        for i in range(len(best)):
            for d in (-step, step):
                trial = best.copy()
                trial[i] += d
                if trial[-1] > trial[-2] and loss(trial) < loss(best) - 1e-12:
                    best, moved = trial, True
        step = step if moved else step / 2
    assert abs(loss(found) - loss(best)) < 1e-3
