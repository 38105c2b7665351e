"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features and ordered thresholds: P(grade > k) = sigmoid(w.x - t_k). The sum
of these tails is the expected grade; the tail above a grade selects documents. Features are the distinct words
of the text, their first four and five bytes (for words that are seen in many forms) and steps of its shape (capitals, symbols, repetition, length), hashed into 2**18 buckets; the
buckets that depend on the grade by a chi-square test are kept: those that chance explains with a probability below
``CHANCE`` over all buckets together, and whose dependence is ``EFFECT`` of the largest there can be or more. Both
follow the size of the sample. Where no bucket is kept there is no model, and everything is accepted.

The model is fitted on the driver to a bounded sample (``per_grade`` distinct texts of each grade, weighted
back to the grades' shares of all ratings); scoring reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import WORD_TABLE, packed, slices, utf8, without

BUCKETS = 1 << 18
PER_GRADE = 2000
#: Most buckets of a model, those with the largest chi-square.
KEPT = 512
CHANCE, EFFECT = 0.05, 0.01
#: Least texts of the sample that have a kept bucket, and their least share of the sample.
TEXTS, TEXT_SHARE = 3, 0.002

_UPPER = bytes(range(65, 91))
_SYMBOL = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings: 0 poor, 1 good but toxic, 2 good. Of several ratings of a document the worst counts;
    rows without an id or a quality are left out and a missing toxicity counts as none."""
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return rated.select("doc_id", F.when(F.col("q") <= 0, 0).when(F.col("t") > 0, 1).otherwise(2).alias("grade"))


def features(text: bytes) -> np.ndarray:
    """Distinct buckets of one UTF-8 text."""
    words = text.translate(WORD_TABLE).split()
    distinct = set(words)
    size, n = max(1, len(text)), max(1, len(words))
    shape = {
        b"upper": (len(text) - len(text.translate(None, _UPPER))) / size,
        b"symbol": (len(text) - len(text.translate(None, _SYMBOL))) / size,
        b"bar": text.count(b" | ") / n,
        b"same": 1 - len(distinct) / n,
    }
    steps = [b"\1%s%d" % (k, i) for k, v in shape.items() for i in range(1, 1 + int(20 * min(v, 1.0)))]
    steps += [b"\1size%d" % i for i in range(1, n.bit_length())]
    starts = [b"\2" + x for x in {w[:k] for w in distinct if len(w) > 4 for k in (4, 5)}]
    h = np.fromiter(map(crc32, (*distinct, *starts, *steps)), np.int64, len(distinct) + len(starts) + len(steps))
    return h & (BUCKETS - 1)


@arrow_udf(T.ArrayType(T.IntegerType()))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([np.unique(features(t)).astype(np.int32) for part in slices(texts) for t in utf8(part)], pa.list_(pa.int32()))


@dataclass
class Model:
    weights: np.ndarray  # by bucket
    thresholds: list[float]  # ascending
    shares: list[float]  # of the ratings above each threshold

    def score(self, text: bytes) -> float:
        return float(self.weights[features(text)].sum())


def _chi_cut(buckets: int, levels: int, n: int) -> float:
    """Least chi-square of a kept bucket out of so many over a sample of ``n`` (Wilson and Hilferty's quantile)."""
    if not buckets:
        return float("inf")
    free, z = levels - 1, NormalDist().inv_cdf(1 - CHANCE / buckets)
    return max(free * (1 - 2 / (9 * free) + z * (2 / (9 * free)) ** 0.5) ** 3, EFFECT * n)


def fit(ids: list[np.ndarray], grade: np.ndarray, weight: np.ndarray, levels: int, rounds: int = 500, ridge: float = 2e-4) -> Model:
    """Maximum penalised likelihood by Adam over the kept buckets."""
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    col = np.concatenate(ids) if ids else np.empty(0, np.int64)
    n = len(ids)
    seen = np.bincount(col, minlength=BUCKETS)
    chi = np.zeros(BUCKETS)
    for g in range(levels):
        here = np.bincount(col[grade[row] == g], minlength=BUCKETS)
        share = (grade == g).mean()
        chi += (here - share * seen) ** 2 / np.maximum(share * seen, 1e-9) * (seen > 0)
    often = seen >= max(TEXTS, TEXT_SHARE * n)
    chi[~often] = 0
    kept = np.argsort(-chi, kind="stable")[:KEPT]
    kept = np.sort(kept[chi[kept] > _chi_cut(int(often.sum()), len(np.unique(grade)), n)])
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    x = np.zeros((n, len(kept)), np.float32)
    used = place[col] >= 0
    x[row[used], place[col[used]]] = 1

    share = np.array([weight[grade == g].sum() for g in range(levels)]) / weight.sum()
    above = np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))  # ascending
    par = np.concatenate([np.zeros(len(kept)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    weight = weight / weight.sum()
    k = len(kept)
    tail_of = lambda z, t: 1 / (1 + np.exp(-np.clip(z[:, None] - t[None], -30, 30)))
    for i in range(1, rounds + 1):
        gaps = np.exp(par[k + 1 :])
        t = par[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        tail = np.concatenate([np.ones((n, 1)), tail_of(x @ par[:k].astype(np.float32), t), np.zeros((n, 1))], 1)
        high, low = tail[np.arange(n), grade], tail[np.arange(n), grade + 1]  # P(>= grade), P(> grade)
        slope = (1 - high - low) * weight
        gap = np.maximum(high - low, 1e-9)
        down = np.zeros((n, levels + 1))
        down[np.arange(n), grade] -= high * (1 - high) / gap
        down[np.arange(n), grade + 1] += low * (1 - low) / gap
        dt = (down[:, 1:-1] * weight[:, None]).sum(0)
        grad = -np.concatenate([x.T @ slope.astype(np.float32) - ridge * par[:k], [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        par -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = par[:k]
    return Model(weights, (par[k] + np.concatenate([[0.0], np.cumsum(np.exp(par[k + 1 :]))])).tolist(), (1 - np.cumsum(share)[:-1]).tolist())


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE, grade: int = 2) -> Model | None:
    """A model from the rated documents, for selecting ``grade`` or better; None where no rating of the sample is so
    good, none is worse, or no feature tells them apart.

    Ratings without an id are left out, as are documents without one; rows that repeat an id are texts of that rating
    each; texts that are equal count once, with the rating of the smallest id; null text is empty text.
    """
    rated = grades(labels)
    counts = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    if len(counts) < 2:
        return None
    levels = max(2, grade, *counts) + 1
    rate = F.create_map(*[F.lit(v) for g, n in counts.items() for v in (g, min(1.0, 1.3 * per_grade / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    first = F.row_number().over(Window.partitionBy("grade").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = rated.where(draw < rate[F.col("grade")]).withColumn("_n", first).where(F.col("_n") <= per_grade)
    ids = F.broadcast(ids.select(F.col("doc_id").alias("_id"), "grade"))  # per_grade rows a grade at most
    sample = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    sample = sample.agg(F.min_by(F.struct("grade", "text"), F.col("doc_id")).alias("x")).select("h", "x.grade", _features("x.text").alias("ids"))
    rows = sample.orderBy("h").toArrow()
    found = np.array(rows.column("grade").to_pylist(), np.int64)
    if not (found >= grade).any() or not (found < grade).any():
        return None
    per = np.bincount(found, minlength=levels)
    weight = np.array([counts[g] / per[g] for g in found])
    model = fit([np.array(x, np.int64) for x in rows.column("ids").to_pylist()], found, weight, levels)
    return model if model.weights.any() else None


def rate(docs: DataFrame, model: Model | None, grade: int = 2, least: float = 0.7) -> DataFrame:
    """``docs`` with score, expected_grade, tail (probability of ``grade`` or better) and accepted (tail >= ``least``,
    or >= the share of such grades among the ratings where that is less: a text that the model knows nothing about
    is no worse than the rest).

    Null and empty texts are rated by their shape like any other; long ones with all their words. Without a model
    everything is accepted, with null ratings. Columns named as the outputs are replaced.
    """
    base = without(docs, "score", "expected_grade", "tail", "accepted")
    if model is None:
        nothing = F.lit(None).cast("double")
        return base.withColumns({"score": nothing, "expected_grade": nothing, "tail": nothing, "accepted": F.lit(True)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([sent.value.score(t) for part in slices(texts) for t in utf8(part)], pa.float64())

    tails = [1 / (1 + F.exp(F.lit(t) - F.col("score"))) for t in model.thresholds]
    out = base.withColumn("score", score("text")).withColumn("expected_grade", sum(tails[1:], tails[0]))
    out = out.withColumn("tail", tails[min(grade, len(tails)) - 1])
    return out.withColumn("accepted", F.col("tail") >= F.lit(min(least, model.shares[min(grade, len(tails)) - 1])))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest: doc_id, score, expected_grade, tail, accepted."""
    return rate(docs, train(docs, labels)).select("doc_id", "score", "expected_grade", "tail", "accepted")


def accepted_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The accepted rows of ``docs``, columns as they are. Rows are judged by their texts alone, so a null or repeated
    id changes nothing; with no model, as with few ratings, all rows stay."""
    marked = rate(packed(docs, "text"), train(docs, labels), **how)
    return marked.where("accepted").select("_row.*")
