"""Language identification by error-correcting output codes.

Every language gets a codeword; for each bit of the code a binary classifier over hashed byte n-grams says
whether the text belongs to the languages that have the bit. Loss-weighted decoding compares the classifiers'
margins with every codeword, weighing a bit by how well its classifier did on that language in training, and
takes the codeword with the smallest loss. The gap to the runner-up flags ambiguous texts.

Classifiers are fitted on the driver to a bounded sample (``per_lang`` documents a language, ``total`` in all but at
least ``LEAST`` a language, however many languages there are),
reduced to ``BUCKETS`` n-gram frequencies each by the executors; prediction reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import WORD_TABLE, slices, utf8, without

BUCKETS = 1 << 13
PER_LANG, TOTAL, LEAST = 600, 2400, 4
#: Positions that are looked up at once; bounds the memory of a prediction.
BLOCK = 1 << 18
UND = "und"


def code_matrix(k: int) -> np.ndarray:
    """Codewords (rows of +1/-1) for ``k`` languages: all dichotomies up to six, else the random code with the
    largest distance between codewords out of 200 seeded ones."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        halves = [s for n in range(1, k) for s in combinations(range(k), n) if 0 in s]
        return np.array([[1 if i in s else -1 for s in halves] for i in range(k)], float)
    rng, best, width = np.random.default_rng(11), None, int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, width))
        gap = ((width - m @ m.T) / 2 + width * np.eye(k)).min()
        if np.all(np.abs(m.sum(0)) < k) and (best is None or gap > best[0]):
            best = gap, m
    return best[1]


def _normal(text: bytes) -> bytes:
    """Lower-case words with single spaces around, then two bytes that keep n-grams from crossing into the next text."""
    return b" " + b" ".join(text.translate(WORD_TABLE).split()) + b" \0\0"


def _buckets(octets: np.ndarray) -> np.ndarray:
    """Buckets of the byte pair (row 0) and the byte triple (row 1) that start at each position but the last two."""
    a, b, c = (octets[i : len(octets) - 2 + i].astype(np.uint32) for i in range(3))
    pair = a | b << np.uint32(8)
    both = np.stack([pair * np.uint32(2_654_435_761), (pair | c << np.uint32(16)) * np.uint32(2_246_822_519)])
    return (both >> np.uint32(20)).astype(np.int32) + np.array([[0], [BUCKETS // 2]], np.int32)


@arrow_udf(T.ArrayType(T.FloatType()))
def _profile(texts: pa.Array) -> pa.Array:
    """Frequencies of the n-gram buckets of each text."""
    out = []
    for part in slices(texts):
        for text in utf8(part):
            octets = np.frombuffer(_normal(text), np.uint8)
            counts = np.zeros(BUCKETS, np.int64)
            for at in range(0, len(octets) - 2, BLOCK):
                counts += np.bincount(_buckets(octets[at : at + BLOCK + 2]).ravel(), minlength=BUCKETS)
            out.append((counts / max(1, len(octets) - 2)).astype(np.float32))
    return pa.array(out, pa.list_(pa.float32()))


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # (languages, bits)
    trust: np.ndarray  # (languages, bits), rows sum to one
    weights: np.ndarray  # (buckets, bits)
    bias: np.ndarray  # (bits,)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """(texts, bits). What a text gets doesn't depend on its neighbours."""
        normal = [_normal(t) for t in texts]
        octets = np.frombuffer(b"".join(normal) + b"\0\0", np.uint8)
        size = np.array([len(x) for x in normal])
        edge = np.concatenate(([0], np.cumsum(size)))
        total = np.zeros((len(texts), len(self.bias)))
        for d, (at, to) in enumerate(zip(edge[:-1], edge[1:] - 2)):
            if to - at > BLOCK:  # a long text by itself, block by block
                for x in range(at, to, BLOCK):
                    total[d] += self._sum(octets, np.array([x, min(to, x + BLOCK)]))[0]
        brief = np.nonzero(size - 2 <= BLOCK)[0]
        held = 0
        while held < len(brief):
            upto = held + max(1, int(np.searchsorted(np.cumsum(size[brief[held:]]), BLOCK, side="right")))
            run = brief[held:upto]
            cuts = np.stack([edge[run], edge[run + 1] - 2], 1).ravel()
            total[run] = self._sum(octets, cuts)[::2]
            held = upto
        return total / (size - 2)[:, None] + self.bias

    def _sum(self, octets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        base, end = int(cuts[0]), int(cuts[-1])
        pair, triple = _buckets(octets[base : end + 2])
        got = self.weights[pair]
        got += self.weights[triple]
        inner = cuts[:-1] - base
        return np.add.reduceat(got, inner, axis=0, dtype=np.float64)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best, runner-up, probability of the best): loss log(1 + exp(-bit * margin)), weighted by trust."""
        loss = np.logaddexp(0, -self.code[None] * margins[:, None, :]) * self.trust[None]
        loss = loss.sum(2) * self.code.shape[1]
        order = np.argsort(loss, axis=1, kind="stable")
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return order[:, 0], order[:, min(1, len(self.langs) - 1)], 1 / p.sum(1)


def fit(profiles: np.ndarray, langs: list[str], rounds: int = 300, ridge: float = 1e-4) -> Model:
    """Logistic regressions for all bits at once, by accelerated gradient descent; languages weigh alike."""
    names = sorted(set(langs))
    y = np.array([names.index(g) for g in langs])
    code = code_matrix(len(names))
    target = (code[y] > 0).astype(np.float32)
    weight = (1 / np.bincount(y)[y] / len(names)).astype(np.float32)[:, None]
    mean = weight.T @ profiles
    scale = (1 / (np.sqrt(mean) + 1e-3)).astype(np.float32)
    x = (profiles - mean) * scale
    step = np.float32(4 / (float(weight[:, 0] @ (x * x).sum(1)) + 1))
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    ahead, bias = w.copy(), np.zeros(code.shape[1], np.float32)
    for i in range(rounds):
        off = (1 / (1 + np.exp(-(x @ ahead + bias))) - target) * weight
        new = ahead - step * (x.T @ off + np.float32(ridge) * ahead)
        ahead = new + np.float32(i / (i + 3)) * (new - w)
        w = new
        bias -= off.sum(0)
    right = ((x @ w + bias > 0) == (target > 0)).astype(float)
    trust = np.stack([right[y == k].mean(0) for k in range(len(names))]) + 1e-6
    w = w * scale.T
    return Model(names, code, trust / trust.sum(1, keepdims=True), w.astype(np.float32), bias - (mean @ w)[0])


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, per_lang: int = PER_LANG, total: int = TOTAL) -> Model | None:
    """A model from the rows that aren't held out and have text with a letter and a language; None without such rows.

    Every language that such a row names is learned. Rows without an id aren't used; repeated rows may be drawn again.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return None
    want = min(per_lang, max(LEAST, total // len(counts)))
    # Rows whose hash falls below the rate of their language, and of these the first by hash, so that the sample is bounded.
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.3 * want / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw < F.coalesce(rate[F.col("lang")], F.lit(0.0)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")))
    sample = drawn.select("doc_id", "lang", "text", first.alias("_n")).where(F.col("_n") <= want).select("lang", _profile("text").alias("x"))
    rows = sample.toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, BUCKETS)
    langs = rows.column("lang").to_pylist()
    order = np.lexsort((x[:, :64].sum(1), langs))  # the order of rows doesn't depend on the order of tasks
    return fit(x[order], [langs[i] for i in order])


RESULT = T.StructType().add("lang", T.StringType()).add("second", T.StringType()).add("score", T.DoubleType())


def predict(docs: DataFrame, model: Model | None, ambiguous_below: float = 0.6) -> DataFrame:
    """``docs`` with lang_pred, score, lang_second and ambiguous (score below ``ambiguous_below``).

    Null text and text without a letter are ``und`` with score 0 and not ambiguous; so is all text without a model
    (no learnable row). Columns named as the outputs are replaced; ids and repeats play no part; long texts are read whole,
    block by block.
    """
    base = without(docs, "lang_pred", "score", "lang_second", "ambiguous", "_p")
    if model is None:
        return base.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0), "lang_second": F.lit(None).cast("string"), "ambiguous": F.lit(False)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(RESULT)
    def identify(texts: pa.Array) -> pa.Array:
        m, best, second, score = sent.value, [], [], []
        for part in slices(texts):
            a, b, p = m.decode(m.margins(utf8(part)))
            best += [m.langs[i] for i in a]
            second += [m.langs[i] for i in b]
            score += p.tolist()
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(second, pa.string()), pa.array(score, pa.float64())], names=["lang", "second", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = base.withColumn("_p", identify("text"))
    return out.withColumns(
        {
            "lang_pred": F.when(letters, F.col("_p.lang")).otherwise(UND),
            "score": F.when(letters, F.col("_p.score")).otherwise(0.0),
            "lang_second": F.when(letters, F.col("_p.second")),
            "ambiguous": letters & (F.col("_p.score") < ambiguous_below),
        }
    ).drop("_p")


def language_table(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, held_out, lang_pred, score, lang_second, ambiguous."""
    out = predict(docs, train(docs)).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "lang_pred", "score", "lang_second", "ambiguous")
