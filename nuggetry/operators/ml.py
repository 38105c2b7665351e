"""Text classifiers and the learned scorer on pyspark.ml.

Term frequencies are damped, 1 + ln n. Spark has no stage that does so to a sparse vector, and vectors don't pass to Python
in Arrow batches, so ``DampedCounts`` maps the non-zero counts of one row at a time where a fitted model is applied. A fit
reads its texts twice, for the terms and for their damped counts, which are written; what follows reads only these.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import discard, settle, small
from .ranking import SCORER_INPUTS, linear_score

TERMS = 5000
#: The learned scorer needs so many rated suggestions; below, the linear score stands.
LEAST_SAMPLES = 50
#: Features of the learned scorer, in order.
GBT_FEATURES = [
    "view_agreement_ratio", "modality_agreement_score", "semantic_memory_hit", "canonical_frequency", "past_approval_rate", "cluster_size", "avg_confidence",
    "has_urgency_markers", "user_segment_importance", "modality_alignment", "is_implied", "grounding_score", "actionability_score", "feasibility_score", "faithfulness_score",
]


class DampedCounts(Transformer):
    """1 + ln n for every non-zero count n of the vectors in ``_tf``, as ``_damped``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        damp = F.udf(lambda v: SparseVector(v.size, v.indices, 1 + np.log(v.values)), VectorUDT())
        return dataset.withColumn("_damped", damp("_tf"))


def _words() -> list:
    """Stages from ``text`` to ``_terms``: words and pairs of words."""
    return [
        RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        NGram(n=2, inputCol="_w", outputCol="_b"),
        SQLTransformer(statement="SELECT *, concat(_w, _b) AS _terms FROM __THIS__"),
    ]


def _damped(counted: DataFrame) -> DataFrame:
    """``counted(label, weight, _tf)``, written with ``_damped`` in place of the counts: the parts of the vectors are columns of the
    file, which is read as vectors again."""
    v = F.unwrap_udt("_tf")
    parts = F.struct(v["type"].alias("type"), v["size"].alias("size"), v["indices"].alias("indices"), F.transform(v["values"], lambda n: 1 + F.log(n)).alias("values"))
    written = settle(counted.select("label", "weight", parts.alias("_damped")), "counts")
    fields = [T.StructField(f.name, VectorUDT() if f.name == "_damped" else f.dataType) for f in written.schema]
    back = counted.sparkSession.read.schema(T.StructType(fields)).parquet(written._nuggetry_path)
    back._nuggetry_path = written._nuggetry_path
    return back


def fitted(train: DataFrame, classifier, terms: int) -> PipelineModel:
    """A classifier of (text, label, weight) by words and pairs of words: the most frequent terms (ties in their order), damped,
    weighted, of length one."""
    words = PipelineModel(_words())
    each = words.transform(train)
    most = each.select(F.explode("_terms").alias("term")).groupBy("term").count().orderBy(F.desc("count"), "term").limit(terms)
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in most.collect()], inputCol="_terms", outputCol="_tf")  # at most ``terms``
    counts = _damped(counter.transform(each))
    rest = Pipeline(stages=[IDF(inputCol="_damped", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="features"), classifier]).fit(counts)
    discard(counts)
    return PipelineModel([*words.stages, counter, DampedCounts(), *rest.stages])


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Column weight: rows over twice the rows of the label, so that both labels weigh alike."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = n.join(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one row
    return df.join(small(w), label)


def logistic(train: DataFrame, terms: int = TERMS) -> PipelineModel:
    """TF-IDF with balanced logistic regression on (text, label)."""
    return fitted(balanced(train), LogisticRegression(weightCol="weight", maxIter=100, regParam=1e-3), terms)


def svm(train: DataFrame, terms: int = TERMS, weighted: bool = True) -> PipelineModel:
    """TF-IDF with a linear support vector machine; labels weigh by their rows without ``weighted``."""
    extra = {"weightCol": "weight"} if weighted else {}
    return fitted(balanced(train), LinearSVC(maxIter=50, regParam=1e-3, **extra), terms)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).select(*df.columns, F.col("prediction").cast("int").alias("pred"))


def _vector(df: DataFrame) -> Column:
    col = lambda n: F.coalesce(F.col(n), F.lit(SCORER_INPUTS[n])) if n in df.columns else F.lit(SCORER_INPUTS[n])
    return array_to_vector(F.array(*[col(n).cast("double") for n in GBT_FEATURES]))


def learned_scorer(rated: DataFrame, rating: str = "rating"):
    """A boosted-tree model of 50 trees of depth 3 from rated features, or None with too few samples."""
    if rated.limit(LEAST_SAMPLES).count() < LEAST_SAMPLES:
        return None
    df = rated.select(_vector(rated).alias("features"), F.col(rating).cast("double").alias("label"))
    return GBTRegressor(maxIter=50, maxDepth=3, seed=42).fit(df)


def learned_score(model, df: DataFrame) -> DataFrame:
    """``df`` with score from 0 to 10, by the model or, without one, linear."""
    if model is None:
        return df.withColumn("score", linear_score(df))
    out = model.transform(df.withColumn("features", _vector(df)))
    return out.withColumn("score", F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col("prediction"))), 2)).drop("features", "prediction")
