"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features are shares of hashed words, word pairs, word shapes and pairs of shapes in the whole text. The model is
fitted on a bounded sample of the labelled documents (``linear.SAMPLE_DOCS``) and applied to every text as a
sparse dot product.

Null and empty texts have no n-grams and get the score of the constant alone; a null ``doc_id`` is never held out
and never labelled; repeated rows are scored row by row; without labels every score is 0.5; other columns of the
input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weekcast.llm.common import arrow_map, text_blocks, text_or_empty
from weekcast.llm.features import FeatureSpace, Ftrl, sigmoid, word_shape
from weekcast.llm.linear import SAMPLE_DOCS, fit_groups, full_weights, labelled_sample, sparse_rows

SPACE = FeatureSpace(views=(str, word_shape), buckets=1 << 18, orders=(1, 2), scale=20.0)
LEARNER = Ftrl(alpha=0.3, epochs=3)
THRESHOLD = 0.7
HELD_OUT_REMAINDER = 2


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: a fixed quarter of the ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Weights of the quality model; the last is the constant. Sees no held-out label."""
    sample = labelled_sample(
        docs, labels, {"quality": F.col("quality")}, ~held_out(F.col("id")), sample_docs
    )
    rows = sparse_rows(sample, SPACE, ["quality"]).withColumn("fold", F.lit(0))
    return full_weights(fit_groups(rows, "quality", [], SPACE, LEARNER), SPACE.buckets + 1)


def score_texts(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """(c0, c1, ..., score): the columns ``keep`` of ``docs`` by number, and the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB, set by the number of buckets
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], text_or_empty().alias("text"))
    schema = StructType([*kept.schema.fields[:-1], StructField("score", DoubleType())])

    def run(batches):
        caches = SPACE.caches()
        for batch, texts in text_blocks(batches, "text"):
            w = shared.value
            score = sigmoid(SPACE.dot(texts, caches, [w[:-1]])[0] + float(w[-1]))
            yield [*(batch.column(i) for i in range(len(keep))), pa.array(score, pa.float64())]

    return arrow_map(kept, run, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = score_texts(docs, fit_quality(docs, labels), ["doc_id"])
    return scored.select(
        F.col("c0").alias("doc_id"),
        held_out(F.col("c0")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    kept = score_texts(docs, fit_quality(docs, labels), docs.columns).where(F.col("score") >= threshold)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
