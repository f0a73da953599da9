"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on hashed words; every model also sees the
probabilities of the categories before it. In training these are out-of-fold: each fold of the sample is scored
by a model that has not seen it. In scoring they come from the full models. The models are fitted on a bounded
sample (``linear.SAMPLE_DOCS``) with follow-the-regularised-leader and a strong l1 penalty, which leaves only
words that tell a category.

Null and empty texts get the score of the constants alone; a null ``doc_id`` is never labelled; repeated rows are
scored row by row; without labels every probability is 0.5; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import arrow_map, materialize, text_blocks, text_or_empty
from weekcast.llm.features import FeatureSpace, Ftrl, plain_word, sigmoid, word_shape
from weekcast.llm.linear import SAMPLE_DOCS, fit_groups, full_weights, labelled_sample, sparse_rows

SPACE = FeatureSpace(views=(plain_word, word_shape), buckets=1 << 18, orders=(1,), presence=True)
LEARNER = Ftrl(alpha=3.0, l1=5.0, epochs=8)
FOLDS = 5
THRESHOLD = 0.5


def default_chain() -> dict[str, Column]:
    """Categories in the order of the chain, from the columns of ``labels``."""
    return {"low_quality": (F.col("quality") == 0), "toxic": (F.col("toxic") == 1)}


def fit_chain(
    docs: DataFrame, labels: DataFrame, chain: dict[str, Column], folds: int = FOLDS, sample_docs: int = SAMPLE_DOCS
) -> list[np.ndarray]:
    """Weights of one model per category: buckets, earlier categories, constant."""
    sample = labelled_sample(docs, labels, chain, sample_docs=sample_docs)
    rows = sparse_rows(sample, SPACE, list(chain))
    rows = materialize(rows.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int")), "chain")
    weights, extras = [], []
    for category in chain:
        last = len(weights) == len(chain) - 1
        fitted = fit_groups(rows, category, extras, SPACE, LEARNER, 0 if last else folds)
        if not last:
            fitted = materialize(fitted, "chain")
        weights.append(full_weights(fitted, SPACE.buckets + len(extras) + 1))
        if not last:
            # at most as many rows as the sample
            held = fitted.where(F.col("fold") >= 0).select("id", F.col("p").alias(f"p_{category}"))
            rows = rows.join(F.broadcast(held), "id")
            extras = [*extras, f"p_{category}"]
    return weights


def score_chain(docs: DataFrame, weights: Sequence[np.ndarray], categories: Sequence[str]) -> DataFrame:
    """(doc_id, p_<category>...) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(list(weights))  # 1 MB per category
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = SPACE.buckets

    def run(batches):
        caches = SPACE.caches()
        for batch, texts in text_blocks(batches, "text"):
            models, found = shared.value, []
            for sums, w in zip(SPACE.dot(texts, caches, [m[:size] for m in models]), models, strict=True):
                for p, weight in zip(found, w[size:-1], strict=True):
                    sums = sums + p * float(weight)
                found.append(sigmoid(sums + float(w[-1])))
            yield [batch.column(0), *(pa.array(p, pa.float64()) for p in found)]

    schema = f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in categories)
    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), run, schema)


def classify_toxicity(
    docs: DataFrame, labels: DataFrame, chain: dict[str, Column] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, p_<category>..., score, predicted): ``score`` is the probability of the last category."""
    chain = chain or default_chain()
    scored = score_chain(docs, fit_chain(docs, labels, chain), list(chain))
    score = F.col(f"p_{list(chain)[-1]}")
    return scored.select("*", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
