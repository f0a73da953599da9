"""Fitting the hashed n-gram models with Spark: a bounded labelled sample becomes sparse rows where the texts
are; the rows of one fit, a few kB each, meet in one task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import arrow_map, ship_package, text_blocks, text_or_empty
from weekcast.llm.features import FeatureSpace, Ftrl, sigmoid

# Bound of the training sample, in labelled documents; their whole texts are learned from.
SAMPLE_DOCS = 8_000
FULL = -1


def labelled_sample(
    docs: DataFrame, labels: DataFrame, targets: dict[str, Column], allowed: Column | None = None,
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """(id, text, targets...) of at most ``sample_docs`` labelled documents, drawn by a hash of the id.

    Rows without an id or with a null target are no labels; of contradicting labels and of differing texts
    under one id the smallest counts.
    """
    known = labels.select(F.col("doc_id").alias("id"), *[c.cast("int").alias(n) for n, c in targets.items()])
    known = known.dropna().where(F.lit(True) if allowed is None else allowed)
    # Ids without a document are not drawn.
    known = known.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    drawn = (
        known.groupBy("id").agg(*[F.min(n).alias(n) for n in targets])
        .orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    )
    texts = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text"))
    joined = texts.join(F.broadcast(drawn), "id")  # at most sample_docs rows of a few numbers
    return joined.groupBy("id", *targets).agg(F.min("text").alias("text"))


def sparse_rows(sample: DataFrame, space: FeatureSpace, targets: Sequence[str]) -> DataFrame:
    """(id, targets..., at, x): buckets and values of each text as bytes."""
    kind = sample.schema["id"].dataType.simpleString()

    def run(batches):
        caches = space.caches()
        for batch, texts in text_blocks(batches, "text"):
            rows = space.sparse(texts, caches)
            yield [
                *(batch.column(i) for i in range(1 + len(targets))),
                pa.array([at.astype("<i4").tobytes() for at, _ in rows], pa.binary()),
                pa.array([x.astype("<f4").tobytes() for _, x in rows], pa.binary()),
            ]

    schema = f"id {kind}, " + "".join(f"{t} int, " for t in targets) + "at binary, x binary"
    return arrow_map(sample.select("id", *targets, "text"), run, schema)


def fit_groups(
    rows: DataFrame, target: str, extras: Sequence[str], space: FeatureSpace, ftrl: Ftrl, folds: int = 0
) -> DataFrame:
    """Fit one model on all rows and, with ``folds``, one without each fold that scores the fold.

    Returns (fold, id, p, weights): a row with the weights of the full model (fold -1), and a row with the
    out-of-fold probability of every sampled document. ``extras`` are columns used as further coordinates.
    Needs the columns ``fold`` (0 to folds - 1) and ``extras`` beside those of ``sparse_rows``.
    """
    kind = rows.schema["id"].dataType.simpleString()
    size = space.buckets + len(extras) + 1

    def fit(key, frame):
        group = int(key[0])
        frame = frame.sort_values("id", ignore_index=True)
        more = np.column_stack([*(frame[e].to_numpy(float) for e in extras), np.ones(len(frame))])
        tail = np.arange(space.buckets, size, dtype=np.int32)
        sparse = [
            (np.concatenate([np.frombuffer(a, "<i4"), tail]), np.concatenate([np.frombuffer(x, "<f4"), m]))
            for a, x, m in zip(frame["at"], frame["x"], more, strict=True)
        ]
        y = frame[target].to_numpy()
        inside = (frame["fold"] == group).to_numpy()
        train = np.flatnonzero(~inside)
        w = ftrl.fit([sparse[i] for i in train], y[train], size)
        if group == FULL:
            return pd.DataFrame({"fold": [FULL], "id": frame["id"].iloc[:1], "p": [0.0], "weights": [w.tobytes()]})
        held = np.flatnonzero(inside)
        p = [float(sigmoid(float(w[sparse[i][0]] @ sparse[i][1]))) for i in held]
        out = pd.DataFrame({"id": frame["id"].iloc[held].to_numpy(), "p": p})
        return out.assign(fold=group, weights=None)[["fold", "id", "p", "weights"]]

    ship_package(rows.sparkSession)
    groups = F.explode(F.array(*[F.lit(g) for g in range(FULL, folds)])).alias("group")
    spread = rows.select("*", groups)
    return spread.groupBy("group").applyInPandas(fit, f"fold int, id {kind}, p double, weights binary")


def full_weights(fitted: DataFrame, size: int) -> np.ndarray:
    """Weights of the full model; all zero where there was nothing to learn from."""
    found = fitted.where(F.col("fold") == FULL).select("weights").take(1)
    return np.frombuffer(found[0][0], "<f4") if found else np.zeros(size, np.float32)
