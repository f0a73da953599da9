"""Quality and toxicity: held-out accuracy on labelled documents, leakage, and awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from weekcast.llm import quality, toxicity
from weekcast.llm.features import FeatureSpace, Ftrl, sigmoid, word_shape
from weekcast.llm.queries import op2_quality, op6_toxicity

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.read.parquet(f"{LARGER}/labels.parquet").collect()
    return {r.doc_id: (r.quality, r.toxic) for r in rows}


def test_quality_on_held_out_documents(spark, labelled):
    rows = op2_quality(spark, LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(labelled[r.doc_id][0], r.predicted) for r in rows if r.held_out and r.doc_id in labelled]
    good, bad = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_toxicity_on_labelled_documents(spark, labelled):
    rows = op6_toxicity(spark, LARGER).collect()
    known = [(labelled[r.doc_id][1], r.predicted) for r in rows if r.doc_id in labelled]
    toxic, clean = [p for y, p in known if y == 1], [p for y, p in known if y == 0]
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.01


def test_held_out_labels_do_not_matter(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, turned)
    assert np.array_equal(a, b)


def test_chain_feeds_earlier_probabilities(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    chain = {"toxic": F.col("toxic") == 1, "again": F.col("toxic") == 1}
    weights = toxicity.fit_chain(docs, labels, chain)
    assert [len(w) - toxicity.SPACE.buckets for w in weights] == [1, 2]


def test_awkward_rows_and_no_labels(spark):
    docs = documents(spark, [(None, None), (1, ""), (1, ""), (2, "word " * 40000)], ["'x' AS score", "1 AS predicted", "2 AS id"])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify_quality(docs, labels).collect()} == {0.5}
    assert {r.score for r in toxicity.classify_toxicity(docs, labels).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, 1), (2, 0, 1)], labels.schema)
    found = quality.classify_quality(docs, odd).collect()
    assert len(found) == 4 and sum(r.doc_id is None for r in found) == 1
    assert toxicity.classify_toxicity(docs, odd).count() == 4
    assert quality.keep_good(docs, labels, 0.2).columns == docs.columns


def plain_features(space, text):
    """Buckets by a loop over words."""
    caches, words, found = space.caches(), text.split(), []
    for cache in caches:
        for order in space.orders:
            for i in range(len(words) - order + 1):
                gram = cache[words[i]]
                for w in words[i + 1 : i + order]:
                    gram = (gram * 0xC2B2AE3D27D4EB4F + cache[w]) % 2**64
                found.append((gram * 0x9E3779B97F4A7C15 % 2**64 >> 29) & (space.buckets - 1))
    return found


@pytest.mark.parametrize("presence", [False, True])
@pytest.mark.parametrize("orders", [(1,), (1, 2), (2, 3)])
def test_dot_products_match_a_loop(presence, orders):
    space = FeatureSpace((str, word_shape), buckets=256, orders=orders, presence=presence, scale=3.0)
    w = np.random.default_rng(0).standard_normal(256).astype(np.float32)
    texts = ["", "one", "one two", "A b!! a b a b C1", "x " * 30]
    got = space.dot(texts, space.caches(), [w])[0]
    for text, value in zip(texts, got, strict=True):
        found = plain_features(space, text)
        want = w[sorted(set(found))].sum() if presence else w[found].sum() * 3.0 / max(len(found), 1)
        assert value == pytest.approx(float(want), abs=1e-4)


def test_ftrl_learns_and_shrinks():
    rows = [(np.array([i % 2, 2, 3 + i % 5]), np.ones(3)) for i in range(200)]
    w = Ftrl(alpha=0.5, l1=1.0, epochs=5).fit(rows, np.array([i % 2 for i in range(200)]), 8)
    assert sigmoid(w[1] + w[2]) > 0.9 and sigmoid(w[0] + w[2]) < 0.1


def test_long_labelled_texts_are_learned_from(spark):
    """Whole texts, however long; ids without a document are not drawn."""
    from weekcast.llm.linear import labelled_sample

    docs = documents(spark, [(1, "x " * 100_000), (2, "short")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    rows = {r.id: (len(r.text), r.quality) for r in labelled_sample(docs, labels, {"quality": F.col("quality")}, sample_docs=2).collect()}
    assert rows == {1: (200_000, 1), 2: (5, 0)}
