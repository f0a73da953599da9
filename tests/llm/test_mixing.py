"""Raking, calibration and sampling."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from weekcast.llm.mixing import calibrate, expected_shares, mix_documents, rake, target_shares

CELLS = [("a", "x", "1", 900), ("a", "y", "1", 50), ("b", "x", "2", 200), ("b", "y", "1", 30), ("c", "x", "1", 5), ("c", "y", "2", 70)]
DIMENSIONS = ("source", "lang", "topic")


def plain_rake(cells, targets, rounds):
    weights = [float(c[3]) for c in cells]
    whole = sum(weights)
    for _ in range(rounds):
        for d in range(3):
            sums = {}
            for c, w in zip(cells, weights, strict=True):
                sums[c[d]] = sums.get(c[d], 0) + w
            weights = [w * targets[d][c[d]] * whole / sums[c[d]] for c, w in zip(cells, weights, strict=True)]
    return weights


def test_rake_matches_plain_fitting_and_targets(spark):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, n long")
    given = [{"a": 0.4, "b": 0.35, "c": 0.25}, {"x": 0.5, "y": 0.5}, {"1": 0.55, "2": 0.45}]
    targets = {
        d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in zip(DIMENSIONS, given, strict=True)
    }
    rows = {(r.source, r.lang, r.topic): r.weight for r in rake(cells, DIMENSIONS, targets, 20).collect()}
    for cell, want in zip(CELLS, plain_rake(CELLS, given, 20), strict=True):
        assert rows[cell[:3]] == pytest.approx(want)
    for d, shares in enumerate(given):
        for value, share in shares.items():
            assert sum(w for k, w in rows.items() if k[d] == value) / sum(rows.values()) == pytest.approx(share, abs=5e-3)


@pytest.mark.parametrize("budget", [0.1, 0.5, 0.9, 1.0])
def test_calibration_meets_the_budget(spark, budget):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, n long")
    shares = {d: target_shares(cells, d) for d in DIMENSIONS}
    rows = calibrate(rake(cells, DIMENSIONS, shares), budget).collect()
    assert all(0 <= r.probability <= 1 for r in rows)
    assert sum(r.n * r.probability for r in rows) == pytest.approx(budget * sum(r.n for r in rows))
    free = {round(r.probability / r.factor, 9) for r in rows if r.probability < 1}
    assert len(free) <= 1
    assert all(r.factor * next(iter(free)) >= 1 - 1e-9 for r in rows if r.probability == 1 and free)


def test_sample_is_near_its_budget_and_stable(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tokens = F.sum(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1)
    first = mix_documents(docs)
    assert first.agg(tokens).first()[0] / docs.agg(tokens).first()[0] == pytest.approx(0.8, abs=0.15)
    again = mix_documents(docs.repartition(5), keep_figures=False)
    assert again.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in again.collect()}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = documents(spark, [(None, None), (1, ""), (1, ""), (2, "a@b " * 3000)], ["1 AS _source", "2 AS n", "3 AS weight", "4 AS factor", "'q' AS _u", "5 AS topic"])
    rows = rows.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") == 2, "s"))
    out = mix_documents(rows, budget=1.0)
    assert out.count() == 4 and out.columns == [*(c for c in rows.columns if c not in ("factor", "topic")), "topic", "tokens", "factor", "probability"]
    assert mix_documents(rows, budget=0.5).where("doc_id = 1").count() in (0, 2)


def test_achieved_shares_beside_targets(spark, folder):
    """The reported shares are those of the probabilities; a missed target is one that the budget rules out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    report = {(r.dimension, r.value): r for r in expected_shares(docs).collect()}
    for d in DIMENSIONS:
        rows = [r for k, r in report.items() if k[0] == d]
        assert sum(r.achieved for r in rows) == pytest.approx(1) and sum(r.target for r in rows) == pytest.approx(1)
        assert all(r.achieved <= r.reachable + 1e-9 for r in rows)
    short = report["topic", "short"]
    assert short.target > short.reachable >= short.achieved
    low = expected_shares(docs, budget=0.01).collect()
    assert all(r.achieved == pytest.approx(r.target, abs=0.01) for r in low)


def test_given_targets_are_reported(spark):
    rows = documents(spark, ["a b c", "d e f"]).withColumn("source", F.when(F.col("doc_id") == 0, "s").otherwise("t"))
    to = {"source": spark.createDataFrame([("s", 0.75), ("t", 0.25)], "source string, target double")}
    for budget, want in ((0.5, 0.75), (0.8, 0.625)):
        got = {r.value: r for r in expected_shares(rows, targets=to, budget=budget).where("dimension = 'source'").collect()}
        assert got["s"].target == 0.75 and got["s"].achieved == pytest.approx(want)
        assert got["s"].reachable == pytest.approx(min(1, 0.5 / budget))
