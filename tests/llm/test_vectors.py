"""Vector search and near-duplicate vectors beside versions that compare everything."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import components
from weekcast.llm import knn, vecdedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(seed=0, n=260, dim=16):
    """Vectors around a few centres, some equal, some within the threshold and some just outside it."""
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((6, dim))
    rows = []
    for i in range(n):
        base = centres[draw.integers(6)]
        noise = draw.choice([0.0, 0.05, 0.12, 0.2, 0.6])
        rows.append((i, (base + noise * draw.standard_normal(dim)).astype(np.float32).tolist(), int(draw.integers(2))))
    return rows


def plain_links(rows, cosine=0.98):
    good = [(i, np.array(v, np.float64), c) for i, v, c in rows
            if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for n, (i, v, c) in enumerate(good):
        for j, w, d in good[n + 1 :]:
            if c == d and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= cosine:
                links.append((i, j))
    return links


def check_links(spark, rows):
    found = {r.vec_id: r for r in vecdedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    links = plain_links(rows)
    want = components([r[0] for r in rows], links)
    for i, *_ in rows:
        r = found[i]
        assert r.n_links == sum(i in p for p in links), i
        assert (r.component_id, r.kept) == (want[i], want[i] == i)
    return links


def test_near_duplicates_against_all_pairs(spark):
    assert len(check_links(spark, clustered())) > 100


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "CELL_ROWS", 9)
    monkeypatch.setattr(vecdedup, "_A_ROWS", 5)
    monkeypatch.setattr(vecdedup, "_PAIRS", 7)
    assert check_links(spark, clustered(3, 200, 5))


def test_odd_vectors_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [1.0, None, 3.0], 0),
            (7, [float("nan"), 2.0, 3.0], 0), (8, [float("inf"), 2.0, 3.0], 0), (9, [0.0, 0.0, 0.0], 0), (10, [], 0), (11, [1.0, 2.0], 0),
            (12, [-1.0, -2.0, -3.0], 0), (13, [1e-30, 2e-30, 3e-30], 0)]
    frame = spark.createDataFrame([*rows, (None, v, 0), (20, v, 2), (20, v, 2)], SCHEMA).selectExpr("*", "1 AS vector", "2 AS rep", "3 AS links", "4 AS id")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vecdedup.near_duplicate_vectors(frame).collect()]
    assert sorted(g for g in got if g[0] in (1, 2, 13)) == [(1, 2, 1, True), (2, 2, 1, False), (13, 2, 1, False)]
    assert all(g[1:] == (0, g[0], True) for g in got if g[0] in range(3, 13))
    assert [g for g in got if g[0] == 20] == [(20, 1, 20, True)] * 2
    assert [g for g in got if g[0] is None] == [(None, 0, None, True)]


def plain_top(rows, k, scale=64):
    good = {i: np.array([np.floor(scale * float(x)) for x in v], np.int64) for i, v, *_ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for i, q in good.items():
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in good.items() if j != i and len(v) == len(q))[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return {i: b for i, b in out.items() if b}


def check_top(spark, rows, k=20):
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for r in knn.top_k(frame, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found == plain_top(rows, k)


def test_search_against_all_scores(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 50)
    monkeypatch.setattr(knn, "LEAF_ROWS", 4)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 64)
    check_top(spark, clustered(1, 300, 6), k=7)


def test_search_with_ties_and_odd_vectors(spark):
    v = [0.5, -0.25]
    rows = [(i, v, 0) for i in range(60)] + [(60, None, 0), (80, [0.1, None], 0), (100, [float("nan"), 1.0], 0), (120, [1.0], 0),
                                             (140, [], 0), (160, [float("inf"), 0.0], 0), (-20, [3.0, 1.0], 0), (180, [2.0], 0)]
    check_top(spark, rows)
    again = spark.createDataFrame([*rows, *rows[:30], (None, v, 0)], SCHEMA).selectExpr("*", "1 AS v", "2 AS dim", "3 AS shard")
    found = knn.top_k(again, F.col("vec_id") % 20 == 0).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in found] == [-20, *(i for i in range(20) if i != 20)][:20]


@pytest.mark.parametrize("leaf", [1, 3, 200])
def test_boxes_hold_their_points(leaf):
    draw = np.random.default_rng(leaf)
    rows = draw.integers(-5, 5, (100, 3))
    tree = knn.KdTree.from_bytes(knn.KdTree.build(np.arange(100), rows, leaf).to_bytes())
    query = draw.integers(-5, 5, (1, 3)).astype(float)
    for node in range(len(tree.start)):
        inside = tree.rows[tree.start[node] : tree.end[node]]
        assert (inside.min(axis=0) == tree.low[node]).all() and (inside.max(axis=0) == tree.high[node]).all()
        assert tree.bounds(query)[0, node] >= (inside @ query[0]).max()


def exact_top(rows, k=20):
    """All scores in whole numbers of any size, held to 64 bits."""
    top = {}
    whole = {i: [max(-(2**63), min(2**63 - 1, math.floor(64.0 * float(c)))) for c in v] for i, v in rows}
    for i, v in whole.items():
        if i % 20 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w in whole.items() if j != i)
            top[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return top


@pytest.mark.parametrize("largest", [2.0**14, 2.0**15, 1e6, 1e9, 1e20])
def test_components_of_any_size(spark, monkeypatch, largest):
    """A few vectors with huge components lead the lists, and their own lists are right."""
    monkeypatch.setattr(knn, "SHARD_ROWS", 40)
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(110)]
    for i in (3, 20, 41, 60, 77):
        rows[i] = (i, (draw.normal(size=4) * largest).tolist())
    rows[50] = (50, [largest, 1.0, 0.0, -largest])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in knn.top_k(frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {i: sorted(f) for i, f in found.items()} == exact_top(rows)
