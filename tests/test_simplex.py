"""Weights of least absolute error beside grids, random mixtures and the weighted median."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from weekcast.operators import simplex


def mixed(models, rows=400, seed=1):
    draw = np.random.default_rng(seed)
    base = draw.gamma(2, 20, rows)
    p = np.column_stack([base * draw.uniform(0.7, 1.3) + draw.normal(draw.normal(0, 3), 8, rows) for _ in range(models)])
    return base + draw.normal(0, 5, rows), p


def frame_of(spark, y, p):
    names = [f"m{i}" for i in range(p.shape[1])]
    return spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(y, p)], ["y", *names]).repartition(2), names


def error(y, p, w):
    return 100 * np.abs(y - p @ np.asarray(w)).sum() / np.abs(y).sum()


@pytest.mark.parametrize("models", [1, 2, 3, 6])
def test_no_mixture_is_better(spark, models):
    y, p = mixed(models)
    frame, names = frame_of(spark, y, p)
    found = simplex.minimise_weights(frame, "y", names)
    assert sum(found.weights) == pytest.approx(1) and min(found.weights) >= 0
    assert found.wmape == pytest.approx(error(y, p, found.weights))
    assert 0 <= found.wmape - found.bound <= 1e-6
    draw = np.random.default_rng(2)
    for w in [*draw.dirichlet(np.full(models, 0.5), 3000), *np.eye(models)]:
        assert error(y, p, w) >= found.bound - 1e-9
    assert found.passes <= 40


def test_two_models_have_the_weighted_median(spark):
    y, p = mixed(2, 300, 3)
    frame, names = frame_of(spark, y, p)
    d = p[:, 0] - p[:, 1]
    r = (y - p[:, 1]) / d
    order = np.argsort(r)
    at = order[np.searchsorted(np.cumsum(np.abs(d)[order]), np.abs(d).sum() / 2)]
    want = min(1.0, max(0.0, r[at]))
    found = simplex.minimise_weights(frame, "y", names, tolerance=1e-12)
    assert found.weights[0] == pytest.approx(want, abs=1e-4) and found.wmape == pytest.approx(error(y, p, (want, 1 - want)), abs=1e-8)


def test_a_corner_and_a_perfect_model(spark):
    y, p = mixed(2, 100, 4)
    perfect, names = frame_of(spark, y, np.column_stack([y, p]))
    found = simplex.minimise_weights(perfect, "y", names)
    assert found.wmape < 1e-6 and found.weights[0] == pytest.approx(1, abs=1e-6)
    noise = np.random.default_rng(8).normal(0, 5, 99)
    first = y[:99] + noise - np.median(noise)  # no shift makes it better
    far, names = frame_of(spark, y[:99], np.column_stack([first, first + 1000]))
    assert simplex.minimise_weights(far, "y", names).weights[0] == pytest.approx(1, abs=1e-6)


def test_awkward_rows(spark):
    y, p = mixed(2, 50, 5)
    frame, names = frame_of(spark, y, p)
    holes = frame.unionByName(spark.sql("SELECT CAST(NULL AS DOUBLE) y, 1e9D m0, 1D m1 UNION ALL SELECT 5D, NULL, 1D"))
    whole, part = (simplex.minimise_weights(f, "y", names) for f in (frame, holes))
    assert part.wmape == pytest.approx(whole.wmape)
    assert simplex.minimise_weights(frame.limit(0), "y", names) == simplex.Optimum((0.5, 0.5), 0.0, 0.0, 0)
    same, names = frame_of(spark, y, np.column_stack([p[:, 0]] * 3))
    assert simplex.minimise_weights(same, "y", names).wmape == pytest.approx(error(y, p[:, :1], [1.0]))
    table = simplex.weights_table(frame, ["m0", "m1"], whole).first()
    assert (table.weight_m0, table.weight_m1, table.wmape, table.gap) == (*whole.weights, whole.wmape, max(0.0, whole.wmape - whole.bound))


def test_planes_against_all_vertices():
    """The lowest point of random planes beside a fine grid of mixtures."""
    draw = np.random.default_rng(6)
    grid = np.array([(a, b - a, 1 - b) for a, b in itertools.combinations_with_replacement(np.linspace(0, 1, 201), 2)])
    for planes in (1, 2, 5, 40):
        slopes, offsets = draw.normal(size=(planes, 3)), draw.normal(size=planes)
        bound, w = simplex.lowest(slopes, offsets)
        best = (grid @ slopes.T + offsets).max(axis=1).min()
        assert bound <= best + 1e-12 and best - bound < 0.05
        assert (slopes @ w + offsets).max() == pytest.approx(bound, abs=1e-9)
