"""The Parzen search on known functions, and in closed form beside fitted models."""

from __future__ import annotations

import math

import numpy as np
import pytest

from weekcast.operators import models, search


class Known:
    """An objective that is a function, the same on every fold."""

    folds = (1, 2, 3, 4)

    def __init__(self, function):
        self.function, self.calls = function, 0

    def errors(self, trials, fold):
        self.calls += len(trials)
        return [(self.function(**t), 1.0) for t in trials]


def bowl(x, y):
    return 1 + (x - 0.31) ** 2 + 0.5 * ((y - 7) / 10) ** 2


SPACE = {"x": (-5.0, 5.0), "y": (0, 20)}


@pytest.mark.parametrize("seed", range(5))
def test_better_than_random_draws(seed):
    found = search.search(Known(bowl), SPACE, 100, seed)
    assert len(found) == 100 and [t["params"] for t in found[:10]] == models.sample_parameters(SPACE, 10, seed)
    best = min(t["error"] for t in found if t["error"] is not None)
    start = min(t["error"] for t in found[:10])
    random = min(100 * bowl(**p) for p in models.sample_parameters(SPACE, 100, seed))
    assert best <= start and best <= random and best < 103
    assert all(-5 <= t["params"]["x"] <= 5 and isinstance(t["params"]["y"], int) and 0 <= t["params"]["y"] <= 20 for t in found)


def test_losers_are_stopped_early():
    objective = Known(bowl)
    found = search.search(objective, SPACE, 100, 3)
    assert all(t["folds"] == 4 for t in found[:10])
    for first in range(10, 100, 10):
        batch = found[first : first + 10]
        assert sorted(t["folds"] for t in batch) == [1] * 5 + [2] * 2 + [3] + [4] * 2
        assert all((t["error"] is None) == (t["folds"] < 4) for t in batch)
        finished = [bowl(**t["params"]) for t in batch if t["folds"] == 4]
        assert max(finished) <= min(bowl(**t["params"]) for t in batch if t["folds"] == 1)
    assert objective.calls == 40 + 9 * (10 + 5 + 3 + 2)


def test_same_seed_same_trials():
    runs = [[t["params"] for t in search.search(Known(bowl), SPACE, 40, 9)] for _ in range(2)]
    assert runs[0] == runs[1] and runs[0] != [t["params"] for t in search.search(Known(bowl), SPACE, 40, 8)]


def test_densities_are_normalised():
    for points in ([], [1.0], [0.0, 0.0, 9.9], list(np.linspace(0, 10, 40))):
        density = search.Density(points, 0.0, 10.0)
        grid = np.linspace(0, 10, 20_001)
        assert np.mean([math.exp(density.log(x)) for x in grid]) * 10 == pytest.approx(1, abs=1e-2)


def test_fixed_parameters_and_few_trials():
    found = search.search(Known(lambda x, k: x * x + k), {"x": (0.0, 1.0), "k": (3, 3)}, 13, 1)
    assert len(found) == 13 and {t["params"]["k"] for t in found} == {3}
    assert len(search.search(Known(bowl), SPACE, 4, 1)) == 4


def test_closed_form_equals_fitted_models(spark):
    draw = np.random.default_rng(2)
    rows = [(int(f), float(a), float(b), float(3 * a - b + draw.normal())) for f in range(4) for a, b in draw.normal(5, 2, (60, 2))]
    frame = spark.createDataFrame(rows, "fold int, a double, b double, quantity double")
    trials = [{"reg_param": p} for p in (0.0, 1.5, 40.0)]
    closed = search.LinearObjective(frame, ["a", "b"])
    fitted = search.ModelObjective(frame, ["a", "b"], "linear")
    assert closed.folds == fitted.folds == [1, 2, 3]
    for fold in closed.folds:
        for (e, base), (e2, base2) in zip(closed.errors(trials, fold), fitted.errors(trials, fold), strict=True):
            assert e == pytest.approx(e2, rel=1e-4) and base == pytest.approx(base2)
    table = search.tune_parzen(frame, ["a", "b"], "linear", {"reg_param": (0.0, 40.0)}, 30)
    rows = table.collect()
    assert len(rows) == 30 and rows[0].wmape == min(r.wmape for r in rows if r.wmape is not None) and rows[-1].wmape is None


def test_trees(spark):
    draw = np.random.default_rng(3)
    rows = [(int(f), float(a), float(abs(a) * 4 + draw.normal())) for f in range(3) for a in draw.normal(5, 2, 80)]
    frame = spark.createDataFrame(rows, "fold int, a double, quantity double").cache()
    table = search.tune_parzen(frame, ["a"], "tree", {"max_depth": (1, 6)}, 6, startup=4, batch=2).collect()
    assert len(table) == 6 and {r.folds for r in table} == {1, 2} and table[0].wmape < 60
