"""Search for parameters: Parzen estimators propose, folds stop the losers early.

The first trials are the seeded random draws of ``sample_parameters``. After them every parameter is drawn from a
density over the good trials (a tenth of them, at least one), and of several draws the one is taken where that density
is largest against the one over all other trials. Trials come in batches, so that an objective can evaluate a batch in
one pass over the data; trials not yet evaluated count as bad ones meanwhile. After each fold the worse part of a batch
is stopped: only ``1 / eta`` of it goes on to the next fold. The first draws are never stopped, so the result is at
least as good as theirs.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.operators.folds import GAP, fold_ids, fold_test, fold_train
from weekcast.operators.models import SEED, ModelSpec, fit, predict, sample_parameters
from weekcast.spec import DEFAULT, SeriesSpec

STARTUP, BATCH, CANDIDATES, ETA = 10, 10, 24, 2
# Good trials: this share, but not more than so many.
GOOD_SHARE, MOST_GOOD = 0.1, 25


class Objective(Protocol):
    """What is searched over: errors of trials, fold by fold."""

    folds: Sequence[int]

    def errors(self, trials: Sequence[Mapping[str, float]], fold: int) -> list[tuple[float, float]]:
        """Per trial the sum of absolute errors on the fold's test rows, and the sum of absolute values there."""


# -- proposing -------------------------------------------------------------------------------


class Density:
    """Mixture of normals on an interval, one around each point and a wide one in the middle. Normals are as wide as the
    gaps around their points, and become narrower with the trials ``seen``."""

    def __init__(self, points: Sequence[float], low: float, high: float, seen: int = 0):
        self.low, self.high = low, high
        span = high - low
        means = sorted([*points, (low + high) / 2])
        least = span / min(100.0, max(seen, len(means)) + 1.0)
        self.parts = []
        for i, m in enumerate(means):
            left = m - (means[i - 1] if i else low)
            right = (means[i + 1] if i + 1 < len(means) else high) - m
            self.parts.append((m, min(span, max(left, right, least))))
        wide = means.index((low + high) / 2)
        self.parts[wide] = (self.parts[wide][0], span)

    def draw(self, rng: random.Random) -> float:
        mean, width = rng.choice(self.parts)
        while True:
            x = rng.gauss(mean, width)
            if self.low <= x <= self.high:
                return x

    def log(self, x: float) -> float:
        total = 0.0
        for mean, width in self.parts:
            inside = 0.5 * (math.erf((self.high - mean) / (width * math.sqrt(2))) - math.erf((self.low - mean) / (width * math.sqrt(2))))
            total += math.exp(-0.5 * ((x - mean) / width) ** 2) / (width * math.sqrt(2 * math.pi)) / max(inside, 1e-300)
        return math.log(max(total / len(self.parts), 1e-300))


class ParzenSampler:
    """Proposes trials from the errors told so far."""

    def __init__(self, space: Mapping[str, tuple], seed: int = SEED, startup: int = STARTUP):
        self.space, self.rng = dict(space), random.Random(seed)
        self.first = sample_parameters(self.space, startup, seed)
        self.told: list[tuple[float, dict]] = []
        self.open: list[dict] = []

    def ask(self) -> dict:
        trial = self.first.pop(0) if self.first else self._propose()
        self.open.append(trial)
        return trial

    def tell(self, trial: dict, error: float) -> None:
        """An infinite error marks a trial that was stopped."""
        self.open = [t for t in self.open if t is not trial]
        self.told.append((error, trial))

    def _propose(self) -> dict:
        ranked = [t for _, t in sorted(self.told, key=lambda e: e[0])]
        count = min(MOST_GOOD, max(1, math.ceil(GOOD_SHARE * len(ranked))))
        good, bad = ranked[:count], [*ranked[count:], *self.open]
        trial = {}
        for name, (low, high) in self.space.items():
            whole = isinstance(low, int) and isinstance(high, int)
            a, b = (low - 0.5, high + 0.5) if whole else (float(low), float(high))
            if a == b:
                trial[name] = low
                continue
            likely, other = (Density([t[name] for t in part], a, b, len(self.told)) for part in (good, bad))
            draws = [likely.draw(self.rng) for _ in range(CANDIDATES)]
            best = max(draws, key=lambda x: likely.log(x) - other.log(x))
            trial[name] = min(high, max(low, round(best))) if whole else min(high, max(low, round(best, 4)))
        return trial


# -- objectives ------------------------------------------------------------------------------


class ModelObjective:
    """Fits a model per trial and fold. ``frame`` must come from ``folded``."""

    def __init__(self, frame: DataFrame, features: Sequence[str], kind: str, spec: SeriesSpec = DEFAULT, gap: int = GAP):
        self.frame, self.features, self.kind, self.spec, self.gap = frame, list(features), kind, spec, gap
        self.folds = fold_ids(frame)

    def errors(self, trials, fold):
        train, test = fold_train(self.frame, fold, self.gap), fold_test(self.frame, fold)
        y, out = F.col(self.spec.target), []
        for params in trials:
            scored = predict(fit(train, self.features, ModelSpec(self.kind, params), self.spec.target), test)
            row = scored.agg(F.sum(F.abs(y - F.col("prediction"))).alias("e"), F.sum(F.abs(y)).alias("b")).first()
            out.append((float(row["e"] or 0.0), float(row["b"] or 0.0)))
        return out


class LinearObjective:
    """Ridge regressions in closed form: the moments of every fold are summed up in one pass, and all trials of a batch
    are evaluated in one more per fold. ``frame`` must come from ``folded``; the parameter is ``reg_param``."""

    def __init__(self, frame: DataFrame, features: Sequence[str], spec: SeriesSpec = DEFAULT):
        self.frame, self.features, self.spec = frame, list(features), spec
        self.folds = fold_ids(frame)
        self.x = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features]
        self.y = F.col(spec.target).cast("double")
        columns = [F.lit(1.0), *self.x, self.y]
        size = len(columns)
        cells = [(i, j) for i in range(size) for j in range(i, size)]
        rows = frame.where(self.y.isNotNull()).groupBy("fold").agg(
            *[F.sum(columns[i] * columns[j]).alias(f"c{i}_{j}") for i, j in cells]
        ).collect()  # one row per fold
        self.sums = {}
        for r in rows:
            gram = np.zeros((size, size))
            for i, j in cells:
                gram[i, j] = gram[j, i] = r[f"c{i}_{j}"]
            self.sums[r["fold"]] = gram

    def weights(self, reg_param: float, fold: int) -> list[float]:
        """Intercept and coefficients learned from all earlier folds."""
        gram = sum(g for f, g in self.sums.items() if f < fold)
        n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
        cov = gram[1:, 1:] / n - np.outer(mean, mean)
        penalty = reg_param / math.sqrt(max(cov[-1, -1], 1e-300))
        w = np.linalg.lstsq(cov[:-1, :-1] + np.eye(len(self.x)) * penalty, cov[:-1, -1], rcond=None)[0]
        return [float(mean[-1] - w @ mean[:-1]), *map(float, w)]

    def errors(self, trials, fold):
        sums = []
        for i, params in enumerate(trials):
            w = self.weights(params["reg_param"], fold)
            fitted = sum((x * F.lit(b) for x, b in zip(self.x, w[1:], strict=True)), F.lit(w[0]))
            sums.append(F.sum(F.abs(self.y - fitted)).alias(f"e{i}"))
        row = fold_test(self.frame, fold).agg(*sums, F.sum(F.abs(self.y)).alias("b")).first()
        return [(float(row[f"e{i}"] or 0.0), float(row["b"] or 0.0)) for i in range(len(trials))]


# -- the search ------------------------------------------------------------------------------


def search(
    objective: Objective, space: Mapping[str, tuple], trials: int = 100, seed: int = SEED, startup: int = STARTUP,
    batch: int = BATCH, eta: int = ETA,
) -> list[dict]:
    """Per trial its parameters, the folds it was evaluated on, and its error over all folds in percent: None where it
    was stopped."""
    sampler, table = ParzenSampler(space, seed, startup), []
    while len(table) < trials:
        first = len(table) < startup
        size = min(batch, trials - len(table), startup - len(table) if first else batch)
        live = [{"trial": len(table) + i, "params": sampler.ask(), "folds": 0, "sums": [0.0, 0.0]} for i in range(size)]
        table += live
        for number, fold in enumerate(objective.folds):
            for item, (error, base) in zip(live, objective.errors([t["params"] for t in live], fold), strict=True):
                item["sums"] = [item["sums"][0] + error, item["sums"][1] + base]
                item["folds"] += 1
            if not first and number + 1 < len(objective.folds):
                kept = max(1, math.ceil(len(live) / eta))
                live = sorted(live, key=lambda t: (_share(t), t["trial"]))[:kept]
        for item in table[-size:]:
            done = item["folds"] == len(objective.folds)
            item["error"] = _share(item) if done else None
            sampler.tell(item["params"], item["error"] if done else math.inf)
    return table


def _share(item: dict) -> float:
    error, base = item["sums"]
    return 100.0 * error / base if base else 0.0


def search_table(frame: DataFrame, table: Sequence[dict], space: Mapping[str, tuple]) -> DataFrame:
    """(trial, parameters..., folds, wmape), best first, stopped trials last."""
    rows = [(t["trial"], *[float(t["params"][n]) for n in space], t["folds"], t["error"]) for t in table]
    columns = ", ".join(["trial int", *[f"`{n}` double" for n in space], "folds int", "wmape double"])
    return frame.sparkSession.createDataFrame(rows, columns).orderBy(F.asc_nulls_last("wmape"), "trial")


def tune_parzen(
    frame: DataFrame, features: Sequence[str], kind: str, space: Mapping[str, tuple], trials: int = 100,
    spec: SeriesSpec = DEFAULT, gap: int = GAP, **options,
) -> DataFrame:
    """``search_table`` for a kind of model; ridge regressions are evaluated in closed form. ``frame`` must come from
    ``folded``."""
    linear = kind == "linear" and set(space) == {"reg_param"} and gap == 0
    objective = LinearObjective(frame, features, spec) if linear else ModelObjective(frame, features, kind, spec, gap)
    return search_table(frame, search(objective, space, trials, **options), space)
