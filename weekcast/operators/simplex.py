"""Ensemble weights of least absolute error over all mixtures, with a proof of how good they are.

The error of a mixture is a convex function of its weights. Its value and slopes at a point are sums over the rows, and
one pass over the data gives them for several points. Each point cuts off what lies below the plane through it; the
least value that all planes allow is a bound on the error of any mixture. The search ends when the best mixture seen is
within the tolerance of this bound, for any number of models.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE, PASSES = 1e-8, 200
# Points evaluated in one pass.
POINTS = 8


@dataclass(frozen=True)
class Optimum:
    """Weights, their error, the bound below every mixture's error (both in percent of the actual total), and passes."""

    weights: tuple[float, ...]
    wmape: float
    bound: float
    passes: int


def _slopes(df: DataFrame, actual: str, predictions: Sequence[str], points: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(sum of absolute errors, its slopes) at each point, in one pass."""
    y = F.col(f"`{actual}`").cast("double")
    p = [F.col(f"`{m}`").cast("double") for m in predictions]
    sums = []
    for i, w in enumerate(points):
        left = y
        for column, weight in zip(p, w, strict=True):
            left = left - column * float(weight)
        sums.append(F.sum(F.abs(left)).alias(f"e{i}"))
        sums += [F.sum(-F.signum(left) * column).alias(f"g{i}_{j}") for j, column in enumerate(p)]
    row = df.agg(*sums).first()
    return [(float(row[f"e{i}"]), np.array([float(row[f"g{i}_{j}"]) for j in range(len(p))])) for i in range(len(points))]


def lowest(slopes: np.ndarray, offsets: np.ndarray) -> tuple[float, np.ndarray]:
    """Minimum over mixtures w of the largest of ``slopes @ w + offsets`` (a bound from below), and where it is.

    The simplex method on the dual, whose basis has a row per model and one for their sum: mixtures l of planes with
    the largest min_m (l @ slopes)[m] + l @ offsets. Planes enter as columns.
    """
    planes, models = slopes.shape
    scale = max(np.abs(slopes).max(), np.abs(offsets).max(), 1e-300)
    # Columns: planes (l >= 0), the value u split in two, a slack per model. Rows: u - l @ slopes[:, m] + s_m = 0; sum l = 1.
    columns = np.zeros((models + 1, planes + 2 + models))
    columns[:models, :planes] = -slopes.T / scale
    columns[models, :planes] = 1.0
    columns[:models, planes], columns[:models, planes + 1] = 1.0, -1.0
    columns[:models, planes + 2 :] = np.eye(models)
    gain = np.concatenate([offsets / scale, [1.0, -1.0], np.zeros(models)])
    right = np.zeros(models + 1)
    right[models] = 1.0
    # Start: the first plane with the value of its lowest model, and slacks for the others.
    first = -columns[:models, 0]
    low = int(np.argmin(first))
    value = planes if first[low] >= 0 else planes + 1
    basis = [0, value, *[planes + 2 + m for m in range(models) if m != low]]
    for step in range(5000):
        inverse = np.linalg.inv(columns[:, basis])
        x = inverse @ right
        price = gain[basis] @ inverse
        reduced = gain - price @ columns
        reduced[basis] = 0.0
        enters = int(np.argmax(reduced)) if step < 2000 else int(np.argmax(reduced > 1e-13))
        if reduced[enters] <= 1e-13:
            break
        way = inverse @ columns[:, enters]
        large = way > 1e-9 * np.abs(way).max(initial=1e-300)
        ratios = np.where(large, np.maximum(x, 0.0) / np.where(large, way, 1.0), np.inf)
        if not np.isfinite(ratios).any():
            break
        ties = np.flatnonzero(ratios <= ratios.min() + 1e-13)
        # Of equal ones the largest pivot, for rounding; late on the smallest number, so that no basis comes back.
        basis[max(ties, key=lambda t: way[t]) if step < 2000 else min(ties, key=lambda t: basis[t])] = enters
    w = np.maximum(price[:models], 0.0)
    w = w / w.sum() if w.sum() > 0 else np.full(models, 1.0 / models)
    # Whatever the rounding, a mixture of planes bounds the minimum from below.
    share = np.zeros(columns.shape[1])
    share[basis] = np.maximum(np.linalg.solve(columns[:, basis], right), 0.0)
    share = share[:planes] / share[:planes].sum()
    return float((share @ slopes).min() + share @ offsets), w


def minimise_weights(
    df: DataFrame, actual: str, predictions: Sequence[str], tolerance: float = TOLERANCE, passes: int = PASSES,
    points: int = POINTS,
) -> Optimum:
    """Weights of least total absolute error over all mixtures of the prediction columns.

    Rows where a value is missing don't count. ``tolerance`` is the gap to the bound, as a share of the actual total.
    Without rows, or if all actual values are zero, the weights are equal and the error is 0.
    """
    models = len(predictions)
    known = df.select(actual, *predictions).dropna()
    total = float(known.agg(F.sum(F.abs(F.col(f"`{actual}`").cast("double")))).first()[0] or 0.0)
    even = np.full(models, 1.0 / models)
    if not total:
        return Optimum(tuple(even), 0.0, 0.0, 0)
    slopes, offsets = np.zeros((0, models)), np.zeros(0)
    best, best_error, bound, number = even, np.inf, 0.0, 0
    ask = np.vstack([even, np.eye(models)])
    for number in range(1, passes + 1):
        for w, (error, slope) in zip(ask, _slopes(known, actual, predictions, ask), strict=True):
            error, slope = error / total, slope / total
            if error < best_error:
                best, best_error = w, error
            slopes, offsets = np.vstack([slopes, slope]), np.append(offsets, error - slope @ w)
        bound, at = lowest(slopes, offsets)
        if best_error - bound <= tolerance:
            break
        # The lowest point of the planes, and points on the way to it from the best one: the planes are right near the
        # latter, so that the way is cut where they stop being so.
        shares = [1.0, *(0.5**i for i in range(1, points))]
        ask = np.array([best + s * (at - best) for s in shares])
    return Optimum(tuple(map(float, best)), 100.0 * best_error, 100.0 * max(0.0, bound), number)


def weights_table(df: DataFrame, predictions: Sequence[str], found: Optimum) -> DataFrame:
    """One row: a weight per model, the error, the bound and the gap between them."""
    rows = [(*found.weights, found.wmape, found.bound, max(0.0, found.wmape - found.bound))]
    columns = ", ".join([*[f"`weight_{m}` double" for m in predictions], "wmape double", "bound double", "gap double"])
    return df.sparkSession.createDataFrame(rows, columns)
