"""Seasonal trend model with changepoints: piecewise linear trend, yearly and weekly waves, regressors.

The slope may change at evenly spaced dates of the first part of the training range. The changes have a Laplace prior,
so most of them are exactly zero; level, slope, waves and regressors have normal priors. The most probable coefficients
minimise, in units of a series' largest value, RSS / (2 v) + sum |change| / changepoint_prior + sum (b / prior)^2 / 2,
where the noise v is taken from the residuals, starting without changes, for ``NOISE_ROUNDS`` rounds.

All columns of the design are functions of the date (but for regressors), so a series travels as its dates and values:
at most one row a week. Series are solved in Arrow batches: their Gram matrices, the elimination of everything without a
Laplace prior, and an active-set search over the signs of the changes. The coefficients come back as one row per series, and rows are predicted in generated code.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.functions.calendar import TAU
from weekcast.spec import DEFAULT, SeriesSpec

NOISE_ROUNDS = 3
# Smallest noise, so that a perfect fit still has a penalty.
LEAST_NOISE = 1e-8
# Series solved at once inside a batch.
GROUP = 256
STEPS, TOLERANCE = 20, 1e-9
EPOCH = datetime.date(1970, 1, 1)


@dataclass(frozen=True)
class Shape:
    """Fixed values by default: those of the usual seasonal trend library."""

    changepoints: int = 25
    reach: float = 0.8
    changepoint_prior: float = 0.05
    trend_prior: float = 5.0
    seasonality_prior: float = 10.0
    yearly: int = 10
    weekly: int = 3
    mode: str = "additive"
    noise: float | None = None

    def knots(self) -> list[float]:
        """Where the slope may change, on the training range from 0 to 1."""
        return [self.reach * (i + 1) / self.changepoints for i in range(self.changepoints)]


@dataclass(frozen=True)
class Fitted:
    """Coefficients per series, and what they refer to."""

    weights: DataFrame
    shape: Shape
    first: int
    span: int
    regressors: tuple[str, ...]
    spec: SeriesSpec


def _terms(days, first, span, shape, regressors, sin, cos, positive, one) -> dict[str, list]:
    """Columns of the design by block, for numbers of days; works on arrays and on Spark columns."""
    t = (days - first) / float(span)
    return {
        "trend": [one, t],
        "change": [positive(t - k) for k in shape.knots()],
        "yearly": [f(days * (TAU * k / 365.25)) for k in range(1, shape.yearly + 1) for f in (sin, cos)],
        "weekly": [f(days * (TAU * k / 7.0)) for k in range(1, shape.weekly + 1) for f in (sin, cos)],
        "regressors": list(regressors),
    }


def _columns(days: Column, fitted: Fitted) -> dict[str, list[Column]]:
    values = [F.coalesce(F.col(f"`{r}`").cast("double"), F.lit(0.0)) for r in fitted.regressors]
    return _terms(
        days.cast("double"), float(fitted.first), fitted.span, fitted.shape, values,
        F.sin, F.cos, lambda x: F.greatest(x, F.lit(0.0)), F.lit(1.0),
    )


def days_of(spec: SeriesSpec) -> Column:
    """Days of a row's week since 1970."""
    return F.datediff(F.col(spec.week_date), F.lit("1970-01-01").cast("date"))


def _target(spec: SeriesSpec, shape: Shape) -> Column:
    y = F.col(spec.target).cast("double")
    return F.log1p(F.greatest(y, F.lit(0.0))) if shape.mode == "multiplicative" else y


# -- the solver ------------------------------------------------------------------------------


def _lowest(h: np.ndarray, b: np.ndarray, penalty: float, x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The lowest point of the objective on the way from ``x`` to ``to``, among its end and the places where a
    coordinate passes through zero."""
    step = to - x
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = np.where(step != 0, -x / step, -1.0)
    at = np.unique([*crossed[(crossed > 0) & (crossed < 1)], 1.0])
    points = x + at[:, None] * step
    for i, place in enumerate(at):
        points[i, crossed == place] = 0.0
    value = 0.5 * np.einsum("ni,ij,nj->n", points, h, points) - points @ b + penalty * np.abs(points).sum(axis=1)
    return points[int(np.argmin(value))]


def lasso(h: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """Minimises x'Hx/2 - b'x + penalty * |x|, exactly.

    Signs are assumed for some coordinates and their equations are solved; on the way there the objective's lowest
    point is taken, which may set coordinates to zero. When the signs agree, the coordinate at zero that violates its
    condition most joins. Every step lowers the objective, so no set of signs comes back.
    """
    size = len(b)
    x, diagonal = np.zeros(size), np.diag(h)
    usable = diagonal > 1e-12 * max(diagonal.max(initial=0.0), 1e-300)
    tolerance = TOLERANCE * (np.abs(b).max(initial=0.0) + penalty + 1e-300)
    for _ in range(STEPS * max(1, size)):
        slack = b - h @ x
        used = np.flatnonzero(x)
        sign = np.sign(x[used])
        if (np.abs(slack[used] - penalty * sign) <= tolerance).all():
            outside = np.where(usable & (x == 0), np.abs(slack), 0.0)
            joins = int(np.argmax(outside)) if size else 0
            if not size or outside[joins] <= penalty + tolerance:
                break
            used, sign = np.append(used, joins), np.append(sign, np.sign(slack[joins]))
        target = np.zeros(size)
        target[used] = np.linalg.lstsq(h[np.ix_(used, used)], b[used] - penalty * sign, rcond=None)[0]
        before, x = x, _lowest(h, b, penalty, x, target)
        if np.array_equal(before, x):
            break  # no lower point within rounding
    return x


def solve(gram: np.ndarray, moments: np.ndarray, squares: np.ndarray, rows: np.ndarray, blocks: dict[str, int], shape: Shape):
    """(coefficients, noise) of a batch of series given as sums over their rows, in units of their largest values."""
    order = [name for name, n in blocks.items() for _ in range(n)]
    change = np.array([name == "change" for name in order])
    prior = np.array([
        {"trend": shape.trend_prior, "change": math.inf}.get(name, shape.seasonality_prior) for name in order
    ])
    ridge = (1.0 / prior**2)[~change]
    size, o, c = len(order), np.flatnonzero(~change), np.flatnonzero(change)
    jitter = 1e-13 * np.einsum("sjj->s", gram) / size
    penalty = 0.0 if math.isinf(shape.changepoint_prior) else 1.0 / shape.changepoint_prior

    def fit(noise: np.ndarray, changes: bool) -> np.ndarray:
        a = gram[:, o[:, None], o] + np.eye(len(o)) * (noise[:, None, None] * ridge + jitter[:, None, None])
        across = gram[:, o[:, None], c]
        solved = np.linalg.solve(a, np.concatenate([across, moments[:, o, None]], axis=2))
        w = np.zeros((len(gram), size))
        if changes and len(c):
            h = gram[:, c[:, None], c] - np.einsum("soc,sod->scd", across, solved[:, :, :-1])
            b = moments[:, c] - np.einsum("soc,so->sc", across, solved[:, :, -1])
            w[:, c] = [lasso(*system) for system in zip(h, b, noise * penalty, strict=True)]
        w[:, o] = solved[:, :, -1] - np.einsum("soc,sc->so", solved[:, :, :-1], w[:, c])
        return w

    def residual(w: np.ndarray) -> np.ndarray:
        rss = squares - 2 * np.einsum("sp,sp->s", w, moments) + np.einsum("sp,spq,sq->s", w, gram, w)
        return np.maximum(rss / rows, LEAST_NOISE)

    if shape.noise is not None:
        noise = np.full(len(gram), shape.noise)
        return fit(noise, True), noise
    noise = residual(fit(np.full(len(gram), LEAST_NOISE), False))
    for _ in range(NOISE_ROUNDS):
        w = fit(noise, True)
        noise = residual(w)
    return w, noise


def _solve_series(series: list[list[dict]], shape: Shape, first: int, span: int, regressors: int) -> list[list[float]]:
    """Coefficients in units of the values, then the noise, of series given as rows of days, value, regressors."""
    grams, moments, squares, rows, scales, blocks = [], [], [], [], [], {}
    for points in series:
        days = np.array([p["days"] for p in points], dtype=float)
        y = np.array([p["y"] for p in points], dtype=float)
        more = [np.array([p["x"][i] for p in points], dtype=float) for i in range(regressors)]
        named = _terms(days, first, span, shape, more, np.sin, np.cos, lambda x: np.maximum(x, 0.0), np.ones(len(y)))
        blocks = {name: len(columns) for name, columns in named.items()}
        x = np.column_stack([column for columns in named.values() for column in columns])
        scale = max(float(np.abs(y).max()), 1e-12)
        y = y / scale
        grams.append(x.T @ x)
        moments.append(x.T @ y)
        squares.append(float(y @ y))
        rows.append(len(y))
        scales.append(scale)
    w, noise = solve(np.array(grams), np.array(moments), np.array(squares), np.array(rows, dtype=float), blocks, shape)
    unit = np.array(scales)[:, None]
    return np.column_stack([w * unit, noise[:, None] * unit**2]).tolist()


# -- fitting and predicting ------------------------------------------------------------------


def fit_changepoints(
    frame: DataFrame, train: str, spec: SeriesSpec = DEFAULT, shape: Shape = Shape(), regressors: Sequence[str] = (),
) -> Fitted | None:
    """Fit one model per series on the rows where the boolean column ``train`` is true; None without such rows.

    Rows without a value or date don't count; missing regressors are 0.
    """
    known = frame.where(F.coalesce(F.col(train), F.lit(False)) & F.col(spec.target).isNotNull() & F.col(spec.week_date).isNotNull())
    ends = known.agg(F.min(days_of(spec)).alias("first"), F.max(days_of(spec)).alias("last")).first()
    if ends["first"] is None:
        return None
    first, span, count = ends["first"], max(1, ends["last"] - ends["first"]), len(regressors)
    x = F.array(*[F.coalesce(F.col(f"`{r}`").cast("double"), F.lit(0.0)) for r in regressors]).cast("array<double>")
    point = F.struct(days_of(spec).alias("days"), _target(spec, shape).alias("y"), x.alias("x"))
    series = known.groupBy(*spec.series).agg(F.sort_array(F.collect_list(point)).alias("_points"))  # at most one a week

    @F.pandas_udf("array<double>")
    def weights(points: pd.Series) -> pd.Series:
        found: list[list[float]] = []
        for at in range(0, len(points), GROUP):
            found += _solve_series(points.iloc[at : at + GROUP].tolist(), shape, first, span, count)
        return pd.Series(found)

    return Fitted(series.select(*spec.series, weights("_points").alias("_w")), shape, first, span, tuple(regressors), spec)


def predict_changepoints(
    frame: DataFrame, fitted: Fitted | None, prediction: str = "prediction", components: bool = False,
) -> DataFrame:
    """``frame`` with the prediction, null for series without a fit, and at least 0.

    ``components`` adds the trend and the waves; with ``mode="multiplicative"`` these are of the logarithm.
    """
    parts = ["trend", "yearly", "weekly"] if components else []
    if fitted is None:
        return frame.withColumns({n: F.lit(None).cast("double") for n in [prediction, *parts]})
    blocks, at, sums = _columns(days_of(fitted.spec), fitted), 0, {}
    for name, columns in blocks.items():
        terms = [c * F.get(F.col("_w"), F.lit(at + i)) for i, c in enumerate(columns)]
        sums[name] = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
        at += len(columns)
    trend = sums["trend"] + sums["change"]
    total = trend + sums["yearly"] + sums["weekly"] + sums["regressors"]
    value = F.expm1(total) if fitted.shape.mode == "multiplicative" else total
    shown = {prediction: F.greatest(value, F.when(value.isNotNull(), F.lit(0.0)))}
    if components:
        shown |= {"trend": trend, "yearly": sums["yearly"], "weekly": sums["weekly"]}
    # A series has at most one row a week, so a join on the series key is not skewed.
    joined = frame.join(fitted.weights, list(fitted.spec.series), "left")
    return joined.select(*frame.columns, *[c.alias(n) for n, c in shown.items()])


def changepoints(fitted: Fitted) -> DataFrame:
    """(series..., changepoint, date, change): the dates where a series' slope changes, and by how much a year."""
    shape, spec = fitted.shape, fitted.spec
    dates = [EPOCH + datetime.timedelta(days=fitted.first + round(k * fitted.span)) for k in shape.knots()]
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("changepoint"), F.lit(d.isoformat()).cast("date").alias("date"),
                 (F.get(F.col("_w"), F.lit(2 + i)) * F.lit(365.25 / fitted.span)).alias("change"))
        for i, d in enumerate(dates)
    ])
    return fitted.weights.select(*spec.series, F.inline(rows)).where(F.col("change") != 0)
