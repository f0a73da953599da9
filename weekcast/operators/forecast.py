"""Scoring frame, post-processing and formatting of forecasts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.calendar import add, calendar_basic, calendar_flags, cyclic_encoding, season_flags
from weekcast.functions.scalars import round_half_even
from weekcast.operators.checks import WEEKS, check_forecast, check_scoring_input, ensure_valid
from weekcast.operators.clean import clip_nonnegative, filter_horizon, require
from weekcast.operators.joins import join_history_bounds
from weekcast.plans.scale import materialize, quantile_row, with_scalars
from weekcast.spec import DEFAULT, SeriesSpec

MAX_MULTIPLIER = 3.0
MEAN_MULTIPLIER = 10.0
NO_HISTORY_BOUND = 1000.0


def shift_to_horizon(df: DataFrame, first_date: dt.date | str | Column, spec: SeriesSpec = DEFAULT, months: int = 1) -> DataFrame:
    """Rows from ``first_date`` on, moved ``months`` ahead, with calendar columns of the new date.

    A projection over a date-filtered scan; month ends are clamped. The first date may be a scalar subquery.
    """
    first = first_date if isinstance(first_date, Column) else F.lit(str(first_date)).cast("date")
    moved = df.where(F.col(spec.week_date) >= first).withColumn(
        spec.week_date, F.add_months(spec.week_date, months)
    )
    day = F.col(spec.week_date)
    recomputed = {**calendar_basic(day), **calendar_flags(day), **cyclic_encoding(day), **season_flags(day)}
    present = {n: e for n, e in recomputed.items() if n in df.columns}
    present[spec.year] = F.year(day)
    present[spec.week] = F.weekofyear(day)
    return add(moved, present)


def recent_means(sizes: Sequence[int], spec: SeriesSpec = DEFAULT) -> dict[str, Column]:
    """Mean of the last rows of a series before each row, per number of rows."""
    q, w = F.col(spec.target).cast("double"), Window.partitionBy(*spec.series).orderBy(spec.week_date, spec.year, spec.week)
    return {f"{spec.target}_mean_{n}": F.avg(q).over(w.rowsBetween(-n, -1)) for n in sizes}


def future_frame(
    panel: DataFrame, sizes: Sequence[int] = (4, 8), spec: SeriesSpec = DEFAULT, weeks: int = 4, months: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Training rows and rows of weeks that have not happened.

    The newest ``weeks`` weeks are moved into the horizon, with the calendar of the new date and without their
    target. Both frames carry the mean of the last rows of history: of the rows before each training row, and of
    the last rows of the series for every row of the horizon. No row is in both.
    """
    key = [*spec.panel_key, spec.week_date]
    history = panel.select(*key, F.col(spec.target).cast("double").alias(spec.target))
    train = history.withColumns(recent_means(sizes, spec)).where(F.col(f"{spec.target}_mean_{sizes[0]}").isNotNull())
    last = history.agg(F.max(spec.week_date).alias("_last"))
    recent = with_scalars(history, last).where(F.col(spec.week_date) > F.date_sub("_last", 7 * weeks)).drop("_last")
    moved = shift_to_horizon(recent, dt.date.min, spec, months).drop(spec.target)
    # A month ahead of the newest weeks can still be history; only later weeks are forecast.
    future = with_scalars(moved, last).where(F.col(spec.week_date) > F.col("_last")).drop("_last")
    future = future.groupBy(*spec.panel_key).agg(F.min(spec.week_date).alias(spec.week_date))
    newest = Window.partitionBy(*spec.series).orderBy(F.desc(spec.week_date), F.desc(spec.year), F.desc(spec.week))
    ranked = history.withColumn("_nth", F.row_number().over(newest))
    means = ranked.groupBy(*spec.series).agg(
        *[F.avg(F.when(F.col("_nth") <= n, F.col(spec.target))).alias(f"{spec.target}_mean_{n}") for n in sizes]
    )
    return train, future.join(means, spec.series)


def forecast_horizon(
    panel: DataFrame, fit: Callable[[DataFrame, list[str]], Transformer], sizes: Sequence[int] = (4, 8),
    spec: SeriesSpec = DEFAULT, weeks: int = 4, months: int = 1,
) -> DataFrame:
    """Fit on all of history, then score, bound, tame, round and check the weeks after it."""
    train, future = future_frame(panel, sizes, spec, weeks, months)
    train = materialize(train, "horizon", spec.series)
    model = fit(train, [f"{spec.target}_mean_{n}" for n in sizes])
    scored = materialize(score(future, model).select(*future.columns, "prediction"), "horizon")
    out = format_forecast(postprocess(scored, panel, spec=spec), None, spec=spec)
    found = [r[0] for r in out.select(spec.week).distinct().collect()]  # at most the weeks of the horizon
    ensure_valid(check_forecast(out, sorted(found), spec))
    return out


def bound_by_history(
    forecast: DataFrame,
    history: DataFrame,
    prediction: str = "prediction",
    spec: SeriesSpec = DEFAULT,
    multiplier: float = MAX_MULTIPLIER,
) -> DataFrame:
    """Cap at min(3 x historical max, 10 x historical mean); 1000 for series without history."""
    wide = join_history_bounds(forecast, history, spec)
    bound = F.least(F.col("history_max") * multiplier, F.col("history_mean") * MEAN_MULTIPLIER)
    capped = F.least(F.col(prediction), F.coalesce(bound, F.lit(NO_HISTORY_BOUND)))
    return wide.withColumn(prediction, capped).drop("history_max", "history_mean")


def bound_by_history_floor(
    forecast: DataFrame,
    history: DataFrame,
    prediction: str = "prediction",
    spec: SeriesSpec = DEFAULT,
    multiplier: float = MAX_MULTIPLIER,
) -> DataFrame:
    """The variant whose cap never falls below 1000."""
    wide = join_history_bounds(forecast, history, spec)
    bound = F.least(
        F.coalesce("history_max", F.lit(NO_HISTORY_BOUND)) * multiplier,
        F.coalesce("history_mean", F.lit(0.0)) * MEAN_MULTIPLIER,
    )
    capped = F.least(F.col(prediction), F.greatest(bound, F.lit(NO_HISTORY_BOUND)))
    return wide.withColumn(prediction, capped).drop("history_max", "history_mean")


def extreme_thresholds(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row with P95 and P99 of the predictions."""
    return quantile_row(df, [prediction], [0.95, 0.99], "_{name}", ["p95", "p99"])


def tame_extremes(df: DataFrame, prediction: str = "prediction", thresholds: DataFrame | None = None) -> DataFrame:
    """Values above P99 become P95; thresholds may come from a reference table."""
    wide = with_scalars(df, thresholds if thresholds is not None else extreme_thresholds(df, prediction))
    p = F.col(prediction)
    return wide.withColumn(prediction, F.when(p > F.col("_p99"), F.col("_p95")).otherwise(p)).drop("_p95", "_p99")


def cap_by_mean(df: DataFrame, multiplier: float, prediction: str = "prediction") -> DataFrame:
    wide = with_scalars(df, df.agg((F.avg(prediction) * multiplier).alias("_limit")))
    return wide.withColumn(prediction, F.least(F.col(prediction), F.col("_limit"))).drop("_limit")


def bounded(
    df: DataFrame, history: DataFrame | None = None, prediction: str = "prediction", spec: SeriesSpec = DEFAULT, floor: bool = False
) -> DataFrame:
    """Clip at zero and, with a history, bound by it."""
    out = clip_nonnegative(df, prediction)
    if history is None:
        return out
    return (bound_by_history_floor if floor else bound_by_history)(out, history, prediction, spec)


def postprocess(
    df: DataFrame,
    history: DataFrame | None = None,
    prediction: str = "prediction",
    spec: SeriesSpec = DEFAULT,
    thresholds: DataFrame | None = None,
    floor: bool = False,
) -> DataFrame:
    """Clip at zero, bound by history, tame extremes, round to units."""
    out = tame_extremes(bounded(df, history, prediction, spec, floor), prediction, thresholds)
    return out.withColumn(prediction, round_half_even(F.col(prediction)))


def format_forecast(
    df: DataFrame, weeks: Sequence[int] | None = WEEKS, prediction: str = "prediction", spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """week, store, product, quantity with their output types, target weeks only."""
    require(df, [*spec.forecast_key, prediction])
    out = df.select(
        F.col(spec.week).cast("int").alias(spec.week),
        *[F.col(c).cast("string").alias(c) for c in spec.series],
        F.col(prediction).cast("int").alias(spec.target),
    )
    return out if weeks is None else filter_horizon(out, weeks, spec)


def sort_forecast(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Total order for a sink: a range-partitioned sort."""
    return df.orderBy(*spec.forecast_key)


def score(df: DataFrame, model: Transformer) -> DataFrame:
    """Raw predictions. The model carries its own feature preparation; batching is partitioning."""
    return model.transform(df)


def generate_forecast(
    df: DataFrame,
    model: Transformer,
    history: DataFrame | None = None,
    weeks: Sequence[int] = WEEKS,
    spec: SeriesSpec = DEFAULT,
    validate: bool = True,
) -> DataFrame:
    """Check the input, score, post-process, format, check the result."""
    if validate:
        ensure_valid(check_scoring_input(df, weeks, spec))
    scored = score(df, model)
    out = format_forecast(postprocess(scored, history, spec=spec), weeks, spec=spec)
    if validate:
        ensure_valid(check_forecast(out, weeks, spec))
    return out
