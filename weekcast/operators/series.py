"""Features along one series: lags, rolling statistics, growth.

All windows are partitioned by (store, product) and ordered by week, and count observed rows. A
panel has at most one row per series and week, so a window partition is bounded by the number of
weeks; one exchange and one sort serve every function here when they are chained.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weekcast.functions.scalars import EPSILON, divide
from weekcast.operators.clean import require
from weekcast.spec import DEFAULT, SeriesSpec

LAGS = (1, 2, 4, 8)
WINDOWS = (4, 8, 12)


def series_window(spec: SeriesSpec = DEFAULT) -> WindowSpec:
    return Window.partitionBy(*spec.series).orderBy(*spec.order)


def _check(df: DataFrame, spec: SeriesSpec) -> None:
    require(df, [*spec.series, spec.target, *spec.order])


def lag_columns(spec: SeriesSpec, lags: Sequence[int]) -> dict[str, Column]:
    w = series_window(spec)
    return {f"{spec.target}_lag_{n}": F.lag(spec.target, n).over(w) for n in lags}


def lags(df: DataFrame, spec: SeriesSpec = DEFAULT, periods: Sequence[int] = LAGS) -> DataFrame:
    _check(df, spec)
    return df.withColumns(lag_columns(spec, periods))


def lag_ratios(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Ratio to lags 1 and 2 (1 without history) and difference to lags 1 and 4 (0 without)."""
    q, name = F.col(spec.target), spec.target
    have = [n for n in (1, 2, 4) if f"{name}_lag_{n}" not in df.columns]
    out = df.withColumns(lag_columns(spec, have)) if have else df
    added = {}
    for n in (1, 2):
        ratio = divide(q, F.col(f"{name}_lag_{n}") + EPSILON)
        added[f"{name}_ratio_lag{n}"] = F.coalesce(ratio, F.lit(1.0))
    for n in (1, 4):
        added[f"{name}_diff_lag{n}"] = F.coalesce(q - F.col(f"{name}_lag_{n}"), F.lit(0.0))
    return out.withColumns(added)


def _frame(w: WindowSpec, size: int, leak_safe: bool) -> WindowSpec:
    return w.rowsBetween(-size, -1) if leak_safe else w.rowsBetween(-(size - 1), 0)


def _median(values: Column) -> Column:
    """Median of an array without nulls; stays inside generated code, unlike a framed percentile."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def rolling_stats(
    df: DataFrame,
    spec: SeriesSpec = DEFAULT,
    windows: Sequence[int] = WINDOWS,
    leak_safe: bool = False,
) -> DataFrame:
    """Mean, std (0 for one row), min, max and median over the last k observed rows.

    The current row is included by default; ``leak_safe`` shifts the frame to the k rows before it.
    The median sorts a short array of lagged values that all window sizes share.
    """
    _check(df, spec)
    w, q, name = series_window(spec), F.col(spec.target), spec.target
    first = 1 if leak_safe else 0
    reach = max(windows) - 1 + first
    steps = {f"_lag{i}": F.lag(q, i).over(w) for i in range(max(first, 1), reach + 1)}
    stats = {}
    for k in windows:
        frame = _frame(w, k, leak_safe)
        stats[f"{name}_rolling_mean_{k}"] = F.avg(q).over(frame)
        stats[f"{name}_rolling_std_{k}"] = F.coalesce(F.stddev_samp(q).over(frame), F.lit(0.0))
        stats[f"{name}_rolling_min_{k}"] = F.min(q).over(frame)
        stats[f"{name}_rolling_max_{k}"] = F.max(q).over(frame)
    wide = df.withColumns({**steps, **stats})
    medians = {}
    for k in windows:
        parts = [q if i == 0 else F.col(f"_lag{i}") for i in range(first, k + first)]
        medians[f"{name}_rolling_median_{k}"] = _median(F.array_compact(F.array(*parts)))
    return wide.withColumns(medians).drop(*steps)


def rolling_full(
    df: DataFrame, spec: SeriesSpec = DEFAULT, windows: Sequence[int] = WINDOWS, leak_safe: bool = False
) -> DataFrame:
    """Mean, std, max and min that stay NULL until the window holds k rows."""
    _check(df, spec)
    w, q, name = series_window(spec), F.col(spec.target), spec.target
    added = {}
    for k in windows:
        frame = _frame(w, k, leak_safe)
        full = F.count(q).over(frame) == k
        for label, fn in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min)):
            added[f"{name}_full_{label}_{k}"] = F.when(full, fn(q).over(frame))
    return df.withColumns(added)


def rolling_cv(df: DataFrame, spec: SeriesSpec = DEFAULT, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Std over mean; needs the columns of ``rolling_stats``."""
    t = spec.target
    return df.withColumns(
        {
            f"{t}_rolling_cv_{k}": F.coalesce(
                divide(F.col(f"{t}_rolling_std_{k}"), F.col(f"{t}_rolling_mean_{k}") + EPSILON), F.lit(0.0)
            )
            for k in windows
        }
    )


def rolling_trend(df: DataFrame, spec: SeriesSpec = DEFAULT, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """First difference of the rolling mean; needs the columns of ``rolling_stats``."""
    w, t = series_window(spec), spec.target
    added = {}
    for k in windows:
        mean = F.col(f"{t}_rolling_mean_{k}")
        added[f"{t}_rolling_trend_{k}"] = F.coalesce(mean - F.lag(mean).over(w), F.lit(0.0))
    return df.withColumns(added)


def pct_change(df: DataFrame, spec: SeriesSpec = DEFAULT, periods: Sequence[int] = (1, 4, 12)) -> DataFrame:
    """Growth against n rows back; 0 without history or over a zero base."""
    _check(df, spec)
    w, q = series_window(spec), F.col(spec.target)
    return df.withColumns(
        {
            f"{spec.target}_pct_change_{n}w": F.coalesce(divide(q, F.lag(q, n).over(w)) - 1, F.lit(0.0))
            for n in periods
        }
    )


def cumulative_growth(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    _check(df, spec)
    w, q = series_window(spec), F.col(spec.target)
    start = F.first(q).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(f"{spec.target}_cumulative_growth", F.coalesce(divide(q, start) - 1, F.lit(0.0)))


def growth_acceleration(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """First difference of the one-week growth; needs ``pct_change``."""
    growth = F.col(f"{spec.target}_pct_change_1w")
    change = growth - F.lag(growth).over(series_window(spec))
    return df.withColumn(f"{spec.target}_growth_acceleration", F.coalesce(change, F.lit(0.0)))


def growth_volatility(df: DataFrame, spec: SeriesSpec = DEFAULT, size: int = 8) -> DataFrame:
    """Std of the one-week growth over the last rows; needs ``pct_change``."""
    growth = F.col(f"{spec.target}_pct_change_1w")
    std = F.stddev_samp(growth).over(series_window(spec).rowsBetween(-(size - 1), 0))
    return df.withColumn(f"{spec.target}_growth_volatility", F.coalesce(std, F.lit(0.0)))


def growth_features(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    df = cumulative_growth(pct_change(df, spec), spec)
    return growth_volatility(growth_acceleration(df, spec), spec)


def row_trend(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Running row number inside each series."""
    return df.withColumn("row_trend", F.row_number().over(series_window(spec)))


def moving_average_total(
    df: DataFrame, spec: SeriesSpec = DEFAULT, windows: Sequence[int] = (7, 30)
) -> DataFrame:
    """Daily totals with moving averages, NULL until the window is full.

    The ordering runs over one row per calendar day, after the totals have been aggregated.
    """
    daily = df.groupBy(F.to_date(spec.date).alias(spec.date)).agg(F.sum(spec.target).alias("total"))
    days = Window.partitionBy(F.lit(0)).orderBy(spec.date)
    added = {}
    for k in windows:
        frame = days.rowsBetween(-(k - 1), 0)
        added[f"moving_average_{k}"] = F.when(F.count("total").over(frame) == k, F.avg("total").over(frame))
    return daily.withColumns(added)


def ewm_smooth(df: DataFrame, column: str, alpha: float, spec: SeriesSpec = DEFAULT, name: str | None = None):
    """Exponentially weighted mean with normalised weights, per series in week order.

    The history of a row is at most the weeks of its series.
    """
    past = F.collect_list(F.col(column).cast("double")).over(
        series_window(spec).rowsBetween(Window.unboundedPreceding, 0)
    )
    keep = 1.0 - alpha
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"))
    smoothed = F.aggregate(
        past,
        start,
        lambda acc, x: F.struct(
            (acc["top"] * keep + x).alias("top"), (acc["bottom"] * keep + 1.0).alias("bottom")
        ),
        lambda acc: acc["top"] / acc["bottom"],
    )
    return df.withColumn(name or column, smoothed)


def series_features(
    df: DataFrame,
    spec: SeriesSpec = DEFAULT,
    periods: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    leak_safe: bool = False,
) -> DataFrame:
    """Lags, ratios, rolling statistics and growth in one chain over one exchange.

    With ``leak_safe`` only columns known before the row's week are made: lags and shifted rolling
    statistics.
    """
    out = lags(df, spec, periods)
    if leak_safe:
        return rolling_cv(rolling_stats(out, spec, windows, leak_safe=True), spec, windows)
    out = lag_ratios(out, spec)
    out = rolling_cv(rolling_stats(out, spec, windows), spec, windows)
    return growth_features(rolling_trend(out, spec, windows), spec)
