"""Error metrics, comparisons, baselines and residual analysis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.scalars import absolute_error, correlation, count_true, divide, percent_error, residual
from weekcast.operators.clean import sales_band
from weekcast.operators.select import pair_correlations
from weekcast.operators.normality import normality
from weekcast.operators.series import series_window
from weekcast.plans.scale import attach, quantile_row, quantiles, with_scalars
from weekcast.spec import DEFAULT, SeriesSpec

WMAPE_THRESHOLD = 25.0


def error_columns(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Absolute error, percent error (NULL over zero) and residual per row."""
    a, p = F.col(actual), F.col(predicted)
    return df.withColumns(
        {"abs_error": absolute_error(a, p), "pct_error": percent_error(a, p), "residual": residual(a, p)}
    )


def metric_aggregates(actual: Column, predicted: Column) -> dict[str, Column]:
    """WMAPE, MAE, RMSE and MAPE in one pass; percentages, zeros excluded from MAPE."""
    error = F.abs(actual - predicted)
    return {
        "wmape": divide(F.sum(error) * 100.0, F.sum(F.abs(actual))),
        "mae": F.avg(error),
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.avg(divide(error, F.abs(actual))) * 100.0,
    }


def metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    expressions = metric_aggregates(F.col(actual), F.col(predicted))
    return df.groupBy(*by).agg(*[e.alias(n) for n, e in expressions.items()])


def quick_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """The same as fractions, 0 where undefined."""
    table = metrics(df, actual, predicted, by)
    return table.withColumns(
        {
            "wmape": F.coalesce(F.col("wmape") / 100, F.lit(0.0)),
            "mape": F.coalesce(F.col("mape") / 100, F.lit(0.0)),
        }
    )


def _segment(df: DataFrame, segment: str, actual: str, predicted: str) -> DataFrame:
    wide = error_columns(df, actual, predicted)
    return wide.groupBy(segment).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(actual).alias("mean_sales"),
        F.avg("abs_error").alias("mae"),
        F.avg("pct_error").alias("mape"),
    )


def metrics_by_segment(df: DataFrame, segment: str, actual: str, predicted: str) -> DataFrame:
    return _segment(df, segment, actual, predicted)


def wmape_by_week(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ("year", "week")) -> DataFrame:
    """Per period: sum of errors over sum of actuals, and error of the sums."""
    a, p = F.col(actual), F.col(predicted)
    return df.groupBy(*by).agg(
        F.sum(a).alias("actual"),
        F.sum(p).alias("predicted"),
        divide(F.sum(F.abs(a - p)) * 100.0, F.sum(a)).alias("wmape"),
        divide(F.abs(F.sum(a) - F.sum(p)) * 100.0, F.sum(a)).alias("wmape_total"),
    )


def metrics_by_band(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return _segment(sales_band(df, actual), "sales_band", actual, predicted).drop("mean_sales")


def hardest_products(
    df: DataFrame, actual: str, predicted: str, spec: SeriesSpec = DEFAULT, at_least: int = 10, k: int = 10
) -> DataFrame:
    wide = error_columns(df, actual, predicted)
    table = wide.groupBy(spec.product).agg(F.avg("pct_error").alias("mape"), F.count("pct_error").alias("rows"))
    return table.where(F.col("rows") >= at_least).orderBy(F.desc("mape"), F.asc(spec.product)).limit(k)


def volume_extremes(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean percent error above P90 and below P10 of the actuals (one row)."""
    cuts = quantile_row(df, [actual], [0.1, 0.9], "_{name}", ["p10", "p90"])
    wide = with_scalars(error_columns(df, actual, predicted), cuts)
    a = F.col(actual)
    return wide.agg(
        F.avg(F.when(a > F.col("_p90"), F.col("pct_error"))).alias("mape_high_volume"),
        F.avg(F.when(a < F.col("_p10"), F.col("pct_error"))).alias("mape_low_volume"),
    )


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, std, min, quartiles, max."""
    x = F.col(column).cast("double")
    base = df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    return with_scalars(base, quantiles(df, column, [0.25, 0.5, 0.75], names=["q25", "q50", "q75"]))


def history_vs_forecast(history: DataFrame, forecast: DataFrame, column: str = "quantity") -> DataFrame:
    """(statistic, history, forecast) side by side."""
    order = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    pair = with_scalars(
        describe_column(history, column).select(*[F.col(n).alias(f"h_{n}") for n in order]),
        describe_column(forecast, column).select(*[F.col(n).alias(f"f_{n}") for n in order]),
    )
    structs = [
        F.struct(
            F.lit(n).alias("statistic"),
            F.col(f"h_{n}").cast("double").alias("history"),
            F.col(f"f_{n}").cast("double").alias("forecast"),
        )
        for n in order
    ]
    return pair.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def forecast_summary(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Totals, distribution and coverage of a forecast (one row)."""
    q = F.col(spec.target)
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(spec.week).alias("first_week"),
        F.max(spec.week).alias("last_week"),
        F.sum(q).alias("total"),
        F.avg(q).alias("mean"),
        F.min(q).alias("min"),
        F.max(q).alias("max"),
        F.stddev_samp(q).alias("std"),
        count_true(q == 0).alias("zeros"),
        count_true(q <= 10).alias("low"),
        count_true(q >= 100).alias("high"),
    )
    out = with_scalars(base, quantiles(df, spec.target, [0.5], names=["median"]))
    for key, name in ((spec.store, "stores"), (spec.product, "products")):
        distinct = df.groupBy(key).agg(F.lit(1).alias("_1")).agg(F.count(F.lit(1)).alias(name))
        out = with_scalars(out, distinct)
    return out


def forecast_by_week(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Per week: rows, total, mean and std to two decimals, distinct stores and products."""
    q = F.col(spec.target)
    return df.groupBy(spec.week).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(q), 2).alias("total"),
        F.round(F.avg(q), 2).alias("mean"),
        F.round(F.stddev_samp(q), 2).alias("std"),
        F.count_distinct(spec.store).alias("stores"),
        F.count_distinct(spec.product).alias("products"),
    )


def top_n_volume(df: DataFrame, key: str, n: int = 10, target: str = "quantity") -> DataFrame:
    totals = df.groupBy(key).agg(F.sum(target).alias("total"))
    return totals.orderBy(F.desc("total"), F.asc(key)).limit(n)


def worst_errors(df: DataFrame, actual: str, predicted: str, keys: Sequence[str], n: int = 20) -> DataFrame:
    wide = error_columns(df, actual, predicted).where(F.col("abs_error").isNotNull())
    return wide.orderBy(F.desc("abs_error"), *[F.asc(k) for k in keys]).limit(n).select(
        *keys, actual, predicted, "abs_error"
    )


def forecast_totals_diff(forecast: DataFrame, baseline: DataFrame, target: str = "quantity") -> DataFrame:
    row = with_scalars(
        forecast.agg(F.coalesce(F.sum(target), F.lit(0)).cast("double").alias("forecast_total")),
        baseline.agg(F.coalesce(F.sum(target), F.lit(0)).cast("double").alias("baseline_total")),
    )
    diff = F.col("forecast_total") - F.col("baseline_total")
    return row.withColumns(
        {
            "difference": diff,
            "difference_pct": F.coalesce(divide(diff * 100.0, F.col("baseline_total")), F.lit(0.0)),
        }
    )


def prediction_diversity(df: DataFrame, predictions: Sequence[str]) -> DataFrame:
    """Mean, min, max pairwise correlation of prediction columns and 1 - mean (one row)."""
    c = F.col("correlation")
    return pair_correlations(df, predictions).agg(
        F.avg(c).alias("mean_correlation"),
        F.min(c).alias("min_correlation"),
        F.max(c).alias("max_correlation"),
        (1 - F.avg(c)).alias("diversity"),
    )


# -- P9 baselines ------------------------------------------------------------------------------


def baselines(
    history: DataFrame, spec: SeriesSpec = DEFAULT, periods: int = 12, season: int = 52, segment: str | None = None
) -> DataFrame:
    """One row per series with the value each baseline forecasts for its next week.

    Historical mean, last value, mean of the last ``periods`` rows, linear trend over row numbers,
    the value ``season`` rows before the next one, and the mean of the segment. The row number needs
    one window per series; everything else is a grouped aggregate over the same partitioning.
    """
    q = F.col(spec.target).cast("double")
    newest = Window.partitionBy(*spec.series).orderBy(*[F.desc(c) for c in spec.order])
    rows = history.withColumns({"_back": F.row_number().over(newest)})
    table = rows.groupBy(*spec.series).agg(
        F.count(q).alias("weeks"),
        F.avg(q).alias("historical_mean"),
        F.max(F.when(F.col("_back") == 1, q)).alias("last_value"),
        F.avg(F.when(F.col("_back") <= periods, q)).alias("moving_average"),
        F.regr_slope(q, -F.col("_back").cast("double")).alias("trend_slope"),
        F.regr_intercept(q, -F.col("_back").cast("double")).alias("linear_trend"),
        F.max(F.when(F.col("_back") == season, q)).alias("seasonal_naive"),
    )
    table = table.withColumns(
        {
            "linear_trend": F.coalesce("linear_trend", "historical_mean"),
            "seasonal_naive": F.coalesce("seasonal_naive", "last_value"),
        }
    )
    if segment is None:
        return table
    means = history.groupBy(segment).agg(F.avg(q).alias("segment_mean"))
    owner = history.groupBy(*spec.series).agg(F.min(segment).alias(segment))
    return table.join(attach(owner, means, [segment]), spec.series, "left")


def baseline_comparison(
    df: DataFrame, actual: str, model: str, baseline_columns: Sequence[str]
) -> DataFrame:
    """(method, metrics, improvement of the model over it in %, rank by WMAPE)."""
    methods = [model, *baseline_columns]
    structs = [F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("_p")) for m in methods]
    long = df.select(actual, F.explode(F.array(*structs)).alias("_m")).select(actual, "_m.*")
    table = metrics(long.where(F.col("_p").isNotNull()), actual, "_p", ["method"])
    # One row per method from here on.
    everything = Window.partitionBy(F.lit(0))
    own = F.max(F.when(F.col("method") == model, F.col("wmape"))).over(everything)
    return table.withColumns(
        {
            "wmape_improvement": divide((F.col("wmape") - own) * 100.0, F.col("wmape")),
            "wmape_rank": F.rank().over(everything.orderBy("wmape")),
            "mae_rank": F.rank().over(everything.orderBy("mae")),
            "rmse_rank": F.rank().over(everything.orderBy("rmse")),
        }
    )


# -- P11, P12 -----------------------------------------------------------------------------------


def residual_report(
    df: DataFrame, actual: str, predicted: str, spec: SeriesSpec = DEFAULT, segment: str | None = None
) -> DataFrame:
    """One row per segment (or one in all): moments, bias, outliers, lag-1 autocorrelation."""
    by = [segment] if segment else []
    r = F.col("residual")
    wide = error_columns(df, actual, predicted).where(r.isNotNull())
    wide = wide.withColumn("_previous", F.lag("residual").over(series_window(spec)))
    moments = wide.groupBy(*by).agg(
        F.count(r).alias("rows"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("std"),
        count_true(r > 0).alias("under_forecast"),
        count_true(r < 0).alias("over_forecast"),
        correlation(r, F.col("_previous")).alias("autocorrelation"),
        divide(F.sum(r) * 100.0, F.sum(F.abs(F.col(actual)))).alias("bias_pct"),
    )
    quarts = quantiles(wide, "residual", [0.25, 0.75], by, names=["q1", "q3"])
    side = attach(moments, quarts, by) if by else with_scalars(moments, quarts)
    bounds = side.select(*by, "mean", "std", "q1", "q3").withColumnsRenamed(
        {"mean": "_mean", "std": "_std", "q1": "_q1", "q3": "_q3"}
    )
    marked = attach(wide, bounds, by) if by else with_scalars(wide, bounds)
    iqr = F.col("_q3") - F.col("_q1")
    outliers = marked.groupBy(*by).agg(
        count_true(F.abs(r - F.col("_mean")) > 3 * F.col("_std")).alias("z_score_outliers"),
        count_true((r < F.col("_q1") - 1.5 * iqr) | (r > F.col("_q3") + 1.5 * iqr)).alias("iqr_outliers"),
    )
    out = attach(side, outliers, by) if by else with_scalars(side, outliers)
    return out.withColumns(
        {
            "z_score_outlier_pct": divide(F.col("z_score_outliers") * 100.0, F.col("rows")),
            "iqr_outlier_pct": divide(F.col("iqr_outliers") * 100.0, F.col("rows")),
        }
    )


def residual_normality(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Normality of the residuals, by moments and by the Kolmogorov-Smirnov test with fitted mean and deviation."""
    residual = F.col(actual).cast("double") - F.col(predicted).cast("double")
    return normality(df.select(residual.alias("residual")), "residual")


NORMALITY = ["skewness", "kurtosis", "k_squared", "k_p_value", "ks_statistic", "ks_p_value"]


def validation_report(
    df: DataFrame,
    actual: str,
    model: str,
    baseline_columns: Sequence[str],
    spec: SeriesSpec = DEFAULT,
    threshold: float = WMAPE_THRESHOLD,
    with_normality: bool = True,
) -> DataFrame:
    """(section, name, value, verdict): metrics, residuals, rank among baselines, approval."""
    def rows(frame: DataFrame, section: str, names: Sequence[str]) -> DataFrame:
        structs = [
            F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value"))
            for n in names
        ]
        return frame.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")

    parts = [
        rows(metrics(df, actual, model), "metrics", ["wmape", "mae", "rmse", "mape"]),
        rows(
            residual_report(df, actual, model, spec),
            "residuals",
            ["mean", "std", "autocorrelation", "z_score_outlier_pct", "iqr_outlier_pct", "bias_pct"],
        ),
    ]
    compared = baseline_comparison(df, actual, model, baseline_columns)
    parts.append(rows(compared.where(F.col("method") == model), "rank", ["wmape_rank", "mae_rank", "rmse_rank"]))
    parts.append(
        rows(
            compared.where(F.col("method") != model).agg(F.min("wmape_improvement").alias("least_improvement")),
            "baselines",
            ["least_improvement"],
        )
    )
    if with_normality:
        parts.append(rows(residual_normality(df, actual, model), "normality", NORMALITY))
    table = reduce(lambda a, b: a.unionByName(b), parts)
    verdict = F.when(
        F.col("name") == "wmape", F.when(F.col("value") <= threshold, "approved").otherwise("rejected")
    )
    return table.withColumn("verdict", verdict)
