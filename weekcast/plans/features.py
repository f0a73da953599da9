"""Feature-set builders: compositions of the feature operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.functions.calendar import (
    add,
    black_friday_window,
    calendar_basic,
    calendar_flags,
    cyclic_encoding,
    holiday_flags,
    holidays_around,
    retail_periods,
    season_flags,
    trend_features,
)
from weekcast.operators.entity import past_features, product_features, store_features
from weekcast.operators.joins import combine_feature_sets
from weekcast.operators.series import lags, rolling_stats, series_features
from weekcast.plans.scale import materialize
from weekcast.spec import DEFAULT, SeriesSpec


def temporal_features(
    df: DataFrame, spec: SeriesSpec = DEFAULT, holidays: DataFrame | None = None, date: str | None = None
) -> DataFrame:
    """Calendar, seasonality, holiday, retail-period and trend columns: one projection, one side join."""
    date = date or spec.week_date
    day = F.col(date)
    # The panel's own calendar year is kept under its name.
    basic = {n: e for n, e in calendar_basic(day).items() if n not in df.columns}
    out = add(
        df,
        basic,
        calendar_flags(day),
        cyclic_encoding(day),
        season_flags(day),
        {"is_black_friday": black_friday_window(day)},
        retail_periods(day),
    )
    out = holiday_flags(out, date, holidays if holidays is not None else holidays_around(df, date))
    return trend_features(out, date)


def all_features(
    panel: DataFrame,
    spec: SeriesSpec = DEFAULT,
    holidays: DataFrame | None = None,
    stores: DataFrame | None = None,
    leak_safe: bool = False,
    cut: bool = False,
    values: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Temporal, product, store and series features in one plan.

    ``cut`` writes the entity-level result once before the series windows. With ``leak_safe`` a row's features are
    taken from earlier weeks only: products and stores have the statistics of their past (``past_features``)
    instead of those of the whole panel, and no ranks, tiers or frequencies over all weeks.
    """
    out = temporal_features(panel, spec, holidays)
    if leak_safe:
        out = past_features(out, spec, source=panel)
    else:
        out = product_features(out, spec, panel, values)
        out = store_features(out, spec, stores, panel, values)
    if cut:
        out = materialize(out, "features", spec.series)
    return series_features(out, spec, leak_safe=leak_safe)


def all_features_parallel(
    panel: DataFrame,
    spec: SeriesSpec = DEFAULT,
    holidays: DataFrame | None = None,
    stores: DataFrame | None = None,
    values: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The same columns with every set built from the panel on its own and joined on the panel key.

    The temporal set depends on the date only: it is built per date and joined last, so no exchange holds it.
    """
    dates = panel.select(spec.week_date).distinct()
    dated = temporal_features(dates, spec, holidays if holidays is not None else holidays_around(panel, spec.week_date))
    new = [c for c in dated.columns if c not in panel.columns]
    rest = combine_feature_sets(
        panel,
        product_features(panel, spec, values=values),
        store_features(panel, spec, stores, values=values),
        series_features(panel, spec),
        spec=spec,
    )
    rest = rest.drop(*new)
    dated = materialize(dated.select(F.col(spec.week_date).alias("_date"), *new), "dates")  # a row per day of the calendar at most
    out = rest.join(F.broadcast(dated), F.col(spec.week_date).eqNullSafe(F.col("_date")), "left")
    return out.select(*panel.columns, *new, *[c for c in rest.columns if c not in panel.columns])


def simplified_features(
    panel: DataFrame, spec: SeriesSpec = DEFAULT, periods: Sequence[int] = (1, 2, 4), window: int = 4
) -> DataFrame:
    """The subset the main flow uses: few calendar columns, holiday flags at 0, lags, one window."""
    day = F.col(spec.week_date)
    calendar = {n: e for n, e in calendar_basic(day).items() if n in ("iso_week", "month", "quarter")}
    waves = {n: e for n, e in cyclic_encoding(day).items() if n.split("_")[0] in ("week", "month")}
    zeros = {n: F.lit(0) for n in ("is_holiday", "is_pre_holiday", "is_post_holiday")}
    out = add(panel, calendar, waves, zeros)
    q = spec.target
    return rolling_stats(lags(out, spec, periods), spec, [window]).drop(
        *[f"{q}_rolling_{s}_{window}" for s in ("min", "max", "median")]
    )


