"""Daily transactions to the weekly (store, product) panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.functions.calendar import week_label
from weekcast.operators.clean import require
from weekcast.spec import DEFAULT, SeriesSpec


def weekly_sales(df: DataFrame, spec: SeriesSpec = DEFAULT, iso_year: bool = False) -> DataFrame:
    """Sum of quantity and of each money column, first sale date, per series and ISO week.

    The year is the calendar year by default, so the first and last days of a year can share a
    week number; ``iso_year=True`` uses the ISO year instead. Hot series are combined map-side.
    """
    require(df, [*spec.series, spec.date, spec.target])
    day = F.col(spec.date)
    year = F.extract(F.lit("YEAROFWEEK"), day) if iso_year else F.year(day)
    money = [c for c in spec.money if c in df.columns]
    return (
        df.groupBy(*spec.series, year.cast("int").alias(spec.year), F.weekofyear(day).alias(spec.week))
        .agg(
            F.sum(spec.target).alias(spec.target),
            F.min(F.to_date(day)).alias(spec.week_date),
            *[F.sum(c).alias(c) for c in money],
        )
        .withColumn("week_label", week_label(F.col(spec.year), F.col(spec.week)))
    )


def sort_panel(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Cluster by series and sort inside each partition, the order the window operators need."""
    return df.repartition(*[F.col(c) for c in spec.series]).sortWithinPartitions(*spec.panel_key)


def keep_first_duplicate(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """First row (by week date, then content) per (week, store, product).

    Expressed as a ``min_by`` aggregate, so a large group of copies collapses on the map side.
    """
    rest = [c for c in df.columns if c not in spec.forecast_key]
    order = F.struct(F.col(spec.week_date), *[F.col(c) for c in rest if c != spec.week_date])
    row = F.struct(*[F.col(c) for c in rest])
    return (
        df.groupBy(*spec.forecast_key)
        .agg(F.min_by(row, order).alias("_row"))
        .select(*spec.forecast_key, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )
