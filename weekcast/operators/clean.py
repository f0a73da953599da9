"""Cleaning and column-level operators: each takes and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.functions.scalars import col, numeric_columns, round_half_even
from weekcast.plans.scale import CALENDAR_ROWS, attach, materialize, quantile_row, with_scalars
from weekcast.spec import DEFAULT, SOURCE_NAMES, SeriesSpec


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def standardize_columns(df: DataFrame, names: Mapping[str, str] = SOURCE_NAMES) -> DataFrame:
    """Rename source columns to engine names; a name already present is left alone."""
    present = set(df.columns)
    renames = {old: new for old, new in names.items() if old in present and new not in present}
    return df.withColumnsRenamed(renames)


def standardize_key(df: DataFrame, key: str, candidates: Sequence[str]) -> DataFrame:
    """Give a dimension its key name, found among the candidate names, as a string column."""
    for name in (key, *candidates):
        if name in df.columns:
            return df.withColumnRenamed(name, key).withColumn(key, F.col(key).cast("string"))
    raise ValueError(f"no key column for {key!r} among {df.columns}")


def cast_types(df: DataFrame, spec: SeriesSpec = DEFAULT, keep_null_ids: bool = False) -> DataFrame:
    """Dates parsed, numbers parsed with bad text as NULL, ids as strings.

    A null id stays NULL (and is dropped later); ``keep_null_ids`` turns it into the text 'None'.
    """
    casts = {}
    if spec.date in df.columns and isinstance(df.schema[spec.date].dataType, T.StringType):
        casts[spec.date] = F.try_to_timestamp(F.col(spec.date))
    for name in (spec.target, *spec.money):
        if name in df.columns:
            value = F.col(name).try_cast("double")
            casts[name] = F.when(~F.isnan(value), value)
    for name in spec.series:
        if name in df.columns:
            text = F.col(name).cast("string")
            casts[name] = F.coalesce(text, F.lit("None")) if keep_null_ids else text
    return df.withColumns(casts)


def drop_missing_critical(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return df.na.drop(subset=[spec.target, spec.date, *spec.series])


def impute_median_financials(
    df: DataFrame, spec: SeriesSpec = DEFAULT, columns: Sequence[str] | None = None
) -> DataFrame:
    """Null money values become the column's exact median."""
    columns = [c for c in (columns or spec.money) if c in df.columns]
    if not columns:
        return df
    medians = quantile_row(df, columns, [0.5], "_median_{column}")
    filled = {c: F.coalesce(F.col(c), F.col(f"_median_{c}")) for c in columns}
    return with_scalars(df, medians).withColumns(filled).select(*df.columns)


def in_year(df: DataFrame, date: str, year: int) -> DataFrame:
    """Rows of one year as a half-open date range, which prunes parquet row groups."""
    # Bounds of the column's own type: a cast of the column would hide it from the scan.
    kind = df.schema[date].dataType
    low, high = (F.lit(f"{y}-01-01").cast(kind) for y in (year, year + 1))
    return df.where((F.col(date) >= low) & (F.col(date) < high))


def filter_valid_rows(df: DataFrame, spec: SeriesSpec = DEFAULT, year: int | None = None) -> DataFrame:
    """Positive quantities, and only one year when ``year`` is given."""
    kept = df.where(F.col(spec.target) > 0)
    return kept if year is None else in_year(kept, spec.date, year)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row dedupe; copies are merged on the map side before the shuffle."""
    return df.dropDuplicates()


def _cap(df: DataFrame, target: str, bounds: DataFrame) -> DataFrame:
    clipped = F.least(F.greatest(F.col(target), F.col("_low")), F.col("_high"))
    value = F.when(F.col("_any"), clipped).otherwise(F.col(target))
    return with_scalars(df, bounds).withColumn(target, value).select(*df.columns)


def iqr_bounds(df: DataFrame, target: str) -> DataFrame:
    """One row: Q1 - 1.5 IQR, Q3 + 1.5 IQR, and whether any value lies outside."""
    quarts = quantile_row(df, [target], [0.25, 0.75], "_{name}", ["q1", "q3"])
    spread = F.col("_q3") - F.col("_q1")
    raw = quarts.select(
        (F.col("_q1") - 1.5 * spread).alias("_raw_low"), (F.col("_q3") + 1.5 * spread).alias("_high")
    )
    extent = df.agg(F.min(target).alias("_min"), F.max(target).alias("_max"))
    outside = (F.col("_min") < F.col("_raw_low")) | (F.col("_max") > F.col("_high"))
    return with_scalars(raw, extent).select(
        F.greatest(F.lit(0.0), F.col("_raw_low")).alias("_low"), "_high", outside.alias("_any")
    )


def cap_outliers_iqr(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Clip the target to the IQR bounds (never below zero) when any value lies outside."""
    return _cap(df, spec.target, iqr_bounds(df, spec.target))


def cap_outliers_percentile(df: DataFrame, spec: SeriesSpec = DEFAULT, low=0.01, high=0.99) -> DataFrame:
    bounds = quantile_row(df, [spec.target], [low, high], "_{name}", ["low", "high"])
    return _cap(df, spec.target, bounds.withColumn("_any", F.lit(True)))


def clean_transactions(
    df: DataFrame,
    spec: SeriesSpec = DEFAULT,
    year: int | None = 2022,
    outliers: str | None = "iqr",
    keep_null_ids: bool = False,
) -> DataFrame:
    """Raw transactions to clean ones: names, types, nulls, validity, duplicates, outliers.

    The deduplicated rows are written once before the outlier bounds are taken: the bounds need two
    passes over one column, which must not repeat the parsing and the dedupe shuffle.
    """
    df = standardize_columns(df)
    require(df, [spec.store, spec.product, spec.date, spec.target])
    df = drop_missing_critical(cast_types(df, spec, keep_null_ids), spec)
    df = impute_median_financials(df, spec)
    df = drop_duplicate_rows(filter_valid_rows(df, spec, year))
    if outliers is None:
        return df
    cap = {"iqr": cap_outliers_iqr, "percentile": cap_outliers_percentile}[outliers]
    return cap(materialize(df, "clean"), spec)


def fill_unmatched(
    df: DataFrame, columns: Sequence[str], unknown: str = "Unknown", medians: DataFrame | None = None
) -> DataFrame:
    """Null text attributes become 'Unknown', null numbers the median over the rows.

    ``medians`` is a one-row frame of ``_median_<column>``; without it they are taken from ``df``.
    """
    present = [c for c in columns if c in df.columns]
    numeric = [c for c in present if c in numeric_columns(df)]
    text = [c for c in present if c not in numeric]
    out = df.na.fill(unknown, text) if text else df
    if not numeric:
        return out
    if medians is None:
        medians = quantile_row(df, numeric, [0.5], "_median_{column}")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}")) for c in numeric}
    return with_scalars(out, medians).withColumns(filled).select(*df.columns)


def select_numeric_features(df: DataFrame, spec: SeriesSpec = DEFAULT, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns other than the identifiers, the target and the dates."""
    excluded = {*spec.series, spec.target, spec.date, spec.week_date}
    return df.select(*keep, *numeric_columns(df, exclude=[*excluded, *keep]))


def zero_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL, NaN and infinities of numeric columns become 0."""
    columns = columns or numeric_columns(df)
    fixed = {}
    for name in columns:
        value = col(name)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            broken = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
            fixed[name] = F.when(broken, F.lit(0.0)).otherwise(value)
        else:
            fixed[name] = F.coalesce(value, F.lit(0))
    return df.withColumns(fixed)


def align_to_model(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's features in order; absent ones and nulls as 0."""
    have = set(df.columns)
    aligned = [
        (F.coalesce(col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f) for f in features
    ]
    return df.select(*keep, *aligned)


def filter_horizon(df: DataFrame, weeks: Sequence[int], spec: SeriesSpec = DEFAULT) -> DataFrame:
    return df.where(F.col(spec.week).isin(list(weeks)))


def clip_nonnegative(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.greatest(F.col(column), F.lit(0).cast(df.schema[column].dataType)))


def round_to_units(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, round_half_even(F.col(column)))


# Upper edges (closed) and labels of the sales bands.
BAND_EDGES = (1, 5, 10, 50, 100)
BAND_LABELS = ("0-1", "1-5", "5-10", "10-50", "50-100", "100+")


def sales_band(df: DataFrame, column: str, name: str = "sales_band") -> DataFrame:
    """Right-closed bands (0,1], (1,5] ... (100,inf); NULL outside."""
    value = F.col(column)
    band = F.when(value <= 0, F.lit(None).cast("string"))
    for edge, label in zip(BAND_EDGES, BAND_LABELS):
        band = band.when(value <= edge, label)
    return df.withColumn(name, band.when(value > BAND_EDGES[-1], BAND_LABELS[-1]))


def renumber_weeks(df: DataFrame, week: str = "week", last: int = 5) -> DataFrame:
    """If any week lies outside 1..last, map the sorted distinct weeks to 1..last.

    The rank is taken over the distinct week numbers (at most 53), not over the rows.
    """
    weeks = df.select(week).where(F.col(week).isNotNull()).distinct()
    everything = Window.partitionBy(F.lit(0))
    ranked = weeks.select(
        week,
        F.least(F.dense_rank().over(everything.orderBy(week)), F.lit(last)).alias("_rank"),
        ((F.min(week).over(everything) < 1) | (F.max(week).over(everything) > last)).alias("_outside"),
    )
    mapped = attach(df, ranked, [week], rows=CALENDAR_ROWS)
    new = F.when(F.col("_outside"), F.col("_rank")).otherwise(F.col(week)).cast("int")
    return mapped.withColumn(week, new).select(*df.columns)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def sample_rows(df: DataFrame, fraction: float, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Seeded sample. With ``keys`` the choice depends on the key only, so it is repeatable
    whatever the partitioning."""
    if keys is None:
        return df.sample(fraction=fraction, seed=seed)
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.where(draw < float(fraction))


def interaction_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": col(a) * col(b) for a, b in pairs})
