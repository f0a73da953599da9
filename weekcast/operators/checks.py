"""Data-quality checks. Each returns rows (check, level, column, value); level 'ok' means no finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.functions.scalars import col, count_true, date_columns, divide, is_digits, is_missing, parses_as_number
from weekcast.operators.profile import duplicate_count
from weekcast.plans.scale import CALENDAR_ROWS, attach, quantile_row, with_scalars
from weekcast.spec import DEFAULT, SeriesSpec

WEEKS = (1, 2, 3, 4, 5)
Finding = tuple[str, str, str | None, Column]


class DataQualityError(ValueError):
    """Raised by ``ensure_valid`` when a report holds errors."""


def report(row: DataFrame, findings: Sequence[Finding]) -> DataFrame:
    """Rows from a one-row aggregate. 'error'/'warning' findings with value 0 are reported as ok."""
    structs = []
    for check, level, column, value in findings:
        number = value.cast("double")
        shown = F.lit(level) if level == "info" else F.when(number > 0, level).otherwise("ok")
        structs.append(
            F.struct(
                F.lit(check).alias("check"),
                shown.alias("level"),
                F.lit(column).cast("string").alias("column"),
                number.alias("value"),
            )
        )
    return row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def checks(df: DataFrame, findings: Sequence[Finding], extra: Sequence[DataFrame] = ()) -> DataFrame:
    """Evaluate aggregate expressions in one pass and report them."""
    row = df.agg(*[value.cast("double").alias(f"_v{i}") for i, (*_, value) in enumerate(findings)])
    named = [(c, lvl, k, F.col(f"_v{i}")) for i, (c, lvl, k, _) in enumerate(findings)]
    out = report(row, named)
    for frame in extra:
        out = out.unionByName(frame)
    return out


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[Finding]:
    return [("missing_column", "error", c, F.lit(float(c not in df.columns))) for c in required]


def nulls(df: DataFrame, columns: Sequence[str], level: str = "warning") -> list[Finding]:
    return [("nulls", level, c, count_true(is_missing(df, c))) for c in columns if c in df.columns]


def duplicates(df: DataFrame, level: str, keys: Sequence[str] | None = None, name: str = "duplicate_rows"):
    label = None if keys is None else ",".join(keys)
    return report(duplicate_count(df, keys), [(name, level, label, F.col("duplicates"))])


def ensure_valid(findings: DataFrame) -> None:
    """Raise if the report holds an error; reads only the error rows of a report-sized table."""
    errors = findings.where(F.col("level") == "error").collect()
    if errors:
        raise DataQualityError("; ".join(f"{r['check']}({r['column']})={r['value']:g}" for r in errors))


def check_transactions(df: DataFrame, spec: SeriesSpec = DEFAULT, year: int | None = 2022) -> DataFrame:
    required = [spec.date, *spec.series, spec.target]
    found = [("rows", "info", None, F.count(F.lit(1))), *missing_columns(df, required)]
    if spec.target in df.columns:
        numeric = isinstance(df.schema[spec.target].dataType, T.NumericType)
        found.append(("not_numeric", "warning", spec.target, F.lit(float(not numeric))))
        found.append(("negative", "warning", spec.target, count_true(col(spec.target).try_cast("double") < 0)))
    found += nulls(df, required)
    if spec.date in df.columns and year is not None:
        day = col(spec.date)
        if isinstance(df.schema[spec.date].dataType, T.StringType):
            day = F.try_to_timestamp(day)
        found.append(("outside_year", "warning", spec.date, count_true(F.year(day) != year)))
    return checks(df, found, [duplicates(df, "warning")])


def _check_master(df: DataFrame, key: str) -> DataFrame:
    found = [("rows", "info", None, F.count(F.lit(1))), *missing_columns(df, [key]), *nulls(df, [key])]
    extra = [duplicates(df.select(key), "error", [key], "duplicate_key")] if key in df.columns else []
    return checks(df, found, extra)


def check_products(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return _check_master(df, spec.product)


def check_stores(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return _check_master(df, spec.store)


def check_generic(df: DataFrame, kind: str = "generic", spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Dispatch by kind of table; otherwise only row, column and null counts."""
    known = {"transactions": check_transactions, "products": check_products, "stores": check_stores}
    if kind in known:
        return known[kind](df, spec)
    found: list[Finding] = [
        ("rows", "info", None, F.count(F.lit(1))),
        ("columns", "info", None, F.lit(len(df.columns))),
    ]
    found += [("nulls", "info", c, count_true(is_missing(df, c))) for c in df.columns]
    return checks(df, found)


def check_panel(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    required = [*spec.series, spec.target]
    rows = F.count(F.lit(1))
    found = [
        ("rows", "info", None, rows),
        ("columns", "info", None, F.lit(len(df.columns))),
        *missing_columns(df, required),
        ("empty", "error", None, (rows == 0).cast("int")),
        *nulls(df, required),
    ]
    if spec.target in df.columns:
        q = col(spec.target)
        found += [
            ("negative", "warning", spec.target, count_true(q < 0)),
            ("zero", "warning", spec.target, count_true(q == 0)),
            ("mean", "info", spec.target, F.avg(q)),
            ("total", "info", spec.target, F.sum(q)),
        ]
    for name in date_columns(df):
        day = F.unix_date(col(name).cast("date"))
        found += [("first_day", "info", name, F.min(day)), ("last_day", "info", name, F.max(day))]
    return checks(df, found, [duplicates(df, "warning")])


def week_coverage(df: DataFrame, expected: Sequence[int], week: str = "week") -> DataFrame:
    """(week, status): expected weeks that are absent and present weeks that are not expected.

    Only distinct week numbers are compared, at most 53 rows.
    """
    have = df.select(F.col(week).cast("int").alias("week")).where(F.col(week).isNotNull()).distinct()
    want = df.sparkSession.createDataFrame([(int(w),) for w in expected], "week int")
    missing = attach(want, have, ["week"], "left_anti", rows=CALENDAR_ROWS).withColumn("status", F.lit("missing"))
    extra = attach(have, want, ["week"], "left_anti", rows=len(expected)).withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def _coverage(df: DataFrame, expected: Sequence[int], week: str, extra_level: str) -> DataFrame:
    row = week_coverage(df, expected, week).agg(
        count_true(F.col("status") == "missing").alias("_missing"),
        count_true(F.col("status") == "extra").alias("_extra"),
    )
    return report(
        row,
        [
            ("missing_weeks", "warning", week, F.col("_missing")),
            ("extra_weeks", extra_level, week, F.col("_extra")),
        ],
    )


def check_forecast(df: DataFrame, weeks: Sequence[int] = WEEKS, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Empty, missing columns, nulls, negatives, duplicate keys are errors; week gaps are warnings."""
    required = [*spec.forecast_key, spec.target]
    found = [
        ("rows", "info", None, F.count(F.lit(1))),
        *missing_columns(df, required),
        ("empty", "error", None, (F.count(F.lit(1)) == 0).cast("int")),
        *nulls(df, df.columns, "error"),
    ]
    if spec.target in df.columns:
        found.append(("negative", "error", spec.target, count_true(col(spec.target) < 0)))
    extra = []
    if all(c in df.columns for c in spec.forecast_key):
        extra = [duplicates(df, "error", spec.forecast_key, "duplicate_key"), _coverage(df, weeks, spec.week, "warning")]
    return checks(df, found, extra)


def check_forecast_format(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Counts only, without week coverage."""
    required = [*spec.forecast_key, spec.target]
    numeric = spec.target in df.columns and isinstance(df.schema[spec.target].dataType, T.NumericType)
    found = [
        ("rows", "info", None, F.count(F.lit(1))),
        ("columns", "info", None, F.lit(len(df.columns))),
        *missing_columns(df, required),
        ("not_numeric", "error", spec.target, F.lit(float(not numeric))),
        *nulls(df, [spec.target], "error"),
    ]
    if numeric:
        found.append(("negative", "error", spec.target, count_true(col(spec.target) < 0)))
    return checks(df, found, [duplicates(df, "error", spec.forecast_key, "duplicate_key")])


def check_business_rules(df: DataFrame, target: str = "quantity") -> DataFrame:
    """Values above twice P99, and a zero share above one half."""
    wide = with_scalars(df.select(target), quantile_row(df, [target], [0.99], "_{name}", ["p99"]))
    q, rows = F.col(target), F.count(F.lit(1))
    zero_pct = divide(count_true(q == 0) * 100.0, rows)
    return checks(
        wide,
        [
            ("very_high", "warning", target, count_true(q > 2 * F.col("_p99"))),
            ("mostly_zero", "warning", target, (zero_pct > 50).cast("int")),
            ("zero_pct", "info", target, zero_pct),
            ("mean", "info", target, F.avg(q)),
            ("std", "info", target, F.stddev_samp(q)),
        ],
    )


def check_submission(df: DataFrame, weeks: Sequence[int] = WEEKS, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Columns, numeric identifiers, weeks, negatives, nulls and basic figures."""
    q = col(spec.target)
    found = [
        ("rows", "info", None, F.count(F.lit(1))),
        *missing_columns(df, [*spec.forecast_key, spec.target]),
        ("week_not_integer", "warning", spec.week, count_true(~is_digits(col(spec.week)))),
        *[("id_not_numeric", "warning", c, count_true(~parses_as_number(col(c)))) for c in spec.series],
        ("negative", "error", spec.target, count_true(q < 0)),
        *nulls(df, df.columns),
        ("total", "info", spec.target, F.sum(q)),
        ("mean", "info", spec.target, F.avg(q)),
        ("min", "info", spec.target, F.min(q)),
        ("max", "info", spec.target, F.max(q)),
    ]
    entities = [
        report(
            df.groupBy(c).agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("_n")),
            [("distinct", "info", c, F.col("_n"))],
        )
        for c in spec.series
    ]
    return checks(df, found, [*entities, _coverage(df, weeks, spec.week, "warning")])


def check_scoring_input(df: DataFrame, weeks: Sequence[int] = WEEKS, spec: SeriesSpec = DEFAULT) -> DataFrame:
    found = [
        ("empty", "error", None, (F.count(F.lit(1)) == 0).cast("int")),
        *missing_columns(df, spec.forecast_key),
    ]
    extra = [_coverage(df, weeks, spec.week, "info")] if spec.week in df.columns else []
    return checks(df, found, extra)


def check_extremes(df: DataFrame, target: str = "quantity") -> DataFrame:
    """Negatives, nulls and values above three times P99, with shares."""
    wide = with_scalars(df.select(target), quantile_row(df, [target], [0.99], "_{name}", ["p99"]))
    q, rows = F.col(target), F.count(F.lit(1))
    tests = {
        "negative": count_true(q < 0),
        "nulls": count_true(is_missing(df, target)),
        "extreme": count_true(q > 3 * F.col("_p99")),
    }
    found: list[Finding] = [(n, "warning", target, v) for n, v in tests.items()]
    found += [(f"{n}_pct", "info", target, divide(v * 100.0, rows)) for n, v in tests.items()]
    return checks(wide, found)
