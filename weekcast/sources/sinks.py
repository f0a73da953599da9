"""Writing forecasts, feature tables and reports, and checking what was written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.functions.scalars import count_true
from weekcast.operators.checks import ensure_valid, report
from weekcast.operators.checks import check_forecast
from weekcast.operators.profile import duplicate_count
from weekcast.operators.runs import compare_runs
from weekcast.plans.scale import with_scalars
from weekcast.spec import DEFAULT, SeriesSpec

FORECAST_COLUMNS = ("week", "store", "product", "quantity")
FORECAST_SCHEMA = "week int, store string, product string, quantity int"


def output_form(df: DataFrame, compact: bool = False) -> DataFrame:
    """Ordered, typed columns; ``compact`` stores the week as a byte."""
    return df.select(
        F.col("week").cast("byte" if compact else "int").alias("week"),
        F.col("store").cast("string").alias("store"),
        F.col("product").cast("string").alias("product"),
        F.rint("quantity").cast("int").alias("quantity"),
    )


def write_forecast_csv(df: DataFrame, path: str, validate: bool = False) -> None:
    """``;`` separated with header, sorted by week, store, product across the part files."""
    if validate:
        ensure_valid(check_forecast(df))
    out = output_form(df).orderBy("week", "store", "product")
    out.write.mode("overwrite").option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)


def write_forecast_parquet(df: DataFrame, path: str, validate: bool = False) -> None:
    if validate:
        ensure_valid(check_forecast(df))
    out = output_form(df, compact=True).orderBy("week", "store", "product")
    out.write.mode("overwrite").option("compression", "snappy").parquet(path)


def read_forecast_csv(spark: SparkSession, path: str) -> DataFrame:
    """Explicit schema, so leading zeros of ids survive; a changed header order fails."""
    reader = spark.read.schema(FORECAST_SCHEMA).option("sep", ";").option("header", True)
    return reader.option("enforceSchema", False).csv(path)


def read_forecast(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return read_forecast_csv(spark, path) if kind == "csv" else spark.read.parquet(path)


def readback_check(written: DataFrame) -> DataFrame:
    """Findings of a written forecast: rows, weeks, keys, nulls, negatives, column order."""
    q = F.col("quantity")
    row = written.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("week").alias("weeks"),
        count_true(q.isNull()).alias("nulls"),
        count_true(q < 0).alias("negatives"),
        F.sum(q).alias("total"),
    )
    for key in ("store", "product"):
        row = with_scalars(
            row, written.groupBy(key).agg(F.lit(1).alias("_1")).agg(F.count(F.lit(1)).alias(f"distinct_{key}"))
        )
    ordered = tuple(written.columns) == FORECAST_COLUMNS
    return report(
        row,
        [
            ("rows", "info", None, F.col("rows")),
            ("empty", "error", None, (F.col("rows") == 0).cast("int")),
            ("column_order", "error", None, F.lit(int(not ordered))),
            ("weeks", "info", "week", F.col("weeks")),
            ("distinct", "info", "store", F.col("distinct_store")),
            ("distinct", "info", "product", F.col("distinct_product")),
            ("nulls", "error", "quantity", F.col("nulls")),
            ("negative", "error", "quantity", F.col("negatives")),
            ("total", "info", "quantity", F.col("total")),
        ],
    )


def padded(key: Column, width: int = 3) -> Column:
    """Left-pad with zeros to ``width`` without cutting longer ids."""
    text = key.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def compare_outputs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Findings of two forecasts: rows, columns, rows on one side only, unequal quantities.

    Ids are compared with leading zeros restored. One full outer join on the forecast key; keys are
    unique in a valid forecast, and their duplicates are reported.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            F.col("week").cast("int").alias("week"),
            padded(F.col("store")).alias("store"),
            padded(F.col("product")).alias("product"),
            F.col("quantity").cast("double").alias(f"_{name}"),
            F.lit(1).alias(f"_in_{name}"),
        )

    key = ["week", "store", "product"]
    joined = side(left, "a").join(side(right, "b"), key, "full_outer")
    row = joined.agg(
        F.count("_in_a").alias("rows_left"),
        F.count("_in_b").alias("rows_right"),
        count_true(F.col("_in_b").isNull()).alias("only_left"),
        count_true(F.col("_in_a").isNull()).alias("only_right"),
        count_true(
            F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))
        ).alias("different"),
    )
    for df, name in ((left, "left"), (right, "right")):
        row = with_scalars(row, duplicate_count(df, key).select(F.col("duplicates").alias(f"dup_{name}")))
    same_columns = list(left.columns) == list(right.columns)
    return report(
        row,
        [
            ("rows_left", "info", None, F.col("rows_left")),
            ("rows_right", "info", None, F.col("rows_right")),
            ("columns_differ", "error", None, F.lit(int(not same_columns))),
            ("only_left", "error", None, F.col("only_left")),
            ("only_right", "error", None, F.col("only_right")),
            ("different", "error", "quantity", F.col("different")),
            ("duplicate_key_left", "error", None, F.col("dup_left")),
            ("duplicate_key_right", "error", None, F.col("dup_right")),
        ],
    )


def write_multi_format(
    df: DataFrame, root: str, strategy: str, version: str, formats: Sequence[str] = ("csv", "parquet")
) -> dict[str, str]:
    """The same forecast in each format below ``strategy=.../version=...``; returns the paths."""
    writers = {"csv": write_forecast_csv, "parquet": write_forecast_parquet}
    paths = {}
    for kind in formats:
        if kind not in writers:
            raise ValueError(f"unsupported format: {kind}")
        paths[kind] = f"{root}/{kind}/strategy={strategy}/version={version}"
        writers[kind](df, paths[kind])
    return paths


def write_feature_table(df: DataFrame, path: str, spec: SeriesSpec = DEFAULT) -> None:
    """Parquet partitioned by year and clustered by series, so later windows read sorted runs."""
    clustered = df.repartition(*[F.col(c) for c in spec.series]).sortWithinPartitions(spec.year, *spec.series, spec.week)
    clustered.write.mode("overwrite").partitionBy(spec.year).parquet(path)


def write_report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_runs_csv(table: DataFrame, path: str) -> None:
    compare_runs(table).write.mode("overwrite").option("header", True).csv(path)
