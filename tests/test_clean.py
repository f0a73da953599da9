"""Cleaning, joins and weekly aggregation on small literal frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weekcast.operators import checks, clean, joins, weekly

RAW = "internal_store_id string, internal_product_id string, transaction_date string, quantity string"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def test_null_ids_and_quantities_are_dropped(spark):
    df = raw(
        spark,
        ("s1", "p1", "2022-01-01", "10"),
        ("s1", None, "2022-01-02", "5"),
        ("s2", "p2", "2022-01-03", None),
        (None, "p3", "2022-01-04", "7"),
    )
    assert clean.clean_transactions(df, outliers=None).count() == 1
    kept = clean.clean_transactions(df, outliers=None, keep_null_ids=True)
    assert kept.count() == 3
    assert {r.store for r in kept.collect()} == {"s1", "None"}


def test_invalid_rows_are_removed(spark):
    df = raw(
        spark,
        ("s1", "p1", "2022-01-01", "10"),
        ("s1", "p1", "2022-01-02", "-3"),
        ("s1", "p1", "2021-06-01", "4"),
        ("s1", "p1", "2022-01-04", "0"),
        ("s1", "p1", "not a date", "4"),
        ("s1", "p1", "2022-01-05", "many"),
    )
    assert clean.clean_transactions(df).count() == 1


def test_missing_column_raises(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        clean.clean_transactions(raw(spark, ("s", "p", "2022-01-01", "1")).drop("quantity"))


def test_outlier_is_capped_and_no_row_lost(spark):
    df = spark.createDataFrame([(5.0,), (6.0,), (7.0,), (1000.0,)], "quantity double")
    got = sorted(r.quantity for r in clean.cap_outliers_iqr(df).collect())
    # Q1 = 5.75, Q3 = 255.25
    assert got == [5.0, 6.0, 7.0, pytest.approx(255.25 + 1.5 * 249.5)]


def test_values_inside_the_bounds_stay_even_if_negative(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (1.0,)], "quantity double")
    assert sorted(r.quantity for r in clean.cap_outliers_iqr(df).collect()) == [-2.0, -1.0, 0.0, 1.0]


def test_weekly_total_is_preserved(spark):
    df = spark.createDataFrame(
        [("s", "product_1", "2022-01-03", 10.0), ("s", "product_1", "2022-01-04", 5.0),
         ("s", "product_1", "2022-01-05", 3.0), ("s", "product_2", "2022-01-05", 7.0)],
        "store string, product string, date string, quantity double",
    ).withColumn("date", F.to_date("date"))
    rows = {r["product"]: r for r in weekly.weekly_sales(df).collect()}
    assert rows["product_1"].quantity == 18 and rows["product_2"].quantity == 7
    assert rows["product_1"].week_date == dt.date(2022, 1, 3)
    assert rows["product_1"].week_label == "2022_W01"


def test_calendar_year_with_iso_week(spark):
    df = spark.createDataFrame(
        [("s", "p", dt.date(2022, 1, 1), 1.0), ("s", "p", dt.date(2022, 12, 31), 2.0)],
        "store string, product string, date date, quantity double",
    )
    assert [(r.year, r.week, r.quantity) for r in weekly.weekly_sales(df).collect()] == [(2022, 52, 3.0)]
    iso = weekly.weekly_sales(df, iso_year=True).collect()
    assert {(r.year, r.week) for r in iso} == {(2021, 52), (2022, 52)}


def test_unknown_dimension_rows_are_filled(spark):
    fact = spark.createDataFrame([("1", 2.0), ("9", 3.0)], "store string, quantity double")
    stores = spark.createDataFrame([(1, "On Premise", 10), (2, "Off", 20)], "pdv int, premise string, zipcode int")
    rows = {r.store: r for r in joins.join_stores(fact, stores).collect()}
    assert rows["1"].premise == "On Premise" and rows["9"].premise == "Unknown"
    assert rows["9"].zipcode == 10.0


def test_clashing_names_get_a_suffix(spark):
    fact = spark.createDataFrame([("1", "mine")], "store string, region string")
    stores = spark.createDataFrame([("1", "theirs")], "store string, region string")
    assert joins.join_stores(fact, stores).columns == ["store", "region", "region_store"]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r.x for r in clean.round_to_units(df, "x").collect()] == [0, 2, 2, 0]


def test_renumber_weeks_only_when_outside(spark):
    inside = spark.createDataFrame([(2,), (5,)], "week int")
    assert sorted(r.week for r in clean.renumber_weeks(inside).collect()) == [2, 5]
    outside = spark.createDataFrame([(48,), (49,), (50,), (51,), (52,), (53,)], "week int")
    assert sorted(r.week for r in clean.renumber_weeks(outside).collect()) == [1, 2, 3, 4, 5, 5]


def test_zero_fill_handles_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("-inf"), None), (None, 3)], "x double, n int")
    assert [(r.x, r.n) for r in clean.zero_fill(df).collect()] == [(0.0, 1), (0.0, 0), (0.0, 3)]


def test_sample_depends_on_the_key_only(spark):
    df = spark.range(20_000).withColumn("v", F.rand(1))
    a = {r.id for r in clean.sample_rows(df, 0.2, ["id"]).collect()}
    b = {r.id for r in clean.sample_rows(df.repartition(7), 0.2, ["id"]).collect()}
    assert a == b and 3600 < len(a) < 4400


def test_checks_grade_findings(spark):
    tx = spark.createDataFrame(
        [("a", "p", "2022-01-01", 10), ("a", "p", "2022-01-02", -5), (None, "p", "2022-01-03", 20)],
        "store string, product string, date string, quantity int",
    )
    found = {(r["check"], r["column"]): r for r in checks.check_transactions(tx).collect()}
    assert found[("negative", "quantity")].level == "warning" and found[("negative", "quantity")].value == 1
    assert found[("nulls", "store")].value == 1
    checks.ensure_valid(checks.check_transactions(tx))
    twice = spark.createDataFrame([("1",), ("2",), ("2",)], "product string")
    with pytest.raises(checks.DataQualityError, match="duplicate_key"):
        checks.ensure_valid(checks.check_products(twice))
    with pytest.raises(checks.DataQualityError, match="missing_column"):
        checks.ensure_valid(checks.check_stores(spark.range(1)))


def test_bad_forecast_is_rejected(spark):
    columns = "week int, store string, product string, quantity int"
    good = spark.createDataFrame([(w, "1", "2", 3) for w in range(1, 6)], columns)
    checks.ensure_valid(checks.check_forecast(good))
    bad = spark.createDataFrame([(1, "1", "2", -5), (1, "1", "2", 10), (2, None, "2", None)], columns)
    with pytest.raises(checks.DataQualityError):
        checks.ensure_valid(checks.check_forecast(bad))


def test_empty_frames_pass_through(spark):
    empty = raw(spark).limit(0)
    assert clean.clean_transactions(empty).count() == 0
    assert weekly.weekly_sales(clean.clean_transactions(empty)).count() == 0


def test_first_duplicate_by_week_date(spark):
    df = spark.createDataFrame(
        [(1, "s", "p", dt.date(2022, 1, 9), 5.0), (1, "s", "p", dt.date(2022, 1, 3), 4.0)],
        "week int, store string, product string, week_date date, quantity double",
    )
    assert [r.quantity for r in weekly.keep_first_duplicate(df).collect()] == [4.0]
