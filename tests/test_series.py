"""Series, calendar and entity features."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekcast.functions import calendar
from weekcast.operators import entity, folds, models, series
from weekcast.plans import features, scale
from weekcast.plans.scale import materialize


def of(df, store):
    return df.where(F.col("store") == store).orderBy("week_date").toPandas()


def test_lags_on_a_ramp(panel):
    got = of(series.lags(panel), "ramp")
    assert got.quantity_lag_1[5] == 5 and got.quantity_lag_4[5] == 2
    assert got.quantity_lag_1.isna().sum() == 1 and got.quantity_lag_8.isna().sum() == 8


def test_rolling_on_a_constant(panel):
    got = of(series.rolling_trend(series.rolling_cv(series.rolling_stats(panel))), "const")
    assert (got.quantity_rolling_mean_4 == 10).all() and (got.quantity_rolling_std_4 == 0).all()
    assert (got.quantity_rolling_trend_8 == 0).all() and (got.quantity_rolling_cv_12 == 0).all()


@pytest.mark.parametrize("k", [4, 8, 12])
def test_rolling_matches_pandas(panel, k):
    got = of(series.rolling_stats(panel), "ramp")
    want = got.quantity.rolling(k, min_periods=1)
    assert np.allclose(got[f"quantity_rolling_mean_{k}"], want.mean())
    assert np.allclose(got[f"quantity_rolling_median_{k}"], want.median())
    assert np.allclose(got[f"quantity_rolling_std_{k}"], want.std().fillna(0))


def test_full_windows_are_null_until_full(panel):
    got = of(series.rolling_full(panel, windows=[4]), "ramp")
    assert got.quantity_full_mean_4.isna().sum() == 3 and got.quantity_full_mean_4[3] == 2.5


def test_growth_of_ten_percent(spark, panel):
    grown = panel.where("store = 'ramp'").withColumn("quantity", 10 * F.pow(F.lit(1.1), F.col("quantity")))
    got = of(series.growth_features(grown), "ramp")
    assert np.allclose(got.quantity_pct_change_1w[1:], 0.1) and got.quantity_pct_change_1w[0] == 0
    assert np.allclose(got.quantity_growth_acceleration[2:], 0)
    assert got.quantity_cumulative_growth.iloc[-1] == pytest.approx(1.1**19 - 1)


def test_zero_base_gives_no_infinity(panel):
    zero = panel.withColumn("quantity", F.when(F.col("quantity") == 3, 0.0).otherwise(F.col("quantity")))
    got = of(series.growth_features(zero), "ramp")
    assert np.isfinite(got.select_dtypes("number")).all().all()


def test_ewm_matches_pandas(panel):
    got = of(series.ewm_smooth(panel, "quantity", 0.3, name="e"), "ramp")
    assert np.allclose(got.e, got.quantity.ewm(alpha=0.3).mean())


def test_one_row_series(panel):
    single = panel.where("quantity = 1 AND store = 'ramp'")
    row = series.series_features(single).collect()[0]
    assert row.quantity_ratio_lag1 == 1 and row.quantity_rolling_std_4 == 0 and row.quantity_pct_change_12w == 0


def test_missing_column_raises(panel):
    with pytest.raises(ValueError, match="missing required columns"):
        series.lags(panel.drop("quantity"))


def test_leak_safe_features_do_not_see_the_present(panel):
    """Changing the target from week t on leaves the leak-safe features of weeks <= t alone."""
    changed = panel.withColumn("quantity", F.when(F.col("week") >= 12, F.lit(999.0)).otherwise(F.col("quantity")))
    keys = ["store", "week"]
    a, b = (
        models.model_frame(p).where("week <= 12").drop("quantity").orderBy(*keys).toPandas() for p in (panel, changed)
    )
    pd.testing.assert_frame_equal(a, b)
    encoded = [
        entity.target_encoding(p, leak_safe=True).where("week <= 12").drop("quantity").orderBy(*keys).toPandas()
        for p in (panel, changed)
    ]
    pd.testing.assert_frame_equal(*encoded)


def test_retail_dates(spark):
    df = spark.createDataFrame([(dt.date(2022, m, d),) for m, d in ((12, 15), (1, 15), (5, 15), (11, 25), (7, 15))], "d date")
    day = F.col("d")
    rows = df.select(
        "d", *[e.alias(n) for n, e in {**calendar.retail_periods(day), "bf": calendar.black_friday_window(day)}.items()]
    ).collect()
    assert [r.is_christmas for r in rows] == [1, 0, 0, 0, 0]
    assert [r.is_back_to_school for r in rows] == [0, 1, 0, 0, 0]
    assert [r.is_mothers_day for r in rows] == [0, 0, 1, 0, 0]
    assert [r.bf for r in rows] == [0, 0, 0, 1, 0]


def test_holiday_distances(spark):
    df = spark.createDataFrame([(dt.date(2022, 12, 20),), (dt.date(2022, 12, 25),), (dt.date(2022, 7, 15),)], "d date")
    rows = calendar.holiday_flags(df, "d", calendar.holidays_around(df, "d")).orderBy("d").collect()
    july, before, on = rows
    assert (july.days_to_holiday, july.days_since_holiday, july.is_pre_holiday) == (0, 0, 1)
    assert (before.days_to_holiday, before.is_holiday) == (5, 0)
    assert (on.is_holiday, on.days_to_holiday) == (1, 7)
    strict = calendar.holiday_flags(df, "d", calendar.holidays_around(df, "d"), strict=True).orderBy("d").collect()
    assert strict[0].is_pre_holiday == 0 and strict[1].is_pre_holiday == 1


def test_easter_dates():
    known = {1999: (4, 4), 2000: (4, 23), 2011: (4, 24), 2022: (4, 17), 2024: (3, 31), 2038: (4, 25)}
    assert all(calendar.easter(y) == dt.date(y, *md) for y, md in known.items())


def test_trend_of_a_single_date(spark):
    df = spark.createDataFrame([(dt.date(2022, 1, 1),)], "d date")
    assert calendar.trend_features(df, "d").collect()[0].trend == 0


def test_ranks_and_percentiles_match_pandas(spark):
    values = [100.0, 50.0, 25.0, 25.0, 7.0, 0.0, -3.0, 1e9]
    df = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(values)], "product string, quantity double")
    got = entity.entity_ranking(df, "product", "product").orderBy("product").toPandas()
    s = pd.Series(values)
    assert list(got.product_rank) == list(s.rank(method="dense", ascending=False))
    assert np.allclose(got.product_percentile, s.rank(pct=True, method="average"))


def test_optional_columns_may_be_absent(panel):
    wide = features.all_features(panel)
    assert "product_qty_mean" in wide.columns and "category_other" not in wide.columns
    assert wide.count() == 40


def test_dimension_values_have_no_limit(spark):
    from weekcast.operators import entity

    values = entity.dimension_values(spark.range(1200).selectExpr("string(id) AS v"), "v")
    assert len(values) == 1200 and values == sorted(values)


def test_folds_are_ordered_and_disjoint(panel):
    frame = folds.temporal_folds(panel, n_splits=3, test_weeks=4).toPandas()
    for fold in (1, 2, 3):
        test = frame[frame.fold == fold]
        train = frame[frame.week_rank > (3 - fold + 1) * 4]
        assert test.week.nunique() == 4 and train.week_date.max() < test.week_date.min()
    assert (frame.fold == 0).sum() == 2 * 8


def test_holdout_splits_on_weeks(panel):
    got = folds.chronological_holdout(panel).toPandas()
    assert got.groupby("split").week.nunique().to_dict() == {"train": 16, "validation": 4}
    assert got[got.split == "train"].week_date.max() < got[got.split == "validation"].week_date.min()


def test_temporal_split_counts(panel):
    got = folds.temporal_split(panel).toPandas()
    assert got.groupby("split").week.nunique().to_dict() == {"train": 16, "validation": 2, "test": 2}


def test_past_statistics_take_no_side_table_without_hot_entities(spark, panel, monkeypatch):
    """One exchange per entity instead of a table of entities x weeks; large entities keep it, with equal rows."""
    holes = spark.createDataFrame(
        [(None, "p", 2022, 2, dt.date(2022, 1, 12), 3.0), ("ramp", None, 2022, 3, dt.date(2022, 1, 19), 4.0),
         ("ramp", "q", 2022, 4, dt.date(2022, 1, 24), None), ("ramp", "q", 2022, 5, None, 5.0)],
        "store string, product string, year int, week int, week_date date, quantity double")
    rows = materialize(panel.unionByName(holes), "rows")
    forms = [entity.past_features, lambda df: entity.target_encoding(df, leak_safe=True)]
    plain = [form(rows) for form in forms]
    for df in plain:
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(scale, "HOT_ROWS", 0)
    for form, df in zip(forms, plain):
        joined = form(rows).select(*df.columns)
        assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
        assert df.dtypes == joined.dtypes and df.count() == rows.count()
        assert df.exceptAll(joined).count() == joined.exceptAll(df).count() == 0
