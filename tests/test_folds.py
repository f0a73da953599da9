"""Folds never train on their test weeks or later ones; the horizon holds no training row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weekcast.operators import ensemble, folds, forecast, models


@pytest.mark.parametrize("n_splits,test_weeks,gap", [(1, 4, 0), (2, 4, 0), (3, 2, 0), (5, 3, 0), (3, 4, 2), (2, 1, 5)])
def test_training_is_before_the_test_block(panel, n_splits, test_weeks, gap):
    frame = folds.temporal_folds(panel, n_splits=n_splits, test_weeks=test_weeks)
    assert folds.fold_ids(frame) == list(range(1, n_splits + 1))
    for fold in folds.fold_ids(frame):
        train = {r.week_date for r in folds.fold_train(frame, fold, gap).select("week_date").collect()}
        test = {r.week_date for r in folds.fold_test(frame, fold).select("week_date").collect()}
        assert len(test) == test_weeks and train
        assert (min(test) - max(train)).days == 7 * (gap + 1)


def test_tuning_and_stacking_read_the_folds_of_the_frame(panel):
    frame = models.folded(models.model_frame(panel, lags=(1,), windows=(4,)), n_splits=2, test_weeks=3)
    found = models.tune(frame, ["quantity_lag_1"], "linear", {"reg_param": (0.0, 1.0)}, 2)
    assert found.count() == 2
    specs = {"a": models.ModelSpec("linear")}
    _, oof = ensemble.fit_stacking(frame, ["quantity_lag_1"], specs)
    assert {r.fold: r["n"] for r in oof.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {1: 6, 2: 6}
    with pytest.raises(ValueError, match="no folds"):
        models.oof_predictions(frame.where("fold = 0"), ["quantity_lag_1"], specs)


def test_missing_predictions_leave_the_others(spark):
    rows = [(1.0, 3.0), (None, 3.0), (1.0, None), (None, None)]
    frame = spark.createDataFrame(rows, "a double, b double")
    got = [r.e for r in ensemble.weighted_ensemble(frame, ["a", "b"], [0.25, 0.75], "e").collect()]
    assert got == [2.5, 3.0, 1.0, None]


def test_horizon_rows_are_new_and_know_only_history(panel):
    train, future = forecast.future_frame(panel, sizes=(4,))
    last = panel.agg(F.max("week_date")).first()[0]
    rows = future.collect()
    assert rows and all(r.week_date > last for r in rows)
    assert {(r.store, r.quantity_mean_4) for r in rows} == {("ramp", 18.5), ("const", 10.0)}
    assert train.join(future, ["store", "product", "year", "week"]).isEmpty()
    first = {r.store: r.quantity_mean_4 for r in train.where("week_date = date'2022-01-17'").collect()}
    assert first == {"ramp": 1.0, "const": 10.0}


def test_forecast_of_the_horizon(panel):
    got = forecast.forecast_horizon(panel, models.fit_linear, sizes=(4,)).collect()
    assert {r.quantity for r in got if r.store == "const"} <= set(range(8, 14))
    assert len(got) == len({(r.week, r.store) for r in got}) > 2


def test_seasonal_model_takes_all_regressors(panel):
    frame = panel.withColumns({f"x{i}": (F.col("week") % (i + 2)).cast("double") for i in range(6)})
    frame = frame.withColumn("quantity", F.col("x5") * 3 + 1).withColumn("train", F.lit(True))
    out = models.fit_seasonal_trend(frame, "train", harmonics=0, regressors=[f"x{i}" for i in range(6)], shrink=1e-6)
    assert out.where(F.abs(F.col("prediction") - F.col("quantity")) > 0.01).isEmpty()


def test_leak_safe_features_do_not_see_later_weeks(spark, panel):
    from weekcast.plans.features import all_features

    full = panel.withColumns({"category": F.lit("c"), "unit_price": F.lit(2.0), "brand": F.lit("b"), "subcategory": F.lit(1)})
    changed = full.withColumn("quantity", F.when(F.col("week_date") > "2022-03-20", F.col("quantity") * 100 + 7).otherwise(F.col("quantity")))
    early = F.col("week_date") <= "2022-03-20"
    a, b = (all_features(x, leak_safe=True).where(early) for x in (full, changed))
    assert a.columns == b.columns and {"product_past_mean", "store_past_std", "quantity_lag_1"} <= set(a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    # The first changed week already has its own past only.
    row = all_features(changed, leak_safe=True).where("store = 'ramp' and week_date = date'2022-01-10'").first()
    assert row is None or row.store_past_weeks == 0


def test_one_hot_values_can_be_given(spark):
    from weekcast.operators.entity import category_onehot, dimension_values, store_type_onehot

    df = spark.range(1500).select(F.concat(F.lit("v"), "id").alias("premise"), F.lit("x").alias("category"))
    assert len(dimension_values(df, "premise")) == 1500
    out = store_type_onehot(df, values={"premise": ["v7", "none"]})
    assert out.agg(F.sum("store_type_v7"), F.sum("store_type_none")).first() == (1, 0)
    assert category_onehot(df, values=["x", "y"]).agg(F.sum("category_x"), F.sum("category_y"), F.sum("category_other")).first() == (1500, 0, 0)


def test_many_store_types_in_long_form(spark):
    """Values are numbered in order without a list of them; the wide form of so many is an error."""
    from weekcast.operators import entity

    stores = spark.range(3000).selectExpr("concat('s', id) store", "concat('v', lpad(id, 5, '0')) premise", "IF(id % 2 = 0, 'even', NULL) store_category", "id + 10000 AS zipcode")
    index = entity.store_type_index(stores.unionByName(stores))
    rows = index.orderBy("position").collect()
    want = sorted({("store_type", f"v{i:05d}") for i in range(3000)} | {("store_category", "even"), ("region", "1")})
    assert [(r.attribute, r.value) for r in rows] == want and [r.position for r in rows] == list(range(1, len(want) + 1))
    found = entity.store_type_long(stores.where("store IN ('s0', 's1')"), ["store"], index).collect()
    assert sorted((r.store, r.attribute) for r in found) == [
        ("s0", "region"), ("s0", "store_category"), ("s0", "store_type"), ("s1", "region"), ("s1", "store_type")
    ]
    with pytest.raises(ValueError, match="store_type_long"):
        entity.store_type_onehot(stores)
    assert entity.store_type_index(stores.limit(0)).count() == 0
