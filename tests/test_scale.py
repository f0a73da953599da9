"""The distributed forms give the same answers as the naive ones, on skewed data and on every path."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weekcast.catalog.tables import Tables
from weekcast.operators import clean, weekly
from weekcast.plans import scale
from weekcast.sources import parquet


def skewed(spark, rows=5000):
    """A third of the rows share one key and one value; the rest spread over many keys."""
    hot = F.col("id") % 3 == 0
    return spark.range(rows).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.when(hot & (F.col("id") % 2 == 0), 7.0).otherwise((F.col("id") * 37 % 1000) / 7.0 - 40).alias("value"),
    )


def test_quantiles_equal_percentile(spark):
    df = skewed(spark)
    p = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = scale.quantiles(df, "value", p, ["key"]).orderBy("key").collect()
    want = df.groupBy("key").agg(F.percentile("value", F.array(*map(F.lit, p))).alias("w")).orderBy("key").collect()
    for g, w in zip(got, want):
        assert g.key == w.key and np.allclose(list(g)[1:], w.w)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False).map(lambda x: round(x, 3)), min_size=1, max_size=40))
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value double")
    row = scale.quantiles(df, "value", [0.1, 0.5, 0.95]).head()
    assert np.allclose(list(row), np.quantile(values, [0.1, 0.5, 0.95]), rtol=1e-9, atol=1e-6)


def test_quantiles_ignore_missing_and_use_weights(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (None, 9), (float("nan"), 9)], "value double, n int")
    assert scale.quantiles(df, "value", [0.5], weight="n").head()[0] == 1.0
    assert scale.quantiles(df, "value", [1.0], weight="n").head()[0] == 5.0
    assert scale.quantiles(df.limit(0), "value", [0.5]).head()[0] is None


def test_buckets_keep_the_order(spark):
    values = sorted({-1e12, -5.5, -1.0, -1e-9, 0.0, 1e-9, 0.5, 1.0, 1.0000001, 2.0, 1e6, 1e12})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r[0] for r in df.orderBy("v").select(scale.value_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("low,step", [(1e9, 1.0), (0.0, 1e-9)])
def test_narrow_bands_are_split(spark, low, step):
    """Values that share a bucket are ordered in small parts, and the results stay exact."""
    n = 200_000
    df = spark.range(n).select((F.lit(low) + F.col("id") * step).alias("value"))
    assert df.select(scale.value_bucket(F.col("value"))).distinct().count() <= 2
    got = scale.quantiles(df, "value", [0.25, 0.5, 0.999]).head()
    assert np.allclose(list(got), np.quantile(low + np.arange(n) * step, [0.25, 0.5, 0.999]), rtol=1e-15, atol=1e-18)
    bounds = df.withColumn("b", scale.value_bucket(F.col("value"))).groupBy("b").agg(F.min("value").alias("l"), F.max("value").alias("h"))
    parts = df.withColumn("b", scale.value_bucket(F.col("value"))).join(bounds, "b")
    sizes = parts.groupBy("b", scale.part_of_bucket(F.col("value"), F.col("l"), F.col("h"))).count()
    assert sizes.agg(F.max("count")).first()[0] <= 8
    ranks = scale.value_ranks(df.limit(5000), "value")
    assert ranks.where(F.col("rows_below") != F.col("values_below")).isEmpty()
    assert ranks.agg(F.max("rows_below")).first()[0] == 4999


def test_compressible_text_is_measured_not_guessed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "side")
    wide = F.concat(F.repeat(F.lit("x"), 5000), F.col("id").cast("string"))
    spark.range(2000).select(F.col("id").alias("key"), wide.alias("note")).write.parquet(path)
    side, fact = spark.read.parquet(path), spark.range(50).withColumnRenamed("id", "key")
    monkeypatch.setattr(scale, "BROADCAST_LIMIT", 4 << 20)
    assert scale.planned_bytes(side) < 4 << 20 < scale.measured_bytes(side)
    text = scale.attach(fact, side, ["key"])._jdf.queryExecution().toString()
    assert "_salt" in text
    assert scale.attach(fact, side, ["key"]).count() == 50


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scale.checkpoint_folder(Session())


def test_salted_join_equals_plain_join(spark):
    fact, side = skewed(spark), skewed(spark).groupBy("key").agg(F.sum("value").alias("total"))
    side = side.where("key <> 'k7'")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = scale.salted_join(fact, side, ["key"], how), fact.join(side, ["key"], how)
        assert a.count() == b.count()
        assert a.exceptAll(b.select(*a.columns)).isEmpty()
    with pytest.raises(ValueError, match="unsupported join type"):
        scale.salted_join(fact, side, ["key"], "full")


def test_salt_spreads_a_group_of_copies(spark):
    copies = spark.range(0, 20_000, numPartitions=16).select(F.lit("hot").alias("key"), F.lit(1).alias("v"))
    side = spark.createDataFrame([("hot", 2)], "key string, w int")
    joined = scale.salted_join(copies, side, ["key"])
    assert joined.count() == 20_000
    row = F.xxhash64("key", "v") + F.spark_partition_id()
    assert copies.select(F.pmod(row, F.lit(scale.JOIN_SALTS)).alias("s")).distinct().count() > 8


def test_only_hot_keys_are_repeated(spark, monkeypatch):
    """A side of many keys is not written once per salt, and a hot key is still spread."""
    monkeypatch.setattr(scale, "HOT_ROWS", 500)
    fact = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"), F.col("id").alias("v")
    )
    side = fact.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    want = fact.join(side, "key").orderBy("v").collect()
    for options in ({}, {"weight": "rows"}, {"counted": fact.select("key")}):
        joined = scale.salted_join(fact, side, ["key"], "inner", **options)
        assert joined.orderBy("v").collect() == want
        hot = scale.hot_buckets(fact, ["key"])
        assert 1 <= len(hot) < 4
        repeated = side.where(scale.key_bucket(["key"]).isin(hot))
        assert repeated.where("key = 'hot'").count() == 1 and repeated.count() < side.count() / 10
    # Keys of two types have different hashes and still meet.
    numbers = spark.range(3000).select((F.col("id") % 2).cast("int").alias("key"))
    assert scale.salted_join(numbers, spark.range(2).withColumnRenamed("id", "key"), ["key"], "inner").count() == 3000


def test_a_large_side_is_never_broadcast_for_its_small_file(spark, tmp_path):
    """Repetitive rows make a small file: only the rows counted decide."""
    path = str(tmp_path / "side")
    spark.range(300_000, numPartitions=1).select(F.col("id").alias("key"), F.lit("x" * 200).alias("note")).write.parquet(path)
    side, fact = spark.read.parquet(path), spark.range(10).withColumnRenamed("id", "key")
    assert scale.planned_bytes(side) < 10 << 20 < scale.measured_bytes(side)
    for salts in (1, scale.JOIN_SALTS):
        joined = scale.attach(fact, side, ["key"], "inner", limit=20 << 20, salts=salts)
        assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert joined.count() == 10


@pytest.mark.parametrize("name", ["join_stores", "product_stats", "dense_rank_total", "target_encoding", "holiday_flags",
                                  "drop_correlated", "week_coverage", "bound_by_history"])
def test_queries_without_any_broadcast(spark, folder, name, monkeypatch):
    """With no room for broadcasts every side is written, measured and joined with salted keys."""
    import __spark_entry__ as entry
    from tests.oracle import compare, duck

    monkeypatch.setattr(scale, "BROADCAST_LIMIT", 0)
    problem = compare(entry.queries()[name](spark, folder), duck(folder), entry.oracle_sql()[name])
    assert problem is None, problem


def test_scratch_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scale, "checkpoint_folder", lambda _: str(tmp_path))
    assert scale.materialize(spark.range(3)).count() == 3
    assert list(tmp_path.rglob("*.parquet"))
    scale.clear_scratch(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_large_side_is_not_broadcast(spark, folder):
    fact = Tables(spark, folder).fine
    side = fact.groupBy("product").agg(F.avg("quantity").alias("m"))
    near = scale.attach(fact, side, ["product"])._jdf.queryExecution().toString()
    far = scale.attach(fact, side, ["product"], limit=0)._jdf.queryExecution().toString()
    assert "_salt" not in near and "_salt" in far


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, folder):
    scan = parquet.scan_filtered_sorted(spark, f"{folder}/lineitem.parquet", "l_quantity", "l_shipdate")
    text = plan(scan.select("l_quantity", "l_shipdate"))
    assert "IsNotNull(l_quantity)" in text and "IsNotNull(l_shipdate)" in text
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in text
    year = plan(clean.in_year(Tables(spark, folder).fine, "date", 1997).select("quantity"))
    assert "GreaterThanOrEqual(l_shipdate" in year and "LessThan(l_shipdate" in year


def test_series_features_use_one_exchange(spark, folder):
    from weekcast.operators.series import series_features

    stored = Tables(spark, folder).weekly_table
    assert plan(series_features(stored)).count("Exchange hashpartitioning") == 1


def test_weekly_aggregation_combines_before_the_shuffle(spark, folder):
    text = plan(weekly.weekly_sales(Tables(spark, folder).fine))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_no_query_plan_has_a_cartesian_product(spark, folder):
    import __spark_entry__ as entry

    for name in ("clean_transactions", "price_tiers", "weight_candidates", "tame_extremes", "pareto_front", "trend_features"):
        text = plan(entry.queries()[name](spark, folder))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_column_ranks_cut_large_buckets_and_keep_ties(spark, monkeypatch):
    """Average ranks as pandas gives them: few values, a frequent value, a narrow band far from zero, signs."""
    monkeypatch.setattr(scale, "RANKED_ROWS", 16)
    draw = np.random.default_rng(4)
    n = 3000
    data = pd.DataFrame({
        "few": draw.integers(-3, 4, n).astype(float), "hot": np.where(draw.random(n) < 0.6, 0.0, draw.normal(size=n) * 1e-4),
        "band": 1e9 + draw.integers(0, 900, n) / 1000, "wide": draw.normal(size=n) * 10.0 ** draw.integers(-3, 6, n), "one": 5.0,
    })
    df = spark.createDataFrame(data.assign(id=range(n)))
    got = scale.column_ranks(df, list(data.columns), "id").toPandas().set_index("id").sort_index()
    pd.testing.assert_frame_equal(got, data.rank(), check_names=False)


def test_located_values_tell_the_rows_of_a_value(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 2, 5, 5, 9]], "value double")
    rows = scale.located_values(df, "value", [F.floor(F.col("_total") / 2).cast("long")]).where("_start <= 3 AND _end > 3").collect()
    assert [(r._value, r._start, r._end, r._n, r._total) for r in rows] == [(2.0, 3, 4, 1, 7)]
