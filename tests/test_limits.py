"""Where data used to be cut or lost without a word."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekcast.functions import calendar
from weekcast.operators import profile, select
from weekcast.plans.features import temporal_features
from weekcast.sources import parquet


def test_holidays_of_any_year(spark):
    days = [dt.date(1985, 12, 25), dt.date(2036, 12, 25), dt.date(2036, 4, 11), dt.date(2050, 7, 3)]
    df = spark.createDataFrame([(d,) for d in days], "week_date date")
    out = {r.week_date: r.is_holiday for r in temporal_features(df).collect()}
    assert [out[d] for d in days] == [1, 1, 1, 0]
    assert calendar.holidays_around(df.limit(0), "week_date").count() == 9


def test_unlisted_categories_are_kept(spark):
    rows = [(dt.date(2022, 1, 1), "a", 1.0), (dt.date(2022, 1, 2), "b", 2.0), (dt.date(2022, 1, 3), None, 4.0)]
    df = spark.createDataFrame(rows, "date date, category string, quantity double")
    assert profile.month_category_pivot(df, ["a"]).collect() == [(1, 1.0, 6.0)]


def test_wide_columns_stay_in_the_profile(spark):
    df = spark.range(300).select(F.concat(F.lit("p"), "id").alias("product"), F.lit("s").alias("store"))
    rows = {(r.column, r["rank"]): r for r in profile.category_profile(df).collect()}
    assert rows["product", 1].distinct_values == 300 and rows["product", 1].is_category == 0
    assert rows["store", 1].is_category == 1


def test_corrupt_files_are_reported(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "bad.parquet").write_bytes(b"PAR1 this is no footer")
    assert parquet.scan_parquet_dir(spark, str(tmp_path / "t")).count() == 5
    assert [r.path.split("/")[-1] for r in parquet.unreadable_files(spark, str(tmp_path / "t")).collect()] == ["bad.parquet"]
    with pytest.raises(Exception, match="(?i)footer|corrupt|parquet"):
        parquet.scan_parquet_dir(spark, str(tmp_path / "t"), skip_unreadable=False).count()
    with pytest.raises(ValueError, match="bad.parquet"):
        parquet.scan_by_schema(spark, str(tmp_path / "t"))


def test_unknown_schemes_are_no_empty_result():
    with pytest.raises(ValueError, match="odd://"):
        list(parquet._signatures(iter([pd.DataFrame({"path": ["odd://bucket/x.parquet"]})])))


def test_nested_folders_are_read_once(spark, tmp_path):
    for name, n in (("a", 3), ("a/b", 4), ("c", 5)):
        path = tmp_path / name
        path.mkdir(exist_ok=True)
        pd.DataFrame({"x": range(n)}).to_parquet(path / "f.parquet")
    pd.DataFrame({"y": [1]}).to_parquet(tmp_path / "c" / "other.parquet")
    found = parquet.scan_by_schema(spark, str(tmp_path))
    assert {k: v.count() for k, v in found.items()} == {"x": 12, "y": 1}
    files = parquet.file_inventory(spark, str(tmp_path / "a" / "b")).collect()
    assert [(r.rows, r.folder_files, r.bytes == r.folder_bytes) for r in files] == [(4, 1, True)]


def test_chunks_have_their_own_size(spark):
    df = spark.range(0, 100, 1, 1)
    sizes = [parquet.map_chunks(df, lambda b: pd.DataFrame({"n": [len(b)]}), "n long", rows=k) for k in (7, 40)]
    assert [max(r.n for r in s.collect()) for s in sizes] == [7, 40]
    assert [s.agg(F.sum("n")).first()[0] for s in sizes] == [100, 100]


def test_chunks_reach_over_batches_and_partitions(spark):
    """Arrow batches hold 10,000 rows; only the last chunk may be short: of a task, or of the table."""
    df = spark.range(0, 70_001, 1, 3).selectExpr("id", "id % 7 AS chunk", "'x' AS at")

    def size(b):
        assert list(b.columns) == ["id", "chunk", "at"]
        return pd.DataFrame({"n": [len(b)], "first": [b["id"].iloc[0]], "last": [b["id"].iloc[-1]]})

    schema = "n long, first long, last long"
    tasks = parquet.map_chunks(df, size, schema, rows=15_000).collect()
    assert sorted(r.n for r in tasks) == [8333, 8334, 8334, 15_000, 15_000, 15_000]
    whole = sorted(parquet.exact_chunks(df, size, schema, 15_000).collect(), key=lambda r: r[1])
    assert [r.n for r in whole] == [15_000] * 4 + [10_001]
    assert [r[1] for r in whole] == [0, 15_000, 30_000, 45_000, 60_000] and whole[-1].last == 70_000
    assert parquet.exact_chunks(df.limit(0), size, schema, 10).count() == 0
    assert [r.n for r in parquet.exact_chunks(df.limit(5), size, schema, 10).collect()] == [5]


def test_spearman_over_complete_pairs(spark):
    draw = np.random.default_rng(2)
    data = pd.DataFrame(draw.integers(0, 9, (60, 4)).astype(float), columns=list("abcd"))
    data.loc[::4, "b"] = None
    data.loc[5:30, "c"] = None
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in r) for r in data.to_numpy()], "a double, b double, c double, d double")
    want = data.corr(method="spearman")
    for frame in (select.spearman_pairs(df, list("abcd")), select.correlation_matrix(df, list("abcd"), "spearman")):
        got = {(r.feature_1, r.feature_2): r.correlation for r in frame.collect()}
        assert len(got) == 6
        for (a, b), r in got.items():
            assert r == pytest.approx(want.loc[a, b])


def test_many_pairs_come_from_one_matrix(spark):
    draw = np.random.default_rng(3)
    names = [f"c{i}" for i in range(27)]
    data = pd.DataFrame(draw.standard_normal((40, 27)), columns=names)
    data["c5"] = 1.0
    data.loc[3:9, "c7"] = None
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in r) for r in data.to_numpy()], ", ".join(f"{n} double" for n in names))
    got = {(r.feature_1, r.feature_2): r.correlation for r in select.pair_correlations(df, names).collect()}
    want = data.corr()
    assert len(got) == 27 * 26 // 2
    for (a, b), r in got.items():
        if "c5" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_rank_bins_need_no_rank_of_every_value(spark, monkeypatch):
    """Bins by average rank from the values at their ends only, ties and hot values included."""
    monkeypatch.setattr(select, "value_ranks", None)
    draw = np.random.default_rng(5)
    for n in (7, 30, 1001):
        data = pd.DataFrame({
            "a": draw.integers(0, 6, n).astype(float), "b": np.where(draw.random(n) < 0.4, 0.0, draw.normal(size=n)),
            "c": draw.normal(size=n) * 1e6, "y": draw.integers(0, 40, n).astype(float),
        })
        bins = np.minimum(np.floor(data.rank() / n * 10), 9)
        df = spark.createDataFrame(data)
        edges = select.bin_edges(df, list(data.columns), 10)
        got = df.select(*data.columns, *[select.rank_bin(F.col(c), edges[c]).alias(f"_{c}") for c in data.columns]).toPandas()
        for c in data.columns:
            assert got[f"_{c}"].tolist() == bins.set_index(data[c])[c].groupby(level=0).first().loc[got[c]].tolist()
        scores = {r.feature: r.score for r in select.mutual_information(df, ["a", "b", "c"], "y").collect()}
        for c in "abc":
            joint = pd.crosstab(bins[c], bins["y"]).to_numpy() / n
            outer = np.outer(joint.sum(axis=1), joint.sum(axis=0))
            want = (joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0])).sum()
            assert scores[c] == pytest.approx(want, abs=1e-9)


def test_selection_matrix_takes_one_exchange(spark, folder):
    from weekcast.catalog import modelling
    from weekcast.catalog.tables import Tables

    plan = modelling.matrix_rows(Tables(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(store") == 1 and "Exchange hashpartitioning(product" not in plan


def test_weekly_tables_take_one_exchange(spark, folder, monkeypatch):
    """Line items are dealt by series once: sums, windows and the stored tables need no other exchange, and models no money columns."""
    from weekcast.catalog import tables

    plans = {}
    monkeypatch.setattr(tables, "materialize", lambda df, label="table", cluster_by=(): plans.setdefault(label, df) if not cluster_by else
                        plans.setdefault(label, df.repartition(*cluster_by)))
    t = tables.Tables(spark, folder)
    frames = {"weekly": t.weekly_table, "sales": t.sales_table, "fine": t.fine_weekly_table, "scored": t.scored}
    for name, df in frames.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, name
    assert "extendedprice" not in t.sales_table._jdf.queryExecution().executedPlan().toString()
