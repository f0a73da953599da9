"""Models, ensembles, evaluation, strategies, run metrics, sinks and streaming."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekcast.operators import checks, ensemble, evaluate, forecast, models, runs, select
from weekcast.plans import strategy
from weekcast.sources import parquet, sinks
from weekcast.streaming.scoring import stream_score


def vectors(spark, actual, predicted):
    return spark.createDataFrame(list(zip(map(float, actual), map(float, predicted))), "y double, p double")


def test_metric_formulas(spark):
    row = evaluate.metrics(vectors(spark, [100, 200, 150, 300], [90, 210, 140, 320]), "y", "p").head()
    assert row.wmape == pytest.approx(50 / 750 * 100) and row.mae == 12.5
    assert row.rmse == pytest.approx(np.sqrt((100 + 100 + 100 + 400) / 4))
    assert evaluate.metrics(vectors(spark, [100, 200, 300], [110, 190, 310]), "y", "p").head().wmape == 5


def test_zero_actuals(spark):
    row = evaluate.metrics(vectors(spark, [0, 10], [1, 10]), "y", "p").head()
    assert row.mape == 0 and row.wmape == 10
    quick = evaluate.quick_metrics(vectors(spark, [0, 0], [1, 2]), "y", "p").head()
    assert quick.wmape == 0 and quick.mape == 0


@pytest.fixture(scope="module")
def collinear(spark):
    rng = np.random.default_rng(42)
    n = 400
    x = rng.normal(size=(n, 5))
    f2, f4 = x[:, 0] + 0.01 * rng.normal(size=n), 2 * x[:, 2] + 0.01 * rng.normal(size=n)
    y = 3 * x[:, 0] + 2 * x[:, 2] + 0.1 * rng.normal(size=n)
    rows = np.column_stack([x[:, 0], f2, x[:, 2], f4, x[:, 4], np.ones(n), y])
    return spark.createDataFrame(rows.tolist(), ["f1", "f2", "f3", "f4", "noise", "constant", "y"])


FEATURES = ["f1", "f2", "f3", "f4", "noise", "constant"]


def test_correlated_pairs_and_constants(collinear):
    high = select.high_pairs(select.pair_correlations(collinear, FEATURES), 0.95).collect()
    assert {(r.feature_1, r.feature_2) for r in high} == {("f1", "f2"), ("f3", "f4")}
    ranked = select.select_by_correlation(collinear, FEATURES, "y", 2).collect()
    assert "constant" not in {r.feature for r in ranked} and sum(r.selected for r in ranked) == 2


def test_vif_matches_the_closed_form(collinear):
    got = {r.feature: r.vif for r in select.vif(collinear, FEATURES).collect()}
    assert "constant" not in got
    x = np.array(collinear.select("f1", "f2", "f3", "f4", "noise").collect())
    for i, name in enumerate(["f1", "f2", "f3", "f4", "noise"]):
        others = np.delete(x, i, axis=1)
        fitted = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        r2 = 1 - ((x[:, i] - fitted) ** 2).sum() / (x[:, i] ** 2).sum()
        assert got[name] == pytest.approx(1 / (1 - r2), rel=1e-6)


def test_rfe_keeps_the_useful_features(collinear):
    kept = select.rfe(collinear, ["f1", "f3", "noise"], "y", 2, "linear_regression").where("selected = 1").collect()
    assert {r.feature for r in kept} == {"f1", "f3"}


def test_selection_pipeline_stages(collinear):
    got = {r.feature: r.stage for r in select.selection_pipeline(
        collinear, FEATURES, "y", selection="kbest", k=2, trees=3, depth=3).collect()}
    assert set(got) == set(FEATURES) and "correlated" in got.values()


def test_spearman_forms_agree(collinear):
    columns = ["f1", "f3", "y"]
    a = {(r[0], r[1]): r[2] for r in select.spearman_pairs(collinear, columns).collect()}
    b = {(r[0], r[1]): r[2] for r in select.correlation_matrix(collinear, columns, "spearman").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_ridge_equals_the_closed_form(collinear):
    model = models.fit(collinear, ["f1", "f3"], models.ModelSpec("linear", {"alpha": 5.0}), "y").stages[-1]
    data = np.array(collinear.select("f1", "f3", "y").collect())
    x, y = data[:, :2] - data[:, :2].mean(0), data[:, 2] - data[:, 2].mean()
    want = np.linalg.solve(x.T @ x + 5.0 * np.eye(2), x.T @ y)
    assert np.allclose(model.coefficients.toArray(), want, rtol=1e-5)


def test_seasonal_trend_follows_a_line(panel):
    frame = panel.withColumn("is_train", F.col("week") < 18)
    out = models.fit_seasonal_trend(frame, "is_train", harmonics=1, shrink=1e-6).toPandas()
    assert len(out) == 40 and (out.prediction >= 0).all()
    const = out[out.store == "const"]
    assert np.allclose(const.prediction, 10, atol=1e-3)
    ramp = out[(out.store == "ramp") & out.is_train]
    assert np.abs(ramp.prediction - ramp.quantity).max() < 0.5


def test_weights(spark):
    grid = ensemble.weight_grid(3, 10)
    assert len(grid) == 66 and all(sum(w) == pytest.approx(1) for w in grid)
    df = spark.createDataFrame([(10.0, 10.0, 0.0), (20.0, 20.0, 0.0)], "y double, a double, b double")
    best = ensemble.optimize_weights(df, "y", ["a", "b"]).head()
    assert (best.weight_a, best.weight_b, best.wmape) == (1.0, 0.0, 0.0)
    assert ensemble.weighted_ensemble(df, ["a", "b"]).head().ensemble == 5
    weights = {r.model: r.weight for r in ensemble.inverse_error_weights(df, "y", ["a", "b"]).collect()}
    assert weights["a"] == pytest.approx(1000 / (1000 + 1 / 1.001))


def test_bootstrap_mean_is_near_the_mean(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("p"))
    row = ensemble.bootstrap_stability(df, "p", ["k"], 60).head()
    assert row["mean"] == pytest.approx(4.5, abs=0.05)
    assert row["std"] == pytest.approx(2.8723 / np.sqrt(2000), rel=0.35)


def test_residual_outliers_are_found(spark):
    rng = np.random.default_rng(42)
    values = np.concatenate([rng.normal(size=95), [10, -10, 15, -15, 20]])
    rows = [("s", "p", 2022, i, "2022-01-01", float(v), 0.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "store string, product string, year int, week int, week_date string, y double, p double")
    row = evaluate.residual_report(df, "y", "p").head()
    assert row.z_score_outliers > 0 and row.iqr_outliers >= 5


def test_baselines_of_a_ramp(panel):
    row = evaluate.baselines(panel).where("store = 'ramp'").head()
    assert (row.historical_mean, row.last_value, row.moving_average) == (10.5, 20, 14.5)
    assert row.trend_slope == pytest.approx(1) and row.linear_trend == pytest.approx(21)
    assert row.seasonal_naive == 20


def test_postprocess_bounds(spark):
    history = spark.createDataFrame([("a", "p", 10.0), ("a", "p", 20.0)], "store string, product string, quantity double")
    rows = [(1, "a", "p", 500.0), (1, "b", "p", 5000.0), (2, "a", "p", -4.0), (3, "a", "p", 7.5)]
    df = spark.createDataFrame(rows, "week int, store string, product string, prediction double")
    capped = {(r.week, r.store): r.prediction for r in forecast.bound_by_history(df, history).collect()}
    assert capped == {(1, "a"): 60.0, (1, "b"): 1000.0, (2, "a"): -4.0, (3, "a"): 7.5}
    floored = {(r.week, r.store): r.prediction for r in forecast.bound_by_history_floor(df, history).collect()}
    assert floored[(1, "a")] == 500.0 and floored[(1, "b")] == 1000.0
    done = forecast.postprocess(df, history).collect()
    assert min(r.prediction for r in done) == 0 and all(isinstance(r.prediction, int) for r in done)


def nine(spark):
    rows = [(w, f"{i:03d}", f"{i * 11}", 5 * w + i) for w in (3, 1, 2) for i in (2, 1, 3)]
    return spark.createDataFrame(rows, "week int, store string, product string, quantity int")


def test_csv_and_parquet_round_trip(spark, tmp_path):
    paths = sinks.write_multi_format(nine(spark), str(tmp_path), "naive", "v1")
    csv, pq = (sinks.read_forecast(spark, p, k) for k, p in paths.items())
    assert csv.exceptAll(nine(spark)).isEmpty() and nine(spark).exceptAll(csv).isEmpty()
    assert dict(pq.dtypes)["week"] == "tinyint" and dict(pq.dtypes)["quantity"] == "int"
    findings = {r["check"]: r for r in sinks.compare_outputs(csv, pq).collect()}
    assert all(findings[c].value == 0 for c in ("only_left", "only_right", "different", "columns_differ"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv/strategy=naive/version=v1").glob("part-*")))
    lines = [line for line in text.splitlines() if line != "week;store;product;quantity"]
    assert lines == sorted(lines, key=lambda x: (int(x.split(";")[0]), *x.split(";")[1:3])) and len(lines) == 9
    assert lines[0].startswith("1;001;")
    checks.ensure_valid(sinks.readback_check(csv))


def test_leading_zeros_are_restored_in_the_comparison(spark):
    short = nine(spark).withColumn("store", F.col("store").cast("int").cast("string"))
    findings = {r["check"]: r.value for r in sinks.compare_outputs(nine(spark), short).collect()}
    assert findings["only_left"] == 0 and findings["different"] == 0


def test_mixed_schemas_are_kept_apart(spark, tmp_path):
    spark.createDataFrame([("a", "p", "2022-01-01", 1)], "internal_store_id string, internal_product_id string, "
                          "transaction_date string, quantity int").write.parquet(str(tmp_path / "t1"))
    spark.createDataFrame([("b", "p", "2022-01-02", 2)], "internal_store_id string, internal_product_id string, "
                          "transaction_date string, quantity int").write.parquet(str(tmp_path / "t2"))
    spark.createDataFrame([("a", "On")], "pdv string, premise string").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([("p", "X")], "produto string, categoria string").write.parquet(str(tmp_path / "p"))
    tables = parquet.scan_by_schema(spark, str(tmp_path))
    roles = parquet.route_by_role(tables)
    assert len(tables) == 3 and roles["transactions"].count() == 2
    assert roles["stores"].columns == ["store", "premise"] and roles["products"].columns == ["product", "category"]


def test_runs_are_recorded_and_compared(spark, tmp_path):
    rows = [("s", "p", 10.0, 11.0, 14.0), ("s", "q", 20.0, 18.0, 20.0)]
    df = spark.createDataFrame(rows, "store string, product string, y double, a double, b double")
    table = runs.run_metrics(df, "y", {"r1": ("one", "a"), "r2": ("two", "b")})
    path = str(tmp_path / "runs")
    runs.record_metrics(table, path)
    stored = runs.read_runs(spark, path)
    assert stored.count() == 2 * 4 * 3
    assert runs.best_run(stored).head().run == "r1"
    champions = {r["product"]: r.run for r in runs.best_run(stored, by=["store", "product"]).collect()}
    assert champions == {"p": "r1", "q": "r2"}
    assert [r.run for r in runs.compare_runs(stored).collect()] == ["r1", "r2"]
    assert runs.list_runs(stored, "two").count() == 1


def test_a_run_is_recorded_once(spark, tmp_path):
    """Recorded again it is replaced; a writer that dies before the manifest leaves everything as it was."""
    df = spark.createDataFrame([("s", "p", 10.0, 11.0, 14.0)], "store string, product string, y double, a double, b double")
    path = str(tmp_path / "runs")
    assert runs.read_runs(spark, path).count() == 0
    both = runs.run_metrics(df, "y", {"r1": ("one", "a"), "r2": ("two", "b")})
    for _ in range(2):
        runs.record_metrics(both, path)
    assert runs.read_runs(spark, path).count() == 2 * 4 * 2

    def overall(run):
        return runs.overall(runs.read_runs(spark, path)).where(f"run = '{run}' AND metric = 'mae'").collect()

    assert [(r.strategy, r.value) for r in overall("r1")] == [("one", 1.0)]
    runs.record_metrics(runs.run_metrics(df, "y", {"r1": ("moved", "b")}), path)
    assert [(r.strategy, r.value) for r in overall("r1")] == [("moved", 4.0)] and [r.value for r in overall("r2")] == [4.0]

    def files(*_):
        raise OSError("the writer died")

    with pytest.MonkeyPatch.context() as patch, pytest.raises(OSError):
        patch.setattr(runs, "_files", files)
        runs.record_metrics(runs.run_metrics(df, "y", {"r1": ("half", "a"), "r3": ("half", "a")}), path)
    assert [(r.strategy, r.value) for r in overall("r1")] == [("moved", 4.0)] and overall("r3") == []


def test_pareto_front(spark):
    rows = [("a", 1.0, 5.0), ("b", 2.0, 3.0), ("c", 2.0, 4.0), ("d", 3.0, 3.0), ("e", 1.0, 5.0), ("f", 4.0, 1.0)]
    df = spark.createDataFrame(rows, "run string, x double, y double")
    assert {r.run for r in runs.pareto_front(df, "x", "y").collect()} == {"a", "b", "e", "f"}


def test_strategy_uses_its_own_features(spark, panel):
    frame = strategy.strategy_frame(panel, strategy.STRATEGIES)
    names = strategy.strategy_features(frame, strategy.STRATEGIES[2])
    assert "quantity_lag_4" in names and "quantity_lag_8" not in names
    assert all(not n.endswith("_12") for n in names if "rolling" in n)
    assert len(names) <= strategy.STRATEGIES[2].max_features


def test_streamed_scores_equal_batch_scores(spark, panel, tmp_path):
    frame = models.folded(models.model_frame(panel, lags=(1, 2), windows=(4,)), n_splits=1)
    model = models.fit_tree(frame, models.model_features(frame), max_depth=3)
    limits = forecast.extreme_thresholds(models.predict(model, frame))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    frame.repartition(5).write.parquet(source)
    for _ in range(2):  # the second start finds nothing new
        stream_score(
            spark, source, frame.schema, model, target, str(tmp_path / "state"), limits, weeks=None, files_per_batch=2
        ).awaitTermination()
    streamed = spark.read.parquet(target).select("week", "store", "product", "quantity")
    batch = sinks.output_form(
        forecast.format_forecast(forecast.postprocess(model.transform(frame), thresholds=limits), None)
    )
    assert streamed.count() == batch.count() == 40
    assert streamed.exceptAll(batch).isEmpty()


def test_saved_models_score_the_same(spark, panel, tmp_path):
    frame = models.folded(models.model_frame(panel, lags=(1,), windows=(4,)), n_splits=2)
    specs = {"tree": models.ModelSpec("tree", {"max_depth": 2}), "linear": models.ModelSpec("linear", {"alpha": 1.0})}
    stacked, oof = ensemble.fit_stacking(frame, models.model_features(frame), specs)
    assert oof.count() == 16 and {"tree", "linear"} <= set(oof.columns)
    stacked.save(str(tmp_path / "m"))
    again = ensemble.StackedModel.load(str(tmp_path / "m"), list(specs))
    a, b = (m.transform(frame).agg(F.sum("prediction")).head()[0] for m in (stacked, again))
    assert a == pytest.approx(b)


def test_invalid_input_stops_the_forecast(spark, panel):
    class Never:
        def transform(self, frame):
            raise AssertionError("not reached")

    with pytest.raises(checks.DataQualityError, match="empty"):
        forecast.generate_forecast(panel.limit(0), Never())


def test_bootstrap_counts_follow_the_digest_in_one_small_expression(spark):
    """A hundred expressions in one aggregation are not compiled; the counts are those of the number in the digest."""
    import hashlib

    rows = [(f"k{i}", float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, p double")
    out = ensemble.bootstrap_stability(df, "p", ["k"], 100)
    assert out._jdf.queryExecution().executedPlan().toString().count("sum(") < 20
    means = []
    for b in range(1, 101):
        draws = [int(hashlib.md5(f"{k}|{b}".encode()).hexdigest()[:8], 16) / (1 << 32) for k, _ in rows]
        counts = [sum(u >= c for c in ensemble.POISSON_CUMULATIVE) for u in draws]
        means.append(sum(n * p for n, (_, p) in zip(counts, rows, strict=True)) / sum(counts))
    row = out.head()
    assert abs(row["mean"] - np.mean(means)) < 1e-9 and abs(row["std"] - np.std(means)) < 1e-9
    limits = [(f"{n:08x}" + "0" * 24, n / (1 << 32)) for c in ensemble.POISSON_CUMULATIVE for n in range(int(c * (1 << 32)) - 1, int(c * (1 << 32)) + 3)]
    got = spark.createDataFrame(limits, "d string, u double").select("u", ensemble._poisson(F.col("d")).alias("n")).collect()
    assert all(r.n == sum(r.u >= c for c in ensemble.POISSON_CUMULATIVE) for r in got)
