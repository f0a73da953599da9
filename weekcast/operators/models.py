"""Regressors as MLlib pipelines, time-ordered validation and tuning."""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.functions.calendar import TAU, add, calendar_basic, cyclic_encoding
from weekcast.functions.scalars import numeric_columns
from weekcast.operators.entity import past_features
from weekcast.operators.evaluate import metrics
from weekcast.operators.folds import GAP, N_SPLITS, TEST_WEEKS, fold_ids, fold_test, fold_train, temporal_folds
from weekcast.operators.leafwise import LeafwiseModel, Settings, fit_leafwise
from weekcast.operators.series import LAGS, WINDOWS, series_features
from weekcast.plans.scale import materialize, scratch_path
from weekcast.spec import DEFAULT, SeriesSpec

SEED = 42


@dataclass(frozen=True)
class ModelSpec:
    """A kind of regressor with its parameters."""

    kind: str = "gbt"
    params: Mapping[str, float] = field(default_factory=dict)


# -- features the models may see -----------------------------------------------------------------


def model_frame(
    panel: DataFrame,
    spec: SeriesSpec = DEFAULT,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    entities: bool = True,
) -> DataFrame:
    """Panel with features known before each row's week: calendar, lags, shifted rolling statistics, and with
    ``entities`` the past of the row's product and store.

    Money totals of the same week are left out.
    """
    base = panel.select(*spec.panel_key, spec.week_date, F.col(spec.target).cast("double").alias(spec.target))
    day = F.col(spec.week_date)
    basic = {n: e for n, e in calendar_basic(day).items() if n in ("month", "quarter", "day_of_year")}
    known = past_features(base, spec) if entities else base
    return series_features(add(known, basic, cyclic_encoding(day)), spec, lags, windows, leak_safe=True)


def model_features(frame: DataFrame, spec: SeriesSpec = DEFAULT) -> list[str]:
    hidden = [*spec.series, spec.target, spec.week_date, spec.year, "fold", "week_rank"]
    return numeric_columns(frame, exclude=hidden)


def preparation(features: Sequence[str]) -> list:
    """Null-to-zero and assembly as pipeline stages, so a saved model scores raw frames."""
    columns = ", ".join(f"coalesce(cast(`{f}` as double), 0.0D) AS `_x_{f}`" for f in features)
    return [
        SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="_features"),
    ]


def regressor(model: ModelSpec, target: str, prediction: str = "prediction", validation: str | None = None):
    """MLlib estimator for a ``ModelSpec``.

    'linear' takes ridge ``alpha``; 'gbt_alt', the leaf-wise boosted model, is no MLlib stage (see ``fit``).
    """
    p = dict(model.params)
    common = dict(featuresCol="_features", labelCol=target, predictionCol=prediction)
    if model.kind == "gbt":
        stage = GBTRegressor(
            maxIter=int(p.get("n_estimators", 20)),
            maxDepth=int(p.get("max_depth", 5)),
            stepSize=float(p.get("learning_rate", 0.1)),
            subsamplingRate=float(p.get("subsample", 1.0)),
            featureSubsetStrategy=str(p.get("colsample_bytree", "all")),
            minInstancesPerNode=int(p.get("min_child_samples", 1)),
            seed=SEED,
            **common,
        )
        return stage.setValidationIndicatorCol(validation) if validation else stage
    if model.kind == "forest":
        return RandomForestRegressor(
            numTrees=int(p.get("n_estimators", 20)), maxDepth=int(p.get("max_depth", 8)), seed=SEED, **common
        )
    if model.kind == "tree":
        return DecisionTreeRegressor(maxDepth=int(p.get("max_depth", 8)), seed=SEED, **common)
    if model.kind == "linear":
        return LinearRegression(
            regParam=float(p.get("reg_param", 0.0)), elasticNetParam=0.0, standardization=False, **common
        )
    raise ValueError(f"unknown model kind: {model.kind}")


def ridge_parameter(frame: DataFrame, target: str, alpha: float) -> float:
    """MLlib regParam equal to ridge ``alpha``: alpha * std(target) / n."""
    row = frame.agg(F.stddev_pop(target).alias("s"), F.count(target).alias("n")).head()
    return alpha * float(row["s"] or 0.0) / max(int(row["n"]), 1)


def leafwise_settings(params: Mapping[str, float]) -> Settings:
    """Settings of the leaf-wise model from plain numbers; whole numbers where the setting is one."""
    known = {f.name: f.type for f in fields(Settings)}
    whole = {n: int(v) if "int" in str(known[n]) else float(v) for n, v in params.items()}
    return Settings(**({"n_estimators": 20} | whole))


def fit(
    frame: DataFrame,
    features: Sequence[str],
    model: ModelSpec,
    target: str = "quantity",
    prediction: str = "prediction",
    validation: str | None = None,
) -> PipelineModel | LeafwiseModel:
    if model.kind == "gbt_alt":
        return fit_leafwise(frame, features, target, leafwise_settings(model.params), validation, prediction)
    if model.kind == "linear" and "alpha" in model.params:
        model = ModelSpec("linear", {"reg_param": ridge_parameter(frame, target, model.params["alpha"])})
    if model.kind == "gbt" and not frame.sparkSession.sparkContext.getCheckpointDir():
        # MLlib cuts the lineage of boosting every ten trees, but only where this is set: many trees overflow the stack.
        frame.sparkSession.sparkContext.setCheckpointDir(scratch_path(frame.sparkSession, "boosting"))
    return Pipeline(stages=[*preparation(features), regressor(model, target, prediction, validation)]).fit(frame)


def mark_validation(frame: DataFrame, weeks: int = TEST_WEEKS, name: str = "is_validation") -> DataFrame:
    """True on the newest weeks, for early stopping; needs ``week_rank`` from ``temporal_folds``."""
    return frame.withColumn(name, F.col("week_rank") <= weeks)


def fit_gbt(frame, features, target="quantity", validation=None, **params) -> PipelineModel:
    """Boosted trees; with ``validation`` (a boolean column) boosting stops when it no longer helps."""
    return fit(frame, features, ModelSpec("gbt", params), target, validation=validation)


def fit_gbt_alt(frame, features, target="quantity", validation=None, **params) -> LeafwiseModel:
    """Boosted trees grown best leaf first, on histograms, with row and feature subsampling."""
    return fit(frame, features, ModelSpec("gbt_alt", params), target, validation=validation)


def fit_forest(frame, features, target="quantity", **params) -> PipelineModel:
    return fit(frame, features, ModelSpec("forest", params), target)


def fit_tree(frame, features, target="quantity", **params) -> PipelineModel:
    return fit(frame, features, ModelSpec("tree", params), target)


def fit_linear(frame, features, target="quantity", alpha: float = 0.0) -> PipelineModel:
    return fit(frame, features, ModelSpec("linear", {"alpha": alpha}), target)


def predict(model: PipelineModel | LeafwiseModel, frame: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Input columns plus the prediction, without the pipeline's helper columns."""
    return model.transform(frame).select(*frame.columns, F.col(prediction))


def importances(model: PipelineModel | LeafwiseModel, frame: DataFrame) -> DataFrame:
    """(feature, importance) of a tree model, |coefficient| of a linear one, number of splits of a leaf-wise one."""
    if isinstance(model, LeafwiseModel):
        names, values = model.features, model.splits()
    else:
        names = [c.removeprefix("_x_") for c in model.stages[1].getInputCols()]
        last = model.stages[-1]
        tree = hasattr(last, "featureImportances")
        values = last.featureImportances.toArray() if tree else np.abs(last.coefficients.toArray())
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return frame.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def save_model(model: PipelineModel | LeafwiseModel, path: str) -> None:
    if isinstance(model, LeafwiseModel):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, kind: str | None = None) -> PipelineModel | LeafwiseModel:
    """``kind`` as in ``ModelSpec``; needed for the leaf-wise model only."""
    return LeafwiseModel.load(SparkSession.active(), path) if kind == "gbt_alt" else PipelineModel.load(path)


# -- M6 ------------------------------------------------------------------------------------------


def _solve(gram: pd.Series, moments: pd.Series, shrink: float) -> pd.Series:
    """Ridge coefficients of a batch of small systems given as flattened sums."""
    size = len(moments.iloc[0]) if len(moments) else 1
    a = np.array(gram.tolist(), dtype=float).reshape(-1, size, size)
    penalty = np.eye(size) * shrink
    penalty[0, 0] = 1e-9
    solved = np.linalg.solve(a + penalty, np.array(moments.tolist(), dtype=float)[..., None])
    return pd.Series(list(solved[..., 0]))


def fit_seasonal_trend(
    frame: DataFrame,
    train: str,
    spec: SeriesSpec = DEFAULT,
    harmonics: int = 2,
    regressors: Sequence[str] = (),
    mode: str = "additive",
    shrink: float = 1.0,
    prediction: str = "prediction",
) -> DataFrame:
    """Linear trend plus yearly waves plus regressors, one ridge regression per series.

    ``train`` names the boolean column of the rows to fit on; every row is predicted. The normal
    equations are sums, so Spark aggregates them per series (combined on the map side); a vectorised
    UDF solves batches of the resulting small systems; the coefficients are joined back by series.
    """
    regressors = list(regressors)
    day, q = F.col(spec.week_date), F.col(spec.target).cast("double")
    y = F.log1p(F.greatest(q, F.lit(0.0))) if mode == "multiplicative" else q
    angle = F.lit(TAU) * F.dayofyear(day) / 365.25
    terms = [F.lit(1.0), F.datediff(day, F.lit("2000-01-01").cast("date")) / 365.25]
    for k in range(1, harmonics + 1):
        terms += [F.sin(angle * k), F.cos(angle * k)]
    terms += [F.coalesce(F.col(r).cast("double"), F.lit(0.0)) for r in regressors]
    size = len(terms)
    names = [f"_x{i}" for i in range(size)]

    wide = frame.withColumns({**dict(zip(names, terms)), "_y": y})
    known = wide.where(F.coalesce(F.col(train), F.lit(False)) & F.col("_y").isNotNull())
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    sums = known.groupBy(*spec.series).agg(
        F.avg("_y").alias("_level"),
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_g{i}_{j}") for i, j in cells],
        *[F.sum(F.col(n) * F.col("_y")).alias(f"_m{i}") for i, n in enumerate(names)],
    )
    gram = F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)])
    # Moments of y - level: sum(x y) - level * sum(x), and sum(x) is the first row of the Gram matrix.
    moments = F.array(*[F.col(f"_m{i}") - F.col("_level") * F.col(f"_g0_{i}") for i in range(size)])

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, moments: pd.Series) -> pd.Series:
        return _solve(gram, moments, shrink)

    weights = sums.select(*spec.series, "_level", solve(gram, moments).alias("_w"))
    fitted = F.col("_level")
    for i, name in enumerate(names):
        fitted = fitted + F.col(name) * F.get(F.col("_w"), F.lit(i))
    value = F.expm1(fitted) if mode == "multiplicative" else fitted
    # A series has at most one row a week, so a join on the series key is not skewed.
    return wide.join(weights, spec.series, "left").select(
        *[c for c in frame.columns], F.greatest(value, F.when(value.isNotNull(), F.lit(0.0))).alias(prediction)
    )


# -- V3 ------------------------------------------------------------------------------------------


def score_with(frame: DataFrame, model, features: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """Score with any object that has ``predict(matrix)``: broadcast once, applied to Arrow batches."""
    handle = frame.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        loaded = handle.value
        for batch in batches:
            yield pd.Series(np.asarray(loaded.predict(batch.fillna(0.0).to_numpy()), dtype=float))

    return frame.withColumn(prediction, run(F.struct(*[F.col(f).cast("double").alias(f) for f in features])))


# -- validation ----------------------------------------------------------------------------------


def folded(frame: DataFrame, spec: SeriesSpec = DEFAULT, n_splits: int = N_SPLITS, test_weeks: int = TEST_WEEKS):
    """Frame with fold ids, written once so the fold loop does not rebuild the features.

    Not dealt again: the windows of the features have left the rows of a series together.
    """
    return materialize(temporal_folds(frame, spec, n_splits, test_weeks), "folds")


def oof_predictions(
    frame: DataFrame,
    features: Sequence[str],
    models: Mapping[str, ModelSpec],
    spec: SeriesSpec = DEFAULT,
    gap: int = GAP,
) -> DataFrame:
    """Test rows of every fold with one prediction column per model, each fitted on earlier weeks.

    ``frame`` must come from ``folded``. The models of a fold are applied to the same rows one after
    the other, so no pivot or join is needed.
    """
    parts = []
    for fold in fold_ids(frame):
        train = fold_train(frame, fold, gap)
        test = fold_test(frame, fold)
        for name, model in models.items():
            fitted = fit(train, features, model, spec.target, prediction=name)
            test = predict(fitted, test, name)
        parts.append(test)
    if not parts:
        raise ValueError("the frame has no folds")
    return reduce(lambda a, b: a.unionByName(b), parts)


def cross_validate_temporal(
    frame: DataFrame,
    features: Sequence[str],
    model: ModelSpec,
    spec: SeriesSpec = DEFAULT,
    gap: int = GAP,
) -> DataFrame:
    """(fold, rows, wmape, mae, rmse, mape) over expanding training windows."""
    scored = oof_predictions(frame, features, {"prediction": model}, spec, gap)
    sizes = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.join(metrics(scored, spec.target, "prediction", ["fold"]), "fold")


# Ranges of the parameter search.
SEARCH_SPACE = {
    "n_estimators": (100, 1000),
    "max_depth": (3, 10),
    "learning_rate": (0.01, 0.3),
    "subsample": (0.6, 1.0),
    "colsample_bytree": (0.6, 1.0),
}


def sample_parameters(space: Mapping[str, tuple], trials: int, seed: int = SEED) -> list[dict]:
    """Seeded draws: integers where both ends are integers, else uniform."""
    rng = random.Random(seed)
    return [
        {
            name: rng.randint(low, high) if isinstance(low, int) and isinstance(high, int) else round(rng.uniform(low, high), 4)
            for name, (low, high) in space.items()
        }
        for _ in range(trials)
    ]


def tune(
    frame: DataFrame,
    features: Sequence[str],
    kind: str = "gbt",
    space: Mapping[str, tuple] = SEARCH_SPACE,
    trials: int = 10,
    spec: SeriesSpec = DEFAULT,
    gap: int = GAP,
) -> DataFrame:
    """(trial, parameters..., wmape) of a random search, best first; error over all folds of ``frame``."""
    rows = []
    for trial, params in enumerate(sample_parameters(space, trials)):
        scored = oof_predictions(frame, features, {"prediction": ModelSpec(kind, params)}, spec, gap)
        error = metrics(scored, spec.target, "prediction").head()["wmape"]
        rows.append((trial, *[float(params[n]) for n in space], float(error)))
    columns = ", ".join(["trial int", *[f"{n} double" for n in space], "wmape double"])
    return frame.sparkSession.createDataFrame(rows, columns).orderBy("wmape", "trial")


