"""Named forecasting strategies: features, models, weights and post-processing in one description."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.operators.clean import clip_nonnegative
from weekcast.operators.ensemble import weighted_ensemble
from weekcast.operators.evaluate import quick_metrics
from weekcast.operators.forecast import cap_by_mean
from weekcast.operators.models import ModelSpec, fit, fit_seasonal_trend, model_features, model_frame, predict
from weekcast.operators.select import select_by_correlation
from weekcast.operators.series import ewm_smooth
from weekcast.plans.scale import materialize, with_scalars
from weekcast.spec import DEFAULT, SeriesSpec


@dataclass(frozen=True)
class Strategy:
    name: str
    models: Mapping[str, tuple[float, ModelSpec]]
    lags: Sequence[int] = (1, 2, 4, 8)
    windows: Sequence[int] = (4, 8, 12)
    max_features: int = 40
    smoothing: float = 0.1
    cap_multiplier: float = 3.0
    notes: Mapping[str, str] = field(default_factory=dict)


def _boosted(kind: str, trees: int, depth: int, rate: float, rows: float = 1.0, columns: float = 1.0) -> ModelSpec:
    return ModelSpec(
        kind,
        {
            "n_estimators": trees,
            "max_depth": depth,
            "learning_rate": rate,
            "subsample": rows,
            "colsample_bytree": columns,
        },
    )


def _seasonal(mode: str) -> ModelSpec:
    return ModelSpec("seasonal_trend", {"mode": mode})


# The five shipped strategies.
STRATEGIES = (
    Strategy(
        "conservative_ensemble",
        {
            "gbt": (0.35, _boosted("gbt", 800, 5, 0.08, 0.85, 0.85)),
            "gbt_alt": (0.35, _boosted("gbt_alt", 800, 5, 0.08, 0.85, 0.85)),
            "seasonal_trend": (0.30, _seasonal("multiplicative")),
        },
        lags=(1, 2, 4, 8), windows=(4, 8, 12), max_features=40, smoothing=0.1, cap_multiplier=2.5,
    ),
    Strategy(
        "aggressive_xgboost",
        {"gbt": (1.0, _boosted("gbt", 1500, 8, 0.05, 0.8, 0.8))},
        lags=(1, 2, 3, 4, 6, 8, 12), windows=(3, 4, 6, 8, 12, 16), max_features=60, smoothing=0.05, cap_multiplier=3.0,
    ),
    Strategy(
        "prophet_focused",
        {"gbt": (0.25, _boosted("gbt", 500, 4, 0.1)), "seasonal_trend": (0.75, _seasonal("additive"))},
        lags=(1, 2, 4), windows=(4, 8), max_features=25, smoothing=0.15, cap_multiplier=2.0,
    ),
    Strategy(
        "lightgbm_optimized",
        {"gbt_alt": (1.0, _boosted("gbt_alt", 1200, 7, 0.06, 0.82, 0.82))},
        lags=(1, 2, 4, 8, 12), windows=(4, 8, 12, 16), max_features=50, smoothing=0.08, cap_multiplier=2.8,
    ),
    Strategy(
        "full_ensemble",
        {
            "gbt": (0.3, _boosted("gbt", 1000, 6, 0.07, 0.85, 0.85)),
            "gbt_alt": (0.3, _boosted("gbt_alt", 1000, 6, 0.07, 0.85, 0.85)),
            "seasonal_trend": (0.2, _seasonal("multiplicative")),
        },
        lags=(1, 2, 4, 8), windows=(4, 8, 12), max_features=45, smoothing=0.12, cap_multiplier=2.3,
    ),
)


def strategy_frame(panel: DataFrame, strategies: Sequence[Strategy], spec: SeriesSpec = DEFAULT) -> DataFrame:
    """One leak-safe feature table holding every lag and window any of the strategies asks for."""
    lags = sorted({n for s in strategies for n in s.lags})
    windows = sorted({n for s in strategies for n in s.windows})
    return materialize(model_frame(panel, spec, lags, windows), "strategies", spec.series)


def strategy_features(frame: DataFrame, strategy: Strategy, spec: SeriesSpec = DEFAULT) -> list[str]:
    """Features of the strategy's lags and windows, the best ``max_features`` by correlation."""
    lags = {f"{spec.target}_lag_{n}" for n in strategy.lags}
    sizes = {str(n) for n in strategy.windows}

    def wanted(name: str) -> bool:
        if "_lag_" in name:
            return name in lags
        return name.rsplit("_", 1)[-1] in sizes if "_rolling_" in name else True

    names = [n for n in model_features(frame, spec) if wanted(n)]
    if len(names) <= strategy.max_features:
        return names
    chosen = select_by_correlation(frame, names, spec.target, strategy.max_features).where("selected = 1")
    picked = {r["feature"] for r in chosen.select("feature").collect()}
    return [n for n in names if n in picked]


def strategy_postprocess(df: DataFrame, strategy: Strategy, prediction: str, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Clip at zero, smooth each series over its weeks, cap by the mean prediction."""
    out = clip_nonnegative(df, prediction)
    if strategy.smoothing > 0:
        out = ewm_smooth(out, prediction, strategy.smoothing, spec)
    if strategy.cap_multiplier > 0:
        out = cap_by_mean(out, strategy.cap_multiplier, prediction)
    return out


def fit_predict_strategy(
    frame: DataFrame,
    strategy: Strategy,
    spec: SeriesSpec = DEFAULT,
    holdout_weeks: int = 4,
) -> DataFrame:
    """Forecasts of the newest weeks by the strategy, fitted on the weeks before them.

    ``frame`` comes from ``strategy_frame``. Returns the panel key, the actual and the prediction. A series
    that a model can't forecast (a new one has no seasonal fit) gets the others, their weights summing to one.
    """
    last = frame.agg(F.max(spec.week_date).alias("_last"))
    recent = F.col(spec.week_date) > F.date_sub("_last", 7 * holdout_weeks)
    marked = with_scalars(frame, last).withColumn("is_train", ~recent).drop("_last")
    features = strategy_features(frame, strategy, spec)
    train, out = marked.where("is_train"), marked.where("NOT is_train")
    names, weights = [], []
    for name, (weight, model) in strategy.models.items():
        if model.kind == "seasonal_trend":
            fitted = fit_seasonal_trend(marked, "is_train", spec, mode=model.params["mode"], prediction=name)
            out = out.join(fitted.where("NOT is_train").select(*spec.panel_key, name), spec.panel_key, "left")
        else:
            out = predict(fit(train, features, model, spec.target, name), out, name)
        names.append(name)
        weights.append(weight)
    combined = weighted_ensemble(out, names, weights, "prediction")
    done = strategy_postprocess(combined, strategy, "prediction", spec)
    return done.select(
        F.lit(strategy.name).alias("strategy"), *spec.panel_key, spec.week_date, spec.target, "prediction"
    )


def run_all_strategies(
    panel: DataFrame,
    strategies: Sequence[Strategy] = STRATEGIES,
    spec: SeriesSpec = DEFAULT,
    holdout_weeks: int = 4,
) -> DataFrame:
    """Forecasts of every strategy over one shared feature table."""
    frame = strategy_frame(panel, strategies, spec)
    out = None
    for strategy in strategies:
        part = fit_predict_strategy(frame, strategy, spec, holdout_weeks)
        out = part if out is None else out.unionByName(part)
    return out


def strategy_metrics(forecasts: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """(strategy, wmape, mae, rmse, mape) as fractions."""
    return quick_metrics(forecasts, spec.target, "prediction", ["strategy"])
