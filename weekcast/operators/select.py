"""Feature selection: correlation, univariate scores, collinearity, model-based ranking."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.scalars import col, correlation, divide, numeric_columns
from weekcast.operators.neighbours import mutual_information_knn
from weekcast.plans.scale import attach, column_ranks, located_values, materialize, unpivot_numeric, value_ranks, with_scalars
from weekcast.spec import DEFAULT, SeriesSpec

# Aggregate expressions per pass; more make the generated code too large.
PAIRS_PER_PASS = 300


def filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles with nulls as 0."""
    return df.select(*[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def _long(row: DataFrame, structs: list) -> DataFrame:
    return row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def pair_correlations(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple] | None = None) -> DataFrame:
    """(feature_1, feature_2, correlation) of every pair; NULL where a column is constant.

    All pairs of a pass share one scan with partial aggregation; only k x k numbers are exchanged. Where there are
    more pairs than an aggregation can hold, those of columns without nulls come from one Gram matrix.
    """
    pairs = list(pairs or combinations(columns, 2))
    if len(pairs) > PAIRS_PER_PASS:
        return _many_pairs(df, pairs)
    return _few_pairs(df, pairs)


def _many_pairs(df: DataFrame, pairs: list[tuple]) -> DataFrame:
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    src = df.select(*[col(c).cast("double").alias(c) for c in columns])
    facts = src.agg(*[F.count_if(col(c).isNull() | F.isnan(c)).alias(c) for c in columns]).first()
    whole = [c for c in columns if facts[c] == 0]
    place = {c: i for i, c in enumerate(whole)}
    rest = [p for p in pairs if not (p[0] in place and p[1] in place)]
    assembled = VectorAssembler(inputCols=whole, outputCol="_v").transform(src.select(*whole))
    matrix = Correlation.corr(assembled, "_v").head()[0].toArray()  # columns x columns
    rows = [
        (a, b, None if np.isnan(matrix[place[a], place[b]]) else float(matrix[place[a], place[b]]))
        for a, b in pairs if a in place and b in place
    ]
    out = df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, correlation double")
    return out.unionByName(_few_pairs(df, rest)) if rest else out


def _few_pairs(df: DataFrame, pairs: list[tuple]) -> DataFrame:
    src = df.select(*[col(c).cast("double").alias(c) for c in dict.fromkeys(c for p in pairs for c in p)])
    out = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[start : start + PAIRS_PER_PASS]
        row = src.agg(*[correlation(col(a), col(b)).alias(f"_{i}") for i, (a, b) in enumerate(chunk)])
        structs = [
            F.struct(
                F.lit(a).alias("feature_1"),
                F.lit(b).alias("feature_2"),
                F.col(f"_{i}").alias("correlation"),
            )
            for i, (a, b) in enumerate(chunk)
        ]
        part = _long(row, structs)
        out = part if out is None else out.unionByName(part)
    return out


def target_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, correlation) with the target, nulls as 0, constants dropped."""
    src = filled(df, [*features, target])
    pairs = pair_correlations(src, [], [(f, target) for f in features])
    return pairs.where(F.col("correlation").isNotNull()).select(F.col("feature_1").alias("feature"), "correlation")


def _selected(scores: DataFrame, score: str, k: int) -> DataFrame:
    """Ranks a table of one row per feature and marks the first k."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), F.asc("feature"))
    return scores.withColumn("rank", F.row_number().over(order)).withColumn(
        "selected", (F.col("rank") <= k).cast("int")
    )


def top_k_features(scores: DataFrame, score: str, k: int) -> DataFrame:
    return _selected(scores, score, k).where(F.col("selected") == 1).drop("selected")


def select_by_correlation(df: DataFrame, features: Sequence[str], target: str, k: int) -> DataFrame:
    scores = target_correlations(df, features, target)
    return _selected(scores.withColumn("correlation", F.abs("correlation")), "correlation", k)


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Upper triangle of the Pearson or Spearman matrix as (feature_1, feature_2, correlation)."""
    if method == "pearson":
        return pair_correlations(df, columns)
    if method != "spearman":
        raise ValueError(f"unsupported method: {method}")
    return spearman_pairs(df, columns)


def _average_ranks(long: DataFrame) -> DataFrame:
    """Adds ``_rank``, the average rank of each value within its column, to (column, value) rows."""
    ranks = value_ranks(long, "value", ["column"]).select(
        "column", "value", "peers", (F.col("rows_below") + (F.col("peers") + 1) / 2).alias("_rank")
    )
    return attach(long, ranks, ["column", "value"], "inner", weight="peers").drop("peers")


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation as Pearson over average ranks, ranked without a single-task sort.

    Each pair is ranked over the rows where both values are present. Columns without nulls are ranked once, in one
    plan, however many there are; only pairs with nulls are ranked by themselves, and those together in another.
    """
    columns = list(columns)
    rows = materialize(
        df.select(F.monotonically_increasing_id().alias("_id"), *[col(c).cast("double").alias(c) for c in columns]), "rows"
    )
    nulls = rows.agg(*[F.count_if(col(c).isNull()).alias(c) for c in columns]).first() if columns else {}
    whole = [c for c in columns if nulls[c] == 0]
    found = None
    if len(whole) > 1:
        found = pair_correlations(column_ranks(rows, whole, "_id"), whole)
    partial = [(a, b) for a, b in combinations(columns, 2) if nulls[a] or nulls[b]]
    if partial:
        sides = [
            F.struct(
                F.lit(i).alias("pair"), F.lit(side).alias("side"), F.concat_ws("|", F.lit(i), F.lit(side)).alias("column"),
                F.when(col(a).isNotNull() & col(b).isNotNull(), col(c)).alias("value"),
            )
            for i, (a, b) in enumerate(partial)
            for side, c in enumerate((a, b))
        ]
        long = rows.select("_id", F.inline(F.array(*sides))).where(F.col("value").isNotNull())
        both = _average_ranks(long).groupBy("pair", "_id").agg(
            *[F.max(F.when(F.col("side") == s, F.col("_rank"))).alias(n) for s, n in ((0, "_x"), (1, "_y"))]
        )
        by_pair = both.groupBy("pair").agg(correlation(F.col("_x"), F.col("_y")).alias("correlation"))
        names = F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2")) for a, b in partial])
        every = df.sparkSession.range(len(partial)).select(F.col("id").cast("int").alias("pair"))
        part = every.join(by_pair, "pair", "left").select(F.get(names, F.col("pair")).alias("_n"), "correlation")
        part = part.select("_n.*", "correlation")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else pair_correlations(df, columns)


def high_pairs(matrix: DataFrame, threshold: float, target: str | None = None) -> DataFrame:
    """Feature pairs with |r| at or above the threshold, target left out."""
    out = matrix.where(F.abs("correlation") >= threshold)
    return out if target is None else out.where((F.col("feature_1") != target) & (F.col("feature_2") != target))


def drop_correlated(df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.95) -> DataFrame:
    """(feature) rows to drop: of each high pair, the one less correlated with the target."""
    scores = target_correlations(df, features, target).withColumn("correlation", F.abs("correlation"))
    pairs = high_pairs(pair_correlations(df, features), threshold).select("feature_1", "feature_2")
    first = scores.select(F.col("feature").alias("feature_1"), F.col("correlation").alias("_c1"))
    second = scores.select(F.col("feature").alias("feature_2"), F.col("correlation").alias("_c2"))
    both = attach(attach(pairs, first, ["feature_1"], rows=len(features)), second, ["feature_2"], rows=len(features))
    weaker = F.coalesce("_c1", F.lit(0.0)) < F.coalesce("_c2", F.lit(0.0))
    loser = F.when(weaker, F.col("feature_1")).otherwise(F.col("feature_2"))
    return both.select(loser.alias("feature")).distinct()


def f_regression_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, score): F = r^2 / (1 - r^2) * (n - 2)."""
    r2 = F.col("correlation") * F.col("correlation")
    counted = with_scalars(target_correlations(df, features, target), df.agg(F.count(F.lit(1)).alias("_n")))
    return counted.select("feature", (divide(r2, 1 - r2) * (F.col("_n") - 2)).alias("score"))


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[tuple[float, bool]]]:
    """Per column, for every bin but the first, the value where it begins and whether that value is in it.

    A row's bin is its average rank as a share of the rows, times ``bins``, so it grows with the value: the values at ``bins`` - 1
    positions, of which only these numbers come to the driver, tell the bins of all rows.
    """
    places = [F.floor((F.col("_total") * b + (bins - 1)) / bins).cast("long") - 1 for b in range(1, bins)]
    at = located_values(unpivot_numeric(df, columns), "value", places, ["column"], groups=len(columns))
    share = (F.col("_start") + (F.col("_n") + 1) / 2) / F.col("_total") * bins
    picks = []
    for b, place in enumerate(places, 1):
        here = (place >= F.col("_start")) & (place < F.col("_end"))
        picks += [F.max(F.when(here, F.col("_value"))).alias(f"v{b}"), F.max(F.when(here, F.floor(share) >= b)).alias(f"in{b}")]
    rows = {r["column"]: r for r in at.groupBy("column").agg(*picks).collect()}
    return {c: [(rows[c][f"v{b}"], rows[c][f"in{b}"]) for b in range(1, bins)] if c in rows else [] for c in columns}


def rank_bin(value: Column, edges: Sequence[tuple[float, bool]]) -> Column:
    out = F.lit(0)
    for edge, inside in edges:
        out = out + (value >= F.lit(edge) if inside else value > F.lit(edge)).cast("int")
    return out


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, score): mutual information in nats over equal-frequency bins.

    The fast, binned estimator; ``mutual_information_knn`` is the one by nearest neighbours. Bins follow average ranks, so ties share one.
    """
    src = filled(df, [*features, target])
    bin_of = {c: rank_bin(col(c), edges) for c, edges in bin_edges(src, [*features, target], bins).items()}
    pairs = F.array(*[F.struct(F.lit(f).alias("column"), bin_of[f].alias("_bin")) for f in features])
    cells = (
        src.select(bin_of[target].alias("_target_bin"), F.explode(pairs).alias("_p"))
        .groupBy("_p.column", "_p._bin", "_target_bin")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    per_feature = Window.partitionBy("column")
    x = F.sum("_n").over(Window.partitionBy("column", "_bin"))
    y = F.sum("_n").over(Window.partitionBy("column", "_target_bin"))
    total = F.sum("_n").over(per_feature)
    parts = cells.select("column", "_n", x.alias("_x"), y.alias("_y"), total.alias("_t"))
    joint = F.col("_n") / F.col("_t")
    term = joint * F.log(F.col("_n") * F.col("_t") / (F.col("_x") * F.col("_y")))
    return parts.groupBy(F.col("column").alias("feature")).agg(F.sum(term).alias("score"))


def select_k_best(df: DataFrame, features: Sequence[str], target: str, k: int, score: str = "f") -> DataFrame:
    """The ``k`` best by F value ("f"), by information over bins ("bins"), or by information of neighbours ("knn")."""
    scorer = {"f": f_regression_scores, "knn": mutual_information_knn}.get(score, mutual_information)
    return _selected(scorer(df, features, target), "score", k)


def _vectors(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    src = filled(df, [*features, target])
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(src).select(
        "features", F.col(target).alias("label")
    )


def _importance_rows(df: DataFrame, features: Sequence[str], values) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, values)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    top = Window.partitionBy(F.lit(0))
    return table.withColumn(
        "importance_normalized", F.coalesce(divide(F.col("importance"), F.max("importance").over(top)), F.lit(0.0))
    )


def tree_importance(
    df: DataFrame, features: Sequence[str], target: str, trees: int = 100, depth: int = 10, seed: int = 42
) -> DataFrame:
    forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(_vectors(df, features, target))
    return _importance_rows(df, features, model.featureImportances.toArray())


def rfe(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    k: int,
    estimator: str = "random_forest",
    step: int = 1,
    trees: int = 20,
    depth: int = 6,
    seed: int = 42,
) -> DataFrame:
    """(feature, ranking, selected): refit and drop the weakest ``step`` features until k remain.

    The matrix is written once; every round reads it and fits an MLlib model.
    """
    left, order = list(features), []
    src = materialize(filled(df, [*features, target]), "rfe")
    while len(left) > k:
        data = _vectors(src, left, target)
        if estimator == "linear_regression":
            weights = np.abs(LinearRegression(solver="normal", regParam=1e-9).fit(data).coefficients.toArray())
        elif estimator == "random_forest":
            forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)
            weights = forest.fit(data).featureImportances.toArray()
        else:
            raise ValueError(f"unsupported estimator: {estimator}")
        drop = min(step, len(left) - k)
        weakest = [left[i] for i in np.argsort(weights, kind="stable")[:drop]]
        order.append(weakest)
        left = [f for f in left if f not in weakest]
    rows = [(f, 1, 1) for f in left]
    for distance, names in enumerate(reversed(order), start=2):
        rows += [(f, distance, 0) for f in names]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int, selected int")


def vif(df: DataFrame, features: Sequence[str], threshold: float = 10.0) -> DataFrame:
    """(feature, vif, is_high) without an intercept, constants removed.

    One aggregation yields the k x k Gram matrix; only that matrix is inverted on the driver.
    """
    src = filled(df, features)
    spread = src.agg(*[F.min(col(f)).alias(f"lo_{i}") for i, f in enumerate(features)],
                     *[F.max(col(f)).alias(f"hi_{i}") for i, f in enumerate(features)]).head()
    kept = [f for i, f in enumerate(features) if spread is not None and spread[f"lo_{i}"] != spread[f"hi_{i}"]]
    k = len(kept)
    gram = np.zeros((k, k))
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    for start in range(0, len(cells), PAIRS_PER_PASS):
        chunk = cells[start : start + PAIRS_PER_PASS]
        sums = src.agg(*[F.sum(col(kept[i]) * col(kept[j])).alias(f"_{n}") for n, (i, j) in enumerate(chunk)]).head()
        for n, (i, j) in enumerate(chunk):
            gram[i, j] = gram[j, i] = sums[n]
    scale = np.sqrt(np.diag(gram)) if k else np.ones(0)
    inverse = np.linalg.pinv(gram / np.outer(scale, scale)) if k else gram
    rows = [(f, float(inverse[i, i]), int(inverse[i, i] > threshold)) for i, f in enumerate(kept)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, is_high int")


def _names(frame: DataFrame, where: str | None = None) -> list[str]:
    """Feature names of a score table: at most one per column of the input."""
    rows = frame.where(where) if where else frame
    return [r["feature"] for r in rows.select("feature").collect()]


def selection_pipeline(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    correlation_threshold: float = 0.95,
    vif_threshold: float = 10.0,
    selection: str = "rfe",
    k: int = 50,
    trees: int = 20,
    depth: int = 6,
) -> DataFrame:
    """(feature, stage, importance): the stage at which each feature left, or 'final'."""
    src = materialize(filled(df, [*features, target]), "selection")
    correlated = set(_names(drop_correlated(src, features, target, correlation_threshold)))
    left = [f for f in features if f not in correlated]
    importance = tree_importance(src, left, target, trees, depth)
    if selection == "rfe":
        chosen = rfe(src, left, target, min(k, len(left)), step=max(1, len(left) // 4), trees=trees, depth=depth)
    elif selection == "kbest":
        chosen = select_k_best(src, left, target, k)
    else:
        raise ValueError(f"unsupported selection: {selection}")
    picked = _names(chosen, "selected = 1")
    high = set(_names(vif(src, picked, vif_threshold), "is_high = 1"))
    stage = {
        f: "correlated" if f in correlated
        else "not_selected" if f not in picked
        else "high_vif" if f in high
        else "final"
        for f in features
    }
    rows = df.sparkSession.createDataFrame(list(stage.items()), "feature string, stage string")
    return attach(rows, importance.select("feature", "importance"), ["feature"], rows=len(features))


def select_features(
    df: DataFrame, target: str, method: str = "correlation", k: int = 50, spec: SeriesSpec = DEFAULT, **options
) -> DataFrame:
    """The frame reduced to keys, target and the k features the named method picks."""
    keys = [c for c in dict.fromkeys([*spec.panel_key, spec.week_date, target]) if c in df.columns]
    features = numeric_columns(df, exclude=keys)
    if method == "correlation":
        names = _names(select_by_correlation(df, features, target, k), "selected = 1")
    elif method == "rfe":
        names = _names(rfe(df, features, target, k, **options), "selected = 1")
    elif method in ("f", "mutual_information"):
        names = _names(select_k_best(df, features, target, k, method), "selected = 1")
    elif method == "importance":
        names = _names(top_k_features(tree_importance(df, features, target, **options), "importance", k))
    else:
        raise ValueError(f"unsupported method: {method}")
    return df.select(*keys, *[f for f in features if f in names])


