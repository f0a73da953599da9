"""Joins of facts with dimensions, statistics and each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.functions.scalars import flag, numeric_columns
from weekcast.operators.clean import fill_unmatched, require, standardize_key
from weekcast.plans.scale import attach, materialize, quantile_row, value_ranks
from weekcast.spec import (
    DEFAULT,
    PRODUCT_ATTRIBUTES,
    PRODUCT_KEY_NAMES,
    STORE_ATTRIBUTES,
    STORE_KEY_NAMES,
    SeriesSpec,
)


def _join_dimension(
    fact: DataFrame, dim: DataFrame, key: str, candidates: Sequence[str], attributes: Sequence[str], suffix: str
) -> DataFrame:
    dim = standardize_key(dim, key, candidates)
    clashes = {c: f"{c}_{suffix}" for c in dim.columns if c != key and c in fact.columns}
    dim = dim.withColumnsRenamed(clashes)
    fact = fact.withColumn(key, F.col(key).cast("string"))
    filled = [clashes.get(a, a) for a in attributes if clashes.get(a, a) in dim.columns]
    numeric = [c for c in filled if c in numeric_columns(dim)]
    joined = fill_unmatched(attach(fact, dim, [key]), [c for c in filled if c not in numeric])
    if not numeric:
        return joined
    # The median over the joined rows is a median over the dimension weighted by rows per key: one
    # pass over the key column, kept because it is read several times.
    rows = materialize(fact.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), "rows")
    weighted = attach(rows, dim.select(key, *numeric), [key])
    holes = weighted.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).head()
    open_columns = [c for c in numeric if holes[c]]
    joined = joined.withColumns({c: F.col(c).cast("double") for c in numeric})
    if not open_columns:
        return joined
    medians = quantile_row(weighted, open_columns, [0.5], "_median_{column}", weight="_rows")
    return fill_unmatched(joined, open_columns, medians=medians)


def join_stores(fact: DataFrame, stores: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Left join with the store master; clashing names get the suffix ``_store``."""
    return _join_dimension(fact, stores, spec.store, STORE_KEY_NAMES, STORE_ATTRIBUTES, "store")


def join_products(fact: DataFrame, products: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Left join with the product master; clashing names get the suffix ``_product``."""
    return _join_dimension(fact, products, spec.product, PRODUCT_KEY_NAMES, PRODUCT_ATTRIBUTES, "product")


def merge_master_data(
    fact: DataFrame,
    products: DataFrame | None = None,
    stores: DataFrame | None = None,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    if stores is not None:
        fact = join_stores(fact, stores, spec)
    if products is not None:
        fact = join_products(fact, products, spec)
    return fact


def match_rate(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows of the fact and how many found a partner in the dimension."""
    marked = attach(fact.select(key), dim.select(key).distinct().withColumn("_hit", F.lit(1)), [key])
    return marked.agg(F.count(F.lit(1)).alias("rows"), F.count("_hit").alias("matched"))


def attach_group_stats(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Group statistics on every row: one aggregation (partial on the map side), one side join."""
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    return attach(df, stats, keys)


def combine_feature_sets(
    base: DataFrame, *others: DataFrame, spec: SeriesSpec = DEFAULT, keys: Sequence[str] | None = None
) -> DataFrame:
    """Left join feature tables on the full panel key, keeping only columns not seen yet."""
    keys = list(keys or spec.panel_key)
    require(base, keys)
    out = base
    for other in others:
        require(other, keys)
        new = [c for c in other.columns if c not in out.columns]
        if new:
            out = out.join(other.select(*keys, *new), keys, "left")
    return out


def top_values(df: DataFrame, column: str, k: int, weight: Column | None = None) -> DataFrame:
    """The k most frequent values, ties by value."""
    size = (weight if weight is not None else F.count(F.lit(1))).alias("_size")
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(size)
    return counts.orderBy(F.desc("_size"), F.asc(column)).limit(k)


def in_top_k(df: DataFrame, column: str, k: int, name: str, weight: Column | None = None) -> DataFrame:
    """1 on rows whose value is among the k most frequent ones."""
    best = top_values(df, column, k, weight).select(column, F.lit(1).alias("_hit"))
    return attach(df, best, [column], rows=k).withColumn(name, flag(F.col("_hit") == 1)).drop("_hit")


def history_stats(history: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return history.groupBy(*spec.series).agg(
        F.avg(spec.target).alias("history_mean"), F.max(spec.target).alias("history_max")
    )


def join_history_bounds(forecast: DataFrame, history: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Historical mean and maximum of each series beside its forecasts.

    A series has at most one forecast a week, so a shuffled join on the series needs no salt.
    """
    return attach(forecast, history_stats(history, spec), spec.series, salts=1)


def align_actual_predicted(actual: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return actual.join(predicted, list(keys), "inner")


def rank_entities(totals: DataFrame, value: str, name: str) -> DataFrame:
    """Dense rank (largest first), average-rank percentile, and top flags of entity totals."""
    ranks = value_ranks(totals, value)
    dense = F.col("values_total") - F.col("values_below")
    percentile = (F.col("rows_below") + (F.col("peers") + 1) / 2) / F.col("rows_total")
    table = ranks.select(value, dense.cast("long").alias(f"{name}_rank"), percentile.alias(f"{name}_percentile"))
    return attach(totals, table, [value]).withColumns(
        {
            f"is_{name}_top10": flag(F.col(f"{name}_rank") <= 10),
            f"is_{name}_top100": flag(F.col(f"{name}_rank") <= 100),
            f"is_{name}_top_percentile": flag(F.col(f"{name}_percentile") >= 0.9),
        }
    )
