"""Product- and store-level features.

Everything is computed at entity grain once and attached to the panel, so the panel is never
shuffled on a product or store key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weekcast.functions.scalars import divide, flag, slug, zip_region
from weekcast.operators.joins import rank_entities, top_values
from weekcast.plans.scale import JOIN_SALTS, attach, hot_buckets, materialize, numbered, quantile_row, quantiles, with_scalars
from weekcast.spec import DEFAULT, SeriesSpec

TOP_CATEGORIES = 10
TOP_BRANDS = 20


def _stat_columns(name: str, spec: SeriesSpec) -> list[Column]:
    q = F.col(spec.target)
    return [
        F.avg(q).alias(f"{name}_qty_mean"),
        F.stddev_samp(q).alias(f"{name}_qty_std"),
        F.min(q).alias(f"{name}_qty_min"),
        F.max(q).alias(f"{name}_qty_max"),
        F.sum(q).alias(f"{name}_qty_total"),
        F.count(q).alias(f"{name}_num_sales"),
    ]


def _activity_columns(name: str, spec: SeriesSpec) -> list[Column]:
    week = F.col(spec.week_date)
    # Weeks of one entity are a part of the calendar.
    return [
        (F.datediff(F.max(week), F.min(week)) / 7).alias(f"{name}_weeks_span"),
        F.size(F.collect_set(week)).cast("long").alias(f"{name}_weeks_active"),
    ]


def _with_median(table: DataFrame, df: DataFrame, entity: str, name: str, spec: SeriesSpec) -> DataFrame:
    """Adds the median and the variation. Both tables have one row per entity and are partitioned by it."""
    median = quantiles(df, spec.target, [0.5], [entity], names=[f"{name}_qty_median"])
    variation = divide(F.col(f"{name}_qty_std"), F.col(f"{name}_qty_mean"))
    joined = table.join(median, entity, "left")
    return joined.withColumn(f"{name}_qty_cv", F.coalesce(variation, F.lit(0.0)))


def _with_rate(table: DataFrame, name: str, ratio: str) -> DataFrame:
    return table.withColumn(ratio, F.col(f"{name}_weeks_active") / (F.col(f"{name}_weeks_span") + 1))


def entity_stats(df: DataFrame, entity: str, name: str, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Mean, median, std, min, max, total, rows and variation of the target per entity."""
    return _with_median(df.groupBy(entity).agg(*_stat_columns(name, spec)), df, entity, name, spec)


def product_stats(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return entity_stats(df, spec.product, "product", spec)


def store_stats(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return entity_stats(df, spec.store, "store", spec)


def entity_activity(df: DataFrame, entity: str, name: str, ratio: str, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Weeks between first and last sale, distinct active weeks, and their ratio."""
    return _with_rate(df.groupBy(entity).agg(*_activity_columns(name, spec)), name, ratio)


def product_velocity(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return entity_activity(df, spec.product, "product", "product_velocity", spec)


def store_activity(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return entity_activity(df, spec.store, "store", "store_activity", spec)


def store_diversity(df: DataFrame, spec: SeriesSpec = DEFAULT, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(spec.store).agg(count(F.col(spec.product)).alias("store_num_products"))


def brand_breadth(df: DataFrame, spec: SeriesSpec = DEFAULT, brand: str = "brand", top: int = TOP_BRANDS) -> DataFrame:
    """Distinct products per brand and whether the brand is among the widest."""
    breadth = df.where(F.col(brand).isNotNull()).groupBy(brand).agg(
        F.count_distinct(spec.product).alias("brand_num_products")
    )
    best = breadth.orderBy(F.desc("brand_num_products"), F.asc(brand)).limit(top)
    marked = attach(breadth, best.select(brand, F.lit(1).alias("_hit")), [brand], rows=top)
    return marked.withColumn("is_top_brand", flag(F.col("_hit") == 1)).drop("_hit")


def product_subcategories(df: DataFrame, spec: SeriesSpec = DEFAULT, subcategory: str = "subcategory") -> DataFrame:
    return df.groupBy(spec.product).agg(F.count_distinct(subcategory).alias("product_num_subcategories"))


def price_tiers(df: DataFrame, price: str = "unit_price", source: DataFrame | None = None) -> DataFrame:
    """Cheap, middle and expensive flags from the price quartiles over the rows of ``source``."""
    quarts = quantile_row(df if source is None else source, [price], [0.25, 0.75], "_{name}", ["p25", "p75"])
    p, low, high = F.col(price), F.col("_p25"), F.col("_p75")
    return (
        with_scalars(df, quarts)
        .withColumns(
            {
                "is_cheap": flag(p <= low),
                "is_mid_price": flag((p > low) & (p <= high)),
                "is_expensive": flag(p > high),
            }
        )
        .drop("_p25", "_p75")
    )


def _one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> dict:
    return {f"{prefix}_{slug(str(v))}": flag(F.col(column) == F.lit(v)) for v in values}


def category_onehot(
    df: DataFrame, column: str = "category", k: int = TOP_CATEGORIES, source: DataFrame | None = None,
    values: Sequence[str] | None = None,
) -> DataFrame:
    """0/1 columns for the k most frequent categories (ties by name), or for ``values``, and for the rest.

    The category names become column names, so at most k of them are read on the driver.
    """
    counted = df if source is None else source
    names = list(values) if values is not None else [r[0] for r in top_values(counted, column, k).select(column).collect()]
    other = {f"{column}_other": flag(~F.coalesce(F.col(column).isin(names), F.lit(False)))}
    return df.withColumns({**_one_hot(df, column, names, column), **other})


# A table of more 0/1 columns than this is no use; the long form has no such bound.
MOST_COLUMNS = 2_000


def dimension_values(dim: DataFrame, column: str) -> list:
    """Distinct attribute values in order. They become column names, so at most ``MOST_COLUMNS`` are read on the driver;
    with more it is an error."""
    values = dim.select(column).where(F.col(column).isNotNull()).distinct()
    found = sorted(r[0] for r in values.limit(MOST_COLUMNS + 1).collect())
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{column} has over {MOST_COLUMNS} values: name the wanted ones, or use store_type_long")
    return found


STORE_TYPES = {"premise": "store_type", "store_category": "store_category", "zipcode": "region"}


def _store_types(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., attribute, value): one row per attribute that a row has."""
    shown = {"zipcode": zip_region(F.col("zipcode"))} if "zipcode" in df.columns else {}
    pairs = [
        F.struct(F.lit(name).alias("attribute"), shown.get(column, F.col(column)).cast("string").alias("value"))
        for column, name in STORE_TYPES.items() if column in df.columns
    ]
    long = df.select(*keep, F.inline(F.array(*pairs)))
    return long.where(F.col("value").isNotNull())


def store_type_index(stores: DataFrame) -> DataFrame:
    """(attribute, value, position): every value of the store attributes with its place in their order, from 1.

    The columns of a sparse 0/1 matrix, as a table: however many values there are, none comes to the driver.
    """
    return numbered(_store_types(stores, []).distinct(), "position", ["attribute", "value"])


def store_type_long(df: DataFrame, keys: Sequence[str], index: DataFrame) -> DataFrame:
    """(keys..., attribute, value, position) of every 1 in the sparse 0/1 matrix of ``df``; values that are not in
    ``index`` have none."""
    return attach(_store_types(df, keys), index, ["attribute", "value"], "inner").select(*keys, "attribute", "value", "position")


def store_type_onehot(
    df: DataFrame, stores: DataFrame | None = None, values: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """0/1 columns for premise, store category and first zip digit.

    ``values`` fixes the values of an attribute, and so the columns. Otherwise the distinct values come from the
    store master when given, which spares a pass over the facts.
    """
    source = stores if stores is not None else df
    values = values or {}
    added = {}
    for column, prefix in (("premise", "store_type"), ("store_category", "store_category")):
        if column in df.columns:
            found = values[column] if column in values else dimension_values(source, column)
            added.update(_one_hot(df, column, found, prefix))
    if "zipcode" in df.columns:
        region = zip_region(F.col("zipcode"))
        regions = values.get("zip_region")
        if regions is None:
            regions = dimension_values(source.select(zip_region(F.col("zipcode")).alias("r")), "r")
        added["zip_region"] = region
        added.update({f"region_{slug(r)}": flag(region == F.lit(r)) for r in regions})
    return df.withColumns(added)


def zip_table(df: DataFrame, zipcode: str = "zipcode") -> DataFrame:
    """Rows per zip code, and whether that is at or above the 75th percentile over the rows."""
    density = df.where(F.col(zipcode).isNotNull()).groupBy(zipcode).agg(F.count(F.lit(1)).alias("zip_density"))
    cut = quantiles(density, "zip_density", [0.75], weight="zip_density", names=["_cut"])
    return with_scalars(density, cut).select(
        zipcode, "zip_density", flag(F.col("zip_density") >= F.col("_cut")).alias("is_urban")
    )


def zip_density(df: DataFrame, zipcode: str = "zipcode", source: DataFrame | None = None) -> DataFrame:
    source = df if source is None else source
    out = attach(df, zip_table(source, zipcode), [zipcode], counted=source)
    return out.withColumn("is_urban", F.coalesce(F.col("is_urban"), F.lit(0)))


def entity_ranking(df: DataFrame, entity: str, name: str, spec: SeriesSpec = DEFAULT) -> DataFrame:
    totals = df.groupBy(entity).agg(F.sum(spec.target).alias(f"{name}_total"))
    return rank_entities(totals, f"{name}_total", name)


def target_encoding(df: DataFrame, spec: SeriesSpec = DEFAULT, leak_safe: bool = False) -> DataFrame:
    """Mean target per product, per store and per series on every row.

    ``leak_safe`` uses earlier weeks only: running sums over the rows of an entity (see ``windowed``), or sums per
    (entity, week) accumulated over weeks, a table of entities x weeks, and attached on (entity, week).
    """
    q = F.col(spec.target)
    groups = {
        "product_mean_encoding": [spec.product],
        "store_mean_encoding": [spec.store],
        "series_mean_encoding": spec.series,
    }
    out = df
    for name, keys in groups.items():
        salts = 1 if keys == spec.series else JOIN_SALTS
        if leak_safe and windowed(df, keys, spec):
            past = _earlier(keys, spec)
            known = F.col(spec.week_date).isNotNull()
            for key in keys:
                known = known & F.col(key).isNotNull()
            out = out.withColumn(name, F.when(known, divide(F.sum(q).over(past), F.count(q).over(past))))
        elif leak_safe:
            out = attach(out, _past_mean(df, keys, name, spec), [*keys, spec.week_date], salts=salts, counted=df)
        else:
            out = attach(out, df.groupBy(*keys).agg(F.avg(q).alias(name)), keys, salts=salts, counted=df)
    return out


def windowed(df: DataFrame, keys: Sequence[str], spec: SeriesSpec) -> bool:
    """Whether statistics of earlier weeks are taken by windows over the rows of each entity, without a side table.

    Right where no entity has more rows than a task should hold (see ``hot_buckets``): the rows are exchanged once, where
    a table of entities x weeks that is about as long is exchanged three times and written.
    """
    return df.schema[spec.week_date].dataType.simpleString() == "date" and not hot_buckets(df, keys)


def _earlier(keys: Sequence[str], spec: SeriesSpec) -> WindowSpec:
    """The rows of an entity in the weeks before a row's week."""
    ordered = Window.partitionBy(*keys).orderBy(F.unix_date(spec.week_date).cast("long"))
    return ordered.rangeBetween(Window.unboundedPreceding, -1)


def _past_mean(df: DataFrame, keys: Sequence[str], name: str, spec: SeriesSpec) -> DataFrame:
    weekly = df.groupBy(*keys, spec.week_date).agg(F.sum(spec.target).alias("_s"), F.count(spec.target).alias("_c"))
    past = Window.partitionBy(*keys).orderBy(spec.week_date).rowsBetween(Window.unboundedPreceding, -1)
    return weekly.select(
        *keys, spec.week_date, divide(F.sum("_s").over(past), F.sum("_c").over(past)).alias(name)
    )


def _entity_table(
    df: DataFrame, entity: str, name: str, ratio: str, spec: SeriesSpec, distinct: str | None, distinct_name: str
) -> DataFrame:
    """One aggregation for everything but the median, written once before it is ranked."""
    columns = _stat_columns(name, spec)
    dated = spec.week_date in df.columns
    if dated:
        columns += _activity_columns(name, spec)
    if distinct is not None:
        columns.append(F.count_distinct(distinct).alias(distinct_name))
    table = _with_median(df.groupBy(entity).agg(*columns), df, entity, name, spec)
    table = _with_rate(table, name, ratio) if dated else table
    return rank_entities(materialize(table, f"{name}-table"), f"{name}_qty_total", name)


def product_table(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """All product-grain features, one row per product."""
    subcategory = "subcategory" if "subcategory" in df.columns else None
    return _entity_table(
        df, spec.product, "product", "product_velocity", spec, subcategory, "product_num_subcategories"
    )


def store_table(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """All store-grain features, one row per store."""
    return _entity_table(df, spec.store, "store", "store_activity", spec, spec.product, "store_num_products")


def entity_history(df: DataFrame, entity: str, name: str, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """(entity, week_date, statistics of the rows in earlier weeks): a table of entities x weeks.

    Weekly sums are combined on the map side; running sums go over the weeks of one entity.
    """
    q = F.col(spec.target).cast("double")
    weekly = df.groupBy(entity, spec.week_date).agg(
        F.sum(q).alias("_s"), F.sum(q * q).alias("_s2"), F.count(q).alias("_c"), F.min(q).alias("_lo"), F.max(q).alias("_hi")
    )
    past = Window.partitionBy(entity).orderBy(spec.week_date).rowsBetween(Window.unboundedPreceding, -1)
    found = _past_columns(
        name, F.sum("_s").over(past), F.sum("_s2").over(past), F.sum("_c").over(past), F.min("_lo").over(past),
        F.max("_hi").over(past), F.count(F.lit(1)).over(past),
    )
    return weekly.select(entity, spec.week_date, *[e.alias(n) for n, e in found.items()])


def _past_columns(
    name: str, total: Column, squares: Column, rows: Column, low: Column, high: Column, weeks: Column
) -> dict[str, Column]:
    mean = divide(total, rows)
    spread = divide(squares - rows * mean * mean, rows - 1)
    return {
        f"{name}_past_mean": mean,
        f"{name}_past_std": F.sqrt(F.greatest(spread, F.lit(0.0))),
        f"{name}_past_min": low,
        f"{name}_past_max": high,
        f"{name}_past_total": F.coalesce(total, F.lit(0.0)),
        f"{name}_past_rows": F.coalesce(rows, F.lit(0)),
        f"{name}_past_weeks": weeks,
    }


def _windowed_history(df: DataFrame, entity: str, name: str, spec: SeriesSpec) -> DataFrame:
    """``df`` with the columns of ``entity_history``, by running sums over the rows of each entity."""
    q, past = F.col(spec.target).cast("double"), _earlier([entity], spec)
    weeks = F.dense_rank().over(Window.partitionBy(entity).orderBy(F.unix_date(spec.week_date).cast("long"))) - 1
    found = _past_columns(
        name, F.sum(q).over(past), F.sum(q * q).over(past), F.count(q).over(past), F.min(q).over(past), F.max(q).over(past),
        weeks.cast("long"),
    )
    known = F.col(entity).isNotNull() & F.col(spec.week_date).isNotNull()
    return df.withColumns({n: F.when(known, e) for n, e in found.items()})


def past_features(df: DataFrame, spec: SeriesSpec = DEFAULT, source: DataFrame | None = None) -> DataFrame:
    """Product and store statistics of earlier weeks on every row.

    Windows over the rows of ``df`` where they are its own source and no entity is too large for a task, else a table of
    entities x weeks.
    """
    rows = df if source is None else source
    out = df
    for entity, name in ((spec.product, "product"), (spec.store, "store")):
        if source is None and windowed(df, [entity], spec):
            out = _windowed_history(out, entity, name, spec)
        else:
            out = attach(out, entity_history(rows, entity, name, spec), [entity, spec.week_date], counted=rows)
    return out


def product_features(
    df: DataFrame,
    spec: SeriesSpec = DEFAULT,
    source: DataFrame | None = None,
    values: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Category, brand, price, performance and rank columns of the product.

    ``source`` holds the rows the statistics are taken from; it is ``df`` itself by default, or the
    stored panel when ``df`` already carries other derived columns.
    """
    source = df if source is None else source
    out = df
    if "category" in df.columns:
        out = category_onehot(out, source=source, values=(values or {}).get("category"))
    if "unit_price" in df.columns:
        out = price_tiers(out, source=source)
    if "brand" in df.columns:
        out = attach(out, brand_breadth(source, spec), ["brand"], counted=source)
    return attach(out, product_table(source, spec), [spec.product], weight="product_num_sales")


def store_features(
    df: DataFrame,
    spec: SeriesSpec = DEFAULT,
    stores: DataFrame | None = None,
    source: DataFrame | None = None,
    values: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Type, location, performance, diversity, activity and rank columns of the store."""
    source = df if source is None else source
    out = store_type_onehot(df, stores if stores is not None else source, values)
    if "zipcode" in df.columns:
        out = zip_density(out, source=source)
    return attach(out, store_table(source, spec), [spec.store], weight="store_num_sales")
