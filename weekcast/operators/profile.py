"""Descriptive reports. Every report is a DataFrame with one row per finding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.scalars import col, count_true, date_columns, divide, is_missing, numeric_columns, slug, text_columns, flag
from weekcast.operators.clean import in_year
from weekcast.operators.select import pair_correlations
from weekcast.plans.scale import attach, column_quantiles, with_scalars
from weekcast.spec import DEFAULT, SeriesSpec

# Keywords that give a column its role in the reports.
DATE_WORDS = ("date", "data", "time", "timestamp")
TARGET_WORDS = ("quantidade", "quantity", "sales", "value")
PRODUCT_WORDS = ("categoria", "category", "produto", "product")
STORE_WORDS = ("pdv", "store", "loja", "premise", "tipo")


def column_with(df: DataFrame, words: Sequence[str], numeric: bool = False) -> str | None:
    """First column whose name contains one of the words."""
    allowed = set(numeric_columns(df)) if numeric else set(df.columns)
    return next((c for c in df.columns if c in allowed and any(w in c.lower() for w in words)), None)


def one_row_to_rows(row: DataFrame, entries: Sequence[tuple[dict, Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate into report rows; each entry is (literal fields, value column)."""
    structs = [
        F.struct(*[F.lit(fields.get(n)).cast("string").alias(n) for n in names], value.cast("double").alias("value"))
        for fields, value in entries
    ]
    return row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One aggregation over the table, one output row per column. ``measures``: name -> fn(column name)."""
    row = df.agg(*[m(c).alias(f"_{i}_{n}") for i, c in enumerate(columns) for n, m in measures.items()])
    structs = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{n}").alias(n) for n in measures])
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for text columns; one combined aggregation."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("_p")).select("_p.*").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def duplicate_count(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: rows beyond the first of each group of equal keys (all columns by default)."""
    groups = df.groupBy(*[col(c) for c in (keys or df.columns)]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def data_summary(df: DataFrame) -> DataFrame:
    """Null count and share, and count, mean, std, min, quartiles, max per column."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numeric = numeric_columns(df)
    as_double = lambda c: col(c).cast("double")
    nothing = F.lit(None).cast("double")
    base = per_column(
        df,
        df.columns,
        {
            "rows": lambda c: F.count(F.lit(1)),
            "nulls": lambda c: count_true(is_missing(df, c)),
            "mean": lambda c: F.avg(as_double(c)) if c in numeric else F.max(nothing),
            "std": lambda c: F.stddev_samp(as_double(c)) if c in numeric else F.max(nothing),
            "min": lambda c: F.min(as_double(c)) if c in numeric else F.max(nothing),
            "max": lambda c: F.max(as_double(c)) if c in numeric else F.max(nothing),
        },
    ).withColumn("null_pct", divide(F.col("nulls") * 100.0, F.col("rows")))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    base = base.withColumn("dtype", F.element_at(kind, F.col("column")))
    if not numeric:
        return base
    quarts = column_quantiles(df, numeric, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return attach(base, quarts, ["column"], rows=len(df.columns))


def top_frequencies(df: DataFrame, k: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values and the k most frequent ones of each text column (ties by value).

    The counts are ranked inside hashed slices first, so at most k rows per slice reach the final
    ranking of a column, however many distinct values it has.
    """
    counts = value_frequencies(df, list(columns or text_columns(df)))
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    order = (F.desc("n"), F.asc("value"))
    sliced = counts.withColumn("_slice", F.pmod(F.hash("value"), F.lit(256)))
    near = Window.partitionBy("column", "_slice").orderBy(*order)
    final = Window.partitionBy("column").orderBy(*order)
    best = sliced.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k)
    ranked = best.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return attach(ranked, sizes, ["column"], rows=len(df.columns)).select("column", "distinct_values", "rank", "value", "n")


def data_quality_profile(df: DataFrame) -> DataFrame:
    """(check, column, value): totals, missing values, duplicate rows, number of columns per kind."""
    names = ["check", "column"]
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[count_true(is_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.col("_rows")
    missing = [F.col(f"_m{i}") for i in range(len(df.columns))]
    total = reduce(lambda a, b: a + b, missing)
    affected = reduce(lambda a, b: a + b, [(m > 0).cast("long") for m in missing])
    entries = [
        ({"check": "total_records"}, rows),
        ({"check": "total_columns"}, F.lit(len(df.columns))),
        ({"check": "numeric_columns"}, F.lit(len(numeric_columns(df)))),
        ({"check": "categorical_columns"}, F.lit(len(text_columns(df)))),
        ({"check": "datetime_columns"}, F.lit(len(date_columns(df)))),
        ({"check": "total_missing"}, total),
        ({"check": "columns_with_missing"}, affected),
    ]
    for c, m in zip(df.columns, missing):
        entries.append(({"check": "missing", "column": c}, m))
        entries.append(({"check": "missing_pct", "column": c}, divide(m * 100.0, rows)))
    base = one_row_to_rows(row, entries, names)
    repeats = (
        df.groupBy(*[col(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.sum(F.col("_n") - 1).alias("_dup"), F.sum("_n").alias("_all"))
    )
    doubled = one_row_to_rows(
        repeats,
        [
            ({"check": "duplicate_rows"}, F.coalesce(F.col("_dup"), F.lit(0))),
            ({"check": "duplicate_pct"}, divide(F.col("_dup") * 100.0, F.col("_all"))),
        ],
        names,
    )
    return base.unionByName(doubled)


def temporal_profile(
    df: DataFrame, date: str | None = None, target: str | None = None, year: int | None = None
) -> DataFrame:
    """(grain, period, total, mean, rows, std) by month, ISO week and weekday, in one aggregation."""
    date = date or column_with(df, DATE_WORDS)
    target = target or column_with(df, TARGET_WORDS, numeric=True)
    src = df if year is None else in_year(df, date, year)
    d = F.col(date)
    parts = src.select(
        F.month(d).alias("month"),
        F.weekofyear(d).alias("week"),
        F.weekday(d).alias("weekday"),
        F.col(target).cast("double").alias("_q"),
    ).where(d.isNotNull())
    m, w, k = F.col("month"), F.col("week"), F.col("weekday")
    grouped = parts.groupingSets([[m], [w], [k]], m, w, k).agg(
        F.grouping_id().alias("_g"),
        F.sum("_q").alias("total"),
        F.avg("_q").alias("mean"),
        F.count("_q").alias("rows"),
        F.stddev_samp("_q").alias("std"),
    )
    grain = F.when(F.col("_g") == 3, "month").when(F.col("_g") == 5, "week").otherwise("weekday")
    return grouped.select(
        grain.alias("grain"), F.coalesce("month", "week", "weekday").alias("period"), "total", "mean", "rows", "std"
    )


def temporal_summary(profile: DataFrame) -> DataFrame:
    """Seasonality figures of ``temporal_profile``: one row from its ~72 rows."""
    def of(grain: str, value: str = "total") -> Column:
        return F.when(F.col("grain") == grain, F.col(value))

    def strongest(grain: str, sign: int) -> Column:
        order = F.struct(of(grain) * sign, -F.col("period"))
        return F.max_by(of(grain, "period"), F.when(F.col("grain") == grain, order))

    return profile.agg(
        F.count(of("month")).alias("total_months"),
        F.count(of("week")).alias("total_weeks"),
        divide(F.stddev_samp(of("month")), F.avg(of("month"))).alias("monthly_variation_cv"),
        divide(F.stddev_samp(of("week")), F.avg(of("week"))).alias("weekly_variation_cv"),
        strongest("month", 1).alias("strongest_month"),
        strongest("month", -1).alias("weakest_month"),
        strongest("weekday", 1).alias("strongest_weekday"),
        strongest("weekday", -1).alias("weakest_weekday"),
    )


def category_profile(df: DataFrame, top: int = 10) -> DataFrame:
    """Value distribution of product-like and store-like text columns: the most frequent values of each.

    ``is_category`` tells whether a column has as few values as a category (below 100 and 50).
    """
    roles = []
    for name in text_columns(df):
        if any(w in name.lower() for w in PRODUCT_WORDS):
            roles.append(("product", name, 100, top))
        if any(w in name.lower() for w in STORE_WORDS):
            roles.append(("store", name, 50, 50))
    if not roles:
        raise ValueError("no product- or store-like text column")
    counts = value_frequencies(df, sorted({r[1] for r in roles}))
    role = F.array(
        *[
            F.struct(
                F.lit(r).alias("role"), F.lit(c).alias("column"), F.lit(m).alias("most"), F.lit(k).alias("keep")
            )
            for r, c, m, k in roles
        ]
    )
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    small = (
        sizes.withColumn("_role", F.explode(F.filter(role, lambda r: r["column"] == F.col("column"))))
        .select(
            "column", "distinct_values", "_role.role", "_role.keep",
            flag(F.col("distinct_values") < F.col("_role.most")).alias("is_category"),
        )
    )
    kept = attach(counts, small, ["column"], "inner", rows=len(roles))
    order = Window.partitionBy("role", "column").orderBy(F.desc("n"), F.asc("value"))
    return (
        kept.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("keep"))
        .select("role", "column", "distinct_values", "is_category", "rank", "value", "n")
    )


def outlier_report(df: DataFrame, min_distinct: int = 10) -> DataFrame:
    """IQR bounds and counts outside them for numeric columns with more than ``min_distinct`` values."""
    columns = numeric_columns(df)
    quarts = column_quantiles(df, columns, [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    bounds = quarts.withColumns({"iqr": iqr, "low": F.col("q1") - 1.5 * iqr, "high": F.col("q3") + 1.5 * iqr})
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in columns])
    counts = (
        df.select(F.explode(pairs).alias("_p"))
        .groupBy("_p.column", "_p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    v = F.col("value")
    return (
        attach(counts, bounds, ["column"], rows=len(columns))
        .groupBy("column", "q1", "q3", "iqr", "low", "high")
        .agg(
            F.count("value").alias("_distinct"),
            F.coalesce(F.sum(F.when(v < F.col("low"), F.col("n"))), F.lit(0)).alias("outliers_low"),
            F.coalesce(F.sum(F.when(v > F.col("high"), F.col("n"))), F.lit(0)).alias("outliers_high"),
            F.sum("n").alias("_rows"),
        )
        .where(F.col("_distinct") > min_distinct)
        .withColumn("outliers", F.col("outliers_low") + F.col("outliers_high"))
        .withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("_rows"))
        .drop("_distinct", "_rows")
    )


def correlation_pairs(
    df: DataFrame, threshold: float = 0.7, risk: float = 0.8, columns: Sequence[str] | None = None
) -> DataFrame:
    """Pairs of numeric columns with |r| above the threshold; ``is_risk`` above the higher one."""
    pairs = pair_correlations(df, list(columns or numeric_columns(df)))
    size = F.abs(F.col("correlation"))
    return pairs.where(size > threshold).withColumn("is_risk", (size > risk).cast("int"))


def insight_rules(df: DataFrame, date: str | None = None, target: str | None = None) -> DataFrame:
    """(insight, value) rows from threshold rules over the other reports."""
    date = date or column_with(df, DATE_WORDS)
    target = target or column_with(df, TARGET_WORDS, numeric=True)
    quality = df.agg(
        *[count_true(is_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)],
        F.count(F.lit(1)).alias("_rows"),
    )
    cells = F.col("_rows") * len(df.columns)
    missing = divide(reduce(lambda a, b: a + b, [F.col(f"_m{i}") for i in range(len(df.columns))]) * 100.0, cells)
    label = F.when(missing > 10, "HIGH_MISSING").when(missing > 0, "LOW_MISSING").otherwise("NO_MISSING")
    out = [quality.select(label.alias("insight"), missing.alias("value"))]
    spark = df.sparkSession
    if date:
        out.append(spark.range(1).select(F.lit("TEMPORAL_DATA").alias("insight"), F.lit(1.0).alias("value")))
        if target:
            season = temporal_summary(temporal_profile(df, date, target))
            cv = F.col("weekly_variation_cv")
            out.append(season.where(cv > 0.3).select(F.lit("HIGH_SEASONALITY").alias("insight"), cv.alias("value")))
    else:
        out.append(spark.range(1).select(F.lit("NO_TEMPORAL").alias("insight"), F.lit(1.0).alias("value")))
    profile = category_profile(df).where("is_category = 1")
    for role, name in (("product", "PRODUCT_CATEGORIES"), ("store", "STORE_CATEGORIES")):
        n = profile.where(F.col("role") == role).agg(F.count_distinct("column").cast("double").alias("value"))
        out.append(n.where("value > 0").select(F.lit(name).alias("insight"), "value"))
    high = outlier_report(df).where("outlier_pct > 5").agg(F.count(F.lit(1)).cast("double").alias("value"))
    out.append(high.where("value > 0").select(F.lit("HIGH_OUTLIERS").alias("insight"), "value"))
    risky = correlation_pairs(df).where("is_risk = 1").agg(F.count(F.lit(1)).cast("double").alias("value"))
    out.append(risky.where("value > 0").select(F.lit("MULTICOLLINEARITY").alias("insight"), "value"))
    return reduce(lambda a, b: a.unionByName(b), out)


def preprocessing_summary(before: DataFrame, after: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Rows and columns before and after, share removed, null targets removed (one row)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        nulls = count_true(is_missing(df, spec.target)) if spec.target in df.columns else F.lit(0)
        return df.agg(F.count(F.lit(1)).alias(f"{name}_records"), nulls.alias(f"_{name}_nulls"))

    row = with_scalars(side(before, "original"), side(after, "processed"))
    removed = F.col("original_records") - F.col("processed_records")
    return row.select(
        "original_records",
        "processed_records",
        removed.alias("records_removed"),
        divide(removed * 100.0, F.col("original_records")).alias("removal_pct"),
        F.lit(len(before.columns)).alias("original_columns"),
        F.lit(len(after.columns)).alias("processed_columns"),
        (F.col("_original_nulls") - F.col("_processed_nulls")).alias("target_nulls_removed"),
    )


def month_category_pivot(
    df: DataFrame, categories: Sequence[str], date: str = "date", category: str = "category", target: str = "quantity"
) -> DataFrame:
    """Month by category totals, missing combinations as 0. The category list fixes the columns; what is in none
    of them, or in no category, is in ``other``."""
    src = df.groupBy(F.month(date).alias("month"))
    listed = F.coalesce(F.col(category).isin(list(categories)), F.lit(False))
    total = {slug(c): F.col(category) == c for c in categories} | {"other": ~listed}
    return src.agg(*[F.coalesce(F.sum(F.when(rows, F.col(target))), F.lit(0.0)).alias(n) for n, rows in total.items()])


def totals_by_dim(df: DataFrame, dimensions: Sequence[str], target: str = "quantity") -> DataFrame:
    """(dimension, value, total) for every dimension, in one grouping-sets aggregation."""
    named = df.select(*[col(d).cast("string").alias(f"_d{i}") for i, d in enumerate(dimensions)], target)
    cols = [F.col(f"_d{i}") for i in range(len(dimensions))]
    grouped = named.groupingSets([[c] for c in cols], *cols).agg(
        F.grouping_id().alias("_g"), F.sum(target).alias("total")
    )
    n = len(dimensions)
    which = reduce(
        lambda acc, i: acc.when(F.col("_g") == (2**n - 1 - 2 ** (n - 1 - i)), dimensions[i]), range(n), F
    )
    return grouped.select(which.alias("dimension"), F.coalesce(*cols).alias("value"), "total")


def zero_share(df: DataFrame, target: str = "quantity") -> DataFrame:
    """Zero and non-zero counts, their shares, and a verdict at 50 % and 90 % zeros."""
    q = F.col(target)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        count_true(q == 0).alias("zeros"),
        F.avg(q).alias("mean"),
        F.max(q).alias("max"),
    )
    share = divide(F.col("zeros") * 100.0, F.col("rows"))
    verdict = F.when(share > 90, "critical").when(share > 50, "serious").otherwise("ok")
    return row.select(
        "rows", "zeros", (F.col("rows") - F.col("zeros")).alias("non_zeros"), share.alias("zero_pct"),
        "mean", "max", verdict.alias("verdict"),
    )


# Name fragments that decide a column's feature family, first match wins.
FAMILIES = (
    ("temporal", ("week", "month", "quarter", "day", "holiday", "christmas", "trend")),
    ("product", ("product", "category", "brand", "price")),
    ("store", ("store", "premise", "zip", "region")),
    ("lag", ("lag",)),
    ("rolling", ("rolling",)),
    ("growth", ("pct_change", "growth", "cumulative")),
)


def feature_family(name: str) -> str:
    lower = name.lower()
    return next((f for f, words in FAMILIES if any(w in lower for w in words)), "original")


def feature_inventory(df: DataFrame) -> DataFrame:
    """(column, family, dtype, nulls) for every column."""
    nulls = per_column(df, df.columns, {"nulls": lambda c: count_true(is_missing(df, c))})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    family = F.create_map(*[F.lit(x) for c in df.columns for x in (c, feature_family(c))])
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return nulls.select(
        "column",
        F.element_at(family, F.col("column")).alias("family"),
        F.element_at(kind, F.col("column")).alias("dtype"),
        "nulls",
    )


def rows_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, distinct_values, mean_rows, min_rows, max_rows) per key column."""
    parts = []
    for key in keys:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(
            counts.agg(
                F.lit(key).alias("key"),
                F.count(F.lit(1)).alias("distinct_values"),
                F.avg("_n").alias("mean_rows"),
                F.min("_n").alias("min_rows"),
                F.max("_n").alias("max_rows"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)
