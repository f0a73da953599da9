"""Queries on profiles, checks, evaluation and post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcast.catalog.registry import FINDING_COLUMNS, findings_sql, query
from weekcast.catalog.tables import Tables
from weekcast.functions.calendar import holiday_table
from weekcast.operators import checks, clean, evaluate, forecast, normality, profile
from weekcast.plans.features import temporal_features

KEY = "store:s product:s year:i week:i"
KEY_SQL = "store, product, year, week"
FORECAST = "week:i store:s product:s quantity:i"
NUMBERS = ("quantity", "gross_value", "net_value", "discount", "taxes")


def _typed(t: Tables):
    return clean.cast_types(clean.standardize_columns(t.raw))


# -- profiles -----------------------------------------------------------------------------------

SUMMARY_KINDS = {
    "store": "string", "product": "string", "date": "timestamp", "quantity": "double", "gross_value": "double",
    "discount": "double", "order_key": "bigint", "line": "int",
}


def _summary_sql() -> str:
    parts = []
    for name, kind in SUMMARY_KINDS.items():
        numeric = kind in ("double", "bigint", "int")
        measures = (
            f"avg({name}) AS mean, stddev_samp({name}) AS std, min({name}) AS min, quantile_cont({name}, 0.25) AS q25, "
            f"quantile_cont({name}, 0.5) AS q50, quantile_cont({name}, 0.75) AS q75, max({name}) AS max"
            if numeric
            else "NULL AS mean, NULL AS std, NULL AS min, NULL AS q25, NULL AS q50, NULL AS q75, NULL AS max"
        )
        parts.append(
            f"SELECT '{name}' AS \"column\", '{kind}' AS dtype, count(*) AS rows, count(*) - count({name}) AS nulls, "
            f"100.0 * (count(*) - count({name})) / count(*) AS null_pct, {measures} FROM typed"
        )
    return " UNION ALL ".join(parts)


@query("data_summary",
       "column:s dtype:s rows:i nulls:i null_pct:f mean:f std:f min:f q25:f q50:f q75:f max:f", _summary_sql())
def data_summary(t: Tables):
    return profile.data_summary(_typed(t))


def _top_sql(source: str, columns, k: int) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    ]
    return f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY "column") AS distinct_values,
row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM ({" UNION ALL ".join(parts)})) WHERE rank <= {k}"""


TEXTS = ("store", "product", "week_label", "premise", "store_category", "category", "brand")


@query("top_frequencies", "column:s distinct_values:i rank:i value:s n:i", _top_sql("panel", TEXTS, 5))
def top_frequencies(t: Tables):
    return profile.top_frequencies(t.panel, 5)


def _quality_sql() -> str:
    names = list(SUMMARY_KINDS)
    total = " + ".join(f"(count(*) - count({n}))" for n in names)
    affected = " + ".join(f"CAST(count(*) > count({n}) AS INTEGER)" for n in names)
    rows = [
        ("total_records", None, "count(*)"), ("total_columns", None, f"max({len(names)})"),
        ("numeric_columns", None, "max(5)"), ("categorical_columns", None, "max(2)"), ("datetime_columns", None, "max(1)"),
        ("total_missing", None, total), ("columns_with_missing", None, affected),
    ]
    for n in names:
        rows.append(("missing", n, f"count(*) - count({n})"))
        rows.append(("missing_pct", n, f"100.0 * (count(*) - count({n})) / count(*)"))
    parts = [
        f"SELECT '{c}' AS \"check\", {'CAST(NULL AS VARCHAR)' if k is None else repr(k)} AS \"column\", "
        f"CAST({e} AS DOUBLE) AS value FROM typed" for c, k, e in rows
    ]
    unique = "(SELECT count(*) FROM (SELECT DISTINCT * FROM typed))"
    parts.append(f"SELECT 'duplicate_rows', NULL, count(*) - {unique} FROM typed")
    parts.append(f"SELECT 'duplicate_pct', NULL, 100.0 * (count(*) - {unique}) / count(*) FROM typed")
    return " UNION ALL ".join(parts)


@query("data_quality_profile", "check:s column:s value:f", _quality_sql())
def data_quality_profile(t: Tables):
    return profile.data_quality_profile(_typed(t))


GRAIN_SQL = """SELECT '{g}' AS grain, {e} AS period, sum(quantity) AS total, avg(quantity) AS mean, count(*) AS rows,
stddev_samp(quantity) AS std FROM fine GROUP BY {e}"""
PROFILE_SQL = " UNION ALL ".join(
    GRAIN_SQL.format(g=g, e=e) for g, e in (("month", "month(date)"), ("week", "week(date)"), ("weekday", "isodow(date) - 1")))


@query("temporal_profile", "grain:s period:i total:f mean:f rows:i std:f", PROFILE_SQL)
def temporal_profile(t: Tables):
    return profile.temporal_profile(t.fine)


@query("temporal_summary",
       "total_months:i total_weeks:i monthly_variation_cv:f weekly_variation_cv:f strongest_month:i weakest_month:i "
       "strongest_weekday:i weakest_weekday:i",
       f"""WITH p AS ({PROFILE_SQL}), m AS (SELECT * FROM p WHERE grain = 'month'), k AS (SELECT * FROM p WHERE grain = 'week'),
d AS (SELECT * FROM p WHERE grain = 'weekday')
SELECT (SELECT count(*) FROM m) AS total_months, (SELECT count(*) FROM k) AS total_weeks,
(SELECT stddev_samp(total) / avg(total) FROM m) AS monthly_variation_cv,
(SELECT stddev_samp(total) / avg(total) FROM k) AS weekly_variation_cv,
(SELECT period FROM m ORDER BY total DESC, period LIMIT 1) AS strongest_month,
(SELECT period FROM m ORDER BY total, period LIMIT 1) AS weakest_month,
(SELECT period FROM d ORDER BY total DESC, period LIMIT 1) AS strongest_weekday,
(SELECT period FROM d ORDER BY total, period LIMIT 1) AS weakest_weekday""")
def temporal_summary(t: Tables):
    return profile.temporal_summary(profile.temporal_profile(t.fine))


def _category_sql() -> str:
    parts = []
    for role, columns, most, keep in (
        ("product", ("product", "store_category", "category"), 100, 10),
        ("store", ("store", "premise", "store_category"), 50, 50),
    ):
        top = _top_sql("panel", columns, keep)
        parts.append(f"SELECT '{role}' AS role, *, CAST(distinct_values < {most} AS INTEGER) AS is_category FROM ({top})")
    return " UNION ALL ".join(parts)


@query("category_profile", "role:s column:s distinct_values:i is_category:i rank:i value:s n:i", _category_sql())
def category_profile(t: Tables):
    return profile.category_profile(t.panel)


def _outlier_sql(source: str, columns) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high,
count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1)) AS outliers_low, count(*) FILTER ({c} > q3 + 1.5 * (q3 - q1)) AS outliers_high,
count(DISTINCT {c}) AS d, count(*) AS n
FROM {source}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}) GROUP BY q1, q3"""
        for c in columns
    ]
    return f"""SELECT *, outliers_low + outliers_high AS outliers, 100.0 * (outliers_low + outliers_high) / n AS outlier_pct
FROM ({" UNION ALL ".join(parts)}) WHERE d > 10"""


@query("outlier_report",
       "column:s q1:f q3:f iqr:f low:f high:f outliers_low:i outliers_high:i outliers:i outlier_pct:f",
       _outlier_sql("weekly", ("year", "week", *NUMBERS)))
def outlier_report(t: Tables):
    return profile.outlier_report(t.weekly_table)


def _pairs_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS correlation FROM {source}"
        for i, a in enumerate(columns) for b in columns[i + 1:])


RISKY = f"""SELECT *, CAST(abs(correlation) > 0.8 AS INTEGER) AS is_risk
FROM ({_pairs_sql('weekly', ('year', 'week', *NUMBERS))}) WHERE abs(correlation) > 0.7"""


@query("correlation_pairs", "feature_1:s feature_2:s correlation:f is_risk:i", RISKY)
def correlation_pairs(t: Tables):
    return profile.correlation_pairs(t.weekly_table)


@query("insight_rules", "insight:s value:f",
       f"""WITH p AS (SELECT week(date) AS k, sum(quantity) AS total FROM fine GROUP BY 1),
o AS ({_outlier_sql('panel', ('year', 'week', *NUMBERS, 'zipcode', 'subcategory', 'unit_price'))}),
r AS (SELECT week(week_date) AS k, sum(quantity) AS total FROM panel GROUP BY 1)
SELECT 'NO_MISSING' AS insight, 0.0 AS value UNION ALL SELECT 'TEMPORAL_DATA', 1.0 UNION ALL
SELECT * FROM (SELECT 'HIGH_SEASONALITY', stddev_samp(total) / avg(total) AS v FROM r) WHERE v > 0.3 UNION ALL
SELECT 'PRODUCT_CATEGORIES', count(DISTINCT "column") FROM ({_category_sql()}) WHERE role = 'product' AND is_category = 1 UNION ALL
SELECT 'STORE_CATEGORIES', count(DISTINCT "column") FROM ({_category_sql()}) WHERE role = 'store' AND is_category = 1 UNION ALL
SELECT * FROM (SELECT 'HIGH_OUTLIERS', CAST(count(*) AS DOUBLE) AS v FROM o WHERE outlier_pct > 5) WHERE v > 0 UNION ALL
SELECT * FROM (SELECT 'MULTICOLLINEARITY', CAST(count(*) AS DOUBLE) AS v FROM
({_pairs_sql('panel', ('year', 'week', *NUMBERS, 'zipcode', 'subcategory', 'unit_price'))}) WHERE abs(correlation) > 0.8) WHERE v > 0""")
def insight_rules(t: Tables):
    return profile.insight_rules(t.panel_table, "week_date", "quantity")


@query("preprocessing_summary",
       "original_records:i processed_records:i records_removed:i removal_pct:f original_columns:i processed_columns:i "
       "target_nulls_removed:i",
       """SELECT a AS original_records, b AS processed_records, a - b AS records_removed, 100.0 * (a - b) / a AS removal_pct,
8 AS original_columns, 8 AS processed_columns, x - y AS target_nulls_removed FROM
(SELECT count(*) AS a, count(*) - count(quantity) AS x FROM typed), (SELECT count(*) AS b, count(*) - count(quantity) AS y FROM complete)""")
def preprocessing_summary(t: Tables):
    return profile.preprocessing_summary(_typed(t), clean.drop_missing_critical(_typed(t)))


CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("month_category_pivot", "month:i " + " ".join(f"{c.lower()}:f" for c in CATEGORIES[:4]) + " other:f",
       "SELECT month(week_date) AS month, " + ", ".join(
           f"coalesce(sum(quantity) FILTER (category = '{c}'), 0) AS {c.lower()}" for c in CATEGORIES[:4])
       + ", coalesce(sum(quantity) FILTER (category IN ('SMALL', 'STANDARD')), 0) AS other FROM panel GROUP BY 1")
def month_category_pivot(t: Tables):
    return profile.month_category_pivot(t.panel, CATEGORIES[:4], date="week_date")


@query("totals_by_dim", "dimension:s value:s total:f", " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, sum(quantity) AS total FROM panel GROUP BY {c}"
    for c in ("category", "premise", "week_date")))
def totals_by_dim(t: Tables):
    return profile.totals_by_dim(t.panel, ["category", "premise", "week_date"])


@query("zero_share", "rows:i zeros:i non_zeros:i zero_pct:f mean:f max:f verdict:s",
       """SELECT *, CASE WHEN zero_pct > 90 THEN 'critical' WHEN zero_pct > 50 THEN 'serious' ELSE 'ok' END AS verdict FROM
(SELECT count(*) AS rows, count(*) FILTER (quantity = 0) AS zeros, count(*) FILTER (quantity <> 0) AS non_zeros,
100.0 * count(*) FILTER (quantity = 0) / count(*) AS zero_pct, avg(quantity) AS mean, max(quantity) AS max FROM forecast)""")
def zero_share(t: Tables):
    return profile.zero_share(t.forecast)


@query("feature_inventory", "column:s family:s dtype:s nulls:i",
       " UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", '{f}' AS family, '{k}' AS dtype, count(*) - count({c}) AS nulls FROM typed"
           for c, f, k in (
               ("store", "store", "string"), ("product", "product", "string"), ("date", "original", "timestamp"),
               ("quantity", "original", "double"), ("gross_value", "original", "double"),
               ("discount", "original", "double"), ("order_key", "original", "bigint"), ("line", "original", "int"))))
def feature_inventory(t: Tables):
    return profile.feature_inventory(_typed(t))


@query("feature_families", "family:s columns:i")
def feature_families(t: Tables):
    wide = temporal_features(t.weekly_table)
    return profile.feature_inventory(wide).groupBy("family").agg(F.count(F.lit(1)).alias("columns"))


@query("rows_per_key", "key:s distinct_values:i mean_rows:f min_rows:i max_rows:i", " UNION ALL ".join(
    f"SELECT '{k}' AS key, count(*) AS distinct_values, avg(n) AS mean_rows, min(n) AS min_rows, max(n) AS max_rows "
    f"FROM (SELECT {k}, count(*) AS n FROM forecast GROUP BY {k})" for k in ("store", "product")))
def rows_per_key(t: Tables):
    return profile.rows_per_key(t.forecast, ["store", "product"])


# -- checks ---------------------------------------------------------------------------------------

DUPLICATES = """SELECT '{name}' AS "check", CASE WHEN d > 0 THEN '{level}' ELSE 'ok' END AS level, {column} AS "column",
CAST(d AS DOUBLE) AS value FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {source})) AS d FROM {source})"""


def duplicates_sql(source: str, keys: str = "*", level: str = "warning", name: str = "duplicate_rows", column=None) -> str:
    label = "CAST(NULL AS VARCHAR)" if column is None else f"'{column}'"
    return DUPLICATES.format(source=source, keys=keys, level=level, name=name, column=label)


def coverage_sql(source: str, extra: str = "warning", weeks=(1, 2, 3, 4, 5)) -> str:
    values = ", ".join(f"({w})" for w in weeks)
    listed = ", ".join(str(w) for w in weeks)
    shown = f"'{extra}'" if extra == "info" else f"CASE WHEN n > 0 THEN '{extra}' ELSE 'ok' END"
    return f"""SELECT 'missing_weeks', CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END, 'week', CAST(n AS DOUBLE) FROM
(SELECT count(*) AS n FROM (VALUES {values}) e(w) WHERE w NOT IN (SELECT week FROM {source})) UNION ALL
SELECT 'extra_weeks', {shown}, 'week', CAST(n AS DOUBLE) FROM
(SELECT count(DISTINCT week) AS n FROM {source} WHERE week NOT IN ({listed}))"""


def missing(*names: str):
    return [("missing_column", "error", n, "0") for n in names]


def null_checks(level: str, *names: str):
    return [("nulls", level, n, f"count(*) - count({n})") for n in names]


@query("check_transactions", FINDING_COLUMNS, findings_sql("typed", [
    ("rows", "info", None, "count(*)"),
    *missing("date", "store", "product", "quantity"),
    ("not_numeric", "warning", "quantity", "0"),
    ("negative", "warning", "quantity", "count(*) FILTER (quantity < 0)"),
    *null_checks("warning", "date", "store", "product", "quantity"),
    ("outside_year", "warning", "date", "count(*) FILTER (year(date) <> 1997)"),
], duplicates_sql("typed")))
def check_transactions(t: Tables):
    return checks.check_transactions(_typed(t), year=1997)


@query("check_products", FINDING_COLUMNS, findings_sql("(SELECT product FROM typed)", [
    ("rows", "info", None, "count(*)"), *missing("product"), *null_checks("warning", "product"),
], duplicates_sql("typed", "product", "error", "duplicate_key", "product")))
def check_products(t: Tables):
    """The product column of the transactions taken as a master: full of repeated keys."""
    return checks.check_products(_typed(t).select("product"))


@query("check_stores", FINDING_COLUMNS, findings_sql("stores", [
    ("rows", "info", None, "count(*)"), *missing("store"), *null_checks("warning", "store"),
], duplicates_sql("stores", "store", "error", "duplicate_key", "store")))
def check_stores(t: Tables):
    return checks.check_stores(t.stores)


@query("check_generic", FINDING_COLUMNS, findings_sql("typed", [
    ("rows", "info", None, "count(*)"), ("columns", "info", None, "8"), *null_checks("info", *SUMMARY_KINDS),
]))
def check_generic(t: Tables):
    return checks.check_generic(_typed(t))


@query("check_panel", FINDING_COLUMNS, findings_sql("weekly", [
    ("rows", "info", None, "count(*)"), ("columns", "info", None, "11"), *missing("store", "product", "quantity"),
    ("empty", "error", None, "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"),
    *null_checks("warning", "store", "product", "quantity"),
    ("negative", "warning", "quantity", "count(*) FILTER (quantity < 0)"),
    ("zero", "warning", "quantity", "count(*) FILTER (quantity = 0)"),
    ("mean", "info", "quantity", "avg(quantity)"), ("total", "info", "quantity", "sum(quantity)"),
    ("first_day", "info", "week_date", "min(week_date) - DATE '1970-01-01'"),
    ("last_day", "info", "week_date", "max(week_date) - DATE '1970-01-01'"),
], duplicates_sql("weekly")))
def check_panel(t: Tables):
    return checks.check_panel(t.weekly)


FORECAST_KEY = "week,store,product"
NAIVE = "(SELECT week, store, product, prediction AS quantity FROM raw_forecast)"


def _naive(t: Tables):
    """Unprocessed predictions of all years under one week number: negatives and repeated keys."""
    return t.raw_forecast.select("week", "store", "product", F.col("prediction").alias("quantity"))


@query("check_forecast", FINDING_COLUMNS, findings_sql(NAIVE, [
    ("rows", "info", None, "count(*)"), *missing("week", "store", "product", "quantity"),
    ("empty", "error", None, "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"),
    *null_checks("error", "week", "store", "product", "quantity"),
    ("negative", "error", "quantity", "count(*) FILTER (quantity < 0)"),
], duplicates_sql("raw_forecast", "week, store, product", "error", "duplicate_key", FORECAST_KEY)
    + " UNION ALL " + coverage_sql("raw_forecast")))
def check_forecast(t: Tables):
    return checks.check_forecast(_naive(t))


@query("check_forecast_format", FINDING_COLUMNS, findings_sql(NAIVE, [
    ("rows", "info", None, "count(*)"), ("columns", "info", None, "4"),
    *missing("week", "store", "product", "quantity"), ("not_numeric", "error", "quantity", "0"),
    *null_checks("error", "quantity"), ("negative", "error", "quantity", "count(*) FILTER (quantity < 0)"),
], duplicates_sql("raw_forecast", "week, store, product", "error", "duplicate_key", FORECAST_KEY)))
def check_forecast_format(t: Tables):
    return checks.check_forecast_format(_naive(t))


P99 = "(SELECT quantile_cont(prediction, 0.99) FROM raw_forecast)"


@query("check_business_rules", FINDING_COLUMNS, findings_sql(NAIVE, [
    ("very_high", "warning", "quantity", f"count(*) FILTER (quantity > 2 * {P99})"),
    ("mostly_zero", "warning", "quantity", "CAST(100.0 * count(*) FILTER (quantity = 0) / count(*) > 50 AS INTEGER)"),
    ("zero_pct", "info", "quantity", "100.0 * count(*) FILTER (quantity = 0) / count(*)"),
    ("mean", "info", "quantity", "avg(quantity)"), ("std", "info", "quantity", "stddev_samp(quantity)"),
]))
def check_business_rules(t: Tables):
    return checks.check_business_rules(_naive(t))


@query("check_submission", FINDING_COLUMNS, findings_sql("forecast", [
    ("rows", "info", None, "count(*)"), *missing("week", "store", "product", "quantity"),
    ("week_not_integer", "warning", "week", "count(*) FILTER (NOT regexp_full_match(CAST(week AS VARCHAR), '[0-9]+'))"),
    ("id_not_numeric", "warning", "store", "count(*) FILTER (try_cast(store AS DOUBLE) IS NULL)"),
    ("id_not_numeric", "warning", "product", "count(*) FILTER (try_cast(product AS DOUBLE) IS NULL)"),
    ("negative", "error", "quantity", "count(*) FILTER (quantity < 0)"),
    *null_checks("warning", "week", "store", "product", "quantity"),
    ("total", "info", "quantity", "sum(quantity)"), ("mean", "info", "quantity", "avg(quantity)"),
    ("min", "info", "quantity", "min(quantity)"), ("max", "info", "quantity", "max(quantity)"),
    ("distinct", "info", "store", "count(DISTINCT store)"), ("distinct", "info", "product", "count(DISTINCT product)"),
], coverage_sql("forecast")))
def check_submission(t: Tables):
    return checks.check_submission(t.forecast)


@query("check_scoring_input", FINDING_COLUMNS, findings_sql("scored", [
    ("empty", "error", None, "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"), *missing("week", "store", "product"),
], coverage_sql("scored", "info")))
def check_scoring_input(t: Tables):
    return checks.check_scoring_input(t.scored)


@query("check_extremes", FINDING_COLUMNS, findings_sql(NAIVE, [
    ("negative", "warning", "quantity", "count(*) FILTER (quantity < 0)"),
    ("nulls", "warning", "quantity", "count(*) - count(quantity)"),
    ("extreme", "warning", "quantity", f"count(*) FILTER (quantity > 3 * {P99})"),
    ("negative_pct", "info", "quantity", "100.0 * count(*) FILTER (quantity < 0) / count(*)"),
    ("nulls_pct", "info", "quantity", "100.0 * (count(*) - count(quantity)) / count(*)"),
    ("extreme_pct", "info", "quantity", f"100.0 * count(*) FILTER (quantity > 3 * {P99}) / count(*)"),
]))
def check_extremes(t: Tables):
    return checks.check_extremes(_naive(t))


# -- evaluation -------------------------------------------------------------------------------------

METRICS = "wmape:f mae:f rmse:f mape:f"


def metrics_sql(p: str = "p_ma4") -> str:
    return (f"100.0 * sum(abs(quantity - {p})) / nullif(sum(abs(quantity)), 0) AS wmape, avg(abs(quantity - {p})) AS mae, "
            f"sqrt(avg(power(quantity - {p}, 2))) AS rmse, 100 * avg(abs(quantity - {p}) / nullif(abs(quantity), 0)) AS mape")


@query("metrics", METRICS, f"SELECT {metrics_sql()} FROM scored")
def metrics(t: Tables):
    return evaluate.metrics(t.scored, "quantity", "p_ma4")


@query("metrics_by_series", f"store:s product:s {METRICS}",
       f"SELECT store, product, {metrics_sql()} FROM scored GROUP BY store, product")
def metrics_by_series(t: Tables):
    return evaluate.metrics(t.scored, "quantity", "p_ma4", ["store", "product"])


@query("quick_metrics", METRICS,
       f"SELECT wmape / 100 AS wmape, mae, rmse, mape / 100 AS mape FROM (SELECT {metrics_sql()} FROM scored)")
def quick_metrics(t: Tables):
    return evaluate.quick_metrics(t.scored, "quantity", "p_ma4")


SEGMENT_SQL = "count(*) AS rows, avg(quantity) AS mean_sales, avg(abs_error) AS mae, avg(pct_error) AS mape FROM errors"


@query("metrics_by_segment", "product:s rows:i mean_sales:f mae:f mape:f", f"SELECT product, {SEGMENT_SQL} GROUP BY product")
def metrics_by_segment(t: Tables):
    return evaluate.metrics_by_segment(t.scored, "product", "quantity", "p_ma4")


@query("wmape_by_week", "year:i week:i actual:f predicted:f wmape:f wmape_total:f",
       """SELECT year, week, sum(quantity) AS actual, sum(p_ma4) AS predicted, 100.0 * sum(abs_error) / sum(quantity) AS wmape,
100.0 * abs(sum(quantity) - sum(p_ma4)) / sum(quantity) AS wmape_total FROM errors GROUP BY year, week""")
def wmape_by_week(t: Tables):
    return evaluate.wmape_by_week(t.scored, "quantity", "p_ma4")


BAND_SQL = """CASE WHEN quantity <= 0 THEN NULL WHEN quantity <= 1 THEN '0-1' WHEN quantity <= 5 THEN '1-5'
WHEN quantity <= 10 THEN '5-10' WHEN quantity <= 50 THEN '10-50' WHEN quantity <= 100 THEN '50-100' ELSE '100+' END"""


@query("metrics_by_band", "sales_band:s rows:i mae:f mape:f",
       f"SELECT {BAND_SQL} AS sales_band, count(*) AS rows, avg(abs_error) AS mae, avg(pct_error) AS mape FROM errors GROUP BY 1")
def metrics_by_band(t: Tables):
    return evaluate.metrics_by_band(t.scored, "quantity", "p_ma4")


@query("hardest_products", "product:s mape:f rows:i",
       """SELECT product, avg(pct_error) AS mape, count(pct_error) AS rows FROM errors GROUP BY product
HAVING count(pct_error) >= 10 ORDER BY mape DESC, product LIMIT 10""")
def hardest_products(t: Tables):
    return evaluate.hardest_products(t.scored, "quantity", "p_ma4")


@query("volume_extremes", "mape_high_volume:f mape_low_volume:f",
       """SELECT avg(pct_error) FILTER (quantity > b) AS mape_high_volume, avg(pct_error) FILTER (quantity < a) AS mape_low_volume
FROM errors, (SELECT quantile_cont(quantity, 0.1) AS a, quantile_cont(quantity, 0.9) AS b FROM errors)""")
def volume_extremes(t: Tables):
    return evaluate.volume_extremes(t.scored, "quantity", "p_ma4")


STATISTICS = {"count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
              "q25": "quantile_cont({c}, 0.25)", "q50": "quantile_cont({c}, 0.5)", "q75": "quantile_cont({c}, 0.75)", "max": "max({c})"}


@query("history_vs_forecast", "statistic:s history:f forecast:f", " UNION ALL ".join(
    f"SELECT '{n}' AS statistic, (SELECT {e.format(c='quantity')} FROM weekly) AS history, "
    f"(SELECT {e.format(c='quantity')} FROM forecast) AS forecast" for n, e in STATISTICS.items()))
def history_vs_forecast(t: Tables):
    return evaluate.history_vs_forecast(t.weekly, t.forecast)


@query("forecast_summary",
       "rows:i first_week:i last_week:i total:f mean:f median:f min:f max:f std:f zeros:i low:i high:i stores:i products:i",
       """SELECT count(*) AS rows, min(week) AS first_week, max(week) AS last_week, sum(quantity) AS total,
avg(quantity) AS mean, median(quantity) AS median, min(quantity) AS min, max(quantity) AS max, stddev_samp(quantity) AS std,
count(*) FILTER (quantity = 0) AS zeros, count(*) FILTER (quantity <= 10) AS low, count(*) FILTER (quantity >= 100) AS high,
count(DISTINCT store) AS stores, count(DISTINCT product) AS products FROM forecast""")
def forecast_summary(t: Tables):
    return evaluate.forecast_summary(t.forecast)


@query("forecast_by_week", "week:i rows:i total:f mean:f std:f stores:i products:i",
       """SELECT week, count(*) AS rows, round(sum(quantity), 2) AS total, round(avg(quantity), 2) AS mean,
round(stddev_samp(quantity), 2) AS std, count(DISTINCT store) AS stores, count(DISTINCT product) AS products
FROM forecast GROUP BY week""")
def forecast_by_week(t: Tables):
    return evaluate.forecast_by_week(t.forecast)


@query("top_n_volume", "store:s total:f",
       "SELECT store, sum(quantity) AS total FROM weekly GROUP BY store ORDER BY total DESC, store LIMIT 10")
def top_n_volume(t: Tables):
    return evaluate.top_n_volume(t.weekly, "store")


@query("top_n_products", "product:s total:f",
       "SELECT product, sum(quantity) AS total FROM fine GROUP BY product ORDER BY total DESC, product LIMIT 20")
def top_n_products(t: Tables):
    return evaluate.top_n_volume(t.fine, "product", 20)


@query("worst_errors", f"{KEY} quantity:f p_ma4:f abs_error:f",
       f"SELECT {KEY_SQL}, quantity, p_ma4, abs_error FROM errors ORDER BY abs_error DESC, {KEY_SQL} LIMIT 20")
def worst_errors(t: Tables):
    return evaluate.worst_errors(t.scored, "quantity", "p_ma4", ["store", "product", "year", "week"])


@query("forecast_totals_diff", "forecast_total:f baseline_total:f difference:f difference_pct:f",
       """SELECT a AS forecast_total, b AS baseline_total, a - b AS difference, 100.0 * (a - b) / b AS difference_pct FROM
(SELECT sum(prediction) AS a FROM raw_forecast), (SELECT sum(quantity) AS b FROM weekly)""")
def forecast_totals_diff(t: Tables):
    return evaluate.forecast_totals_diff(_naive(t), t.weekly)


PREDICTIONS = ("p_lag1", "p_ma4", "p_ma8", "p_mean")


@query("prediction_diversity", "mean_correlation:f min_correlation:f max_correlation:f diversity:f",
       f"""SELECT avg(correlation) AS mean_correlation, min(correlation) AS min_correlation,
max(correlation) AS max_correlation, 1 - avg(correlation) AS diversity FROM ({_pairs_sql('scored', PREDICTIONS)})""")
def prediction_diversity(t: Tables):
    return evaluate.prediction_diversity(t.scored, PREDICTIONS)


BASELINE_SQL = """
SELECT store, product, count(*) AS weeks, avg(quantity) AS historical_mean, max(quantity) FILTER (back = 1) AS last_value,
  avg(quantity) FILTER (back <= 12) AS moving_average, regr_slope(quantity, -back) AS trend_slope,
  coalesce(regr_intercept(quantity, -back), avg(quantity)) AS linear_trend,
  coalesce(max(quantity) FILTER (back = 52), max(quantity) FILTER (back = 1)) AS seasonal_naive
FROM (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY week_date DESC, year DESC, week DESC) AS back FROM weekly)
GROUP BY store, product"""


@query("baselines",
       "store:s product:s weeks:i historical_mean:f last_value:f moving_average:f trend_slope:f linear_trend:f "
       "seasonal_naive:f segment_mean:f",
       f"""SELECT b.*, m.segment_mean FROM ({BASELINE_SQL}) b JOIN
(SELECT product AS segment, avg(quantity) AS segment_mean FROM weekly GROUP BY product) m ON b.product = m.segment""")
def baselines(t: Tables):
    return evaluate.baselines(t.weekly_table.withColumn("segment", F.col("product")), segment="segment")


COMPARED = " UNION ALL ".join(f"SELECT '{p}' AS method, {metrics_sql(p)} FROM scored" for p in PREDICTIONS)


@query("baseline_comparison", f"method:s {METRICS} wmape_improvement:f wmape_rank:i mae_rank:i rmse_rank:i",
       f"""WITH c AS ({COMPARED}) SELECT *, 100.0 * (wmape - (SELECT wmape FROM c WHERE method = 'p_ma8')) / wmape
AS wmape_improvement, rank() OVER (ORDER BY wmape) AS wmape_rank, rank() OVER (ORDER BY mae) AS mae_rank,
rank() OVER (ORDER BY rmse) AS rmse_rank FROM c""")
def baseline_comparison(t: Tables):
    return evaluate.baseline_comparison(t.scored, "quantity", "p_ma8", ["p_lag1", "p_ma4", "p_mean"])


RESIDUAL = ("rows:i mean:f std:f under_forecast:i over_forecast:i autocorrelation:f bias_pct:f q1:f q3:f "
            "z_score_outliers:i iqr_outliers:i z_score_outlier_pct:f iqr_outlier_pct:f")


def residual_sql(by: str = "") -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    on = f"ON a.{by} = b.{by}" if by else "ON true"
    first, outer, drop = (f"a.{by} AS k, ", f"a.{by}, ", f" EXCLUDE ({by})") if by else ("", "", "")
    last, match = (f"GROUP BY a.{by}", f"ON a.{by} = o.k") if by else ("", "ON true")
    return f"""
WITH e AS (SELECT *, lag(residual) OVER (PARTITION BY store, product ORDER BY week_date, year, week) AS previous FROM errors),
a AS (SELECT {key}count(*) AS rows, avg(residual) AS mean, stddev_pop(residual) AS std,
  count(*) FILTER (residual > 0) AS under_forecast, count(*) FILTER (residual < 0) AS over_forecast,
  corr(residual, previous) AS autocorrelation, 100.0 * sum(residual) / sum(abs(quantity)) AS bias_pct,
  quantile_cont(residual, 0.25) AS q1, quantile_cont(residual, 0.75) AS q3 FROM e {group})
SELECT {outer}a.*{drop}, z_score_outliers, iqr_outliers, 100.0 * z_score_outliers / rows AS z_score_outlier_pct,
  100.0 * iqr_outliers / rows AS iqr_outlier_pct
FROM a JOIN (SELECT {first}count(*) FILTER (abs(residual - mean) > 3 * std) AS z_score_outliers,
  count(*) FILTER (residual < q1 - 1.5 * (q3 - q1) OR residual > q3 + 1.5 * (q3 - q1)) AS iqr_outliers
  FROM a JOIN e b {on} {last}) o {match}"""


@query("residual_report", RESIDUAL, residual_sql())
def residual_report(t: Tables):
    return evaluate.residual_report(t.scored, "quantity", "p_ma4")


@query("residual_report_by_segment", f"product:s {RESIDUAL}", residual_sql("product"))
def residual_report_by_segment(t: Tables):
    return evaluate.residual_report(t.scored, "quantity", "p_ma4", segment="product")


NORMAL = "rows:i skewness:f kurtosis:f k_squared:f k_p_value:f ks_statistic:f ks_p_value:f"


@query("residual_normality", NORMAL, normality.sql("errors", "residual"))
def residual_normality(t: Tables):
    return evaluate.residual_normality(t.scored, "quantity", "p_ma4")


@query("validation_report", "section:s name:s value:f verdict:s",
       f"""WITH m AS (SELECT {metrics_sql('p_ma8')} FROM scored), c AS ({COMPARED}),
r AS ({residual_sql().replace('FROM errors', 'FROM (SELECT * REPLACE (quantity - p_ma8 AS residual) FROM errors)')}),
g AS ({normality.sql('(SELECT quantity - p_ma8 AS residual FROM scored)', 'residual')})
SELECT section, name, value, CASE WHEN name = 'wmape' THEN CASE WHEN value <= 25 THEN 'approved' ELSE 'rejected' END END
AS verdict FROM (
SELECT 'metrics' AS section, 'wmape' AS name, wmape AS value FROM m UNION ALL SELECT 'metrics', 'mae', mae FROM m UNION ALL
SELECT 'metrics', 'rmse', rmse FROM m UNION ALL SELECT 'metrics', 'mape', mape FROM m UNION ALL
SELECT 'residuals', 'mean', mean FROM r UNION ALL SELECT 'residuals', 'std', std FROM r UNION ALL
SELECT 'residuals', 'autocorrelation', autocorrelation FROM r UNION ALL
SELECT 'residuals', 'z_score_outlier_pct', z_score_outlier_pct FROM r UNION ALL
SELECT 'residuals', 'iqr_outlier_pct', iqr_outlier_pct FROM r UNION ALL SELECT 'residuals', 'bias_pct', bias_pct FROM r UNION ALL
SELECT 'rank', 'wmape_rank', 1 + count(*) FROM c, m WHERE c.wmape < m.wmape AND method <> 'p_ma8' UNION ALL
SELECT 'rank', 'mae_rank', 1 + count(*) FROM c, m WHERE c.mae < m.mae AND method <> 'p_ma8' UNION ALL
SELECT 'rank', 'rmse_rank', 1 + count(*) FROM c, m WHERE c.rmse < m.rmse AND method <> 'p_ma8' UNION ALL
SELECT 'baselines', 'least_improvement', min(100.0 * (c.wmape - m.wmape) / c.wmape) FROM c, m WHERE method <> 'p_ma8'
{''.join(f" UNION ALL SELECT 'normality', '{n}', {n} FROM g" for n in evaluate.NORMALITY)})""")
def validation_report(t: Tables):
    return evaluate.validation_report(t.scored, "quantity", "p_ma8", ["p_lag1", "p_ma4", "p_mean"])


# -- post-processing ----------------------------------------------------------------------------------

PREDICTED = f"{KEY} prediction:f"
HISTORY = "(SELECT store, product, avg(quantity) AS m, max(quantity) AS x FROM history GROUP BY store, product) h"
BOUNDED = f"""SELECT r.store, r.product, year, week, least({{p}}, coalesce(least(3 * h.x, 10 * h.m), 1000)) AS prediction
FROM raw_forecast r LEFT JOIN {HISTORY} ON r.store = h.store AND r.product = h.product"""


def _large(t: Tables):
    return t.raw_forecast.withColumn("prediction", F.col("prediction") * 20)


@query("bound_by_history", PREDICTED, BOUNDED.format(p="20 * prediction"))
def bound_by_history(t: Tables):
    return forecast.bound_by_history(_large(t), t.history)


@query("bound_by_history_floor", PREDICTED, f"""
SELECT r.store, r.product, year, week,
  least(20 * prediction, greatest(least(3 * coalesce(h.x, 1000), 10 * coalesce(h.m, 0)), 1000)) AS prediction
FROM raw_forecast r LEFT JOIN {HISTORY} ON r.store = h.store AND r.product = h.product""")
def bound_by_history_floor(t: Tables):
    return forecast.bound_by_history_floor(_large(t), t.history)


TAMED = """SELECT {k}, CASE WHEN prediction > c.p99 THEN c.p95 ELSE prediction END AS prediction FROM {s} f,
(SELECT quantile_cont(prediction, 0.95) AS p95, quantile_cont(prediction, 0.99) AS p99 FROM {s} g) c"""


@query("tame_extremes", PREDICTED, TAMED.format(k=KEY_SQL, s="raw_forecast"))
def tame_extremes(t: Tables):
    return forecast.tame_extremes(t.raw_forecast)


@query("cap_by_mean", PREDICTED,
       f"SELECT {KEY_SQL}, least(prediction, 2.5 * (SELECT avg(prediction) FROM raw_forecast)) AS prediction FROM raw_forecast")
def cap_by_mean(t: Tables):
    return forecast.cap_by_mean(t.raw_forecast, 2.5)


@query("postprocess", f"{KEY} prediction:i",
       f"WITH b AS ({BOUNDED.format(p='greatest(prediction, 0)')}) SELECT * REPLACE (round_even(prediction, 0) AS prediction) "
       f"FROM ({TAMED.format(k=KEY_SQL, s='b')})")
def postprocess(t: Tables):
    return forecast.postprocess(t.raw_forecast, t.history)


@query("shift_to_horizon", "store:s product:s year:i week:i week_date:d quantity:f month:i quarter:i month_sin:f",
       """SELECT store, product, year(n) AS year, week(n) AS week, n AS week_date, quantity, month(n) AS month,
quarter(n) AS quarter, sin(2 * pi() * month(n) / 12) AS month_sin
FROM (SELECT *, CAST(week_date + INTERVAL 1 MONTH AS DATE) AS n FROM weekly
WHERE week_date >= (SELECT CAST(date_trunc('week', max(week_date)) AS DATE) - 21 FROM weekly))""")
def shift_to_horizon(t: Tables):
    dated = t.weekly.withColumns({"month": F.lit(0), "quarter": F.lit(0), "month_sin": F.lit(0.0)})
    return forecast.shift_to_horizon(dated, t.horizon_start)
