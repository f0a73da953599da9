"""Queries on sources, sinks, cleaning, joins and the weekly aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcast.catalog.registry import FINDING_COLUMNS, findings_sql, query
from weekcast.catalog.tables import Tables
from weekcast.functions.scalars import is_digits, parses_as_number
from weekcast.operators import asof, clean, joins, weekly
from weekcast.operators.checks import week_coverage
from weekcast.operators.folds import temporal_split
from weekcast.operators.forecast import format_forecast, sort_forecast
from weekcast.operators.profile import data_summary
from weekcast.plans.scale import materialize, scratch_path, with_scalars
from weekcast.sources import parquet, sinks

FINE = "store:s product:s date:d quantity:f gross_value:f discount:f net_value:f taxes:f"
TYPED = "store:s product:s date:d quantity:f gross_value:f discount:f order_key:i line:i"
PANEL = (
    "store:s product:s year:i week:i quantity:f week_date:d gross_value:f net_value:f discount:f taxes:f week_label:s"
)
MASTER = PANEL + " premise:s store_category:s zipcode:f category:s subcategory:f brand:s unit_price:f"
FORECAST = "week:i store:s product:s quantity:i"


# -- sources -----------------------------------------------------------------------------------


LINEITEM = ("l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f l_tax:f "
            "l_returnflag:s l_linestatus:s l_shipdate:d")
ORDERS = "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:d o_orderpriority:s"


@query("scan_parquet", LINEITEM, "SELECT * FROM lineitem")
def scan_parquet(t: Tables):
    return parquet.scan_parquet(t.spark, t.path("lineitem"))


@query("scan_parquet_dir", ORDERS, "SELECT * FROM orders")
def scan_parquet_dir(t: Tables):
    return parquet.scan_parquet_dir(t.spark, t.folder, "orders.parquet")


# Tables of the folder that share a set of columns with no other table, with their column count.
SCHEMA_TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query("scan_by_schema", "table:s columns:i rows:i", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", {c} AS columns, count(*) AS rows FROM {n}"
    for n, c in SCHEMA_TABLES.items()))
def scan_by_schema(t: Tables):
    # The first column prefix tells which table a signature belongs to.
    first = {
        "r_regionkey": "region", "n_nationkey": "nation", "c_custkey": "customer", "s_suppkey": "supplier",
        "p_partkey": "part", "o_orderkey": "orders", "l_orderkey": "lineitem", "event_id": "events",
        "n_chars": "documents", "html": "pages", "item_id": "benchmark", "toxic": "labels", "conv_id": "conversations",
        "vec_id": "embeddings",
    }
    out = None
    for signature, frame in parquet.scan_by_schema(t.spark, t.folder).items():
        names = signature.split(",")
        table = next(v for k, v in first.items() if k in names)
        row = frame.agg(
            F.lit(table).alias("table"), F.lit(len(names)).alias("columns"), F.count(F.lit(1)).alias("rows")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("scan_filtered_sorted", LINEITEM,
       "SELECT * FROM lineitem WHERE l_quantity IS NOT NULL AND l_shipdate IS NOT NULL")
def scan_filtered_sorted(t: Tables):
    return parquet.scan_filtered_sorted(t.spark, t.path("lineitem"), "l_quantity", "l_shipdate")


CHUNK_SQL = ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net_value FROM lineitem "
             "WHERE l_quantity > 10")


def _net_of_large(batch):
    kept = batch[batch["l_quantity"] > 10]
    return kept.assign(net_value=kept["l_extendedprice"] * (1 - kept["l_discount"]))[
        ["l_orderkey", "l_linenumber", "net_value"]
    ]


@query("map_chunks", "l_orderkey:i l_linenumber:i net_value:f", CHUNK_SQL)
def map_chunks(t: Tables):
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
    return parquet.map_chunks(
        t.read("lineitem").select(*columns), _net_of_large, "l_orderkey long, l_linenumber int, net_value double"
    )


@query("exact_chunks", "rows:i chunks:i",
       """SELECT 25000 AS rows, count(*) // 25000 AS chunks FROM lineitem HAVING count(*) >= 25000
UNION ALL SELECT count(*) % 25000, 1 FROM lineitem HAVING count(*) % 25000 > 0""")
def exact_chunks(t: Tables):
    """Sizes of the chunks of 25,000 rows that a function sees: all full but for the last."""
    columns = t.read("lineitem").select("l_orderkey", "l_linenumber")
    sizes = parquet.exact_chunks(columns, lambda b: b.iloc[:1].assign(rows=len(b))[["rows"]], "rows long", 25_000)
    return sizes.groupBy("rows").agg(F.count(F.lit(1)).alias("chunks"))


@query("chunk_function", "store:s rows:i units:f",
       "SELECT store, count(*) AS rows, sum(quantity) AS units FROM fine WHERE quantity > 25 GROUP BY store")
def chunk_function(t: Tables):
    """A user function per chunk, aggregated afterwards by Spark."""
    large = parquet.map_chunks(
        t.fine.select("store", "quantity"), lambda b: b[b["quantity"] > 25], "store string, quantity double"
    )
    return large.groupBy("store").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("units"))


@query("file_inventory", "folder:s file:s bytes:i rows:i columns:i schema:s folder_files:i folder_bytes:i")
def file_inventory(t: Tables):
    return parquet.file_inventory(t.spark, t.path("lineitem"))


@query("load_validated", "product:s category:s subcategory:i brand:s unit_price:f", "SELECT * FROM products")
def load_validated(t: Tables):
    return parquet.load_validated(t.spark, t.path("part"), "products", table=t.products)


@query("preprocess_and_save", "l_orderkey:i l_linenumber:i net_value:f", CHUNK_SQL)
def preprocess_and_save(t: Tables):
    return parquet.preprocess_and_save(
        t.spark,
        t.path("lineitem"),
        scratch_path(t.spark, "preprocessed"),
        lambda df: df.where("l_quantity > 10").select(
            "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_value")
        ),
    )


@query("union_files", "nation_key:i source:s",
       "SELECT s_nationkey AS nation_key, 'supplier' AS source FROM supplier UNION ALL "
       "SELECT c_nationkey, 'customer' FROM customer")
def union_files(t: Tables):
    a = t.read("supplier").select(F.col("s_nationkey").alias("nation_key"), F.lit("supplier").alias("source"))
    b = t.read("customer").select(F.col("c_nationkey").alias("nation_key"), F.lit("customer").alias("source"))
    return parquet.union_files(a, b)


# -- sinks ---------------------------------------------------------------------------------------


@query("write_forecast_csv", FORECAST, "SELECT * FROM forecast")
def write_forecast_csv(t: Tables):
    path = scratch_path(t.spark, "forecast-csv")
    sinks.write_forecast_csv(t.forecast, path)
    return sinks.read_forecast_csv(t.spark, path)


@query("write_forecast_parquet", FORECAST, "SELECT * FROM forecast")
def write_forecast_parquet(t: Tables):
    path = scratch_path(t.spark, "forecast-parquet")
    sinks.write_forecast_parquet(t.forecast, path)
    return t.spark.read.parquet(path)


@query("readback_check", FINDING_COLUMNS, findings_sql("forecast", [
    ("rows", "info", None, "count(*)"),
    ("empty", "error", None, "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"),
    ("column_order", "error", None, "0"),
    ("weeks", "info", "week", "count(DISTINCT week)"),
    ("distinct", "info", "store", "count(DISTINCT store)"),
    ("distinct", "info", "product", "count(DISTINCT product)"),
    ("nulls", "error", "quantity", "count(*) FILTER (quantity IS NULL)"),
    ("negative", "error", "quantity", "count(*) FILTER (quantity < 0)"),
    ("total", "info", "quantity", "sum(quantity)"),
]))
def readback_check(t: Tables):
    path = scratch_path(t.spark, "readback")
    sinks.write_forecast_csv(t.forecast, path)
    return sinks.readback_check(sinks.read_forecast_csv(t.spark, path))


@query("compare_outputs", FINDING_COLUMNS, findings_sql("forecast", [
    ("rows_left", "info", None, "count(*)"),
    ("rows_right", "info", None, "count(*)"),
    ("columns_differ", "error", None, "0"),
    ("only_left", "error", None, "0"),
    ("only_right", "error", None, "0"),
    ("different", "error", "quantity", "count(*) FILTER (store = '1')"),
    ("duplicate_key_left", "error", None, "0"),
    ("duplicate_key_right", "error", None, "0"),
]))
def compare_outputs(t: Tables):
    """A written forecast against one whose store 1 was raised by one unit."""
    paths = sinks.write_multi_format(t.forecast, scratch_path(t.spark, "compare"), "naive", "1")
    changed = F.col("quantity") + F.when(F.col("store") == "1", 1).otherwise(0)
    return sinks.compare_outputs(
        sinks.read_forecast(t.spark, paths["csv"], "csv"),
        sinks.read_forecast(t.spark, paths["parquet"], "parquet").withColumn("quantity", changed),
    )


@query("write_multi_format", "format:s rows:i total:f",
       "SELECT f.format, count(*) AS rows, sum(quantity) AS total FROM forecast, "
       "(VALUES ('csv'), ('parquet')) f(format) GROUP BY f.format")
def write_multi_format(t: Tables):
    paths = sinks.write_multi_format(t.forecast, scratch_path(t.spark, "multi"), "naive", "1")
    out = None
    for kind, path in paths.items():
        row = sinks.read_forecast(t.spark, path, kind).agg(
            F.lit(kind).alias("format"), F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("total")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("write_feature_table", PANEL, "SELECT * FROM weekly")
def write_feature_table(t: Tables):
    path = scratch_path(t.spark, "features")
    sinks.write_feature_table(t.weekly, path)
    return t.spark.read.parquet(path)


@query("write_report_json", "column:s nulls:i mean:f",
       "SELECT 'quantity' AS \"column\", count(*) FILTER (quantity IS NULL) AS nulls, avg(quantity) AS mean FROM fine "
       "UNION ALL SELECT 'gross_value', count(*) FILTER (gross_value IS NULL), avg(gross_value) FROM fine")
def write_report_json(t: Tables):
    path = scratch_path(t.spark, "report")
    sinks.write_report_json(data_summary(t.fine.select("quantity", "gross_value")), path)
    return t.spark.read.schema("column string, nulls long, mean double").json(path)


# -- cleaning -------------------------------------------------------------------------------------


@query("standardize_columns", "store:i product:i date:s quantity:s order_key:i line:i",
       "SELECT internal_store_id AS store, internal_product_id AS product, transaction_date AS date, quantity, "
       "order_key, line FROM raw_tx")
def standardize_columns(t: Tables):
    return clean.standardize_columns(t.raw)


@query("cast_types", TYPED, "SELECT * FROM typed")
def cast_types(t: Tables):
    return clean.cast_types(clean.standardize_columns(t.raw))


def _complete(t: Tables):
    return clean.drop_missing_critical(clean.cast_types(clean.standardize_columns(t.raw)))


@query("drop_missing_critical", TYPED, "SELECT * FROM complete")
def drop_missing_critical(t: Tables):
    return _complete(t)


@query("impute_median_financials", TYPED, "SELECT * FROM imputed")
def impute_median_financials(t: Tables):
    return clean.impute_median_financials(_complete(t))


@query("filter_valid_rows", TYPED,
       "SELECT * FROM complete WHERE quantity > 0 AND date >= DATE '1997-01-01' AND date < DATE '1998-01-01'")
def filter_valid_rows(t: Tables):
    return clean.filter_valid_rows(_complete(t), year=1997)


@query("drop_duplicate_rows", TYPED, "SELECT DISTINCT * FROM typed")
def drop_duplicate_rows(t: Tables):
    return clean.drop_duplicate_rows(clean.cast_types(clean.standardize_columns(t.raw)))


IQR_SQL = """
SELECT t.* REPLACE (CASE WHEN b.lo < b.raw_low OR b.hi > b.high
                    THEN least(greatest(t.{c}, greatest(0, b.raw_low)), b.high) ELSE t.{c} END AS {c})
FROM {s} t, (SELECT min({c}) AS lo, max({c}) AS hi,
  quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS raw_low,
  quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS high FROM {s}) b"""


@query("cap_outliers_iqr", PANEL, IQR_SQL.format(c="quantity", s="weekly"))
def cap_outliers_iqr(t: Tables):
    return clean.cap_outliers_iqr(t.weekly)


@query("cap_outliers_percentile", PANEL,
       "SELECT w.* REPLACE (least(greatest(quantity, b.low), b.high) AS quantity) FROM weekly w, "
       "(SELECT quantile_cont(quantity, 0.01) AS low, quantile_cont(quantity, 0.99) AS high FROM weekly) b")
def cap_outliers_percentile(t: Tables):
    return clean.cap_outliers_percentile(t.weekly)


@query("clean_transactions", TYPED,
       "WITH valid AS (SELECT DISTINCT * FROM imputed WHERE quantity > 0) " + IQR_SQL.format(c="quantity", s="valid"))
def clean_transactions(t: Tables):
    return clean.clean_transactions(t.raw, year=None)


# Masters without every seventh store and product, so the joins leave rows unmatched.
PARTIAL_STORES = "SELECT * FROM stores WHERE CAST(store AS BIGINT) % 7 <> 3"
PARTIAL_PRODUCTS = "SELECT * FROM products WHERE CAST(product AS BIGINT) % 7 <> 3"


def _partial(frame, key: str):
    return frame.where(F.col(key).cast("long") % 7 != 3)


FILLED_SQL = f"""
WITH merged AS (SELECT w.*, s.premise, s.store_category, s.zipcode, p.category, p.subcategory, p.brand, p.unit_price
  FROM fine_weekly w LEFT JOIN ({PARTIAL_STORES}) s ON w.store = s.store
  LEFT JOIN ({PARTIAL_PRODUCTS}) p ON w.product = p.product)
SELECT * REPLACE (coalesce(premise, 'Unknown') AS premise, coalesce(store_category, 'Unknown') AS store_category,
  coalesce(zipcode, (SELECT median(zipcode) FROM merged)) AS zipcode, coalesce(category, 'Unknown') AS category,
  coalesce(subcategory, (SELECT median(subcategory) FROM merged)) AS subcategory, coalesce(brand, 'Unknown') AS brand,
  coalesce(unit_price, (SELECT median(unit_price) FROM merged)) AS unit_price) FROM merged"""


@query("fill_unmatched_dims", MASTER, FILLED_SQL)
def fill_unmatched_dims(t: Tables):
    return joins.merge_master_data(t.fine_weekly_table, _partial(t.products, "product"), _partial(t.stores, "store"))


@query("join_stores", PANEL + " premise:s store_category:s zipcode:f",
       f"""WITH merged AS (SELECT w.*, s.premise, s.store_category, s.zipcode FROM fine_weekly w
LEFT JOIN ({PARTIAL_STORES}) s ON w.store = s.store)
SELECT * REPLACE (coalesce(premise, 'Unknown') AS premise, coalesce(store_category, 'Unknown') AS store_category,
  coalesce(zipcode, (SELECT median(zipcode) FROM merged)) AS zipcode) FROM merged""")
def join_stores(t: Tables):
    return joins.join_stores(t.fine_weekly_table, _partial(t.stores, "store").withColumnRenamed("store", "pdv_id"))


@query("join_products", PANEL + " category:s subcategory:f brand:s unit_price:f",
       f"""WITH merged AS (SELECT w.*, p.category, p.subcategory, p.brand, p.unit_price FROM fine_weekly w
LEFT JOIN ({PARTIAL_PRODUCTS}) p ON w.product = p.product)
SELECT * REPLACE (coalesce(category, 'Unknown') AS category, coalesce(brand, 'Unknown') AS brand,
  coalesce(subcategory, (SELECT median(subcategory) FROM merged)) AS subcategory,
  coalesce(unit_price, (SELECT median(unit_price) FROM merged)) AS unit_price) FROM merged""")
def join_products(t: Tables):
    return joins.join_products(t.fine_weekly_table, _partial(t.products, "product").withColumnRenamed("product", "product_id"))


@query("merge_master_data", MASTER, "SELECT * FROM panel")
def merge_master_data(t: Tables):
    return t.panel


@query("select_numeric_features", "store:s product:s year:i week:i gross_value:f net_value:f discount:f taxes:f",
       "SELECT store, product, year, week, gross_value, net_value, discount, taxes FROM weekly")
def select_numeric_features(t: Tables):
    return clean.select_numeric_features(t.weekly, keep=["store", "product"])


@query("zero_fill_features", "order_key:i line:i gross_value:f discount:f share:f",
       "SELECT order_key, line, coalesce(gross_value, 0) AS gross_value, coalesce(discount, 0) AS discount, "
       "coalesce(gross_value / nullif(discount, 0), 0) AS share FROM typed")
def zero_fill_features(t: Tables):
    typed = clean.cast_types(clean.standardize_columns(t.raw))
    infinite = F.when(F.col("discount") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(F.col("gross_value"), F.col("discount"))
    )
    return clean.zero_fill(typed.select("order_key", "line", "gross_value", "discount", infinite.alias("share")))


@query("align_to_model", "store:s product:s year:i week:i taxes:f promotion:f gross_value:f",
       "SELECT store, product, year, week, taxes, 0.0 AS promotion, gross_value FROM weekly")
def align_to_model(t: Tables):
    return clean.align_to_model(
        t.weekly, ["taxes", "promotion", "gross_value"], keep=["store", "product", "year", "week"]
    )


@query("filter_horizon", PANEL, "SELECT * FROM weekly WHERE week IN (1, 2, 3, 4, 5)")
def filter_horizon(t: Tables):
    return clean.filter_horizon(t.weekly, [1, 2, 3, 4, 5])


KEYED = "store:s product:s year:i week:i prediction:f"


@query("clip_nonnegative", KEYED, "SELECT * REPLACE (greatest(prediction, 0) AS prediction) FROM raw_forecast")
def clip_nonnegative(t: Tables):
    return clean.clip_nonnegative(t.raw_forecast, "prediction")


@query("round_to_units", KEYED, "SELECT * REPLACE (round_even(prediction, 0) AS prediction) FROM raw_forecast")
def round_to_units(t: Tables):
    return clean.round_to_units(t.raw_forecast, "prediction")


@query("sales_band", "store:s product:s year:i week:i quantity:f sales_band:s",
       """SELECT store, product, year, week, quantity, CASE WHEN quantity <= 0 THEN NULL WHEN quantity <= 1 THEN '0-1'
WHEN quantity <= 5 THEN '1-5' WHEN quantity <= 10 THEN '5-10' WHEN quantity <= 50 THEN '10-50'
WHEN quantity <= 100 THEN '50-100' ELSE '100+' END AS sales_band FROM weekly""")
def sales_band(t: Tables):
    return clean.sales_band(t.weekly, "quantity")


@query("renumber_weeks", "store:s product:s year:i week:i quantity:f",
       """SELECT store, product, year, least(r.n, 5) AS week, quantity FROM weekly
JOIN (SELECT week AS old, dense_rank() OVER (ORDER BY week) AS n FROM (SELECT DISTINCT week FROM weekly)) r
ON week = r.old""")
def renumber_weeks(t: Tables):
    return clean.renumber_weeks(t.weekly)


@query("drop_incomplete", TYPED,
       "SELECT * FROM typed WHERE store IS NOT NULL AND product IS NOT NULL AND date IS NOT NULL AND quantity IS NOT NULL "
       "AND gross_value IS NOT NULL AND discount IS NOT NULL")
def drop_incomplete(t: Tables):
    return clean.drop_incomplete(clean.cast_types(clean.standardize_columns(t.raw)))


@query("sample_rows", PANEL,
       "SELECT * FROM weekly WHERE CAST('0x' || substr(md5(concat_ws('|', store, product, year, week, 42)), 1, 8) AS BIGINT) "
       "/ 4294967296.0 < 0.2")
def sample_rows(t: Tables):
    return clean.sample_rows(t.weekly, 0.2, keys=["store", "product", "year", "week"])


@query("interaction_features",
       "store:s product:s year:i week:i quantity_x_discount:f week_x_quantity:f",
       "SELECT store, product, year, week, quantity * discount AS quantity_x_discount, week * quantity AS week_x_quantity "
       "FROM weekly")
def interaction_features(t: Tables):
    return clean.interaction_features(t.weekly, [("quantity", "discount"), ("week", "quantity")])


# -- joins -------------------------------------------------------------------------------------


@query("attach_group_stats", "store:s product:s year:i week:i quantity:f store_mean:f store_rows:i",
       "SELECT store, product, year, week, quantity, avg(quantity) OVER (PARTITION BY store) AS store_mean, "
       "count(*) OVER (PARTITION BY store) AS store_rows FROM fine_weekly")
def attach_group_stats(t: Tables):
    stats = {"store_mean": F.avg("quantity"), "store_rows": F.count(F.lit(1))}
    return joins.attach_group_stats(t.fine_weekly, ["store"], stats)


@query("combine_feature_sets", "store:s product:s year:i week:i quantity:f q_lag_1:f month:i",
       """SELECT store, product, year, week, quantity, lag(quantity) OVER w AS q_lag_1, month(week_date) AS month
FROM weekly WINDOW w AS (PARTITION BY store, product ORDER BY week_date, year, week)""")
def combine_feature_sets(t: Tables):
    from weekcast.operators.series import lags

    key = ["store", "product", "year", "week"]
    first = lags(t.weekly, periods=[1]).select(*key, F.col("quantity_lag_1").alias("q_lag_1"))
    second = t.weekly.select(*key, F.month("week_date").alias("month"))
    return joins.combine_feature_sets(t.weekly.select(*key, "quantity"), first, second)


@query("asof_backward", "store:s product:s date:d quantity:f as_of:d units:f",
       """SELECT f.store, f.product, CAST(f.date AS DATE) AS date, f.quantity, r.week_date AS as_of, r.units FROM dense f ASOF LEFT JOIN
(SELECT product, week_date, sum(quantity) AS units FROM weekly GROUP BY product, week_date) r
ON f.product = r.product AND CAST(f.date AS DATE) >= r.week_date""")
def asof_backward(t: Tables):
    """Every sale with the latest weekly units of its product that had begun by then."""
    sales = t.dense.select("store", "product", F.col("date").cast("date").alias("date"), "quantity")
    units = t.weekly.groupBy("product", F.col("week_date").alias("as_of")).agg(F.sum("quantity").alias("units"))
    return asof.asof_join(sales, units, "date", "as_of", ["product"])


@query("asof_forward", "store:s product:s year:i week:i week_date:d busy_day:d busy_units:f",
       """WITH d AS (SELECT CAST(date AS DATE) AS busy_day, sum(quantity) AS busy_units FROM fine GROUP BY 1),
b AS (SELECT * FROM d WHERE busy_units > (SELECT 1.2 * avg(busy_units) FROM d))
SELECT store, product, year, week, week_date, CASE WHEN busy_day - week_date <= 30 THEN busy_day END AS busy_day,
  CASE WHEN busy_day - week_date <= 30 THEN busy_units END AS busy_units
FROM weekly w ASOF LEFT JOIN b ON w.week_date <= b.busy_day""")
def asof_forward(t: Tables):
    """Every week with the next day of all stores that is a fifth above the average, if within 30 days."""
    days = t.fine.groupBy(F.col("date").cast("date").alias("busy_day")).agg(F.sum("quantity").alias("busy_units"))
    days = materialize(days, "days")
    busy = with_scalars(days, days.agg((F.avg("busy_units") * 1.2).alias("_limit"))).where("busy_units > _limit").drop("_limit")
    weeks = t.weekly.select("store", "product", "year", "week", "week_date")
    return asof.asof_join(weeks, busy, "week_date", "busy_day", direction="forward", tolerance=30 * 86_400)


@query("in_top_k", "store:s product:s year:i week:i quantity:f is_top_brand:i",
       """SELECT store, product, year, week, quantity, CAST(product IN (SELECT product FROM weekly GROUP BY product
ORDER BY count(*) DESC, product LIMIT 10) AS INTEGER) AS is_top_brand FROM weekly""")
def in_top_k(t: Tables):
    return joins.in_top_k(t.weekly, "product", 10, "is_top_brand")


@query("join_history_bounds", "store:s product:s year:i week:i prediction:f history_mean:f history_max:f",
       """SELECT r.*, h.m AS history_mean, h.x AS history_max FROM raw_forecast r LEFT JOIN
(SELECT store, product, avg(quantity) AS m, max(quantity) AS x FROM history GROUP BY store, product) h
ON r.store = h.store AND r.product = h.product""")
def join_history_bounds(t: Tables):
    return joins.join_history_bounds(t.raw_forecast, t.history)


@query("align_actual_predicted", "store:s product:s year:i week:i quantity:f prediction:f",
       """SELECT w.store, w.product, w.year, w.week, w.quantity, r.prediction FROM weekly w JOIN raw_forecast r
USING (store, product, year, week)""")
def align_actual_predicted(t: Tables):
    key = ["store", "product", "year", "week"]
    return joins.align_actual_predicted(
        t.weekly.select(*key, "quantity"), t.raw_forecast.select(*key, "prediction"), key
    )


@query("match_rate", "rows:i matched:i",
       f"SELECT count(*) AS rows, count(s.store) AS matched FROM fine_weekly w LEFT JOIN ({PARTIAL_STORES}) s "
       "ON w.store = s.store")
def match_rate(t: Tables):
    return joins.match_rate(t.fine_weekly, _partial(t.stores, "store"), "store")


# -- weekly panel --------------------------------------------------------------------------------


@query("weekly_sales", PANEL, "SELECT * FROM fine_weekly")
def weekly_sales(t: Tables):
    return t.fine_weekly


@query("weekly_sales_iso", "store:s product:s year:i week:i quantity:f week_date:d",
       "SELECT store, product, isoyear(date) AS year, week(date) AS week, sum(quantity) AS quantity, "
       "min(date) AS week_date FROM dense GROUP BY 1, 2, 3, 4")
def weekly_sales_iso(t: Tables):
    return weekly.weekly_sales(t.dense, iso_year=True)


@query("sort_panel", PANEL, "SELECT * FROM weekly ORDER BY store, product, year, week")
def sort_panel(t: Tables):
    return weekly.sort_panel(t.weekly)


@query("keep_first_duplicate", "week:i store:s product:s year:i quantity:f",
       """SELECT week, store, product, year, quantity FROM (SELECT *, row_number() OVER (PARTITION BY week, store, product
ORDER BY week_date) AS n FROM weekly) WHERE n = 1""")
def keep_first_duplicate(t: Tables):
    return weekly.keep_first_duplicate(t.weekly)


@query("sort_forecast", FORECAST, "SELECT * FROM forecast ORDER BY week, store, product")
def sorted_forecast(t: Tables):
    return sort_forecast(t.forecast)


@query("format_forecast", FORECAST,
       "SELECT week, store, product, CAST(trunc(prediction) AS INTEGER) AS quantity FROM raw_forecast "
       "WHERE week BETWEEN 1 AND 5")
def formatted_forecast(t: Tables):
    return format_forecast(t.raw_forecast)


@query("week_coverage", "week:i status:s",
       """SELECT e.week, 'missing' AS status FROM (VALUES (0), (1), (2), (3), (60)) e(week)
WHERE e.week NOT IN (SELECT week FROM weekly) UNION ALL
SELECT DISTINCT week, 'extra' FROM weekly WHERE week NOT IN (0, 1, 2, 3, 60)""")
def covered_weeks(t: Tables):
    return week_coverage(t.weekly, [0, 1, 2, 3, 60])


@query("temporal_split", "store:s product:s year:i week:i split:s",
       """SELECT store, product, year, week, CASE WHEN week_date > (SELECT max(week_date) FROM weekly) - 14 THEN 'test'
WHEN week_date > (SELECT max(week_date) FROM weekly) - 28 THEN 'validation' ELSE 'train' END AS split FROM weekly""")
def split_by_date(t: Tables):
    return temporal_split(t.weekly)


@query("numeric_string_check", "order_key:i line:i is_number:i is_digits:i",
       """SELECT order_key, line, CAST(try_cast(quantity AS DOUBLE) IS NOT NULL AS INTEGER) AS is_number,
CAST(regexp_full_match(CAST(internal_store_id AS VARCHAR), '[0-9]+') AS INTEGER) AS is_digits FROM raw_tx""")
def numeric_string_check(t: Tables):
    return t.raw.select(
        "order_key",
        "line",
        parses_as_number(F.col("quantity")).cast("int").alias("is_number"),
        is_digits(F.col("internal_store_id")).cast("int").alias("is_digits"),
    )
