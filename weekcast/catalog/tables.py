"""The given tables in the engine's roles, as Spark frames and as SQL for the checks.

FINE fact: line items per supplier (store) and part (product). DENSE fact: the same per supplier and
brand, whose weekly series are long enough for lags and models.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.operators.folds import newest_weeks_start
from weekcast.operators.joins import merge_master_data
from weekcast.operators.series import series_window
from weekcast.operators.weekly import weekly_sales
from weekcast.plans.scale import attach, materialize
from weekcast.spec import SeriesSpec


def by_series(lines: DataFrame) -> DataFrame:
    """Weekly sales from line items in one exchange: all lines of a series go to one task."""
    return weekly_sales(lines.repartition("store", "product"))


class Tables:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.stored: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def fine(self) -> DataFrame:
        gross = F.col("l_extendedprice")
        discount = gross * F.col("l_discount")
        return self.read("lineitem").select(
            F.col("l_suppkey").cast("string").alias("store"),
            F.col("l_partkey").cast("string").alias("product"),
            F.col("l_shipdate").alias("date"),
            F.col("l_quantity").alias("quantity"),
            gross.alias("gross_value"),
            discount.alias("discount"),
            (gross - discount).alias("net_value"),
            ((gross - discount) * F.col("l_tax")).alias("taxes"),
        )

    @cached_property
    def raw(self) -> DataFrame:
        """Transactions under source names with faults: bad and missing numbers, dates and ids,
        negative quantities, and a copy of every first line."""
        li, key, line = self.read("lineitem"), F.col("l_orderkey"), F.col("l_linenumber")
        faulty = li.select(
            F.when(key % 97 != 0, F.col("l_suppkey")).alias("internal_store_id"),
            F.when(key % 89 != 0, F.col("l_partkey")).alias("internal_product_id"),
            F.when(key % 83 == 0, "unknown")
            .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
            .alias("transaction_date"),
            F.when((line == 7) & (key % 5 == 0), "n/a")
            .when(key % 31 == 0, "-3")
            .otherwise(F.col("l_quantity").cast("string"))
            .alias("quantity"),
            F.when(key % 11 != 0, F.col("l_extendedprice")).alias("gross_value"),
            F.when(key % 13 != 0, F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
            key.alias("order_key"),
            line.alias("line"),
        )
        return faulty.unionByName(faulty.where(line == 1))

    @cached_property
    def stores(self) -> DataFrame:
        nation = self.read("nation").join(
            self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        masters = self.read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").cast("string").alias("store"),
            F.col("r_name").alias("premise"),
            F.col("n_name").alias("store_category"),
            F.col("s_nationkey").alias("zipcode"),
        )
        return materialize(masters, "stores")

    @cached_property
    def products(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").cast("string").alias("product"),
            F.col("p_type").alias("category"),
            F.col("p_size").alias("subcategory"),
            F.col("p_brand").alias("brand"),
            F.col("p_retailprice").alias("unit_price"),
        )

    @cached_property
    def dense(self) -> DataFrame:
        brands = self.products.select("product", "brand")
        return attach(self.fine, brands, ["product"], "inner").drop("product").withColumnRenamed("brand", "product")

    @cached_property
    def fine_weekly(self) -> DataFrame:
        return weekly_sales(self.fine)

    @cached_property
    def fine_weekly_table(self) -> DataFrame:
        """``fine_weekly`` written once, clustered by series, as ``weekly_table`` is."""
        return materialize(by_series(self.fine).sortWithinPartitions("store", "product"), "fine-weekly")

    @cached_property
    def panel(self) -> DataFrame:
        """Weekly FINE panel with store and product attributes."""
        return merge_master_data(self.fine_weekly_table, self.products, self.stores)

    @cached_property
    def panel_table(self) -> DataFrame:
        """``panel`` written once, clustered by series: the input of the feature builders."""
        return materialize(self.panel, "panel", ["store", "product"])

    @cached_property
    def weekly(self) -> DataFrame:
        """Weekly DENSE panel, dealt by series: sums and windows over a series need no other exchange."""
        return by_series(self.dense)

    @cached_property
    def horizon_start(self) -> Column:
        """First day of the newest four weeks of the data; everything before is history."""
        return newest_weeks_start(self.fine.select("date"), spec=SeriesSpec(week_date="date"))

    @cached_property
    def history(self) -> DataFrame:
        """Weekly DENSE panel before the newest four weeks."""
        return self.weekly.where(F.col("week_date") < self.horizon_start)

    @cached_property
    def weekly_table(self) -> DataFrame:
        """``weekly`` written once, clustered by series as it is dealt."""
        return materialize(self.weekly.sortWithinPartitions("store", "product"), "weekly")

    @cached_property
    def sales_table(self) -> DataFrame:
        """Keys and quantity of ``weekly``, written once: what models and encodings read. The money columns are not exchanged."""
        narrow = self.weekly.select("store", "product", "year", "week", "week_date", "quantity")
        return materialize(narrow.sortWithinPartitions("store", "product"), "sales")

    @cached_property
    def scored(self) -> DataFrame:
        """DENSE panel with naive forecasts from earlier rows, used where predictions are needed."""
        w, q = series_window(), F.col("quantity")
        columns = ["store", "product", "year", "week", "week_date", "quantity"]
        before = {
            "p_lag1": F.lag(q, 1).over(w),
            "p_ma4": F.avg(q).over(w.rowsBetween(-4, -1)),
            "p_ma8": F.avg(q).over(w.rowsBetween(-8, -1)),
            "p_mean": F.avg(q).over(w.rowsBetween(-(1 << 30), -1)),
        }
        return self.weekly.select(*columns).withColumns(before).where(F.col("p_lag1").isNotNull())

    @cached_property
    def raw_forecast(self) -> DataFrame:
        """Panel keys with an unbounded prediction: last value extrapolated away from its mean."""
        return self.scored.select(
            "store", "product", "year", "week", "week_date",
            (3 * F.col("p_lag1") - 2 * F.col("p_ma4")).alias("prediction"),
        )

    @cached_property
    def forecast(self) -> DataFrame:
        """(week, store, product, quantity) of the newest year's rows of each key: a valid forecast."""
        newest = F.max_by("p_ma4", "year")
        return self.scored.groupBy("week", "store", "product").agg(F.rint(newest).cast("int").alias("quantity"))


SERIES = "WINDOW w AS (PARTITION BY store, product ORDER BY week_date, year, week)"
WEEKLY_SQL = """
SELECT store, product, year(date) AS year, week(date) AS week, sum(quantity) AS quantity,
       CAST(min(date) AS DATE) AS week_date, sum(gross_value) AS gross_value, sum(net_value) AS net_value,
       sum(discount) AS discount, sum(taxes) AS taxes,
       CAST(year(date) AS VARCHAR) || '_W' || lpad(CAST(week(date) AS VARCHAR), 2, '0') AS week_label
FROM {fact} GROUP BY store, product, year(date), week(date)"""

CTES = {
    "fine": """
SELECT CAST(l_suppkey AS VARCHAR) AS store, CAST(l_partkey AS VARCHAR) AS product, l_shipdate AS date,
       l_quantity AS quantity, l_extendedprice AS gross_value, l_extendedprice * l_discount AS discount,
       l_extendedprice - l_extendedprice * l_discount AS net_value,
       (l_extendedprice - l_extendedprice * l_discount) * l_tax AS taxes FROM lineitem""",
    "faulty": """
SELECT CASE WHEN l_orderkey % 97 <> 0 THEN l_suppkey END AS internal_store_id,
       CASE WHEN l_orderkey % 89 <> 0 THEN l_partkey END AS internal_product_id,
       CASE WHEN l_orderkey % 83 = 0 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS transaction_date,
       CASE WHEN l_linenumber = 7 AND l_orderkey % 5 = 0 THEN 'n/a' WHEN l_orderkey % 31 = 0 THEN '-3'
            ELSE CAST(l_quantity AS VARCHAR) END AS quantity,
       CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END AS gross_value,
       CASE WHEN l_orderkey % 13 <> 0 THEN l_extendedprice * l_discount END AS discount,
       l_orderkey AS order_key, l_linenumber AS line FROM lineitem""",
    "raw_tx": "SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE line = 1",
    "typed": """
SELECT CAST(internal_store_id AS VARCHAR) AS store, CAST(internal_product_id AS VARCHAR) AS product,
       try_cast(transaction_date AS TIMESTAMP) AS date, try_cast(quantity AS DOUBLE) AS quantity,
       gross_value, discount, order_key, line FROM raw_tx""",
    "complete": """
SELECT * FROM typed WHERE quantity IS NOT NULL AND date IS NOT NULL AND store IS NOT NULL AND product IS NOT NULL""",
    "imputed": """
SELECT * REPLACE (coalesce(gross_value, (SELECT median(gross_value) FROM complete)) AS gross_value,
                  coalesce(discount, (SELECT median(discount) FROM complete)) AS discount) FROM complete""",
    "stores": """
SELECT CAST(s_suppkey AS VARCHAR) AS store, r_name AS premise, n_name AS store_category, s_nationkey AS zipcode
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "products": """
SELECT CAST(p_partkey AS VARCHAR) AS product, p_type AS category, p_size AS subcategory, p_brand AS brand,
       p_retailprice AS unit_price FROM part""",
    "dense": "SELECT f.* REPLACE (p.brand AS product) FROM fine f JOIN products p ON f.product = p.product",
    "fine_weekly": WEEKLY_SQL.format(fact="fine"),
    "weekly": WEEKLY_SQL.format(fact="dense"),
    "history": """
SELECT * FROM weekly WHERE week_date < (SELECT CAST(date_trunc('week', max(week_date)) AS DATE) - 21 FROM weekly)""",
    "panel": """
SELECT w.*, coalesce(s.premise, 'Unknown') AS premise, coalesce(s.store_category, 'Unknown') AS store_category,
       s.zipcode, coalesce(p.category, 'Unknown') AS category, p.subcategory,
       coalesce(p.brand, 'Unknown') AS brand, p.unit_price
FROM fine_weekly w LEFT JOIN stores s ON w.store = s.store LEFT JOIN products p ON w.product = p.product""",
    "scored": f"""
SELECT * FROM (SELECT store, product, year, week, week_date, quantity, lag(quantity, 1) OVER w AS p_lag1,
  avg(quantity) OVER (PARTITION BY store, product ORDER BY week_date, year, week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS p_ma4,
  avg(quantity) OVER (PARTITION BY store, product ORDER BY week_date, year, week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS p_ma8,
  avg(quantity) OVER (PARTITION BY store, product ORDER BY week_date, year, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_mean
  FROM weekly {SERIES}) WHERE p_lag1 IS NOT NULL""",
    "raw_forecast": "SELECT store, product, year, week, week_date, 3 * p_lag1 - 2 * p_ma4 AS prediction FROM scored",
    "forecast": """
SELECT week, store, product, CAST(round_even(max_by(p_ma4, year), 0) AS INTEGER) AS quantity
FROM scored GROUP BY week, store, product""",
    "errors": """
SELECT *, abs(quantity - p_ma4) AS abs_error, abs(quantity - p_ma4) / nullif(quantity, 0) * 100 AS pct_error,
       quantity - p_ma4 AS residual FROM scored""",
}
