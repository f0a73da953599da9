"""Queries on calendar, entity and series features and their compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcast.catalog.registry import query
from weekcast.catalog.tables import SERIES, Tables
from weekcast.functions import calendar, scalars
from weekcast.operators import entity, folds, series
from weekcast.plans import features

KEY = "store:s product:s year:i week:i"
KEY_SQL = "store, product, year, week"

# -- calendar ------------------------------------------------------------------------------------
# The calendar functions run over the order dates, one row per order.


def _orders(t: Tables, *groups):
    orders = t.read("orders").select("o_orderkey", F.col("o_orderdate").alias("d"))
    return calendar.add(orders, *[g(F.col("d")) for g in groups])


BASIC_SQL = """week(d) AS iso_week, month(d) AS month, quarter(d) AS quarter, year(d) AS year, isodow(d) - 1 AS weekday,
day(d) AS day, dayofyear(d) AS day_of_year, day(d) // 7 + 1 AS week_of_month"""
FLAGS_SQL = """CAST(day(d) <= 7 AS INTEGER) AS is_month_start, CAST(day(d) > 7 AND day(d) <= 21 AS INTEGER) AS is_month_middle,
CAST(day(d) > 21 AS INTEGER) AS is_month_end, CAST(isodow(d) >= 6 AS INTEGER) AS is_weekend"""
CYCLIC_SQL = """sin(2 * pi() * week(d) / 52) AS week_sin, cos(2 * pi() * week(d) / 52) AS week_cos,
sin(2 * pi() * month(d) / 12) AS month_sin, cos(2 * pi() * month(d) / 12) AS month_cos,
sin(2 * pi() * (isodow(d) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(d) - 1) / 7) AS weekday_cos,
sin(2 * pi() * quarter(d) / 4) AS quarter_sin, cos(2 * pi() * quarter(d) / 4) AS quarter_cos"""
SEASON_SQL = """CAST(quarter(d) = 1 AS INTEGER) AS is_q1, CAST(quarter(d) = 2 AS INTEGER) AS is_q2,
CAST(quarter(d) = 3 AS INTEGER) AS is_q3, CAST(quarter(d) = 4 AS INTEGER) AS is_q4,
CAST(month(d) = 1 AS INTEGER) AS is_january, CAST(month(d) = 12 AS INTEGER) AS is_december,
CAST(month(d) IN (6, 7) AS INTEGER) AS is_june_july"""
RETAIL_SQL = """CAST(month(d) = 12 AS INTEGER) AS is_christmas, CAST(month(d) IN (1, 2) AS INTEGER) AS is_back_to_school,
CAST(month(d) = 5 AS INTEGER) AS is_mothers_day"""
# Last Friday of November counted back from the 30th.
FRIDAY_SQL = """CAST(month(d) = 11 AND abs(date_diff('day', CAST(d AS DATE),
make_date(year(d), 11, 30) - CAST((isodow(make_date(year(d), 11, 30)) + 2) % 7 AS INTEGER))) <= 7 AS INTEGER)"""
ORDERS = "(SELECT o_orderkey, o_orderdate AS d FROM orders)"

BASIC = "iso_week:i month:i quarter:i year:i weekday:i day:i day_of_year:i week_of_month:i"
FLAGS = "is_month_start:i is_month_middle:i is_month_end:i is_weekend:i"
CYCLIC = "week_sin:f week_cos:f month_sin:f month_cos:f weekday_sin:f weekday_cos:f quarter_sin:f quarter_cos:f"
SEASON = "is_q1:i is_q2:i is_q3:i is_q4:i is_january:i is_december:i is_june_july:i"
RETAIL = "is_christmas:i is_back_to_school:i is_mothers_day:i"


@query("calendar_basic", f"o_orderkey:i {BASIC}", f"SELECT o_orderkey, {BASIC_SQL} FROM {ORDERS}")
def calendar_basic(t: Tables):
    return _orders(t, calendar.calendar_basic)


@query("calendar_flags", f"o_orderkey:i {FLAGS}", f"SELECT o_orderkey, {FLAGS_SQL} FROM {ORDERS}")
def calendar_flags(t: Tables):
    return _orders(t, calendar.calendar_flags)


@query("time_features_v1",
       "o_orderkey:i month:i quarter:i weekday:i day:i week_of_month:i is_month_start:i is_month_end:i is_weekend:i "
       "month_name:s",
       f"""SELECT o_orderkey, month(d) AS month, quarter(d) AS quarter, isodow(d) - 1 AS weekday, day(d) AS day,
day(d) // 7 + 1 AS week_of_month, CAST(day(d) <= 7 AS INTEGER) AS is_month_start,
CAST(day(d) >= 24 AS INTEGER) AS is_month_end, CAST(isodow(d) >= 6 AS INTEGER) AS is_weekend,
monthname(d) AS month_name FROM {ORDERS}""")
def time_features_v1(t: Tables):
    return _orders(t, calendar.time_features_v1)


@query("cyclic_encoding", f"o_orderkey:i {CYCLIC}", f"SELECT o_orderkey, {CYCLIC_SQL} FROM {ORDERS}")
def cyclic_encoding(t: Tables):
    return _orders(t, calendar.cyclic_encoding)


@query("season_flags", f"o_orderkey:i {SEASON}", f"SELECT o_orderkey, {SEASON_SQL} FROM {ORDERS}")
def season_flags(t: Tables):
    return _orders(t, calendar.season_flags)


@query("retail_periods", f"o_orderkey:i {RETAIL}", f"SELECT o_orderkey, {RETAIL_SQL} FROM {ORDERS}")
def retail_periods(t: Tables):
    return _orders(t, calendar.retail_periods)


@query("black_friday_window", "o_orderkey:i is_black_friday:i",
       f"SELECT o_orderkey, {FRIDAY_SQL} AS is_black_friday FROM {ORDERS}")
def black_friday_window(t: Tables):
    return _orders(t, lambda d: {"is_black_friday": calendar.black_friday_window(d)})


@query("advanced_time", "o_orderkey:i weekday:i is_weekend:i annual_season:f quarter_season:f",
       f"""SELECT o_orderkey, isodow(d) - 1 AS weekday, CAST(isodow(d) IN (6, 7) AS INTEGER) AS is_weekend,
sin(2 * pi() * week(d) / 52) AS annual_season, sin(2 * pi() * quarter(d) / 4) AS quarter_season FROM {ORDERS}""")
def advanced_time(t: Tables):
    return _orders(t, calendar.advanced_time)


@query("week_label", "event_id:i week_label:s",
       """SELECT event_id, CAST(year(ts) AS VARCHAR) || '_W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week_label
FROM events""")
def week_label(t: Tables):
    ts = F.col("ts")
    return t.read("events").select("event_id", calendar.week_label(F.year(ts), F.weekofyear(ts)).alias("week_label"))


@query("week_start", "event_id:i week_start:d",
       "SELECT event_id, date_trunc('week', ts) AS week_start FROM events")
def week_start(t: Tables):
    return t.read("events").select("event_id", calendar.week_start(F.col("ts")).alias("week_start"))


@query("zip_region", "store:s zip_region:s",
       "SELECT store, substr(CAST(zipcode AS VARCHAR), 1, 1) AS zip_region FROM stores")
def zip_region(t: Tables):
    return t.stores.select("store", scalars.zip_region(F.col("zipcode")).alias("zip_region"))


@query("errors", f"{KEY} abs_error:f pct_error:f residual:f",
       f"SELECT {KEY_SQL}, abs_error, pct_error, residual FROM errors")
def errors(t: Tables):
    from weekcast.operators.evaluate import error_columns

    return error_columns(t.scored, "quantity", "p_ma4")


HOLIDAYS = "(VALUES " + ", ".join(
    f"(DATE '{d}')" for d, _ in calendar.holiday_rows(1990, 2035)) + ") h(h)"
DISTANCE_SQL = f"""
SELECT x.dd, coalesce(max(CASE WHEN h = x.dd THEN 1 END), 0) AS is_holiday,
  coalesce(min(CASE WHEN h > x.dd AND h <= x.dd + 30 THEN h - x.dd END), 0) AS days_to_holiday,
  coalesce(min(CASE WHEN h < x.dd AND h >= x.dd - 30 THEN x.dd - h END), 0) AS days_since_holiday
FROM (SELECT DISTINCT CAST({{d}} AS DATE) AS dd FROM {{src}}) x, {HOLIDAYS} GROUP BY x.dd"""
HOLIDAY = "is_holiday:i days_to_holiday:i days_since_holiday:i"


@query("holiday_distance", f"o_orderkey:i {HOLIDAY}",
       "SELECT o_orderkey, is_holiday, days_to_holiday, days_since_holiday FROM orders JOIN ("
       + DISTANCE_SQL.format(d="o_orderdate", src="orders") + ") k ON CAST(o_orderdate AS DATE) = k.dd")
def holiday_distance(t: Tables):
    return calendar.holiday_distance(t.read("orders"), "o_orderdate", calendar.holidays_around(t.read("orders"), "o_orderdate"))


PRE_POST_SQL = """CAST(days_to_holiday <= 7 AS INTEGER) AS is_pre_holiday, CAST(days_since_holiday <= 7 AS INTEGER)
AS is_post_holiday"""


@query("holiday_flags", f"o_orderkey:i {HOLIDAY} is_pre_holiday:i is_post_holiday:i",
       f"SELECT o_orderkey, is_holiday, days_to_holiday, days_since_holiday, {PRE_POST_SQL} FROM orders JOIN ("
       + DISTANCE_SQL.format(d="o_orderdate", src="orders") + ") k ON CAST(o_orderdate AS DATE) = k.dd")
def holiday_flags(t: Tables):
    return calendar.holiday_flags(t.read("orders"), "o_orderdate", calendar.holidays_around(t.read("orders"), "o_orderdate"))


@query("holiday_flags_strict", "o_orderkey:i is_pre_holiday:i is_post_holiday:i",
       "SELECT o_orderkey, CAST(days_to_holiday BETWEEN 1 AND 7 AS INTEGER) AS is_pre_holiday, "
       "CAST(days_since_holiday BETWEEN 1 AND 7 AS INTEGER) AS is_post_holiday FROM orders JOIN ("
       + DISTANCE_SQL.format(d="o_orderdate", src="orders") + ") k ON CAST(o_orderdate AS DATE) = k.dd")
def holiday_flags_strict(t: Tables):
    return calendar.holiday_flags(t.read("orders"), "o_orderdate", calendar.holidays_around(t.read("orders"), "o_orderdate"), strict=True)


TREND = "days_since_start:i weeks_since_start:i trend:f trend_squared:f annual_trend:f"
TREND_SQL = """CAST({d} AS DATE) - s.a AS days_since_start, (CAST({d} AS DATE) - s.a) // 7 AS weeks_since_start,
(CAST({d} AS DATE) - s.a) / (s.b - s.a) AS trend, power((CAST({d} AS DATE) - s.a) / (s.b - s.a), 2) AS trend_squared,
dayofyear({d}) / 365.25 AS annual_trend"""


@query("trend_features", f"o_orderkey:i {TREND}",
       f"SELECT o_orderkey, {TREND_SQL.format(d='o_orderdate')} FROM orders, "
       "(SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders) s")
def trend_features(t: Tables):
    return calendar.trend_features(t.read("orders"), "o_orderdate")


# -- entities --------------------------------------------------------------------------------------

STATS = "{n}_qty_mean:f {n}_qty_median:f {n}_qty_std:f {n}_qty_min:f {n}_qty_max:f {n}_qty_total:f {n}_num_sales:i {n}_qty_cv:f"
STATS_SQL = """avg(quantity) AS {n}_qty_mean, median(quantity) AS {n}_qty_median, stddev_samp(quantity) AS {n}_qty_std,
min(quantity) AS {n}_qty_min, max(quantity) AS {n}_qty_max, sum(quantity) AS {n}_qty_total, count(*) AS {n}_num_sales,
coalesce(stddev_samp(quantity) / nullif(avg(quantity), 0), 0) AS {n}_qty_cv"""
ACTIVITY_SQL = """(max(week_date) - min(week_date)) / 7 AS {n}_weeks_span, count(DISTINCT week_date) AS {n}_weeks_active,
count(DISTINCT week_date) / ((max(week_date) - min(week_date)) / 7 + 1) AS {r}"""


@query("product_stats", "product:s " + STATS.format(n="product"),
       f"SELECT product, {STATS_SQL.format(n='product')} FROM fine_weekly GROUP BY product")
def product_stats(t: Tables):
    return entity.product_stats(t.fine_weekly)


@query("store_stats", "store:s " + STATS.format(n="store"),
       f"SELECT store, {STATS_SQL.format(n='store')} FROM fine_weekly GROUP BY store")
def store_stats(t: Tables):
    return entity.store_stats(t.fine_weekly)


@query("product_velocity", "product:s product_weeks_span:f product_weeks_active:i product_velocity:f",
       f"SELECT product, {ACTIVITY_SQL.format(n='product', r='product_velocity')} FROM fine_weekly GROUP BY product")
def product_velocity(t: Tables):
    return entity.product_velocity(t.fine_weekly)


@query("store_activity", "store:s store_weeks_span:f store_weeks_active:i store_activity:f",
       f"SELECT store, {ACTIVITY_SQL.format(n='store', r='store_activity')} FROM fine_weekly GROUP BY store")
def store_activity(t: Tables):
    return entity.store_activity(t.fine_weekly)


@query("store_diversity", "store:s store_num_products:i",
       "SELECT store, count(DISTINCT product) AS store_num_products FROM fine_weekly GROUP BY store")
def store_diversity(t: Tables):
    return entity.store_diversity(t.fine_weekly)


BRAND_SQL = """
SELECT brand, count(DISTINCT product) AS brand_num_products,
  CAST(row_number() OVER (ORDER BY count(DISTINCT product) DESC, brand) <= 20 AS INTEGER) AS is_top_brand
FROM panel GROUP BY brand"""


@query("brand_breadth", "brand:s brand_num_products:i is_top_brand:i", BRAND_SQL)
def brand_breadth(t: Tables):
    return entity.brand_breadth(t.panel)


@query("product_subcategories", "product:s product_num_subcategories:i",
       "SELECT product, count(DISTINCT subcategory) AS product_num_subcategories FROM panel GROUP BY product")
def product_subcategories(t: Tables):
    return entity.product_subcategories(t.panel)


PRICE_SQL = """CAST(unit_price <= q.a AS INTEGER) AS is_cheap, CAST(unit_price > q.a AND unit_price <= q.b AS INTEGER)
AS is_mid_price, CAST(unit_price > q.b AS INTEGER) AS is_expensive"""
PRICE_CUTS = "(SELECT quantile_cont(unit_price, 0.25) AS a, quantile_cont(unit_price, 0.75) AS b FROM panel) q"


@query("price_tiers", f"{KEY} unit_price:f is_cheap:i is_mid_price:i is_expensive:i",
       f"SELECT {KEY_SQL}, unit_price, {PRICE_SQL} FROM panel, {PRICE_CUTS}")
def price_tiers(t: Tables):
    return entity.price_tiers(t.panel_table)


# Fixed values of the given tables: part types and regions.
CATEGORIES = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


VALUES = {
    "category": CATEGORIES,
    "premise": REGIONS,
    "store_category": tuple(f"NATION_{i}" for i in range(25)),
    "zip_region": tuple("123456789"),
}
CATEGORY_SET = " ".join(f"category_{c.lower()}:i" for c in CATEGORIES) + " category_other:i"
CATEGORY_SQL = ", ".join(f"CAST({{p}}category = '{c}' AS INTEGER) AS category_{c.lower()}" for c in CATEGORIES)


@query("category_onehot", f"{KEY} category:s {CATEGORY_SET}",
       f"""SELECT {KEY_SQL}, category, {CATEGORY_SQL.format(p='')}, CAST(category NOT IN (SELECT category FROM panel
GROUP BY category ORDER BY count(*) DESC, category LIMIT 10) AS INTEGER) AS category_other FROM panel""")
def category_onehot(t: Tables):
    return entity.category_onehot(t.panel_table)


_PREMISES = {f"store_type_{v.lower().replace(' ', '_')}": f"premise = '{v}'" for v in REGIONS}
_STORE_CATEGORIES = {f"store_category_{v.lower()}": f"store_category = '{v}'" for v in VALUES["store_category"]}
_ZIP = "substr(CAST(CAST(zipcode AS INTEGER) AS VARCHAR), 1, 1)"
_ZIPS = {f"region_{d}": f"{_ZIP} = '{d}'" for d in VALUES["zip_region"]}
_HOT = {**_PREMISES, **_STORE_CATEGORIES, **_ZIPS}
ONEHOT = " ".join(f"{n}:i" for n in _HOT) + " zip_region:s"
ONEHOT_SQL = ", ".join(f"CAST({c} AS INTEGER) AS {n}" for n, c in _HOT.items()) + f", {_ZIP} AS zip_region"


@query("store_type_onehot", f"{KEY} {ONEHOT}", f"SELECT {KEY_SQL}, {ONEHOT_SQL} FROM panel")
def store_type_onehot(t: Tables):
    return entity.store_type_onehot(t.panel_table, t.stores, VALUES)


TYPES_SQL = """SELECT {k}'store_type' AS attribute, premise AS value FROM {s} UNION ALL
SELECT {k}'store_category', store_category FROM {s} UNION ALL SELECT {k}'region', substr(CAST(CAST(zipcode AS INTEGER) AS VARCHAR), 1, 1) FROM {s}"""


@query("store_type_long", f"{KEY} attribute:s value:s position:i",
       f"""SELECT {KEY_SQL}, attribute, value, position FROM ({TYPES_SQL.format(k=KEY_SQL + ", ", s="panel")})
JOIN (SELECT attribute, value, row_number() OVER (ORDER BY attribute, value) AS position
  FROM (SELECT DISTINCT attribute, value FROM ({TYPES_SQL.format(k="", s="stores")}) WHERE value IS NOT NULL)) USING (attribute, value)""")
def store_type_long(t: Tables):
    """The 0/1 columns of store attributes in long form, with no list of values."""
    return entity.store_type_long(t.panel_table, ["store", "product", "year", "week"], entity.store_type_index(t.stores))


ZIP_SQL = """
SELECT zipcode AS z, count(*) AS zip_density FROM panel GROUP BY zipcode"""
ZIP_CUT = f"""(SELECT quantile_cont(zip_density, 0.75) AS c FROM panel JOIN ({ZIP_SQL}) ON zipcode = z)"""


@query("zip_density", f"{KEY} zipcode:i zip_density:i is_urban:i",
       f"""SELECT {KEY_SQL}, zipcode, zip_density, CAST(zip_density >= c AS INTEGER) AS is_urban
FROM panel JOIN ({ZIP_SQL}) ON zipcode = z, {ZIP_CUT}""")
def zip_density(t: Tables):
    return entity.zip_density(t.panel_table)


RANK_SQL = """
SELECT {e}, sum(quantity) AS {n}_total, dense_rank() OVER (ORDER BY sum(quantity) DESC) AS {n}_rank,
  (rank() OVER (ORDER BY sum(quantity)) + (count(*) OVER (PARTITION BY sum(quantity)) - 1) / 2) / count(*) OVER ()
  AS {n}_percentile FROM fine_weekly GROUP BY {e}"""
RANK = "{e}:s {n}_total:f {n}_rank:i {n}_percentile:f is_{n}_top10:i is_{n}_top100:i is_{n}_top_percentile:i"
RANK_FLAGS = """CAST({n}_rank <= 10 AS INTEGER) AS is_{n}_top10, CAST({n}_rank <= 100 AS INTEGER) AS is_{n}_top100,
CAST({n}_percentile >= 0.9 AS INTEGER) AS is_{n}_top_percentile"""


@query("dense_rank_total", RANK.format(e="product", n="product"),
       f"SELECT *, {RANK_FLAGS.format(n='product')} FROM ({RANK_SQL.format(e='product', n='product')})")
def dense_rank_total(t: Tables):
    return entity.entity_ranking(t.fine_weekly, "product", "product")


@query("percentile_rank", RANK.format(e="store", n="store"),
       f"SELECT *, {RANK_FLAGS.format(n='store')} FROM ({RANK_SQL.format(e='store', n='store')})")
def percentile_rank(t: Tables):
    return entity.entity_ranking(t.fine_weekly, "store", "store")


ENCODING = "product_mean_encoding:f store_mean_encoding:f series_mean_encoding:f"


@query("target_encoding", f"{KEY} {ENCODING}",
       f"""SELECT {KEY_SQL}, avg(quantity) OVER (PARTITION BY product) AS product_mean_encoding,
avg(quantity) OVER (PARTITION BY store) AS store_mean_encoding,
avg(quantity) OVER (PARTITION BY store, product) AS series_mean_encoding FROM weekly""")
def target_encoding(t: Tables):
    return entity.target_encoding(t.sales_table)


PAST = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"


@query("target_encoding_leak_safe", f"{KEY} {ENCODING}",
       f"""SELECT {KEY_SQL}, avg(quantity) OVER (PARTITION BY product ORDER BY week_date {PAST}) AS product_mean_encoding,
avg(quantity) OVER (PARTITION BY store ORDER BY week_date {PAST}) AS store_mean_encoding,
avg(quantity) OVER (PARTITION BY store, product ORDER BY week_date {PAST}) AS series_mean_encoding FROM weekly""")
def target_encoding_leak_safe(t: Tables):
    return entity.target_encoding(t.sales_table, leak_safe=True)


# -- series ------------------------------------------------------------------------------------------


def frame(size: int, end: str = "CURRENT ROW") -> str:
    start = "UNBOUNDED" if size == 0 else str(size)
    return f"OVER (PARTITION BY store, product ORDER BY week_date, year, week ROWS BETWEEN {start} PRECEDING AND {end})"


LAG_SQL = ", ".join(f"lag(quantity, {n}) OVER w AS quantity_lag_{n}" for n in (1, 2, 4, 8))


@query("lags", f"{KEY} quantity_lag_1:f quantity_lag_2:f quantity_lag_4:f quantity_lag_8:f",
       f"SELECT {KEY_SQL}, {LAG_SQL} FROM weekly {SERIES}")
def lags(t: Tables):
    return series.lags(t.weekly)


@query("lags_long", f"{KEY} quantity_lag_1:f quantity_lag_12:f quantity_lag_26:f quantity_lag_52:f",
       f"SELECT {KEY_SQL}, " + ", ".join(f"lag(quantity, {n}) OVER w AS quantity_lag_{n}" for n in (1, 12, 26, 52))
       + f" FROM weekly {SERIES}")
def lags_long(t: Tables):
    return series.lags(t.weekly, periods=(1, 12, 26, 52))


RATIO_SQL = """coalesce(quantity / (lag(quantity, 1) OVER w + 1e-8), 1) AS quantity_ratio_lag1,
coalesce(quantity / (lag(quantity, 2) OVER w + 1e-8), 1) AS quantity_ratio_lag2,
coalesce(quantity - lag(quantity, 1) OVER w, 0) AS quantity_diff_lag1,
coalesce(quantity - lag(quantity, 4) OVER w, 0) AS quantity_diff_lag4"""
RATIOS = "quantity_ratio_lag1:f quantity_ratio_lag2:f quantity_diff_lag1:f quantity_diff_lag4:f"


@query("lag_ratios", f"{KEY} {RATIOS}", f"SELECT {KEY_SQL}, {RATIO_SQL} FROM weekly {SERIES}")
def lag_ratios(t: Tables):
    return series.lag_ratios(t.weekly)


def rolling_sql(safe: bool = False) -> str:
    parts = []
    for k in (4, 8, 12):
        over = frame(k, "1 PRECEDING") if safe else frame(k - 1)
        parts += [
            f"avg(quantity) {over} AS quantity_rolling_mean_{k}",
            f"coalesce(stddev_samp(quantity) {over}, 0) AS quantity_rolling_std_{k}",
            f"min(quantity) {over} AS quantity_rolling_min_{k}",
            f"max(quantity) {over} AS quantity_rolling_max_{k}",
            f"median(quantity) {over} AS quantity_rolling_median_{k}",
        ]
    return ", ".join(parts)


ROLLING = " ".join(f"quantity_rolling_{s}_{k}:f" for k in (4, 8, 12) for s in ("mean", "std", "min", "max", "median"))


@query("rolling_stats", f"{KEY} {ROLLING}", f"SELECT {KEY_SQL}, {rolling_sql()} FROM weekly")
def rolling_stats(t: Tables):
    return series.rolling_stats(t.weekly)


@query("rolling_stats_leak_safe", f"{KEY} {ROLLING}", f"SELECT {KEY_SQL}, {rolling_sql(True)} FROM weekly")
def rolling_stats_leak_safe(t: Tables):
    return series.rolling_stats(t.weekly, leak_safe=True)


FULL_SQL = ", ".join(
    f"CASE WHEN count(quantity) {frame(k - 1)} = {k} THEN {fn}(quantity) {frame(k - 1)} END AS quantity_full_{s}_{k}"
    for k in (4, 8, 12) for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))
FULL = " ".join(f"quantity_full_{s}_{k}:f" for k in (4, 8, 12) for s in ("mean", "std", "max", "min"))


@query("rolling_full", f"{KEY} {FULL}", f"SELECT {KEY_SQL}, {FULL_SQL} FROM weekly")
def rolling_full(t: Tables):
    return series.rolling_full(t.weekly)


CV_SQL = ", ".join(
    f"coalesce(quantity_rolling_std_{k} / (quantity_rolling_mean_{k} + 1e-8), 0) AS quantity_rolling_cv_{k}" for k in (4, 8, 12))
CV = " ".join(f"quantity_rolling_cv_{k}:f" for k in (4, 8, 12))
ROLLED = f"(SELECT *, {rolling_sql()} FROM weekly)"


@query("rolling_cv", f"{KEY} {CV}", f"SELECT {KEY_SQL}, {CV_SQL} FROM {ROLLED}")
def rolling_cv(t: Tables):
    return series.rolling_cv(series.rolling_stats(t.weekly))


ROLL_TREND_SQL = ", ".join(
    f"coalesce(quantity_rolling_mean_{k} - lag(quantity_rolling_mean_{k}) OVER w, 0) AS quantity_rolling_trend_{k}"
    for k in (4, 8, 12))
ROLL_TREND = " ".join(f"quantity_rolling_trend_{k}:f" for k in (4, 8, 12))


@query("rolling_trend", f"{KEY} {ROLL_TREND}", f"SELECT {KEY_SQL}, {ROLL_TREND_SQL} FROM {ROLLED} {SERIES}")
def rolling_trend(t: Tables):
    return series.rolling_trend(series.rolling_stats(t.weekly))


PCT_SQL = ", ".join(
    f"coalesce(quantity / nullif(lag(quantity, {n}) OVER w, 0) - 1, 0) AS quantity_pct_change_{n}w" for n in (1, 4, 12))
PCT = "quantity_pct_change_1w:f quantity_pct_change_4w:f quantity_pct_change_12w:f"
GROWN = f"(SELECT *, {PCT_SQL} FROM weekly {SERIES})"


@query("pct_change", f"{KEY} {PCT}", f"SELECT {KEY_SQL}, {PCT_SQL} FROM weekly {SERIES}")
def pct_change(t: Tables):
    return series.pct_change(t.weekly)


CUMULATIVE_SQL = (f"coalesce(quantity / nullif(first_value(quantity) {frame(0)}, 0) - 1, 0) AS quantity_cumulative_growth")
ACCELERATION_SQL = ("coalesce(quantity_pct_change_1w - lag(quantity_pct_change_1w) OVER w, 0) "
                    "AS quantity_growth_acceleration")
VOLATILITY_SQL = f"coalesce(stddev_samp(quantity_pct_change_1w) {frame(7)}, 0) AS quantity_growth_volatility"


@query("cumulative_growth", f"{KEY} quantity_cumulative_growth:f", f"SELECT {KEY_SQL}, {CUMULATIVE_SQL} FROM weekly")
def cumulative_growth(t: Tables):
    return series.cumulative_growth(t.weekly)


@query("growth_acceleration", f"{KEY} quantity_growth_acceleration:f",
       f"SELECT {KEY_SQL}, {ACCELERATION_SQL} FROM {GROWN} {SERIES}")
def growth_acceleration(t: Tables):
    return series.growth_acceleration(series.pct_change(t.weekly))


@query("growth_volatility", f"{KEY} quantity_growth_volatility:f", f"SELECT {KEY_SQL}, {VOLATILITY_SQL} FROM {GROWN}")
def growth_volatility(t: Tables):
    return series.growth_volatility(series.pct_change(t.weekly))


@query("row_trend", f"{KEY} row_trend:i", f"SELECT {KEY_SQL}, row_number() OVER w AS row_trend FROM weekly {SERIES}")
def row_trend(t: Tables):
    return series.row_trend(t.weekly)


@query("moving_average_total", "date:d total:f moving_average_7:f moving_average_30:f",
       """SELECT date, total, CASE WHEN row_number() OVER (ORDER BY date) >= 7 THEN
avg(total) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS moving_average_7,
CASE WHEN row_number() OVER (ORDER BY date) >= 30 THEN
avg(total) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS moving_average_30
FROM (SELECT CAST(date AS DATE) AS date, sum(quantity) AS total FROM fine GROUP BY 1)""")
def moving_average_total(t: Tables):
    return series.moving_average_total(t.fine)


@query("ewm_smooth", f"{KEY} smoothed:f",
       f"""SELECT {KEY_SQL}, list_sum(list_transform(range(1, len(h) + 1), lambda i: h[i] * power(0.9, len(h) - i)))
/ list_sum(list_transform(range(1, len(h) + 1), lambda i: power(0.9, len(h) - i))) AS smoothed
FROM (SELECT *, list(quantity) {frame(0)} AS h FROM weekly)""")
def ewm_smooth(t: Tables):
    return series.ewm_smooth(t.weekly, "quantity", 0.1, name="smoothed")


FOLD_WEEKS = """(SELECT date_trunc('week', week_date) AS ws, row_number() OVER (ORDER BY date_trunc('week', week_date) DESC) AS r,
count(*) OVER () AS n FROM (SELECT DISTINCT date_trunc('week', week_date) AS week_date FROM weekly)) k"""


@query("temporal_folds", f"{KEY} fold:i week_rank:i",
       f"""SELECT {KEY_SQL}, CASE WHEN ceil(r / 4) <= 5 THEN 6 - ceil(r / 4) ELSE 0 END AS fold, r AS week_rank
FROM weekly JOIN {FOLD_WEEKS} ON date_trunc('week', weekly.week_date) = k.ws""")
def temporal_folds(t: Tables):
    return folds.temporal_folds(t.weekly)


@query("chronological_holdout", f"{KEY} split:s",
       f"""SELECT {KEY_SQL}, CASE WHEN n - r < floor(n * 0.8) THEN 'train' ELSE 'validation' END AS split
FROM weekly JOIN {FOLD_WEEKS} ON date_trunc('week', weekly.week_date) = k.ws""")
def chronological_holdout(t: Tables):
    return folds.chronological_holdout(t.weekly)


# -- compositions --------------------------------------------------------------------------------------

TEMPORAL = (f"iso_week:i month:i quarter:i weekday:i day:i day_of_year:i week_of_month:i {FLAGS} {CYCLIC} {SEASON} "
            f"is_black_friday:i {RETAIL} {HOLIDAY} is_pre_holiday:i is_post_holiday:i {TREND}")
BASIC_NO_YEAR = BASIC_SQL.replace("year(d) AS year, ", "")


def temporal_sql(source: str) -> str:
    return f"""SELECT t.*, {BASIC_NO_YEAR}, {FLAGS_SQL}, {CYCLIC_SQL}, {SEASON_SQL}, {FRIDAY_SQL} AS is_black_friday,
{RETAIL_SQL}, is_holiday, days_to_holiday, days_since_holiday, {PRE_POST_SQL}, {TREND_SQL.format(d='d')}
FROM (SELECT *, week_date AS d FROM {source}) t JOIN ({DISTANCE_SQL.format(d='week_date', src=source)}) h ON t.d = h.dd,
(SELECT min(week_date) AS a, max(week_date) AS b FROM {source}) s"""


@query("temporal_features", f"{KEY} {TEMPORAL}", temporal_sql("weekly"))
def temporal_features(t: Tables):
    return features.temporal_features(t.weekly_table)


PRODUCT_SET = (CATEGORY_SET + " is_cheap:i is_mid_price:i is_expensive:i brand_num_products:i "
               "is_top_brand:i " + STATS.format(n="product") + " product_weeks_span:f product_weeks_active:i "
               "product_velocity:f product_num_subcategories:i product_rank:i product_percentile:f is_product_top10:i "
               "is_product_top100:i is_product_top_percentile:i")
PRODUCT_TABLE = f"""
SELECT s.*, v.* EXCLUDE (product), c.* EXCLUDE (product), r.* EXCLUDE (product, product_total),
  {RANK_FLAGS.format(n='product')}
FROM (SELECT product, {STATS_SQL.format(n='product')} FROM fine_weekly GROUP BY product) s
JOIN (SELECT product, {ACTIVITY_SQL.format(n='product', r='product_velocity')} FROM fine_weekly GROUP BY product) v
  ON s.product = v.product
JOIN (SELECT product, count(DISTINCT subcategory) AS product_num_subcategories FROM panel GROUP BY product) c
  ON s.product = c.product
JOIN ({RANK_SQL.format(e='product', n='product')}) r ON s.product = r.product"""
PRODUCT_SELECT = f"""{CATEGORY_SQL.format(p='p.')}, 0 AS category_other, {PRICE_SQL},
b.brand_num_products, b.is_top_brand, x.* EXCLUDE (product)"""
PRODUCT_FROM = f"""JOIN ({BRAND_SQL}) b ON p.brand = b.brand JOIN ({PRODUCT_TABLE}) x ON p.product = x.product, {PRICE_CUTS}"""


@query("product_features", f"{KEY} {PRODUCT_SET}",
       f"SELECT p.store, p.product, p.year, p.week, {PRODUCT_SELECT} FROM panel p {PRODUCT_FROM}")
def product_features(t: Tables):
    return entity.product_features(t.panel_table, values=VALUES)


STORE_SET = (ONEHOT + " zip_density:i is_urban:i " + STATS.format(n="store") + " store_num_products:i store_weeks_span:f "
             "store_weeks_active:i store_activity:f store_rank:i store_percentile:f is_store_top10:i is_store_top100:i "
             "is_store_top_percentile:i")
STORE_TABLE = f"""
SELECT s.*, v.* EXCLUDE (store), c.* EXCLUDE (store), r.* EXCLUDE (store, store_total), {RANK_FLAGS.format(n='store')}
FROM (SELECT store, {STATS_SQL.format(n='store')} FROM fine_weekly GROUP BY store) s
JOIN (SELECT store, {ACTIVITY_SQL.format(n='store', r='store_activity')} FROM fine_weekly GROUP BY store) v
  ON s.store = v.store
JOIN (SELECT store, count(DISTINCT product) AS store_num_products FROM fine_weekly GROUP BY store) c ON s.store = c.store
JOIN ({RANK_SQL.format(e='store', n='store')}) r ON s.store = r.store"""
STORE_SELECT = f"{ONEHOT_SQL}, zip_density, CAST(zip_density >= z.c AS INTEGER) AS is_urban, y.* EXCLUDE (store)"
STORE_FROM = f"JOIN ({ZIP_SQL}) d ON zipcode = d.z JOIN ({STORE_TABLE}) y ON p.store = y.store, {ZIP_CUT} z"


@query("store_features", f"{KEY} {STORE_SET}",
       f"SELECT p.store, p.product, p.year, p.week, {STORE_SELECT} FROM panel p {STORE_FROM}")
def store_features(t: Tables):
    return entity.store_features(t.panel_table, stores=t.stores, values=VALUES)


SERIES_SET = (f"quantity_lag_1:f quantity_lag_2:f quantity_lag_4:f quantity_lag_8:f {RATIOS} {ROLLING} {CV} {ROLL_TREND} "
              f"{PCT} quantity_cumulative_growth:f quantity_growth_acceleration:f quantity_growth_volatility:f")


def series_sql(source: str) -> str:
    return f"""SELECT *, {CV_SQL}, {ROLL_TREND_SQL}, {CUMULATIVE_SQL}, {ACCELERATION_SQL}, {VOLATILITY_SQL}
FROM (SELECT *, {LAG_SQL}, {RATIO_SQL}, {rolling_sql()}, {PCT_SQL} FROM {source} {SERIES}) {SERIES}"""


@query("series_features", f"{KEY} {SERIES_SET}", series_sql("weekly"))
def series_features(t: Tables):
    return series.series_features(t.weekly)


ALL_SQL = f"""
SELECT u.* FROM (WITH m AS ({temporal_sql('panel')}), n AS ({series_sql('panel')})
SELECT m.*, {PRODUCT_SELECT}, {STORE_SELECT},
  n.* EXCLUDE (store, product, year, week, quantity, week_date, gross_value, net_value, discount, taxes, week_label,
    premise, store_category, zipcode, category, subcategory, brand, unit_price)
FROM m JOIN panel p USING (store, product, year, week) JOIN n USING (store, product, year, week)
JOIN ({BRAND_SQL}) b ON p.brand = b.brand JOIN ({PRODUCT_TABLE}) x ON p.product = x.product
JOIN ({ZIP_SQL}) d ON p.zipcode = d.z JOIN ({STORE_TABLE}) y ON p.store = y.store, {PRICE_CUTS}, {ZIP_CUT} z) u"""
ALL_SQL = (ALL_SQL.replace("CAST(premise", "CAST(p.premise").replace("CAST(store_category", "CAST(p.store_category")
           .replace("CAST(zipcode AS", "CAST(p.zipcode AS").replace("CAST(unit_price", "CAST(p.unit_price")
           .replace("AND unit_price <=", "AND p.unit_price <="))
EVERYTHING = f"{KEY} quantity:f {TEMPORAL} {PRODUCT_SET} {STORE_SET} {SERIES_SET}"


@query("all_features", EVERYTHING, ALL_SQL)
def all_features(t: Tables):
    return features.all_features(t.panel_table, stores=t.stores, values=VALUES)


@query("all_features_parallel", EVERYTHING, ALL_SQL)
def all_features_parallel(t: Tables):
    return features.all_features_parallel(t.panel_table, stores=t.stores, values=VALUES)


@query("simplified_features",
       f"{KEY} iso_week:i month:i quarter:i week_sin:f week_cos:f month_sin:f month_cos:f is_holiday:i is_pre_holiday:i "
       "is_post_holiday:i quantity_lag_1:f quantity_lag_2:f quantity_lag_4:f quantity_rolling_mean_4:f "
       "quantity_rolling_std_4:f",
       f"""SELECT {KEY_SQL}, week(d) AS iso_week, month(d) AS month, quarter(d) AS quarter,
sin(2 * pi() * week(d) / 52) AS week_sin, cos(2 * pi() * week(d) / 52) AS week_cos,
sin(2 * pi() * month(d) / 12) AS month_sin, cos(2 * pi() * month(d) / 12) AS month_cos,
0 AS is_holiday, 0 AS is_pre_holiday, 0 AS is_post_holiday, {LAG_SQL},
avg(quantity) {frame(3)} AS quantity_rolling_mean_4, coalesce(stddev_samp(quantity) {frame(3)}, 0) AS quantity_rolling_std_4
FROM (SELECT *, week_date AS d FROM weekly) {SERIES}""")
def simplified_features(t: Tables):
    return features.simplified_features(t.weekly)


def _past_sql(entity_column: str, name: str) -> str:
    over = f"OVER (PARTITION BY {entity_column} ORDER BY week_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""SELECT {entity_column}, week_date, s / c AS {name}_past_mean,
  sqrt(greatest((s2 - s * s / c) / nullif(c - 1, 0), 0)) AS {name}_past_std, lo AS {name}_past_min, hi AS {name}_past_max,
  coalesce(s, 0) AS {name}_past_total, coalesce(c, 0) AS {name}_past_rows, n AS {name}_past_weeks
FROM (SELECT {entity_column}, week_date, sum(sum(quantity)) {over} AS s, sum(sum(quantity * quantity)) {over} AS s2,
  sum(count(quantity)) {over} AS c, min(min(quantity)) {over} AS lo, max(max(quantity)) {over} AS hi, count(*) {over} AS n
  FROM weekly GROUP BY {entity_column}, week_date)"""


PAST_SET = " ".join(
    f"{n}_past_mean:f {n}_past_std:f {n}_past_min:f {n}_past_max:f {n}_past_total:f {n}_past_rows:i {n}_past_weeks:i"
    for n in ("product", "store"))


@query("past_features", f"{KEY} {PAST_SET}",
       f"""SELECT {KEY_SQL}, p.* EXCLUDE (product, week_date), s.* EXCLUDE (store, week_date) FROM weekly
JOIN ({_past_sql('product', 'product')}) p USING (product, week_date) JOIN ({_past_sql('store', 'store')}) s USING (store, week_date)""")
def past_features(t: Tables):
    return entity.past_features(t.sales_table)
