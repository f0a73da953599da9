"""Calendar expressions and the holiday table."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.functions.scalars import flag
from weekcast.plans.scale import CALENDAR_ROWS, attach, with_scalars

TAU = 2 * math.pi
HOLIDAY_REACH = 30
HOLIDAY_NEAR = 7

# National holidays on fixed dates (month, day, name).
FIXED_HOLIDAYS = (
    (1, 1, "New Year"),
    (4, 21, "Tiradentes"),
    (5, 1, "Labour Day"),
    (9, 7, "Independence Day"),
    (10, 12, "Our Lady of Aparecida"),
    (11, 2, "All Souls"),
    (11, 15, "Republic Day"),
    (12, 25, "Christmas"),
)


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday: first Sunday after the ecclesiastical full moon."""
    golden = year % 19
    century = year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    epact -= (epact // 28) * (1 - (29 // (epact + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + epact + 2 - century + century // 4) % 7
    moon = epact - weekday
    month = 3 + (moon + 40) // 44
    return dt.date(year, month, moon + 28 - 31 * (month // 4))


def holiday_rows(first_year: int, last_year: int) -> list[tuple[dt.date, str]]:
    rows = []
    for year in range(first_year, last_year + 1):
        rows += [(dt.date(year, m, d), name) for m, d, name in FIXED_HOLIDAYS]
        rows.append((easter(year) - dt.timedelta(days=2), "Good Friday"))
    return sorted(rows)


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(date, name) of the national holidays; nine rows a year, so always small."""
    return spark.createDataFrame(holiday_rows(first_year, last_year), "date date, name string")


def holidays_around(df: DataFrame, date: str) -> DataFrame:
    """The national holidays of all years of a date column, and of the years next to them."""
    first, last = df.agg(F.min(F.year(date)), F.max(F.year(date))).first()
    if first is None:
        return holiday_table(df.sparkSession, 2000, 2000)
    return holiday_table(df.sparkSession, max(first - 1, 1), min(last + 1, 9998))


# -- F1-F3, F5, F7-F10 -------------------------------------------------------------------------


def weekday(date: Column) -> Column:
    """Monday = 0."""
    return F.weekday(date)


def calendar_basic(date: Column) -> dict[str, Column]:
    return {
        "iso_week": F.weekofyear(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "year": F.year(date),
        "weekday": weekday(date),
        "day": F.day(date),
        "day_of_year": F.dayofyear(date),
        "week_of_month": (F.floor(F.day(date) / 7) + 1).cast("int"),
    }


def calendar_flags(date: Column) -> dict[str, Column]:
    day = F.day(date)
    return {
        "is_month_start": flag(day <= 7),
        "is_month_middle": flag((day > 7) & (day <= 21)),
        "is_month_end": flag(day > 21),
        "is_weekend": flag(weekday(date) >= 5),
    }


def time_features_v1(date: Column) -> dict[str, Column]:
    """Variant applied right after aggregation: month end from day 24, month name in English."""
    day = F.day(date)
    return {
        "month": F.month(date),
        "quarter": F.quarter(date),
        "weekday": weekday(date),
        "day": day,
        "week_of_month": (F.floor(day / 7) + 1).cast("int"),
        "is_month_start": flag(day <= 7),
        "is_month_end": flag(day >= 24),
        "is_weekend": flag(weekday(date) >= 5),
        "month_name": F.date_format(date, "MMMM"),
    }


def cyclic_encoding(date: Column) -> dict[str, Column]:
    cycles = {
        "week": (F.weekofyear(date), 52),
        "month": (F.month(date), 12),
        "weekday": (weekday(date), 7),
        "quarter": (F.quarter(date), 4),
    }
    out = {}
    for name, (position, length) in cycles.items():
        angle = F.lit(TAU) * position / length
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def season_flags(date: Column) -> dict[str, Column]:
    month, quarter = F.month(date), F.quarter(date)
    out = {f"is_q{q}": flag(quarter == q) for q in (1, 2, 3, 4)}
    out["is_january"] = flag(month == 1)
    out["is_december"] = flag(month == 12)
    out["is_june_july"] = flag(month.isin(6, 7))
    return out


def last_friday(date: Column) -> Column:
    """Last Friday of the date's month."""
    return F.date_sub(F.next_day(F.last_day(date), "Fri"), 7)


def black_friday_window(date: Column) -> Column:
    near = F.abs(F.datediff(date, last_friday(date))) <= 7
    return flag((F.month(date) == 11) & near)


def retail_periods(date: Column) -> dict[str, Column]:
    month = F.month(date)
    return {
        "is_christmas": flag(month == 12),
        "is_back_to_school": flag(month.isin(1, 2)),
        "is_mothers_day": flag(month == 5),
    }


def week_label(year: Column, week: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("_W"), F.lpad(week.cast("string"), 2, "0"))


def week_start(date: Column) -> Column:
    """Monday of the date's week."""
    return F.date_sub(F.to_date(date), weekday(date))


def advanced_time(date: Column) -> dict[str, Column]:
    """Weekday, weekend flag, and annual and quarterly waves."""
    return {
        "weekday": weekday(date),
        "is_weekend": flag(weekday(date).isin(5, 6)),
        "annual_season": F.sin(F.lit(TAU) * F.weekofyear(date) / 52),
        "quarter_season": F.sin(F.lit(TAU) * F.quarter(date) / 4),
    }


# -- J6, F6, W13 -------------------------------------------------------------------------------


def holiday_distance_table(holidays: DataFrame, reach: int = HOLIDAY_REACH) -> DataFrame:
    """Every date within ``reach`` days of a holiday with its distances.

    Built from the holiday table alone (at most 61 dates per holiday), so the as-of search needs
    neither a range join on the facts nor a pass over them.
    """
    offsets = holidays.select("date").distinct().select(
        F.col("date").alias("_h"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_k")
    )
    return (
        offsets.groupBy(F.date_add("_h", F.col("_k")).alias("_date"))
        .agg(
            F.max(F.when(F.col("_k") == 0, 1).otherwise(0)).alias("is_holiday"),
            F.min(F.when(F.col("_k") < 0, -F.col("_k"))).alias("days_to_holiday"),
            F.min(F.when(F.col("_k") > 0, F.col("_k"))).alias("days_since_holiday"),
        )
    )


def holiday_distance(df: DataFrame, date: str, holidays: DataFrame, reach: int = HOLIDAY_REACH) -> DataFrame:
    """Adds is_holiday and days to the next / since the previous holiday (0 = none within reach)."""
    table = holiday_distance_table(holidays, reach)
    joined = attach(df.withColumn("_date", F.to_date(date)), table, ["_date"], rows=CALENDAR_ROWS)
    added = ("is_holiday", "days_to_holiday", "days_since_holiday")
    return joined.drop("_date").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in added})


def holiday_flags(df: DataFrame, date: str, holidays: DataFrame, strict: bool = False) -> DataFrame:
    """``holiday_distance`` plus pre/post flags.

    A distance of 0 means "none within 30 days" and also passes the 7-day test, as in the original
    feature; ``strict=True`` asks for a distance of 1-7.
    """
    low = 1 if strict else 0
    return holiday_distance(df, date, holidays).withColumns(
        {
            "is_pre_holiday": flag(F.col("days_to_holiday").between(low, HOLIDAY_NEAR)),
            "is_post_holiday": flag(F.col("days_since_holiday").between(low, HOLIDAY_NEAR)),
        }
    )


def trend_features(df: DataFrame, date: str) -> DataFrame:
    """Days and weeks since the first date, normalised and squared trend, position in the year."""
    span = df.agg(F.min(F.to_date(date)).alias("_first"), F.max(F.to_date(date)).alias("_last"))
    d = F.to_date(date)
    days = F.datediff(d, F.col("_first"))
    share = F.coalesce(F.try_divide(days, F.datediff(F.col("_last"), F.col("_first"))), F.lit(0.0))
    return (
        with_scalars(df, span)
        .withColumns(
            {
                "days_since_start": days,
                "weeks_since_start": F.floor(days / 7).cast("int"),
                "trend": share,
                "trend_squared": share * share,
                "annual_trend": F.dayofyear(d) / 365.25,
            }
        )
        .drop("_first", "_last")
    )


def add(df: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    """Add several groups of named expressions in one projection."""
    merged: dict[str, Column] = {}
    for group in groups:
        merged.update(group)
    return df.withColumns(merged)
