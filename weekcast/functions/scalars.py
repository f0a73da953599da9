"""Small column expressions used across operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: guard added to denominators of ratio features.
EPSILON = 1e-8


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def divide(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL instead of failing on a zero denominator."""
    return F.try_divide(numerator, denominator)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present; NULL where one of them is constant.

    The built-in ``corr`` fails on constants in ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for NULL)."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def count_true(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def date_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def slug(text: str) -> str:
    """Lower-case name with blanks and dashes as underscores, usable in a column name."""
    return text.strip().lower().replace(" ", "_").replace("-", "_").replace(".", "_").replace("#", "_")


def round_half_even(value: Column) -> Column:
    """Nearest whole unit, ties to even."""
    return F.rint(value).cast("int")


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def percent_error(actual: Column, predicted: Column) -> Column:
    """|a - p| / a * 100, NULL where the actual is zero."""
    return divide(F.abs(actual - predicted), actual) * 100


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def is_digits(value: Column) -> Column:
    return value.cast("string").rlike("^[0-9]+$")


def parses_as_number(value: Column) -> Column:
    return value.cast("string").try_cast("double").isNotNull()


def zip_region(value: Column) -> Column:
    return F.substring(value.cast("string"), 1, 1)
