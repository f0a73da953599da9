"""Tests of normality from sums and ranks: D'Agostino's K^2 and the Kolmogorov-Smirnov test with fitted parameters.

Moments are sums that tasks combine; ranks come from ``value_ranks``, which orders inside value buckets. As mean and
deviation are taken from the same values, the Kolmogorov-Smirnov p-value is that of Lilliefors' test, by the
approximation of Dallal and Wilkinson and, above 0.1, by the polynomials for the modified statistic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.plans.scale import value_ranks, with_scalars

# Hart's rational approximation of the normal tail, and the coefficients of the two approximations.
TAIL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
            220.206867912376)
TAIL_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
               793.826512519948, 440.413735824752)
LARGE = (
    (0.302, (1.0,)),
    (0.5, (2.76773, -19.828315, 80.709644, -138.55152, 81.218052)),
    (0.9, (-4.901232, 40.662806, -97.490286, 94.029866, -32.355711)),
    (1.31, (6.198765, -19.558097, 23.186922, -12.234627, 2.423045)),
)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + c
    return total


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution, to about 15 digits."""
    x = F.abs(z)
    tail = F.when(x > 37, 0.0).when(x < 7.07106781186547, F.exp(-x * x / 2) * _horner(x, TAIL_TOP) / _horner(x, TAIL_BOTTOM)).otherwise(
        F.exp(-x * x / 2) / ((x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) * 2.506628274631)
    )
    return F.when(z > 0, 1 - tail).otherwise(tail)


def _lilliefors(d: Column, n: Column) -> Column:
    size, scaled = F.least(n, F.lit(100.0)), F.when(n > 100, d * F.pow(n / 100, F.lit(0.49))).otherwise(d)
    p = F.exp(
        -7.01256 * scaled * scaled * (size + 2.78019) + 2.99587 * scaled * F.sqrt(size + 2.78019) - 0.122119
        + 0.974598 / F.sqrt(size) + 1.67997 / size
    )
    k = (F.sqrt(n) - 0.01 + 0.85 / F.sqrt(n)) * d
    high = None
    for limit, coefficients in LARGE:
        value = _horner(k, coefficients[::-1])
        high = F.when(k <= limit, value) if high is None else high.when(k <= limit, value)
    return F.when(p > 0.1, high.otherwise(0.0)).otherwise(p)


def _k_squared(n: Column, g1: Column, b2: Column, log: Callable = F.log) -> Column:
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    ratio = y / F.sqrt(2 / (w2 - 1))
    z1 = log(ratio + F.sqrt(ratio * ratio + 1)) / F.sqrt(log(w2) / 2)
    x = (b2 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + F.sqrt(1 + 4 / (skew * skew)))
    down = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(down) * F.pow((1 - 2 / a) / F.abs(down), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def normality(df: DataFrame, value: str) -> DataFrame:
    """(rows, skewness, kurtosis, k_squared, k_p_value, ks_statistic, ks_p_value), one row.

    Nulls and NaN don't count. Kurtosis is above that of a normal. With fewer than 8 values, or all equal, the tests are
    null.
    """
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v)).withColumn("v", F.col("v") + 0.0)
    moments = rows.agg(
        F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"),
    )
    ranked = with_scalars(value_ranks(rows, "v"), moments.select("n", "mean", "std"))
    below = normal_cdf((F.col("v") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
    gap = F.greatest((F.col("rows_below") + F.col("peers")) / F.col("n") - below, below - F.col("rows_below") / F.col("n"))
    found = with_scalars(moments, ranked.agg(F.max(gap).alias("ks")))
    enough = (F.col("n") >= 8) & (F.col("std") > 0)
    n = F.when(enough, F.col("n"))
    k2 = _k_squared(n, F.col("skewness"), F.col("kurtosis") + 3)
    ks = F.when(enough, F.col("ks"))
    return found.select(
        F.col("n").cast("long").alias("rows"), F.when(enough, F.col("skewness")).alias("skewness"),
        F.when(enough, F.col("kurtosis")).alias("kurtosis"), k2.alias("k_squared"), F.exp(-k2 / 2).alias("k_p_value"),
        ks.alias("ks_statistic"), F.when(enough, _lilliefors(ks, n)).alias("ks_p_value"),
    )


def _horner_sql(x: str, coefficients: tuple[float, ...]) -> str:
    total = str(coefficients[0])
    for c in coefficients[1:]:
        total = f"({total} * {x} + {c})"
    return total


def sql(source: str, value: str) -> str:
    """The same in SQL over the rows of ``source``."""
    tail = f"exp(-x * x / 2) * {_horner_sql('x', TAIL_TOP)} / {_horner_sql('x', TAIL_BOTTOM)}"
    high = " ".join(f"WHEN k <= {limit} THEN {_horner_sql('k', c[::-1])}" for limit, c in LARGE)
    return f"""
SELECT CAST(n AS BIGINT) AS rows, g1 AS skewness, b2 - 3 AS kurtosis, z1 * z1 + z2 * z2 AS k_squared,
  exp(-(z1 * z1 + z2 * z2) / 2) AS k_p_value, d AS ks_statistic, CASE WHEN p > 0.1 THEN CASE {high} ELSE 0 END ELSE p END AS ks_p_value
FROM (SELECT *, ln(ratio + sqrt(ratio * ratio + 1)) / sqrt(ln(w2) / 2) AS z1,
  (1 - 2 / (9 * a) - sign(down) * power((1 - 2 / a) / abs(down), 1.0 / 3)) / sqrt(2 / (9 * a)) AS z2,
  exp(-7.01256 * sd * sd * (size + 2.78019) + 2.99587 * sd * sqrt(size + 2.78019) - 0.122119 + 0.974598 / sqrt(size) + 1.67997 / size) AS p
FROM (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / sqrt(2 / (w2 - 1)) AS ratio, 1 + x2 * sqrt(2 / (a - 4)) AS down
FROM (SELECT *, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  6 + 8 / skew * (2 / skew + sqrt(1 + 4 / (skew * skew))) AS a, least(n, 100) AS size,
  CASE WHEN n > 100 THEN d * power(n / 100, 0.49) ELSE d END AS sd, (sqrt(n) - 0.01 + 0.85 / sqrt(n)) * d AS k
FROM (SELECT *, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x2,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS skew
FROM (SELECT any_value(n) AS n, any_value(g1) AS g1, any_value(b2) AS b2, max(greatest(upto / n - f, f - (upto - peers) / n)) AS d
FROM (SELECT *, CASE WHEN v > mean THEN 1 - t ELSE t END AS f FROM (SELECT *, {tail} AS t FROM
  (SELECT *, abs((v - mean) / std) AS x, CAST(count(*) OVER (ORDER BY v) AS DOUBLE) AS upto, count(*) OVER (PARTITION BY v) AS peers
   FROM (SELECT {value} AS v FROM {source}), (SELECT CAST(count(*) AS DOUBLE) AS n, any_value(m) AS mean, stddev_samp(w) AS std,
     avg(power(w - m, 3)) / power(var_pop(w), 1.5) AS g1, avg(power(w - m, 4)) / power(var_pop(w), 2) AS b2
     FROM (SELECT {value} AS w, avg({value}) OVER () AS m FROM {source})))))))))) AS q"""
