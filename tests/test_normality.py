"""Normality tests beside formulas in Python and simulation."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekcast.operators.normality import normal_cdf, normality


def frame(spark, x):
    return spark.createDataFrame([(None if v is None else float(v),) for v in x], "x double").repartition(3)


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def plain_ks(x):
    x = np.sort(x)
    f = np.array([phi(z) for z in (x - x.mean()) / x.std(ddof=1)])
    n = len(x)
    return max((np.searchsorted(x, x, "right") / n - f).max(), (f - np.searchsorted(x, x, "left") / n).max())


def test_normal_cdf(spark):
    z = np.concatenate([np.linspace(-8, 8, 161), [-40.0, 40.0, 0.0]])
    got = [r.p for r in frame(spark, z).coalesce(1).select("x", normal_cdf(F.col("x")).alias("p")).orderBy("x").collect()]
    assert np.allclose(got, [phi(v) for v in np.sort(z)], atol=1e-14)


@pytest.mark.parametrize("shape", ["normal", "skewed", "flat", "ties"])
def test_statistics(spark, shape):
    draw = np.random.default_rng(1)
    x = {"normal": draw.normal(3, 2, 500), "skewed": draw.gamma(2, 1, 500), "flat": draw.uniform(-1, 1, 500),
         "ties": np.round(draw.normal(0, 2, 500))}[shape]
    row = normality(frame(spark, [*x, None, float("nan")]), "x").first()
    c = x - x.mean()
    assert row.rows == 500
    assert row.skewness == pytest.approx((c**3).mean() / (c**2).mean() ** 1.5, abs=1e-9)
    assert row.kurtosis == pytest.approx((c**4).mean() / (c**2).mean() ** 2 - 3, abs=1e-9)
    assert row.ks_statistic == pytest.approx(plain_ks(x), abs=1e-10)
    assert row.k_p_value == pytest.approx(math.exp(-row.k_squared / 2))
    if shape == "normal":
        assert row.k_p_value > 0.01 and row.ks_p_value > 0.01
    else:
        assert row.ks_p_value < 0.05 and (shape == "ties" or row.k_p_value < 1e-4)


def test_p_values_hold_their_level():
    """Of many normal samples about a tenth has the fitted statistic that a p-value of 0.1 stands for."""
    draw = np.random.default_rng(2)
    n = 80
    found = np.sort([plain_ks(draw.normal(size=n)) for _ in range(3000)])
    d = found[int(0.9 * len(found))]
    p = math.exp(-7.01256 * d * d * (n + 2.78019) + 2.99587 * d * math.sqrt(n + 2.78019) - 0.122119 + 0.974598 / math.sqrt(n) + 1.67997 / n)
    assert p == pytest.approx(0.1, abs=0.02)


def test_too_little_to_test(spark):
    for x in ([], [1.0] * 20, [1.0, 2.0, 3.0], [None]):
        row = normality(frame(spark, x), "x").first()
        assert (row.k_squared, row.k_p_value, row.ks_statistic, row.ks_p_value) == (None, None, None, None)
