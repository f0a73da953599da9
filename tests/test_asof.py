"""As-of joins beside a loop."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekcast.operators.asof import asof_join

DAY = datetime.date(2020, 1, 1)


def plain(left, right, direction, tolerance, keyed):
    out = []
    for k, t, i in left:
        near = [(abs(t - rt), rt, v) for rk, rt, v in right if t is not None and rt is not None and (not keyed or (rk == k and k is not None))
                and (rt <= t if direction == "backward" else rt >= t)]
        near = [n for n in near if tolerance is None or n[0] <= tolerance]
        best = min(near, key=lambda n: (n[0], -n[2]), default=None)
        out.append((k, t, i, best and best[1], best and best[2]))
    return out


def order(rows):
    return sorted(rows, key=lambda r: r[2])


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("tolerance", [None, 3.0])
@pytest.mark.parametrize("ranges", [1, 7])
def test_against_a_loop(spark, direction, keyed, tolerance, ranges):
    """Ties, nulls, rows before and after everything, and a key that most rows share."""
    draw = np.random.default_rng(1)

    def key():
        return None if draw.random() < 0.05 else ("hot" if draw.random() < 0.6 else f"k{draw.integers(4)}")

    left = [(key(), None if draw.random() < 0.05 else float(draw.integers(-5, 60)), i) for i in range(150)]
    right = [(key(), None if draw.random() < 0.05 else float(draw.integers(0, 50)), int(i)) for i in draw.permutation(60)]
    a = spark.createDataFrame(left, "k string, t double, i int").repartition(3)
    b = spark.createDataFrame(right, "k string, rt double, v int").repartition(2)
    got = asof_join(a, b if keyed else b.drop("k"), "t", "rt", ["k"] if keyed else [], direction, tolerance, ranges)
    assert got.columns == ["k", "t", "i", "rt", "v"]
    assert order(map(tuple, got.collect())) == order(plain(left, right, direction, tolerance, keyed))


def test_rows_of_one_time_are_not_sent_to_one_task(spark, monkeypatch):
    """Many rows with few times are not exchanged at all; with many times there are more ranges."""
    from weekcast.operators import asof

    a = spark.range(50_000).select((F.col("id") % 3).cast("double").alias("t"), F.col("id").alias("i"))
    b = spark.createDataFrame([(0.5, "x"), (1.5, "y")], "rt double, v string")
    joined = asof_join(a, b, "t", "rt")
    assert sorted(map(tuple, joined.groupBy("t", "v").count().collect()), key=str) == [(0.0, None, 16667), (1.0, "x", 16667), (2.0, "y", 16666)]
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Window" not in text and "hashpartitioning" not in text
    monkeypatch.setattr(asof, "RANGE_TIMES", 10)
    many = asof_join(spark.range(5000).select(F.col("id").cast("double").alias("t")), b, "t", "rt", direction="forward")
    assert many.where("v IS NOT NULL").orderBy("t").collect() == [(0.0, 0.5, "x"), (1.0, 1.5, "y")]


def test_dates_and_times(spark):
    a = spark.createDataFrame([(DAY, 1), (DAY + datetime.timedelta(days=9), 2)], "d date, i int")
    b = spark.sql("SELECT timestamp'2019-12-31 23:00:00' AS at, 'x' AS v UNION ALL SELECT timestamp'2020-01-05 01:00:00', 'y'")
    assert [(r.i, r.v) for r in asof_join(a, b, "d", "at").orderBy("i").collect()] == [(1, "x"), (2, "y")]
    assert [(r.i, r.v) for r in asof_join(a, b, "d", "at", tolerance=86_400).orderBy("i").collect()] == [(1, "x"), (2, None)]
    assert [r.v for r in asof_join(a, b.limit(0), "d", "at").collect()] == [None, None]
    assert asof_join(a.limit(0), b, "d", "at").count() == 0


def test_what_cannot_be_joined(spark):
    a, b = spark.createDataFrame([(1.0, 2)], "t double, v int"), spark.createDataFrame([(1.0, 3)], "t double, v int")
    with pytest.raises(ValueError, match="t, v"):
        asof_join(a, b, "t")
    with pytest.raises(ValueError, match="direction"):
        asof_join(a, b, "t", direction="sideways")
