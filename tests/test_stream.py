"""Quantiles that follow a stream, and scoring with them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from weekcast.streaming.scoring import stream_score
from weekcast.streaming.thresholds import RunningQuantiles, running_thresholds


def values(spark, x, keys=None):
    rows = [(float(v), "k" if keys is None else keys[i]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "v double, key string").repartition(3)


def rank_error(x, value, share):
    x = np.sort(x)
    low, high = np.searchsorted(x, value, "left") / len(x), np.searchsorted(x, value, "right") / len(x)
    return max(0.0, low - share, share - high)


def test_ranks_follow_all_batches(spark, tmp_path):
    """Batches of quite different values; the state of every batch is right for all so far, also after a restart."""
    draw = np.random.default_rng(1)
    batches = [draw.normal(i * 10, 1 + i, 4000) for i in range(5)]
    seen = np.array([])
    for number, batch in enumerate(batches):
        running = RunningQuantiles(spark, str(tmp_path / "state"))  # a new one each time: as after a restart
        running.update(values(spark, batch), "v", number)
        seen = np.concatenate([seen, batch])
        row = running.quantiles([0.05, 0.5, 0.95, 0.99], ["a", "b", "c", "d"]).first()
        for value, share in zip(row, (0.05, 0.5, 0.95, 0.99), strict=True):
            assert rank_error(seen, value, share) <= 0.01
        assert running.state().first().rows == len(seen)
    assert running.versions() == [1, 2, 3, 4]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    running = RunningQuantiles(spark, str(tmp_path / "state"))
    assert running.state() is None and running.quantiles([0.5], ["m"]) is None
    for number in (0, 1, 1, 1, 2, 2):
        running.update(values(spark, np.arange(100) + number), "v", number)
    assert running.state().first().rows == 300
    (tmp_path / "state" / "batch_id=3").mkdir()  # a writer that died leaves no complete version
    assert running.versions()[-1] == 2


def test_keys_missing_values_and_empty_batches(spark, tmp_path):
    running = RunningQuantiles(spark, str(tmp_path / "state"), ["key"])
    running.update(values(spark, [1, 2, 3, 100], ["a", "a", "a", "b"]), "v", 0)
    holes = values(spark, [4, 5], ["a", "c"]).unionByName(spark.sql("SELECT double('NaN') v, 'a' key UNION ALL SELECT NULL, 'd'"))
    running.update(holes, "v", 1)
    running.update(holes.limit(0), "v", 2)
    found = {r.key: (r.rows, r.m) for r in running.state().join(running.quantiles([1.0], ["m"]), "key").collect()}
    assert found == {"a": (4, 4.0), "b": (1, 100.0), "c": (1, 5.0)}
    whole = running_thresholds(spark, str(tmp_path / "none"))
    whole.update(holes.limit(0), "v", 0)
    assert whole.quantiles([0.5], ["m"]).first().m is None


def test_stream_scores_with_running_thresholds(spark, panel, tmp_path):
    """Each batch is tamed by the predictions up to it; a restart goes on from the stored state."""
    model = SQLTransformer(statement="SELECT *, quantity * 1.0D AS prediction FROM __THIS__")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    frame = panel.where("store = 'ramp'").coalesce(1)
    for part, (low, high) in enumerate(((0, 10), (10, 20))):
        frame.where(f"quantity > {low} AND quantity <= {high}").write.mode("append").parquet(source)
        running = running_thresholds(spark, str(tmp_path / "sketch"))
        for _ in range(2):  # the second start finds nothing new
            stream_score(
                spark, source, frame.schema, model, target, str(tmp_path / "state"), weeks=None, running=running, history=panel
            ).awaitTermination()
        assert running.state().first().rows == 10 * (part + 1)
    out = sorted(r.quantity for r in spark.read.parquet(target).collect())
    assert len(out) == 20 and out[:9] == list(range(1, 10)) and max(out) <= 20
    assert running.quantiles([0.5], ["m"]).select(F.col("m").between(9, 11)).first()[0]


@pytest.mark.parametrize("size", [100, 800])
def test_size_of_the_sketch(spark, tmp_path, size):
    running = RunningQuantiles(spark, str(tmp_path / "s"), size=size)
    running.update(values(spark, np.arange(3000)), "v", 0)
    assert len(running.state().first().sketch) < 60 * size
