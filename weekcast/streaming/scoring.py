"""Incremental scoring of arriving feature files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weekcast.operators.checks import WEEKS
from weekcast.operators.forecast import bounded, format_forecast, postprocess
from weekcast.plans.scale import scratch_path
from weekcast.sources.sinks import output_form
from weekcast.spec import DEFAULT, SeriesSpec
from weekcast.streaming.thresholds import RunningQuantiles


def stream_score(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    model: Transformer,
    target: str,
    checkpoint: str | None = None,
    thresholds: DataFrame | None = None,
    weeks: Sequence[int] | None = WEEKS,
    spec: SeriesSpec = DEFAULT,
    kind: str = "parquet",
    files_per_batch: int | None = None,
    running: RunningQuantiles | None = None,
    history: DataFrame | None = None,
) -> StreamingQuery:
    """Score every file that is new in ``source`` and add the forecasts to ``target``.

    Each micro-batch owns one folder named by its id and overwrites it, so a batch that is retried
    after a failure leaves no duplicates. The P95/P99 thresholds come from a reference table computed
    once, or from ``running``, which follows all predictions of the stream up to the batch (and survives
    restarts with it); without either they are taken from the batch. ``history`` bounds the predictions
    of each series. Processes what is there and stops.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        limits = thresholds
        scored = model.transform(batch)
        if running is not None:
            # The thresholds are of what is tamed by them: clipped, bounded predictions.
            scored = bounded(scored, history, spec=spec)
            running.update(scored, "prediction", batch_id)
            limits = running.quantiles([0.95, 0.99], ["_p95", "_p99"], batch_id)
            scored = postprocess(scored, thresholds=limits, spec=spec)
        else:
            scored = postprocess(scored, history, thresholds=limits, spec=spec)
        out = output_form(format_forecast(scored, weeks, spec=spec))
        writer = out.write.mode("overwrite")
        path = f"{target}/batch_id={batch_id}"
        if kind == "csv":
            writer.option("sep", ";").option("header", True).csv(path)
        else:
            writer.parquet(path)

    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(source)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
