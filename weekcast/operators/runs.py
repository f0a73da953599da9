"""Run-metrics table: (run, strategy, recorded_at, store, product, metric, value).

Overall figures have NULL store and product; the other rows hold the same metric per series, so the
comparisons work overall and per series.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekcast.operators.evaluate import metric_aggregates
from weekcast.plans.scale import quantiles
from weekcast.spec import DEFAULT, SeriesSpec

SCHEMA = (
    "run string, strategy string, recorded_at timestamp, store string, product string, metric string, value double"
)
MANIFEST = "_runs"  # a name that readers of the data skip
ERROR_METRICS = ("wmape", "mae", "rmse", "mape")


def run_metrics(
    df: DataFrame, actual: str, runs: dict[str, tuple[str, str]], spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Metrics of several prediction columns, overall and per series, from one pass.

    ``runs``: run name -> (strategy, prediction column). Rows without a prediction are left out.
    """
    structs = [
        F.struct(F.lit(r).alias("run"), F.lit(s).alias("strategy"), F.col(p).cast("double").alias("_p"))
        for r, (s, p) in runs.items()
    ]
    long = (
        df.select(*spec.series, F.col(actual).cast("double").alias("_a"), F.explode(F.array(*structs)).alias("_r"))
        .select(*spec.series, "_a", "_r.*")
        .where(F.col("_p").isNotNull())
    )
    keys = [F.col("run"), F.col("strategy")]
    series = [F.col(c) for c in spec.series]
    table = long.groupingSets([[*keys, *series], keys], *keys, *series).agg(
        *[e.alias(n) for n, e in metric_aggregates(F.col("_a"), F.col("_p")).items()]
    )
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ERROR_METRICS])
    return table.select(*keys, *series, F.explode(pairs).alias("_m")).select(
        "run", "strategy", F.col(spec.store).alias("store"), F.col(spec.product).alias("product"), "_m.metric", "_m.value"
    )


def record_metrics(table: DataFrame, path: str, recorded_at: Column | None = None) -> None:
    """Store the metrics of the runs in ``table``, each run once, however often it is recorded.

    The rows go to a new folder below ``path``. When they are complete, one small file per run is put into the manifest:
    it names the folder that holds the run now. Readers obey the manifest, so a writer that dies half-way leaves the
    runs as they were, and recording a run again replaces it.
    """
    spark = table.sparkSession
    when = recorded_at if recorded_at is not None else F.current_timestamp()
    folder = uuid.uuid4().hex
    stored = f"{path}/folder={folder}"
    table.withColumn("recorded_at", when).write.partitionBy("strategy").parquet(stored)
    names = spark.read.schema(SCHEMA).parquet(stored).select("run").distinct().collect()  # the runs of one call
    files, jvm_path = _files(spark, path)
    for (run,) in names:
        entry = f"{path}/{MANIFEST}/{hashlib.sha256(str(run).encode()).hexdigest()}"
        fresh = jvm_path(f"{entry}.{folder}")
        stream = files.create(fresh, True)
        stream.write(bytearray(json.dumps({"run": run, "folder": folder}).encode()))
        stream.close()
        # A run's entry is replaced as a whole: the newest file of a run counts, and older ones go.
        for old in files.globStatus(jvm_path(f"{entry}.*")):
            if old.getPath().getName() != fresh.getName():
                files.delete(old.getPath(), False)


def _files(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    return jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run, folder): where each recorded run is; of a run with two entries that which was written last."""
    entries = spark.read.text(f"{path}/{MANIFEST}/*", wholetext=True)
    read = entries.select(F.from_json("value", "run string, folder string").alias("e"), F.col("_metadata.file_modification_time").alias("t"))
    flat = read.select("e.run", "e.folder", "t")
    return flat.groupBy("run").agg(F.max_by("folder", F.struct("t", "folder")).alias("folder"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The recorded runs; none before the first."""
    files, jvm_path = _files(spark, path)
    if not files.exists(jvm_path(f"{path}/{MANIFEST}")):
        return spark.createDataFrame([], SCHEMA)
    current = manifest(spark, path)
    stored = spark.read.schema(f"{SCHEMA}, folder string").parquet(path)
    named = [c.split()[0] for c in SCHEMA.split(", ")]
    return stored.join(current, ["run", "folder"], "left_semi").select(*named)


def overall(table: DataFrame) -> DataFrame:
    return table.where(F.col("store").isNull() & F.col("product").isNull())


def per_series(table: DataFrame) -> DataFrame:
    return table.where(F.col("store").isNotNull() & F.col("product").isNotNull())


def list_runs(table: DataFrame, strategy: str | None = None) -> DataFrame:
    """(run, strategy, recorded_at), newest first, optionally of one strategy (prunes partitions)."""
    src = table if strategy is None else table.where(F.col("strategy") == strategy)
    return (
        overall(src)
        .groupBy("run", "strategy")
        .agg(F.max("recorded_at").alias("recorded_at"))
        .orderBy(F.desc("recorded_at"), F.asc("run"))
    )


def _best_first(metric: str) -> Column:
    value = F.col("value")
    return F.struct(value if metric in ERROR_METRICS else -value, F.col("run"))


def best_run(table: DataFrame, metric: str = "wmape", by: Sequence[str] = ()) -> DataFrame:
    """Lowest error (or highest score), ties by run name: overall, per strategy or per series."""
    src = table.where((F.col("metric") == metric) & F.col("value").isNotNull())
    src = per_series(src) if set(by) & {"store", "product"} else overall(src)
    row = F.min_by(F.struct("run", "strategy", "value"), _best_first(metric)).alias("_b")
    picked = src.groupBy(*by).agg(row)
    fields = [f for f in ("run", "strategy", "value") if f not in by]
    return picked.select(*by, *[F.col(f"_b.{f}").alias(f) for f in fields])


def compare_runs(table: DataFrame, metrics: Sequence[str] = ERROR_METRICS, primary: str = "wmape") -> DataFrame:
    """One row per run with its metrics as columns, sorted by the primary one."""
    wide = overall(table).groupBy("run", "strategy").pivot("metric", list(metrics)).agg(F.first("value"))
    return wide.orderBy(F.asc(primary), F.asc("run"))


def metric_summary(table: DataFrame, metric: str) -> DataFrame:
    """Count, mean, std, min, max and median of a metric over the series of each run."""
    src = per_series(table).where((F.col("metric") == metric) & F.col("value").isNotNull())
    v = F.col("value")
    base = src.groupBy("run").agg(
        F.count(v).alias("series"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    return base.join(quantiles(src, "value", [0.5], ["run"], names=["median"]), "run")


def cv_summary(fold_metrics: DataFrame, metrics: Sequence[str] = ERROR_METRICS) -> DataFrame:
    """(metric, mean, std) over the folds of a cross-validation table."""
    row = fold_metrics.agg(
        *[F.avg(m).alias(f"_a_{m}") for m in metrics], *[F.stddev_samp(m).alias(f"_s_{m}") for m in metrics]
    )
    structs = [
        F.struct(F.lit(m).alias("metric"), F.col(f"_a_{m}").alias("mean"), F.col(f"_s_{m}").alias("std"))
        for m in metrics
    ]
    return row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def leaderboard(table: DataFrame, metric: str = "wmape", k: int = 5) -> DataFrame:
    """The k best runs of a metric."""
    src = overall(table).where((F.col("metric") == metric) & F.col("value").isNotNull())
    value = F.col("value")
    order = F.asc(value) if metric in ERROR_METRICS else F.desc(value)
    return src.select("run", "strategy", "value").orderBy(order, F.asc("run")).limit(k)


def top_k_runs(table: DataFrame, metric: str = "wmape", k: int = 2) -> DataFrame:
    """The k best runs of each strategy with their rank."""
    src = overall(table).where((F.col("metric") == metric) & F.col("value").isNotNull())
    order = Window.partitionBy("strategy").orderBy(F.asc("value"), F.asc("run"))
    ranked = src.select("strategy", "run", "value", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def pareto_front(wide: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows no other row of the group beats on both metrics (smaller is better).

    A row is dominated if a smaller first value comes with a second value at most its own, or an
    equal first value with a smaller second one. Both are running minima over the group in order of
    the first metric, so no pairs of rows are formed.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = wide.where(F.col(first).isNotNull() & F.col(second).isNotNull()).withColumn(
        "_rank", F.dense_rank().over(group.orderBy(first))
    )
    smaller = group.orderBy("_rank").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*by, "_rank")
    before, peers = F.min(second).over(smaller), F.min(second).over(same)
    marked = ranked.withColumns({"_before": before, "_peers": peers})
    dominated = (F.col("_before") <= F.col(second)) | (F.col("_peers") < F.col(second))
    return marked.where(~F.coalesce(dominated, F.lit(False))).select(*wide.columns)


