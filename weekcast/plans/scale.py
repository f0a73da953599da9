"""Plan shapes that keep whole-table statistics and joins distributed.

Three things recur in the operators and have a naive form that does not survive large data:

* an exact quantile keeps every distinct value of a column in one task;
* a rank over a whole table sorts it in one task;
* a join with per-entity statistics shuffles the fact table on a key that may be skewed.

The functions here express them as aggregations with map-side combine, windows inside value
buckets, and joins that are broadcast only after the size of the side has been checked.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_LIMIT = 64 << 20
JOIN_SALTS = 16
# Keys are counted in so many hash buckets; those of a bucket with more than a share of the rows, and no fewer than HOT_ROWS, are salted.
KEY_BUCKETS, HOT_SHARE, HOT_ROWS = 1 << 14, 1 / 1024, 10_000
# Value buckets per factor of two. Bucket tables stay below 2 * 1024 * log2(range) rows.
BUCKETS_PER_OCTAVE = 1024
# Parts into which the range of the values found in one bucket is cut again.
PARTS_PER_BUCKET = 1 << 16
# Rows of a bucket per part where its rows are ranked.
RANKED_ROWS = 1 << 16


# -- materialisation -------------------------------------------------------------------------


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``. A folder of this machine only where everything runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{checkpoint_folder(spark).rstrip('/')}/weekcast/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables once their results are written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame, label: str = "table", cluster_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner a measured size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    out = df.repartition(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ROW_BITS = 33  # of monotonically_increasing_id, below which the rows of a task are counted


def numbered(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """``df`` with the place of each row in the order of its columns ``order``, from 1, without one big sort.

    Rows are dealt out by ranges of the order and sorted inside; a number per task comes to the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("_at", _ROW_BITS)
    sizes = {r["task"]: r["n"] for r in stored.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for number in sorted(sizes):
        offsets.append((number, before))
        before += sizes[number]
    table = df.sparkSession.createDataFrame(offsets, "_task bigint, _before bigint")
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = stored.withColumn("_task", task).join(F.broadcast(table), "_task")
    return joined.withColumn(name, F.col("_before") + inside + 1).drop("_task", "_before", "_at")


# -- joins -----------------------------------------------------------------------------------


def planned_bytes(df: DataFrame) -> int | None:
    """Catalyst's size bound of ``df``; file scans use file sizes, filters and aggregates do not
    lower it, so it errs on the large side. None where the planner is not reachable."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except AttributeError:
        return None


# Bytes counted per row and for a text of unknown length.
TEXT_BYTES, ROW_BYTES = 32, 16
# No calendar table of days, weeks or months is longer than this (about 270 years of days).
CALENDAR_ROWS = 100_000
FIXED_BYTES = {"double": 8, "bigint": 8, "timestamp": 8, "timestamp_ntz": 8, "int": 4, "date": 4, "float": 4, "boolean": 1}


def row_width(df: DataFrame) -> int:
    """Bytes of a row whose texts have the usual length of keys."""
    return ROW_BYTES + sum(FIXED_BYTES.get(f.dataType.simpleString(), TEXT_BYTES) for f in df.schema.fields)


def _size(df: DataFrame) -> tuple[int, Column]:
    """Bytes of a row that are the same in every row, and the length of the rest of it."""
    fixed, sums = ROW_BYTES, []
    for f in df.schema.fields:
        kind, column = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in FIXED_BYTES:
            fixed += FIXED_BYTES[kind]
        elif kind in ("string", "binary"):
            sums.append(F.octet_length(column))
        elif kind.startswith(("array", "map", "struct")):
            sums.append(F.octet_length(F.to_json(F.struct(column))))
        else:
            fixed += 16
    length = F.lit(0)
    for part in sums:
        length = length + F.coalesce(part, F.lit(0))
    return fixed, length.cast("long")


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows, uncompressed: fixed widths times the counted rows, and the summed lengths of the rest."""
    fixed, length = _size(df)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("b")).first()
    return int(row["n"]) * fixed + int(row["b"] or 0)


def materialize_measured(df: DataFrame, label: str) -> DataFrame:
    """``materialize``, with the bytes of all rows counted while they are written, for ``side_bytes``.

    Rows of tasks that ran twice may count twice, so the figure errs on the large side.
    """
    fixed, length = _size(df)
    seen = Observation()
    stored = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(length).alias("b")), label)
    found = seen.get
    _measured[_key(stored)] = int(found["n"]) * fixed + int(found["b"] or 0)
    return stored


def _is_computed(df: DataFrame) -> bool:
    """Whether the plan does more than scan, filter and project."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    except AttributeError:
        return True
    return any(step in plan for step in ("Aggregate", "Join", "Window", "Sort", "Generate", "Python", "Union"))


_measured: dict[tuple[str, int], int] = {}


def _key(side: DataFrame) -> tuple[str, int]:
    return side.sparkSession.sparkContext.applicationId, side.semanticHash()


def side_bytes(side: DataFrame) -> int:
    """``measured_bytes``, remembered per application and plan."""
    key = _key(side)
    if key not in _measured:
        _measured[key] = measured_bytes(side)
    return _measured[key]


def key_bucket(on: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in on]), F.lit(KEY_BUCKETS)).cast("int")


def hot_buckets(counted: DataFrame, on: Sequence[str], weight: str | None = None) -> list[int]:
    """Hash buckets of the keys that hold more than ``HOT_SHARE`` of the rows, so at most ``1 / HOT_SHARE`` numbers.

    ``weight`` names a column with the rows of each key. A bucket has no fewer rows than any key in it, so no hot key is
    missed. The rows are counted per bucket on the map side: ``KEY_BUCKETS`` numbers a task are exchanged.
    """
    n = F.sum(F.col(f"`{weight}`")) if weight else F.count(F.lit(1))
    counts = counted.groupBy(key_bucket(on).alias("_b")).agg(n.alias("_n"))
    counts = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(0))))
    most = F.greatest(F.lit(float(HOT_ROWS)), F.col("_all") * HOT_SHARE)
    return sorted(r["_b"] for r in counts.where(F.col("_n") > most).select("_b").collect())


def salted_join(
    fact: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left", salts: int = JOIN_SALTS,
    counted: DataFrame | None = None, weight: str | None = None,
) -> DataFrame:
    """Shuffled join in which each hot key of ``fact`` is spread over ``salts`` partitions.

    The salt depends on the row and on its input partition, so neither a hot key nor a large group
    of equal rows ends in one task. Only hot keys of ``side`` are repeated once per salt (see ``hot_buckets``): all rows
    of the side would be many times the input. ``weight`` names the column of ``side`` with the rows that ``fact`` has of
    each key; without it they are counted in ``counted``, which is ``fact`` unless something cheaper has its keys.
    The join is a merge of sorted sides: the planner takes a compressed file for the size of the side.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type for a salted join: {how}")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in fact.columns])
    spread = F.pmod(row + F.spark_partition_id(), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if any(fact.schema[c].dataType != side.schema[c].dataType for c in on):
        # Equal keys of two types have two hashes: any key may be hot.
        left, right = fact.withColumn("_salt", spread), side.withColumn("_salt", F.explode(every))
    else:
        hot = hot_buckets(side if weight else fact if counted is None else counted, on, weight)
        is_hot = key_bucket(on).isin(hot) if hot else F.lit(False)
        left = fact.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
        right = side.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0))))) if hot else (
            side.withColumn("_salt", F.lit(0)))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def attach(
    fact: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    how: str = "left",
    rows: int | None = None,
    limit: int | None = None,
    salts: int = JOIN_SALTS,
    counted: DataFrame | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Join a per-entity table to a fact table without shuffling the fact where that is safe.

    Broadcast only where the side is known to fit into ``limit`` bytes: by ``rows``, a number of rows that it can't
    exceed, or by counting its rows and text. A side that is more than a scan of a small table is written out first,
    so that it is computed once. Beyond the limit it is joined with salted keys, of which ``counted`` or ``weight`` tell
    the hot ones (see ``salted_join``). ``salts=1`` asks for a plain shuffled join, right where the fact holds few rows
    per key.
    """
    on = list(on)
    limit = BROADCAST_LIMIT if limit is None else limit
    if rows is not None:
        if rows * row_width(side) <= limit:
            return fact.join(F.broadcast(side), on, how)
    planned = planned_bytes(side)
    if planned is None or planned > limit or _is_computed(side):
        side = materialize_measured(side, "side") if limit > 0 else materialize(side, "side")
    if limit > 0 and side_bytes(side) <= limit:
        return fact.join(F.broadcast(side), on, how)
    if salts > 1:
        return salted_join(fact, side, on, how, salts, counted, weight)
    return fact.join(side.hint("merge"), on, how)


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery (no join)."""
    row = scalars.select(F.struct(*scalars.columns).alias("_row")).scalar()
    return (
        df.withColumn("_scalars", row)
        .withColumns({c: F.col("_scalars").getField(c) for c in scalars.columns})
        .drop("_scalars")
    )


# -- value buckets ---------------------------------------------------------------------------


def value_bucket(value: Column) -> Column:
    """Order-preserving integer bucket of a number, finer near zero, data-independent."""
    magnitude = F.floor(F.log2(F.abs(value) + 1.0) * BUCKETS_PER_OCTAVE)
    return F.when(value < 0, -magnitude - 1).otherwise(magnitude).cast("long")


def part_of_bucket(value: Column, low: Column, high: Column) -> Column:
    """Order-preserving part of a bucket whose smallest and largest values are known."""
    share = F.try_divide(value.cast("double") - low, high - low)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * PARTS_PER_BUCKET), F.lit(PARTS_PER_BUCKET - 1)).cast("long")


def _offsets(totals: DataFrame, by: Sequence[str], order: str, sums: dict[str, str]) -> DataFrame:
    """Adds for each (sum, name) what lies before each row of its group in ``order``. The rows of a group are
    buckets or their parts, so their number is bounded by the bucket scheme, not by the data."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for c, n in sums.items()})


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) rows, one per numeric column."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    )
    return df.select(*keep, F.explode(pairs).alias("_pair")).select(*keep, "_pair.column", "_pair.value")


def located_values(
    df: DataFrame, value: str, ranks: Sequence[Column], by: Sequence[str] = (), weight: str | None = None, groups: int | None = None,
) -> DataFrame:
    """The values at the positions ``ranks`` (from 0, expressions of ``_total``) of each group, and few others: (by..., _value, _n, _total,
    _start, _end), where the rows of a value have the positions from ``_start`` up to ``_end``. See ``quantiles``.
    """
    by = list(by)
    groups = groups if by else 1
    src = df.select(
        *by,
        F.col(f"`{value}`").cast("double").alias("_value"),
        (F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")).alias("_weight"),
    )
    src = src.where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    src = src.withColumn("_bucket", value_bucket(F.col("_value")))
    most = groups * len(ranks) if groups else None

    def holds_rank(frame: DataFrame) -> DataFrame:
        wanted = F.filter(
            F.array(*ranks), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))
        )
        return frame.where(F.size(wanted) > 0)

    totals = src.groupBy(*by, "_bucket").agg(
        F.sum("_weight").alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high")
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    totals = _offsets(totals.withColumn("_total", F.sum("_n").over(group)), by, "_bucket", {"_n": "_before"})
    needed = holds_rank(totals).withColumnRenamed("_n", "_rows")
    counts = (
        attach(src, needed, [*by, "_bucket"], "inner", rows=most, weight="_rows")
        .groupBy(*by, "_bucket", "_before", "_total", "_low", "_high", "_value")
        .agg(F.sum("_weight").alias("_n"))
        .withColumn("_part", part_of_bucket(F.col("_value"), F.col("_low"), F.col("_high")))
    )
    parts = counts.groupBy(*by, "_bucket", "_total", "_part").agg(
        F.sum("_n").alias("_n"), F.min("_before").alias("_first"), F.count(F.lit(1)).alias("_d")
    )
    parts = _offsets(parts, [*by, "_bucket"], "_part", {"_n": "_inside"})
    parts = holds_rank(parts.withColumn("_before", F.col("_first") + F.col("_inside")))
    parts = parts.select(*by, "_bucket", "_part", "_d", F.col("_before").alias("_from"))
    counts = attach(counts, parts, [*by, "_bucket", "_part"], "inner", rows=most, weight="_d").drop("_d")

    inside = Window.partitionBy(*by, "_bucket", "_part").orderBy("_value")
    end = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_from")
    return counts.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
    names: Sequence[str] | None = None,
    groups: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group.

    First pass: rows per value bucket, with the smallest and largest value found in it (map-side combined). Second
    pass: only the buckets that hold a wanted position are counted by value. Their ranges are cut into many parts,
    and only values of a part that holds a wanted position are ordered, so a narrow band of values is split as well
    as a wide one. ``weight`` counts a row that many times. Nulls and NaN are ignored. ``groups`` is the largest
    possible number of groups where the caller knows it.
    """
    by = list(by)
    names = list(names or [f"q{int(round(p * 1000))}" for p in probabilities])
    ranks = []
    for p in probabilities:
        position = F.lit(float(p)) * (F.col("_total") - 1)
        ranks += [F.floor(position).cast("long"), F.ceil(position).cast("long")]
    located = located_values(df, value, ranks, by, weight, groups)
    picks = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (rank >= F.col("_start")) & (rank < F.col("_end"))
            picks.append(F.max(F.when(here, F.col("_value"))).alias(f"_{side}{i}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_t{i}"))
    found = located.groupBy(*by).agg(*picks)
    return found.select(
        *by,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_t{i}")).alias(n)
            for i, n in enumerate(names)
        ],
    )


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    names: Sequence[str],
    weight: str | None = None,
) -> DataFrame:
    """Quantiles of many columns in one pass: one row per column."""
    long = unpivot_numeric(df, columns, [weight] if weight else [])
    return quantiles(long, "value", probabilities, ["column"], weight, names, groups=len(columns))


def quantile_row(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    name: str = "{column}_{name}",
    names: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """The same as a single row with one column per (column, probability), for ``with_scalars``."""
    names = list(names or [f"q{int(round(p * 1000))}" for p in probabilities])
    table = column_quantiles(df, columns, probabilities, names, weight)
    return table.agg(
        *[
            F.max(F.when(F.col("column") == c, F.col(n))).alias(name.format(column=c, name=n))
            for c in columns
            for n in names
        ]
    )


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank statistics of every distinct value: one row per (group, value).

    ``peers`` rows share the value, ``rows_below`` rows and ``values_below`` distinct values are
    smaller, out of ``rows_total`` and ``values_total``. Ordering happens inside parts of value buckets.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("peers"))
        .withColumn("_bucket", value_bucket(F.col(value)))
    )
    plain = F.col(value).cast("double")
    totals = counts.groupBy(*by, "_bucket").agg(
        F.sum("peers").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min(plain).alias("_low"), F.max(plain).alias("_high")
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    totals = totals.withColumns({"rows_total": F.sum("_n").over(group), "values_total": F.sum("_d").over(group)})
    buckets = _offsets(totals, by, "_bucket", {"_n": "_rows0", "_d": "_values0"}).drop("_n")
    placed = attach(counts, buckets, [*by, "_bucket"], "inner", weight="_d").drop("_d")
    placed = placed.withColumn("_part", part_of_bucket(plain, F.col("_low"), F.col("_high")))
    parts = placed.groupBy(*by, "_bucket", "_part").agg(F.sum("peers").alias("_n"), F.count(F.lit(1)).alias("_d"))
    parts = _offsets(parts, [*by, "_bucket"], "_part", {"_n": "_rows1", "_d": "_values1"}).drop("_n")
    inside = Window.partitionBy(*by, "_bucket", "_part").orderBy(value)
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    return attach(placed, parts, [*by, "_bucket", "_part"], "inner", weight="_d").select(
        *by,
        value,
        "peers",
        (F.col("_rows0") + F.col("_rows1") + F.coalesce(F.sum("peers").over(below), F.lit(0))).alias("rows_below"),
        (F.col("_values0") + F.col("_values1") + F.row_number().over(inside) - 1).alias("values_below"),
        "rows_total",
        "values_total",
    )


def column_ranks(rows: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(key, columns...) with every value replaced by its average rank in its column; no nulls, and ``key`` is unique.

    Rows are counted per value bucket. Where a bucket holds one value, its rank follows from the counts, so columns of few values
    and frequent values are never exchanged. Rows of the other buckets are ranked inside parts of them, and go back to their key.
    ``rows`` is read several times.
    """
    columns = list(columns)
    names = {c: str(i) for i, c in enumerate(columns)}
    src = rows.select(key, *[(F.col(f"`{c}`").cast("double") + 0.0).alias(n) for c, n in names.items()])
    long = unpivot_numeric(src, list(names.values()))
    totals = long.groupBy("column", value_bucket(F.col("value")).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    totals = materialize(_offsets(totals, ["column"], "_bucket", {"_n": "_before"}), "buckets")
    wide = src
    for n in names.values():
        fields = F.struct("_n", "_low", "_high", "_before").alias(f"s{n}")
        side = totals.where(F.col("column") == n).select(F.col("_bucket").alias(f"b{n}"), fields)
        wide = attach(wide.withColumn(f"b{n}", value_bucket(F.col(f"`{n}`"))), side, [f"b{n}"], counted=src.select(
            value_bucket(F.col(f"`{n}`")).alias(f"b{n}")))
    known, open_rows = [], []
    for n in names.values():
        s = F.col(f"s{n}")
        one = s["_low"] == s["_high"]
        known.append(F.when(one, s["_before"] + (s["_n"] + 1) / 2).alias(n))
        cuts = F.ceil(s["_n"] / RANKED_ROWS)
        share = F.coalesce(F.try_divide(F.col(f"`{n}`") - s["_low"], s["_high"] - s["_low"]), F.lit(0.0))
        part = F.least(F.floor(share * cuts), cuts - 1).cast("long")
        open_rows.append(F.when(~one, F.struct(
            F.lit(int(n)).alias("column"), F.col(f"b{n}").alias("_bucket"), part.alias("_part"), F.col(f"`{n}`").alias("_value"),
            s["_before"].alias("_first"))))
    inner = wide.select(key, F.inline(F.array_compact(F.array(*open_rows))))
    group = ["column", "_bucket", "_part"]
    parts = inner.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), F.first("_first").alias("_first"))
    parts = _offsets(parts, ["column", "_bucket"], "_part", {"_rows": "_inside"})
    parts = parts.select(*group, "_rows", (F.col("_first") + F.col("_inside")).alias("_from"))
    ordered, equal = Window.partitionBy(*group).orderBy("_value"), Window.partitionBy(*group, "_value")
    placed = inner.drop("_first").withColumn("_rank", F.rank().over(ordered) + (F.count(F.lit(1)).over(equal) - 1) / 2)
    placed = attach(placed, parts, group, "inner", weight="_rows")
    rank = F.col("_from") + F.col("_rank")
    back = placed.select(key, *[F.when(F.col("column") == int(n), rank).alias(n) for n in names.values()])
    both = wide.select(key, *known).unionByName(back)
    ranked = both.groupBy(key).agg(*[F.max(f"`{n}`").alias(n) for n in names.values()])
    return ranked.select(key, *[F.col(f"`{n}`").alias(c) for c, n in names.items()])
