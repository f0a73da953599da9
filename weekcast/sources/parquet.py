"""Reading transactions and master tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.operators.checks import check_generic, ensure_valid
from weekcast.operators.clean import standardize_columns
from weekcast.plans.scale import materialize
from weekcast.spec import DEFAULT, SeriesSpec


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_parquet_dir(
    spark: SparkSession, path: str, pattern: str = "*.parquet", skip_unreadable: bool = True
) -> DataFrame:
    """All parquet files below a directory that share a schema. Unreadable files are skipped, and reported by
    ``unreadable_files``; without ``skip_unreadable`` they fail the read."""
    reader = spark.read.option("ignoreCorruptFiles", skip_unreadable).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if not skip_unreadable or error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return reader.option("mergeSchema", True).parquet(path)  # the file taken for the schema was unreadable


def unreadable_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path) of the files below a directory that are no parquet files: what a scan of it leaves out."""
    return file_signatures(spark, path, pattern).where(F.col("signature").isNull()).select("path")


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, length) of the files; the listing is Spark's, contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return files.option("pathGlobFilter", pattern).load(path).select("path", "length")


def _uri(path: str) -> str:
    """Local paths come as ``file:/x``; Arrow wants ``file:///x``."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path in batch["path"]:
            # A scheme that Arrow doesn't know raises; it is no unreadable file.
            filesystem, name = fs.FileSystem.from_uri(_uri(path))
            try:
                with filesystem.open_input_file(name) as handle:
                    found.append(",".join(sorted(pq.ParquetFile(handle).schema_arrow.names)))
            except (OSError, pa.ArrowInvalid):
                found.append(None)
        yield pd.DataFrame({"path": batch["path"], "signature": found})


def file_signatures(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, signature): sorted column names of each file, footers read inside tasks."""
    files = list_files(spark, path, pattern).select("path")
    return files.mapInPandas(_signatures, "path string, signature string")


def scan_by_schema(spark: SparkSession, path: str, pattern: str = "*.parquet") -> dict[str, DataFrame]:
    """One lazy table per distinct set of columns, keyed by that set. Unreadable files fail the scan.

    The driver learns of folders, and of single files only in folders that hold several sets.
    """
    files = materialize(file_signatures(spark, path, pattern), "signatures")
    unreadable = [r["path"] for r in files.where(F.col("signature").isNull()).limit(3).collect()]
    if unreadable:
        raise ValueError(f"no parquet files: {', '.join(unreadable)}, ...")
    files = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    folders = files.groupBy("folder").agg(F.min("signature").alias("a"), F.max("signature").alias("b")).collect()
    ordered = sorted(f"{r['folder']}/" for r in folders)
    parents = {a for a, b in zip(ordered, ordered[1:], strict=False) if b.startswith(a)}
    places: dict[str, list[str]] = {}
    mixed = []
    for row in folders:
        if row["a"] == row["b"] and f"{row['folder']}/" not in parents:
            places.setdefault(row["a"], []).append(row["folder"])
        else:
            mixed.append(row["folder"])
    for row in files.where(F.col("folder").isin(mixed)).select("signature", "path").collect() if mixed else []:
        places.setdefault(row["signature"], []).append(row["path"])
    reader = spark.read.option("pathGlobFilter", pattern)
    return {signature: reader.parquet(*sorted(found)) for signature, found in sorted(places.items())}


def route_by_role(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Transactions, stores and products among tables, recognised by their columns."""
    roles: dict[str, DataFrame] = {}
    for table in tables.values():
        named = standardize_columns(table)
        columns = set(named.columns)
        if {"quantity", "date"} <= columns:
            role = "transactions"
        elif columns & {"premise", "store_category", "zipcode"}:
            role = "stores"
        elif columns & {"category", "subcategory", "brand", "descricao", "tipos", "label", "fabricante"}:
            role = "products"
        else:
            continue
        roles[role] = roles[role].unionByName(named, allowMissingColumns=True) if role in roles else named
    return roles


def union_files(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def scan_filtered_sorted(spark: SparkSession, path: str, target: str = "quantity", date: str = "date") -> DataFrame:
    """Rows with a target and a date (pushed to the scan), ordered by date inside partitions."""
    table = standardize_columns(spark.read.parquet(path))
    return table.where(F.col(target).isNotNull() & F.col(date).isNotNull()).sortWithinPartitions(date)


def map_chunks(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, rows: int | None = None
) -> DataFrame:
    """Apply a user function to batches of rows inside tasks, or to chunks of ``rows`` rows where that is given.

    Rows are carried over from batch to batch, so chunks of a task are full but for its last one, whatever the size of
    Arrow batches. ``exact_chunks`` has one short chunk in all.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not rows:
            yield from map(fn, batches)
            return
        held: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            while count + len(batch) >= rows:
                cut = rows - count
                yield fn(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                batch, held, count = batch.iloc[cut:], [], 0
            if len(batch):
                held.append(batch)
                count += len(batch)
        if count:
            yield fn(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)


def exact_chunks(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, rows: int
) -> DataFrame:
    """Apply a user function to chunks of exactly ``rows`` rows of the whole table; only the last one may be short.

    The table is written with the number of each row in its task. With the tasks' row counts (one number each) every row
    knows its place in the table, and so its chunk; the rows of a chunk then meet in one task.
    """
    if rows < 1:
        raise ValueError("a chunk has at least one row")
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    columns, kept = df.columns, [f"c{i}" for i in range(len(df.columns))]
    stored = materialize(df.select(*named, F.monotonically_increasing_id().alias("at")), "chunks")
    bits = 33  # of the number, below which the rows of a task are counted
    sizes = stored.groupBy(F.shiftright("at", bits).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["task"]):
        offsets.append((r["task"], before))
        before += r["n"]
    table = df.sparkSession.createDataFrame(offsets, "task bigint, before bigint")
    inside = F.col("at").bitwiseAND(F.lit((1 << bits) - 1))
    placed = stored.withColumn("task", F.shiftright("at", bits)).join(F.broadcast(table), "task")
    placed = placed.select(F.floor((F.col("before") + inside) / rows).alias("chunk"), "at", *kept)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return fn(frame.sort_values("at", ignore_index=True)[kept].set_axis(columns, axis=1))

    return placed.groupBy("chunk").applyInPandas(run, schema)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file, bytes, rows, columns, schema, folder_files, folder_bytes) of a table's files."""
    table = spark.read.parquet(path)
    meta = table.select(
        F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
    )
    files = meta.groupBy("folder", "file", "bytes").agg(F.count(F.lit(1)).alias("rows"))
    totals = files.groupBy("folder").agg(
        F.count(F.lit(1)).alias("folder_files"), F.sum("bytes").alias("folder_bytes")
    )
    described = files.withColumns({"columns": F.lit(len(table.columns)), "schema": F.lit(table.schema.simpleString())})
    return described.join(totals, "folder")


def load_validated(
    spark: SparkSession, path: str | Sequence[str], kind: str, spec: SeriesSpec = DEFAULT, table: DataFrame | None = None
) -> DataFrame:
    """Load a table, standardise its names, and raise if its checks report errors."""
    if table is None:
        paths = [path] if isinstance(path, str) else list(path)
        table = spark.read.parquet(*paths)
    table = standardize_columns(table)
    ensure_valid(check_generic(table, kind, spec))
    return table


def preprocess_and_save(
    spark: SparkSession, source: str, target: str, fn: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Read, transform, write snappy parquet; returns the written table."""
    out = spark.read.parquet(source).transform(fn)
    out.write.mode("overwrite").option("compression", "snappy").parquet(target)
    return spark.read.schema(out.schema).parquet(target)
