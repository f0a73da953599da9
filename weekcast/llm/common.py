"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weekcast.plans.scale import materialize

__all__ = ["arrow_map", "load", "materialize", "text_or_empty"]

# Texts handled at once by a Python worker, in characters; longer texts are handled alone.
BLOCK_CHARS = 4_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut batches into pieces of bounded text volume and decode the text column of each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        offset, total = 0, 0
        sizes = pa.compute.binary_length(texts).to_pylist()
        for i, size in enumerate(sizes):
            if i > offset and total + (size or 0) > BLOCK_CHARS:
                piece = batch.slice(offset, i - offset)
                yield piece, texts.slice(offset, i - offset).to_pylist()
                offset, total = i, 0
            total += size or 0
        yield batch.slice(offset), texts.slice(offset).to_pylist()


def arrow_map(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for a function from a batch to a list of columns in the order of ``schema``."""
    ship_package(df.sparkSession)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.fieldNames()

    def apply(batches):
        for batch in function(batches):
            yield pa.RecordBatch.from_arrays(batch, names=names)

    return df.mapInArrow(apply, schema)
