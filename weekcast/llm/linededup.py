"""Removal of repeated passages by overlapping windows of three lines.

Every three consecutive lines of a text form a window. A window is known by 128 bits of hash. Windows that occur
more than once anywhere are found with one aggregation; all occurrences but the first (by doc_id, then position)
are later ones. The lines that later occurrences cover are merged into spans and removed.

Only windows of repeated passages and their positions are joined; a hot window is one key of a plain join, which
adaptive execution splits. Texts travel once, keyed by document.

Null and shorter texts (under three lines) have no windows and stay as they are. A null ``doc_id`` comes first in
the order. Rows with equal id and text are occurrences of one document: they don't repeat each other. Of rows with
equal ids and other texts, the order is that of a hash of the text. Columns of the input pass through unchanged,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.common import materialize

WINDOW = 3
KEY = ["_doc", "_hash"]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The input row as one column, beside the key of its document."""
    return df.select(
        F.struct("*").alias("_row"),
        F.col(doc_id).alias("_doc"),
        F.xxhash64(F.col(text)).alias("_hash"),
        F.col(text).cast("string").alias("_text"),
    )


def windows(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """(_doc, _hash, at, w1, w2): every window of every text; ``at`` is its first line, from 0."""
    lines = lines_of(F.col("_text"))
    hashed = rows.select(
        *KEY,
        F.transform(lines, lambda line: F.xxhash64(line)).alias("a"),
        # The number first, so that the line is hashed from another seed.
        F.transform(lines, lambda line: F.xxhash64(F.lit(size), line)).alias("b"),
    ).where(F.size("a") >= size)
    at_each = F.transform(
        F.sequence(F.lit(0), F.size("a") - size),
        lambda at: F.struct(
            at.alias("at"),
            F.xxhash64(*[F.get("a", at + i) for i in range(size)]).alias("w1"),
            F.xxhash64(*[F.get("b", at + i) for i in range(size)]).alias("w2"),
        ),
    )
    return hashed.select(*KEY, F.inline(at_each))


def later_spans(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """(_doc, _hash, spans): per document the merged spans (first, last line) of later occurrences."""
    found = materialize(windows(rows, size), "windows")
    place = F.struct(*KEY, "at")
    repeated = (
        found.groupBy("w1", "w2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("w1", "w2", "first")
    )
    later = found.join(repeated, ["w1", "w2"]).where(place != F.col("first")).select(*KEY, "at").distinct()
    order = Window.partitionBy(*KEY).orderBy("at")
    before = F.lag("at").over(order)
    begins = F.when(before.isNull() | (F.col("at") > before + size), 1).otherwise(0)
    islands = later.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(order))
    spans = islands.groupBy(*KEY, "_island").agg(
        F.min("at").alias("first"), (F.max("at") + size - 1).alias("last")
    )
    return spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def dedup_lines(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = "removed_lines",
    size: int = WINDOW,
) -> DataFrame:
    """``df`` with later occurrences of passages taken out of ``text``, and how many lines went (``removed``; an
    input column of that name is replaced)."""
    rows = keyed(df, doc_id, text)
    spans = later_spans(rows, size)
    same = [rows["_doc"].eqNullSafe(spans["_doc"]), rows["_hash"] == spans["_hash"]]
    joined = rows.join(spans, same, "left").select("_row", "_text", "spans")
    lines = lines_of(F.col("_text"))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["last"] + 1))
    ends = F.concat(F.transform("spans", lambda s: s["first"] - 1), F.array(F.size(lines) - 1))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a + 1)))
    gone = F.aggregate("spans", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    new = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    columns = [new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in df.columns if c != removed]
    if removed:
        columns.append(F.coalesce(gone, F.lit(0)).cast("long").alias(removed))
    return joined.select(*columns)


def sql(documents: str = "documents") -> str:
    """The same in SQL for unique ids: (doc_id, text, removed_lines)."""
    return f"""
    WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {documents}),
    w AS (SELECT doc_id, i, array_to_string(ls[i:i + 2], chr(10)) AS passage
          FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls) - 2)) AS i FROM l WHERE len(ls) > 2)),
    later AS (SELECT doc_id, i FROM w
              QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1),
    gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, generate_series(0, 2) AS g(j)),
    kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
             FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l) AS a
             ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
           CASE WHEN l.text IS NULL THEN 0 ELSE len(ls) - coalesce(kept.n, 0) END AS removed_lines
    FROM l LEFT JOIN kept USING (doc_id)
    """
