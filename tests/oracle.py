"""Runs registered queries beside their SQL: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(frame, con, sql: str) -> str | None:
    """None if equal, else a description."""
    got_rows = [tuple(r) for r in frame.collect()]
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want_rows = result.fetchall()
    if sorted(frame.columns) != sorted(want_columns):
        return f"columns {frame.columns} != {want_columns}"
    got, want = _rows(frame.columns, got_rows), _rows(want_columns, want_rows)
    if got == want:
        return None
    extra, absent = got - want, want - got
    return (
        f"{sum(got.values())} rows vs {sum(want.values())}; {sum(extra.values())} differ; columns "
        f"{sorted(frame.columns)}; spark {sorted(extra, key=str)[:2]} sql {sorted(absent, key=str)[:2]}"
    )


def main() -> int:
    import __spark_entry__ as entry
    from weekcast.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(**{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), duck(folder)
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in oracles:
                problem = compare(frame, con, oracles[name])
                note = "ok" if problem is None else f"MISMATCH {problem}"
                failed += problem is not None
            else:
                note = f"rows {frame.count()}"
        except Exception as error:  # noqa: BLE001
            failed += 1
            note = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
