"""Registered queries: a Spark function, its output columns, and the SQL it is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.catalog.tables import CTES, Tables

DIGITS = 6


@dataclass(frozen=True)
class Entry:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(self.build(Tables(spark, sf_dir)), self.columns)

    def oracle(self) -> str | None:
        return None if self.sql is None else wrap_sql(self.sql, self.columns)


REGISTRY: dict[str, Entry] = {}


def parse_columns(text: str) -> tuple[tuple[str, str], ...]:
    """'store:s year:i quantity:f week_date:d' -> ((name, kind), ...)."""
    return tuple(tuple(part.rsplit(":", 1)) for part in text.split())


def query(name: str, columns: str, sql: str | None = None):
    """Register a query. Column kinds: s text, i integer, f double, d date (shown as text)."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(name, parse_columns(columns), fn, sql)
        return fn

    return register


def tidy(df: DataFrame, columns) -> DataFrame:
    """Fixed column order and comparable types."""
    shown = {
        "s": lambda c: c.cast("string"),
        "i": lambda c: c.cast("long"),
        "f": lambda c: F.round(c.cast("double"), DIGITS) + F.lit(0.0),
        "d": lambda c: F.date_format(c.cast("date"), "yyyy-MM-dd"),
    }
    return df.select(*[shown[kind](F.col(f"`{name}`")).alias(name) for name, kind in columns])


def wrap_sql(core: str, columns) -> str:
    shown = {
        "s": 'CAST("{0}" AS VARCHAR)',
        "i": 'CAST("{0}" AS BIGINT)',
        "f": 'round(CAST("{0}" AS DOUBLE), 6) + 0.0',
        "d": 'CAST(CAST("{0}" AS DATE) AS VARCHAR)',
    }
    fields = ", ".join(f'{shown[kind].format(name)} AS "{name}"' for name, kind in columns)
    used = required_ctes(core)
    prefix = "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in used) + " " if used else ""
    return f"{prefix}SELECT {fields} FROM ({core}) AS result"


def required_ctes(core: str) -> list[str]:
    """Shared table definitions the SQL mentions, in dependency order."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in found:
                    found.append(name)

    visit(core)
    return found


def findings_sql(source: str, findings, extra: str = "") -> str:
    """SQL for a check report: ``findings`` are (check, level, column, expression)."""
    values = ", ".join(f"CAST({expr} AS DOUBLE) AS v{i}" for i, (*_, expr) in enumerate(findings))
    parts = []
    for i, (check, level, column, _) in enumerate(findings):
        shown = f"'{level}'" if level == "info" else f"CASE WHEN v{i} > 0 THEN '{level}' ELSE 'ok' END"
        name = "CAST(NULL AS VARCHAR)" if column is None else f"'{column}'"
        parts.append(f"SELECT '{check}' AS \"check\", {shown} AS level, {name} AS \"column\", v{i} AS value FROM r")
    tail = f" UNION ALL {extra}" if extra else ""
    return f"WITH r AS (SELECT {values} FROM {source}) " + " UNION ALL ".join(parts) + tail


FINDING_COLUMNS = "check:s level:s column:s value:f"
