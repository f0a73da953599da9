"""Registered queries against their SQL where there is one."""

from __future__ import annotations

import pytest

from tests.oracle import compare, duck
from weekcast.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    connection = duck(folder)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, folder, con, name):
    assert compare(QUERIES[name](spark, folder), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folder, tmp_path, name):
    for table in ("documents", "embeddings", "labels", "conversations"):
        frame = spark.read.parquet(f"{folder}/{table}.parquet").limit(0)
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
    frame = QUERIES[name](spark, str(tmp_path))
    assert frame.count() == (1 if name == "op5_chat" else 0)
