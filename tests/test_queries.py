"""Every registered query: against its SQL where there is one, else that it yields its columns."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck
from weekcast.catalog.registry import REGISTRY, tidy
from weekcast.catalog.tables import Tables

QUERIES = {name: query for name, query in entry.queries().items() if name in REGISTRY}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def con(folder):
    connection = duck(folder)
    yield connection
    connection.close()


@pytest.fixture(scope="module")
def run(spark, folder):
    """Builds queries over one ``Tables``, so stored panels are written once for the whole module."""
    tables = Tables(spark, folder)
    return lambda name: tidy(REGISTRY[name].build(tables), REGISTRY[name].columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(run, con, name):
    problem = compare(run(name), con, ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_yields_rows(run, name):
    frame = run(name)
    assert frame.columns == [c for c, _ in REGISTRY[name].columns]
    assert frame.count() > 0


def test_entry_is_the_flagship(spark):
    frame = entry.entry(spark)
    assert set(frame.columns) == {"wmape", "mae", "rmse", "mape"}
    assert frame.count() == 1
