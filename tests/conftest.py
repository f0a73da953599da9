from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weekcast.session import build_session

    session = build_session(
        "weekcast-tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    return FOLDER


@pytest.fixture()
def panel(spark):
    """Two short series: a ramp 1..20 and a constant 10."""
    return spark.sql(
        """
        SELECT s AS store, 'p' AS product, year(d) AS year, weekofyear(d) AS week, d AS week_date,
               CASE WHEN s = 'ramp' THEN CAST(i AS DOUBLE) ELSE 10.0D END AS quantity
        FROM (SELECT explode(sequence(1, 20)) AS i) LATERAL VIEW explode(array('ramp', 'const')) x AS s
        LATERAL VIEW explode(array(date_add(date'2022-01-03', 7 * i))) y AS d
        """
    )
