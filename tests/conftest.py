"""A local session, and a comparison of a query's rows with those of DuckDB's SQL."""

from __future__ import annotations

import os
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
# the workers of a local session get the environment that the JVM is started with
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


def _plain(x):
    if isinstance(x, float):
        return None if x != x else f"{x:.9g}"
    return tuple(map(_plain, x)) if isinstance(x, (list, tuple)) else str(x) if x is not None and not isinstance(x, (int, str, bool)) else x


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql():
    """same_as_sql(df, sql, **tables): df's rows are those of the SQL over the test tables, or over the given pandas ones."""

    def check(df: DataFrame, sql: str, **tables) -> None:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        for t, rows in tables.items():
            con.execute(f"DROP VIEW {t}")
            con.register(t, rows)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(names)
        assert bag(df.columns, df.collect()) == bag(names, found.fetchall())

    return check
