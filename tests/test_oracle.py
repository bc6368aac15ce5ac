"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import queries as graph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(graph.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert rows(graph.queries()[name](spark, SF).toPandas()) == rows(duck.execute(graph.oracle_sql()[name]).df())


def test_entry_points(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
