"""Every query with SQL gives the rows DuckDB gives."""

import glob
import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as driver


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(
            f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')"
        )
    return con


def normal(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_same_rows(spark, database, name):
    df = driver.queries()[name](spark, SMALL)
    ours = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = database.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert ours == normal(cursor.fetchall(), columns)


def test_sql_only_for_known_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
