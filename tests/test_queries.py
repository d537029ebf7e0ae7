"""Queries against their SQL on the smallest tables; the jobs have tests of their own."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from catalog import inspection, scalars

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", [*scalars.QUERIES, *inspection.QUERIES, "flagship", "ingest", "weekly_digests"])
def test_query_agrees_with_its_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    result = duck.execute(driver.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert got == want


def test_every_query_has_its_sql():
    modules = (scalars, inspection, driver.sourcing, driver.operators, driver.jobs)
    own = set(driver.queries()) - set(driver.CORPUS)
    assert len(own) == sum(len(module.QUERIES) for module in modules)
    assert set(driver.oracle_sql()) == own


def test_entry(spark):
    assert driver.entry(spark).columns == ["iso_year", "iso_week", "items", "hosts", "first"]
