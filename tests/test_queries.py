"""Every registered query against its check SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, differences
from telemill.plans import catalog

FOLDER = entry.SMALL
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["timestamp", "rule_name", "severity"]


@pytest.mark.parametrize("name", sorted(catalog.PLANS))
def test_query(spark, db, name):
    found = catalog.callables()[name](spark, FOLDER).toPandas()
    assert differences(found, db.execute(catalog.ORACLES[name]).df()).startswith("ok")
