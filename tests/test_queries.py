"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None  # NULL, in whatever form a column of this type gives it
    return value.item() if hasattr(value, "item") else value


def rows(frame):
    columns = sorted(frame.columns)
    clean = [tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)]
    return columns, sorted(map(repr, clean))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    if name not in entry.oracle_sql():
        assert got.columns and got.count() >= 0
        return
    assert rows(got.toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).fetchdf())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
