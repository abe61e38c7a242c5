"""Every registered catalogue query against its SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from foliant.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(frame):
    own = frame[sorted(frame.columns)].astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"})
    return sorted(map(tuple, own.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    found, wanted = registry.QUERIES[name](spark, FOLDER).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).schema


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
