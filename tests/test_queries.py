"""Every registered query against its SQL twin at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, canonical
from shelfmark.plans.oracles import ORACLES
from shelfmark.plans.registry import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = db.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got).equals(canonical(want))
    assert len(got) > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["item_id", "name", "type", "amount"]
