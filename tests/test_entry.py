"""Registered queries against their SQL statements on the smallest data set."""

import collections
import os

import pytest

import __spark_entry__ as contract
from graphproof.testbed import oracle
from graphproof.testbed.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(oracle.statements())))
def test_query_equals_its_statement(spark, duck, name):
    frame = contract.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = collections.Counter(tuple(repr(row[i]) for i in places) for row in cursor.fetchall())
    got = collections.Counter(tuple(repr(row[c]) for c in columns) for row in frame.collect())
    assert got == want


@needs_data
def test_entry_runs(spark):
    assert set(contract.entry(spark).columns) == {"status", "code", "n"}
