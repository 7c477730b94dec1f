"""Every registered query of the reference's operators against its SQL twin."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
NAMES = sorted(n for n in contract.queries() if n.startswith("q_"))


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    wanted = {n for n in contract.queries() if n.startswith("q_")}
    assert wanted == {n for n in contract.oracle_sql() if n.startswith("q_")}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, database, name):
    frame = contract.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = sorted(map(tuple, frame.select(*columns).collect()), key=repr)
    wanted = database.execute(f"SELECT {', '.join(columns)} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert found == sorted(wanted, key=repr)


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
