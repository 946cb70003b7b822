"""The registered queries against their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tools.check_oracle import TABLES, table
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = spark_entry.queries()[name](spark, SF_DIR)
    res = con.execute(spark_entry.oracle_sql()[name])
    want = table([d[0] for d in res.description], res.fetchall())
    assert table(df.columns, df.collect()) == want


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 7
