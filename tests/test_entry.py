import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from urbandemand.oracles import ORACLE_SQL
from urbandemand.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_names():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(str([tidy(r[c]) for c in columns]) for r in got.collect()) == sorted(str([tidy(r[i]) for i in place]) for r in want.fetchall())
