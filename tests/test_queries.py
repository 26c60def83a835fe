"""Each query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op") or n.startswith("oc_")))
def test_same_rows(spark, data_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    expected = con.execute(SQL[name]).fetchdf()
    got = QUERIES[name](spark, data_dir).toPandas()
    columns = sorted(got.columns)
    assert sorted(expected.columns) == columns
    as_rows = lambda df: sorted(map(repr, zip(*(df[c].tolist() for c in columns), strict=True)))
    assert as_rows(got) == as_rows(expected)


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    assert entry.entry(spark).count() > 0
