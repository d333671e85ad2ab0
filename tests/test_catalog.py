"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from terraspark.plans import catalog

SF = "/root/testdata/sf0.001"
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, duck, key):
    df = catalog.QUERIES[key](spark, SF)
    got = df.toPandas()
    assert len(got.columns) == len(set(got.columns))
    if key not in catalog.ORACLE:
        assert len(got) > 0
        return
    want = duck.sql(catalog.ORACLE[key])
    kinds = {r[0]: r[1] for r in duck.sql("DESCRIBE " + catalog.ORACLE[key]).fetchall()}
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    cols = sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want.df()))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-9)


def test_entry_and_contract(spark):
    assert entry.entry(spark).columns == ["z", "x", "y"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
