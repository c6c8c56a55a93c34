"""Every query of the catalog with a SQL statement returns what DuckDB returns for it."""

from pathlib import Path

import duckdb
import pytest
from hudlake import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df, names):
    df = df[names].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, str(SF)).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names and rows(got, names) == rows(want, names)


@pytest.mark.parametrize("name", [q for q in catalog.QUERIES if q not in catalog.ORACLES])
def test_other_queries_return_rows(spark, name):
    assert catalog.QUERIES[name](spark, str(SF)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1500
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())
