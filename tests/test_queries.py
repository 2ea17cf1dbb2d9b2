"""Every query with SQL against DuckDB, and the others for rows."""

import glob
import os

import pytest

from proofsheet import plans

from .conftest import SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    pdf = pdf.apply(lambda c: c.astype("float64") if str(c.dtype).startswith("Int") and c.isna().any() else c)
    return sorted(map(repr, pdf.astype(object).where(pdf.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLE_SQL:
        want = duck.execute(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
