"""Every core query over the smallest test data, against its SQL where it has one."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SMALL}/{t}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return "-"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number)) or hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    return str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.core.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    got = df.toPandas()
    if name in entry.oracle_sql():
        assert rows(got) == rows(db.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
