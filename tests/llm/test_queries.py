"""The queries over the smallest test data, against their SQL where there is one."""

import os

import duckdb
import pytest

from docmill.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SMALL)
    got = df.toPandas()
    if name.endswith("_found"):
        assert len(got) == len(got.drop_duplicates())
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in os.listdir(SMALL):
            con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SMALL}/{t}'")
        want = con.execute(queries.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_columns_of_found():
    assert {n for n in queries.queries() if n.endswith("_found")} == {"p1_found", "p2_found", "p3_found", "p5_found", "p6_found", "p9_found"}
