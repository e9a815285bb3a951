"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _names():
    import gleanery.plans.further  # noqa: F401
    from gleanery.plans.queries import QUERIES

    return sorted(QUERIES)


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    one = lambda v: None if not isinstance(v, list) and pd.isna(v) else f"{float(v):.9g}" if isinstance(v, float) else str(v)
    return sorted(str([one(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", _names())
def test_query(spark, name):
    from gleanery.plans.queries import QUERIES, SQL

    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    assert _rows(got) == _rows(con.execute(SQL[name]).df())
