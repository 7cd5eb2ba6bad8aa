"""Queries against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

from quillon.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


def plain(df):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(value(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert plain(registry.queries()[name](spark, DATA).toPandas()) == plain(con.sql(registry.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
