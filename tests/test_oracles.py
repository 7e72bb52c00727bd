"""Every query that has SQL gives the same rows in Spark and DuckDB over the smallest tables."""

import math
import os

import duckdb
import pytest

from gablework.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


def rows(frame):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, bool) or not hasattr(x, "__float__"):
            return x
        return float(x)

    return sorted((tuple(value(x) for x in r) for r in frame), key=repr)


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for table in ("supplier", "lineitem"):
        base.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return base


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR)
    theirs = duck.sql(ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours.select(*columns).collect()) == rows(theirs.select(", ".join(f'"{c}"' for c in columns)).fetchall())
