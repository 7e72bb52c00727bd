"""The corpus query that has SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from gablework.llm import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    base = duckdb.connect()
    base.sql(f"create view documents as select * from '{SF_DIR}/documents.parquet'")
    ours = registry.queries()[name](spark, SF_DIR)
    columns = ", ".join(ours.columns)
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, base.sql(registry.oracle_sql()[name]).select(columns).fetchall()))
