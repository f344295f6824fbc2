"""The queries that SQL expresses give DuckDB's rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from folioscope.llm import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_are_those_of_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    found = registry.queries()[name](spark, str(DATA))
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)
