"""Every query with an oracle gives DuckDB's rows at the smallest scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from folioscope.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    expected = duck.execute(registry.oracle_sql()[name])
    assert rows(df.collect(), df.columns) == rows(expected.fetchall(), [c[0] for c in expected.description])


def test_registry():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) == sum(len(m.QUERIES) for m in registry.MODULES)
