"""Every query outside the llm subpackage against its DuckDB counterpart on a small scale factor."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from riskloom.plans import registry

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in SF.iterdir():
        con.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM '{f}'")
    return con


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([value(r[k]) for k in order]) for r in data)


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SF))
    want = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).count() > 0
