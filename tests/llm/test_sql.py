"""Every query of the subpackage that has SQL against DuckDB on a small scale factor."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from riskloom.llm import queries
from tests.test_oracles import SF, rows


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same(spark, name):
    con = duckdb.connect()
    for f in Path(SF).iterdir():
        con.sql(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM '{f}'")
    df, want = queries.QUERIES[name](spark, str(SF)), con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
