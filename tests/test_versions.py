"""Version keys and specifiers against the packaging library, clause by clause."""

from __future__ import annotations

import itertools

import pytest
from packaging.specifiers import InvalidSpecifier, SpecifierSet
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from riskloom.functions import versions as ve

VERSIONS = [
    "0", "0.0", "1", "1.0", "1.0.0", "1.0.1", "1.1", "1.10", "1.9", "1.4", "1.4.2", "1.5", "2", "2.0", "2.1", "2.0rc1", "2.0a1", "2.0b2", "2.0.dev3", "2.0a1.dev1", "2.0.post1", "2.0.post1.dev2", "2.0-1", "2.0rc1.post2",
    "2.0+local", "2.0+local.1", "2.0+1", "2.0+1.local", "2.0+10", "1!0.5", "1!2.0", "v3.0", "3.0ALPHA2", "3.0-beta_4", "3.0preview", "3.0.rev5", "20230101", "20230101123456789012", "1.0.100", "1.0.1000", "10.0", "1.0a", "1.0.dev", "1.0+a.b", "1.0+ab", "1.0+a10", "1.0+a9", "1.0+9a", "1.0+9", "1.0+a", "1.0+a-1", "1.0+a.0x",
]
BROKEN = ["", "x", "1.x", "1..2", "1.0+", "1|2", "french toast"]
CLAUSES = [f"{op}{v}" for op in ("==", "!=", "<=", ">=", "<", ">", "~=", "===") for v in ("1", "1.0", "1.4", "1.4.2", "2.0", "2.0rc1", "2.0.post1", "2.0.dev3", "2.0+local", "1!2.0", "0.0", "1.0.0.1", " 3.0 ")]
CLAUSES += [f"{op}{v}.*" for op in ("==", "!=", ">=", "~=") for v in ("1", "1.0", "1.0.0", "2", "2.0", "0", "1!2", "2.0rc1")]
SETS = ["", " , ", ">=1.0,<2", ">=1.0, !=1.4.*, <2.0rc1", "~=1.4,!=1.4.2", ">=1,nonsense", "nonsense", "=1.0", ">= 1.0 ,, <3", "==1.*,>1.0"]


def met(version, spec):
    try:
        Version(version)
        return SpecifierSet(spec).contains(version, prereleases=True)
    except (InvalidSpecifier, InvalidVersion):
        return True


def test_keys_sort_as_versions(spark):
    rows = spark.createDataFrame([(v,) for v in VERSIONS + BROKEN], "v string").select("v", ve.version_key(F.col("v")).alias("k")).collect()
    keys = {r.v: r.k for r in rows}
    assert all(keys[v] is None for v in BROKEN)
    for a, b in itertools.product(VERSIONS, VERSIONS):
        assert (keys[a] < keys[b], keys[a] == keys[b]) == (Version(a) < Version(b), Version(a) == Version(b)), (a, b)


@pytest.mark.parametrize("specs", [CLAUSES, SETS], ids=["clauses", "sets"])
def test_clauses_as_the_library(spark, specs):
    pairs = [(v, s) for v in VERSIONS + BROKEN for s in specs]
    rows = spark.createDataFrame(pairs, "v string, s string").select("v", "s", ve.satisfies(F.col("v"), F.col("s")).alias("m")).collect()
    wrong = [(r.v, r.s, r.m) for r in rows if r.m != met(r.v, r.s)]
    assert not wrong, wrong[:20]


def test_nulls(spark):
    one = spark.range(1).select(ve.satisfies(F.lit(None).cast("string"), F.lit(">=1")).alias("a"), ve.satisfies(F.lit("1"), F.lit(None).cast("string")).alias("b"), ve.version_key(F.lit(None).cast("string")).alias("c")).first()
    assert (one.a, one.b, one.c) == (True, True, None)


def test_no_python_in_the_plan(spark):
    plan = spark.range(3).select(ve.satisfies(F.col("id").cast("string"), F.lit("~=1.0")))._jdf.queryExecution().toString()
    assert "Python" not in plan
