"""Audit chains, canonical texts, streams with state, keyed lookups, as-of and interval joins against plain versions and on odd input."""

from __future__ import annotations

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions import canonical as js
from riskloom.operators import joins, metrics, scratch
from riskloom.operators import windows as wi
from riskloom.sources import readers, writers
from riskloom.streaming import streams

ODD = ["", "plain", 'q"\\/', "a\nb\r\t\f\b", "\x00\x01\x1f\x7f", "café", "中文 😀 \U0010ffff", "[]{}^", None]


def test_json_texts_as_the_json_module(spark):
    rows = spark.createDataFrame([(k, t, {"b": t or "", "é": "x", "a": "1"}) for k, t in enumerate(ODD)], "k long, t string, m map<string,string>")
    got = rows.select("k", js.string(F.col("t")).alias("s"), js.mapping(F.col("m")).alias("m"), js.members({"z": js.string(F.col("t")), "a": js.items(F.array(js.string(F.lit("x")), js.string(F.col("t"))), js.SPACED)}, js.SPACED).alias("o")).collect()
    for r in got:
        t = ODD[r.k]
        assert r.s == json.dumps(t) and r.m == json.dumps({"b": t or "", "é": "x", "a": "1"}, sort_keys=True, separators=(",", ":"))
        assert r.o == json.dumps({"z": t, "a": ["x", t]}, sort_keys=True)
    assert spark.range(1).select(js.mapping(F.lit(None).cast("map<string,string>"))).first()[0] == "{}"


def entries(n):
    """A log as the audit trail writes it: each hash is of the predecessor's and the entry's JSON text."""
    last, out = "0" * 64, []
    for k in range(n):
        body = {"timestamp": f"t{k}", "tenant": "a", "actor": 'b"é', "action": "x", "details": {"n": str(k)}, "prev_hash": last}
        last = hashlib.sha256((last + json.dumps(body, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()
        out.append({**body, "entry_hash": last, "seq": k})
    return out


def broken_at(spark, rows):
    log = spark.createDataFrame(rows, "timestamp string, tenant string, actor string, action string, details map<string,string>, prev_hash string, entry_hash string, seq long")
    said = js.audit_payload(*map(F.col, ("timestamp", "tenant", "actor", "action", "details")))
    return [r.broken_at for r in wi.verify(log.withColumn("payload", said), "tenant", "seq", "payload").collect()]


def test_an_audit_trail_and_what_breaks_it(spark):
    log = entries(6)
    assert broken_at(spark, log) == [None] and broken_at(spark, []) == []
    edit = lambda k, **x: [{**r, **x} if r["seq"] == k else r for r in log]
    for rows, at in (
        (edit(3, action="forged"), 3), (edit(3, prev_hash=None, action="forged"), 3), (edit(0, prev_hash=None), 0), (edit(2, entry_hash=None), 2), (edit(4, prev_hash="0" * 64), 4), (edit(1, details=None), 1),
        ([r for r in log if r["seq"] != 2], 3), (log[1:], 1), (edit(2, seq=30), 3), ([*log, {**log[2], "seq": 9}], 9),
    ):
        assert broken_at(spark, rows) == [at]


def test_chains_as_the_trail(spark):
    log = spark.createDataFrame([{k: v for k, v in r.items() if k not in ("prev_hash", "entry_hash")} for r in entries(5)], "timestamp string, tenant string, actor string, action string, details map<string,string>, seq long")
    said = js.audit_payload(*map(F.col, ("timestamp", "tenant", "actor", "action", "details")))
    got = wi.chained(log.withColumn("payload", said), "tenant", "seq", "payload").orderBy("seq").collect()
    assert [r.entry_hash for r in got] == [r["entry_hash"] for r in entries(5)]


def test_structural_hash_as_json(spark):
    rows = [("p", "b.f", "X", 1), ("p", "a.é", "Y", 2), ("p", "b.f", "Z", 3), ("q", "c", "X", 1), ("q", "", "X", 1)]
    got = {r.package: r.structural_hash for r in metrics.structural_hash(spark.createDataFrame(rows, "package string, fqn string, change_type string, seq int"), "package").collect()}
    for package, classes in (("p", {"b.f": "Z", "a.é": "Y"}), ("q", {"c": "X"})):
        text = json.dumps({"fqns": sorted(classes), "classes": classes}, sort_keys=True)
        assert got[package] == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_log_is_appended_from_its_tails(spark, tmp_path):
    rows = [(t, k, None if k == 2 else f"p{k}") for t in ("a", "b", None) for k in range(9)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], "tenant string, seq long, payload string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("tenant string, seq long, payload string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.append_log(source(), f"{tmp_path}/log", f"{tmp_path}/state")
    whole = sorted((str(r.tenant), r.seq, r.entry_hash) for r in streams.read_log(spark, f"{tmp_path}/log").collect())
    want = wi.chained(spark.createDataFrame(rows, "tenant string, seq long, payload string"), "tenant", "seq", "payload")
    assert whole == sorted((str(r.tenant), r.seq, r.entry_hash) for r in want.collect())
    # a batch that is run again, and a writer that begins anew: the log stays one chain
    streams.append_batch(spark.createDataFrame([r for r in rows if r[1] // 3 == 2], "tenant string, seq long, payload string"), 2, f"{tmp_path}/log")
    streams.append_batch(spark.createDataFrame(rows, "tenant string, seq long, payload string"), 3, f"{tmp_path}/log")
    assert sorted((str(r.tenant), r.seq, r.entry_hash) for r in streams.read_log(spark, f"{tmp_path}/log").collect()) == whole
    # a batch that was cut off before it left its tails isn't part of the log
    spark.createDataFrame([("a", 99, "x", "y", "z")], streams.LOG).write.parquet(f"{tmp_path}/log/log/batch=4")
    assert streams.read_log(spark, f"{tmp_path}/log").count() == len(rows)


def test_scans_are_due_again(spark, tmp_path):
    day = datetime.timedelta(days=1)
    begin = datetime.datetime(2024, 1, 1)
    rng, rows = random.Random(3), []
    for batch in range(4):
        part = [(rng.choice("abcd"), begin + batch * 20 * day + rng.randrange(20 * 24) * day / 24) for _ in range(40)]
        rows += part
        spark.createDataFrame(part, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{batch}")
        spark.read.parquet(f"{tmp_path}/in{batch}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with streams.rocks(spark):
            streams.run_available(streams.scans_due(spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in"), 30 * 86_400), f"{tmp_path}/out", f"{tmp_path}/state")
    want, last = [], {}
    for key, ts in sorted(rows, key=lambda r: r[1]):
        if key not in last or ts - last[key] >= 30 * day:
            last[key] = ts
            want.append((key, ts))
    got = [(r.key, r.ts) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(want) and len(want) > 4


def test_lookup_reads_one_part(spark, tmp_path):
    rows = spark.createDataFrame([(f"CVE-{k}", "no_patch_found" if k % 3 == 0 else "ok") for k in range(300)], "cve_id string, status string")
    writers.write_patches(rows, f"{tmp_path}/p")
    found = readers.lookup_patch(spark, f"{tmp_path}/p", "cve-9")
    assert [tuple(r) for r in found.collect()] == [("CVE-9", "no_patch_found")]
    parts = {f.rsplit("part=", 1)[1].split("/")[0] for f in found.inputFiles()}
    assert "PartitionFilters: [isnotnull(part" in found._jdf.queryExecution().toString() and len(parts) >= 1
    assert readers.lookup_patch(spark, f"{tmp_path}/p", "CVE-999").count() == 0
    ids = spark.createDataFrame([("cve-1",), ("CVE-1",), ("CVE-999",), (None,)], "cve_id string")
    assert sorted(tuple(r) for r in readers.lookup_patches(spark, f"{tmp_path}/p", ids).collect()) == [("CVE-1", "ok"), ("CVE-999", "not_fetched")]


def test_as_of_as_a_plain_search(spark):
    rng, begin = random.Random(5), datetime.datetime(2024, 1, 1)
    at = lambda: begin + datetime.timedelta(minutes=rng.randrange(6 * 1440))
    requests = [(k, rng.choice(["hot", "hot", "a", "b", None]), at()) for k in range(300)]
    snaps = [(rng.choice(["hot", "a", None]), at(), f"v{k}") for k in range(60)] + [("b", begin + datetime.timedelta(days=3), "w"), ("b", begin + datetime.timedelta(days=3), "x"), ("b", None, "y")]
    got = joins.as_of(spark.createDataFrame(requests, "id long, key string, asked_at timestamp"), spark.createDataFrame(snaps, "key string, fetched_at timestamp, snapshot string"), "key", 7200, 3600)
    for r in got.collect():
        earlier = sorted((f, s) for k, f, s in snaps if k == r.key and f is not None and f <= r.asked_at)
        want = earlier[-1] if earlier else (None, None)
        state = "missing" if not earlier else "fresh" if (r.asked_at - want[0]).total_seconds() < 7200 else "stale"
        assert (r.fetched_at, r.snapshot, r.state) == (*want, state)
    assert got.count() == len(requests)


@pytest.mark.parametrize("seed", range(3))
def test_innermost_as_a_plain_search(spark, seed):
    rng = random.Random(seed)
    ranges = [(k, rng.choice(["hot", "hot", "a"]), low := rng.randrange(-50, 3000), low + rng.choice([0, 1, 5, 63, 64, 900, -1])) for k in range(400)]
    points = [(k, rng.choice(["hot", "a", "none", None]), rng.randrange(-60, 4000)) for k in range(600)]
    got = joins.innermost(spark.createDataFrame(points, "hit long, file string, line int"), spark.createDataFrame(ranges, "range_id long, file string, low int, high int"), "file", "line", "hit")
    want = {}
    for hit, file, line in points:
        held = [(low, -k) for k, f, low, high in ranges if f == file and low <= line <= high]
        want[hit] = -max(held)[1] if held else None
    assert {r.hit: r.range_id for r in got.collect()} == want


def test_nested_ranges_meet_once_a_level(spark):
    """A thousand ranges about each point make a few rows a point, not a thousand."""
    ranges = spark.range(1000).selectExpr("id as range_id", "'f' as file", "id as low", "100000 - id as high")
    points = spark.range(2000).selectExpr("id as hit", "'f' as file", "20000 + id as line")
    found = joins.innermost(points, ranges, "file", "line", "hit")
    assert found.groupBy("range_id").count().collect() == [(999, 2000)]
    cut = ranges.select(F.explode(joins.dyadic(F.col("low"), F.col("high"))).alias("x")).groupBy("x.level", "x.slot").count()
    assert cut.count() < 2_100  # the strips that are kept, a row each


def test_numbered_in_order(spark):
    rows = spark.range(5000).selectExpr("id * 7919 % 5003 as v").repartition(7)
    assert [(r.v, r.n) for r in scratch.numbered(rows, "n", F.desc("v")).orderBy("n").collect()] == [(v, k + 1) for k, v in enumerate(sorted((k * 7919 % 5003 for k in range(5000)), reverse=True))]
    assert scratch.numbered(rows.limit(0), "n", F.col("v")).count() == 0


def test_missing_model_is_trained_and_stored(spark, tmp_path):
    from riskloom.sources import models

    path = f"{tmp_path}/model"
    trained = models.ensure_exploit_model(spark, path, rows=200, epochs=3)
    assert len(trained["weights"]) == 5 and any(trained["weights"])
    assert models.ensure_exploit_model(spark, path) == trained == models.load_exploit_model(spark, path)
    spark.createDataFrame([("{}",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    assert models.ensure_exploit_model(spark, path, rows=200, epochs=3) == trained
