"""Queries of the learnt model, services, streams and source extraction."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import extract, ml, scratch, service
from riskloom.operators import windows as wi
from riskloom.plans.analogs import ctes, view
from riskloom.plans.scores import SCORED, scored
from riskloom.plans.windowed import chain_sql
from riskloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


REQUESTS = "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'analyst' WHEN 2 THEN 'owner' ELSE 'guest' END AS role, CASE event_type WHEN 'click' THEN 'assessment:read' WHEN 'view' THEN 'assessment:create' WHEN 'purchase' THEN 'assessment:delete' WHEN 'signup' THEN 'audit:read' ELSE 'other' END AS action, user_id % 3 AS tenant, event_id % 2 AS resource_tenant FROM {events}"
GRANTS = ", ".join(f"('{r}', '{a}')" for r, xs in service.ROLES.items() for a in xs)


@query("authorization_predicate", f"WITH r AS ({REQUESTS.replace('{events}', 'events')}), g(role, action) AS (VALUES {GRANTS}) SELECT event_id, g.role IS NOT NULL AND tenant = resource_tenant AS allowed FROM r LEFT JOIN g USING (role, action)")
def authorization(spark, sf):
    return service.allowed(spark.sql(REQUESTS, events=view(spark, sf, "events")), service.permissions(spark)).select("event_id", "allowed")


@query("tenant_row_filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def tenant_rows(spark, sf):
    rows = view(spark, sf, "customer").withColumnRenamed("c_mktsegment", "tenant")
    return service.own(rows, "BUILDING").select("c_custkey", "c_acctbal")


@query("tenant_submit_get", "SELECT c_custkey, c_acctbal, concat('scan', c_custkey % 10) AS scan_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 10 = 3 UNION ALL SELECT c_custkey, c_acctbal, 'late' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 10 = 4")
def tenant_submit(spark, sf):
    """Two submissions into a store by tenant; a tenant's own scans are read, and a scan of another tenant is as if it weren't there."""
    path = f"{scratch.root(spark)}/store-{uuid.uuid4().hex}"
    rows = view(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("tenant"), F.concat(F.lit("scan"), (F.col("c_custkey") % 10).cast("string")).alias("scan_id"))
    service.submit(path, rows)
    service.submit(path, rows.filter("c_custkey % 10 = 4").withColumn("scan_id", F.lit("late")))
    service.submit(path, rows.filter("tenant != 'BUILDING'").withColumn("scan_id", F.lit("theirs")))
    held = spark.read.schema(rows.schema).parquet(path)
    mine = [service.get(held, "BUILDING", scan) for scan in ("scan3", "late", "theirs")]
    return mine[0].unionByName(mine[1]).unionByName(mine[2]).select("c_custkey", "c_acctbal", "scan_id")


@query("tenant_delete", "SELECT c_mktsegment AS tenant, count(*) AS n FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_custkey % 10 = 3) GROUP BY 1")
def tenant_delete(spark, sf):
    rows = view(spark, sf, "customer").select(F.col("c_mktsegment").alias("tenant"), (F.col("c_custkey") % 10).cast("string").alias("scan_id"))
    return service.without_scan(rows, "BUILDING", "3").groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))


@query("tenant_audit", f"WITH RECURSIVE {chain_sql("concat(actor, ':', action)")} SELECT seq, prev_hash, entry_hash, (SELECT count(DISTINCT tenant) FROM c) AS chains, 0::BIGINT AS broken, (SELECT count(*) FROM c) AS entries FROM c WHERE tenant = 'tenant3'")
def tenant_audit(spark, sf):
    log = view(spark, sf, "log").select("tenant", "seq", F.concat(F.col("actor").cast("string"), F.lit(":"), "action").alias("payload"))
    state, own = service.audit(wi.chained(log, "tenant", "seq", "payload"), "tenant3", "tenant", "seq", "payload")
    one = state.agg(F.count(F.lit(1)).alias("chains"), F.count("broken_at").alias("broken"), F.sum("entries").alias("entries"))
    return own.select("seq", "prev_hash", "entry_hash").join(F.broadcast(one))  # one row


@query("tenant_vex", f"{SCORED} SELECT package AS tenant, count(*) FILTER (reachability_kind = 'direct') AS affected, count(*) AS n FROM s WHERE package IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1")
def tenant_vex(spark, sf):
    return scored(spark, sf).filter("package in ('Brand#1', 'Brand#2', 'Brand#3')").groupBy(F.col("package").alias("tenant")).agg(F.expr("count_if(reachability_kind = 'direct')").alias("affected"), F.count(F.lit(1)).alias("n"))


#: Fixed value: the epochs of a fit.
EPOCHS = 800


def _stream(spark, sf, name: str, f, mode: str) -> DataFrame:
    """Runs a stream over a table's files to its end and reads its result from the shared folder."""
    root = f"{scratch.root(spark)}/stream-{uuid.uuid4().hex}"
    table = view(spark, sf, name)
    source = spark.readStream.schema(table.schema).parquet(f"{sf}/{name}.parquet*")
    streams.run_available(f(source), f"{root}/out", f"{root}/state", mode)
    return spark.read.parquet(f"{root}/out")


@query("stream_flywheel_counts", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_counts(spark, sf):
    return _stream(spark, sf, "events", lambda s: streams.counters(s, "event_type"), "complete")


@query("stream_first_seen", "SELECT DISTINCT event_type, user_id FROM events")
def stream_first(spark, sf):
    keyed = lambda s: streams.first_seen(s.select(F.concat_ws(":", "event_type", "user_id").alias("key"), "event_type", "user_id")).drop("key")
    return _stream(spark, sf, "events", keyed, "append")


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    return _stream(spark, sf, "events", lambda s: streams.windowed(s), "complete")


@query("stream_hash_chain", f"WITH RECURSIVE {chain_sql("concat(action, ':', props)")} SELECT tenant, count(*) AS entries, true AS valid, arg_max(entry_hash, seq) AS last_hash FROM c GROUP BY tenant")
def stream_chain(spark, sf):
    entries = lambda s: streams.chain_log(s.select(F.concat(F.lit("tenant"), (F.col("user_id") % 7).cast("string")).alias("tenant"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(":"), "props").alias("payload")))
    done = _stream(spark, sf, "events", entries, "append")
    valid = wi.verify(done, "tenant", "seq", "payload").select("tenant", "entries", F.col("broken_at").isNull().alias("valid"))
    return valid.join(wi.tail_hash(done, "tenant", "seq"), "tenant")


@query("stream_scans_due", """WITH RECURSIVE e AS (SELECT event_type AS key, ts FROM events), s(key, ts) AS (SELECT key, min(ts) FROM e GROUP BY key UNION ALL SELECT s.key, (SELECT min(e.ts) FROM e WHERE e.key = s.key AND e.ts >= s.ts + INTERVAL 3 DAY) FROM s WHERE s.ts IS NOT NULL)
  SELECT key, ts FROM s WHERE ts IS NOT NULL""")
def stream_scans(spark, sf):
    with streams.rocks(spark):
        due = _stream(spark, sf, "events", lambda s: streams.scans_due(s.select(F.col("event_type").alias("key"), "ts"), 3 * 86_400), "append")
    return due.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_audit_append", f"""WITH RECURSIVE {chain_sql("concat(action, ':', props)")} SELECT tenant, count(*) AS entries, true AS valid, arg_max(entry_hash, seq) AS last_hash FROM c GROUP BY tenant""")
def stream_append(spark, sf):
    """The log in three files, read in three batches; the last batch is run once more, as after a failure."""
    root = f"{scratch.root(spark)}/stream-{uuid.uuid4().hex}"
    log = view(spark, sf, "log").select("tenant", "seq", F.concat("action", F.lit(":"), "props").alias("payload"))
    total = log.agg(F.max("seq")).first()[0] or 0
    for part in range(3):
        log.filter((F.col("seq") * 3 / (total + 1)).cast("int") == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    streams.append_log(source, f"{root}/log", f"{root}/state")
    streams.append_batch(log.filter((F.col("seq") * 3 / (total + 1)).cast("int") == 2), 2, f"{root}/log")
    done = streams.read_log(spark, f"{root}/log")
    valid = wi.verify(done, "tenant", "seq", "payload").select("tenant", "entries", F.col("broken_at").isNull().alias("valid"))
    return valid.join(wi.tail_hash(done, "tenant", "seq"), "tenant")


@query("model_train_evaluate", None)
def model_evaluate(spark, sf):
    """A logistic model of size and price for parts, trained on three quarters in order of key, evaluated on the rest."""
    rows = view(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("x"), (F.col("p_size") + F.col("p_partkey") % 11 > 30).cast("int").alias("label"), F.lit(1).alias("k"))
    split = rows.withColumn("train", F.col("p_partkey") % 4 != 3)
    means, stds = ml.scale(split.filter("train"), 2)
    known = split.withColumn("x", ml.scaled(F.col("x"), means, stds))
    weights, bias = ml.fit(known.filter("train"), 2, rate=0.5, epochs=EPOCHS)
    return ml.evaluate(ml.predict(known.filter("not train"), weights, bias))


@query("zscore_features", "SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 5) AS z FROM part")
def zscore(spark, sf):
    part = view(spark, sf, "part")
    means, stds = ml.scale(part.select(F.array(F.col("p_size").cast("double")).alias("x")), 1)
    return part.select("p_partkey", F.round(ml.scaled(F.array(F.col("p_size").cast("double")), means, stds)[0], 5).alias("z"))


def _sources(spark, sf) -> DataFrame:
    text = "concat('import yaml as y', char(10), 'from os import path', char(10), '@app.route(\"/r', p_partkey % 10, '\")', char(10), 'def f', p_partkey, '(a, b=1):', char(10), '    return y.load(a)', char(10), 'def g():', char(10), if(p_partkey % 2 = 0, '    return path.join(1)', '    return f(2'), char(10))"
    return view(spark, sf, "part").selectExpr("concat('m', p_partkey, '.py') as path", f"{text} as text")


@query("source_reference_extract", "SELECT concat('m', p_partkey, '.py') AS path, unnest(['import', 'import', 'call', 'attribute', 'call', 'attribute']) AS kind, unnest([1, 2, 5, 5, 7, 7])::INT AS line, unnest(['yaml', 'os.path', 'yaml.load', 'yaml.load', 'os.path.join', 'os.path.join']) AS fqn, unnest(['', '', concat('f', p_partkey), concat('f', p_partkey), 'g', 'g']) AS enclosing, unnest(['', '', concat('/r', p_partkey % 10), concat('/r', p_partkey % 10), '', '']) AS entry_route FROM part WHERE p_partkey % 2 = 0")
def source_refs(spark, sf):
    return extract.extract_refs(_sources(spark, sf)).select("path", "kind", "line", "fqn", "enclosing", "entry_route")


@query("public_api_extract", "SELECT concat('m', p_partkey, '.py') AS path, unnest([concat('f', p_partkey), 'g']) AS symbol, unnest(['a,b', '']) AS params, unnest([1, 0])::INT AS n_defaults FROM part WHERE p_partkey % 2 = 0")
def public_api(spark, sf):
    return extract.extract_api(_sources(spark, sf)).select("path", "symbol", F.array_join("params", ",").alias("params"), "n_defaults")


@query("call_graph_build", "SELECT concat('m', p_partkey, '.py::', unnest([concat('f', p_partkey), 'g'])) AS src, unnest(['ext::yaml.load', 'ext::os.path.join']) AS dst FROM part WHERE p_partkey % 2 = 0")
def call_graph(spark, sf):
    return extract.resolve_calls(extract.extract_functions(_sources(spark, sf)))


@query("entry_point_services", "SELECT DISTINCT concat('/r', p_partkey % 10) AS route, 'GET' AS method FROM part WHERE p_partkey % 2 = 0")
def entry_points(spark, sf):
    return extract.extract_refs(_sources(spark, sf)).filter("entry_route != ''").select(F.col("entry_route").alias("route"), F.col("entry_method").alias("method")).distinct()


@query("entry_point_detect", """SELECT path, unnest(['f', 'g', 'job', 'cli']) AS name, unnest(['flask', 'fastapi', 'celery', 'click']) AS framework, unnest([concat('/r', k), concat('/i', k % 9), NULL, NULL]) AS route, unnest(['POST', 'PUT', NULL, NULL]) AS method FROM (SELECT p_partkey AS k, concat('app', p_partkey, '.py') AS path FROM part WHERE p_partkey % 2 = 0)
  UNION ALL SELECT concat('site', p_partkey, '/urls.py'), unnest([concat('list', p_partkey), 'home']), 'django', unnest([concat('items/', p_partkey), '']), 'GET' FROM part WHERE p_partkey % 2 = 1""")
def entry_point_detect(spark, sf):
    app = "concat('@app.route(\"/r', p_partkey, '\", methods=[\"post\", \"GET\"])', char(10), 'def f(): pass', char(10), '@login', char(10), '@api.put(\"/i', p_partkey % 9, '\")', char(10), 'async def g(): pass', char(10), '@c.task', char(10), 'def job(): pass', char(10), '@cli.command()', char(10), 'def cli(): pass', char(10))"
    urls = "concat('urlpatterns = [path(\"items/', p_partkey, '\", views.list', p_partkey, '), path(\"\", home), path(\"again\", home), path(\"x\", V.as_view())]', char(10))"
    sources = view(spark, sf, "part").selectExpr("if(p_partkey % 2 = 0, concat('app', p_partkey, '.py'), concat('site', p_partkey, '/urls.py')) as path", f"if(p_partkey % 2 = 0, {app}, {urls}) as text")
    return extract.extract_entry_points(sources)


@query("diff_hunk_extract", "SELECT concat('CVE-', p_partkey) AS cve_id, concat('src/f', p_partkey % 9, '.py') AS file, concat('def h', p_partkey % 5, '(x):') AS header, 2 AS n_added, 1 AS n_removed FROM part WHERE p_partkey % 3 <> 0")
def hunks(spark, sf):
    text = "concat('--- a/x', char(10), '+++ b/', if(p_partkey % 3 = 0, 'tests/', 'src/'), 'f', p_partkey % 9, '.py', char(10), '@@ -1,2 +1,3 @@ def h', p_partkey % 5, '(x):', char(10), '-old', char(10), '+new', char(10), '+more', char(10))"
    found = extract.extract_hunks(view(spark, sf, "part").selectExpr("concat('CVE-', p_partkey) as cve_id", f"{text} as text"))
    return found.select("cve_id", "file", "header", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))


@query("change_classification", "SELECT p_partkey AS id, CASE WHEN p_partkey % 42 = 0 THEN 'INTERNAL_CHANGE' WHEN p_partkey % 7 = 0 THEN 'REMOVED' WHEN p_partkey % 6 = 0 THEN 'ADDED' WHEN p_partkey % 11 = 0 THEN 'RENAMED' WHEN p_partkey % 5 = 0 THEN 'SIGNATURE_CHANGED' WHEN p_partkey % 3 = 0 THEN 'RETURN_CHANGED' WHEN p_partkey % 2 = 0 THEN 'HARDENED_ONLY' ELSE 'INTERNAL_CHANGE' END AS label FROM part")
def classification(spark, sf):
    k = F.col("p_partkey")
    one = lambda m: (k % m == 0).cast("int")
    zero, name = F.lit(0), F.lit("f")
    before = {"exists": k % 6 != 0, "name": name, "signature": zero, "returns": zero, "guards": zero, "body": zero}
    after = {"exists": k % 7 != 0, "name": F.when(k % 11 == 0, "g").otherwise("f"), "signature": one(5), "returns": one(3), "guards": one(2), "body": F.lit(1)}
    return view(spark, sf, "part").select(k.alias("id"), extract.classify(before, after).alias("label"))


@query("fix_plan_diff", "SELECT concat('r', p_partkey, '.txt') AS path, concat('--- a/r', p_partkey, '.txt', chr(10), '+++ b/r', p_partkey, '.txt', chr(10), '@@ -1,2 +1,2 @@', chr(10), '-flask==0.', p_partkey % 5, chr(10), '+flask==2.0', chr(10), ' click==8', chr(10)) AS diff FROM part WHERE p_partkey % 2 = 0")
def fix_diff(spark, sf):
    old = "concat('flask==0.', p_partkey % 5, char(10), 'click==8', char(10))"
    files = view(spark, sf, "part").selectExpr("concat('r', p_partkey, '.txt') as path", f"{old} as old", f"if(p_partkey % 2 = 0, concat('flask==2.0', char(10), 'click==8', char(10)), {old}) as new")
    return extract.unified_diffs(files)
