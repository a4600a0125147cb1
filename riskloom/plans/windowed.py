"""Queries of windows, sorts, limits and set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators import windows as wi
from riskloom.operators.scratch import numbered
from riskloom.plans.analogs import ctes, view
from riskloom.plans.scores import SCORED, scored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def chain_sql(payload: str) -> str:
    """The log's chains as CTEs that end in one named c, folded an entry a round; to follow WITH RECURSIVE."""
    return f"""{ctes("log")}, p AS (SELECT tenant, seq, {payload} AS payload, row_number() OVER (PARTITION BY tenant ORDER BY seq) AS n FROM log),
  c(tenant, seq, payload, n, prev_hash, entry_hash) AS (SELECT *, repeat('0', 64), sha256(concat(repeat('0', 64), payload)) FROM p WHERE n = 1
    UNION ALL SELECT p.*, c.entry_hash, sha256(concat(c.entry_hash, p.payload)) FROM c JOIN p ON p.tenant = c.tenant AND p.n = c.n + 1)"""


CHAIN = chain_sql("concat(actor, ':', action, ':', props)")


def chain(spark, sf):
    log = view(spark, sf, "log").select("tenant", "seq", F.concat(F.col("actor").cast("string"), F.lit(":"), "action", F.lit(":"), "props").alias("payload"))
    return wi.chained(log, "tenant", "seq", "payload")


#: How a log is tampered with after it was chained, each in a tenant of its own: in SQL that Spark and DuckDB read alike.
TAMPERED = """SELECT tenant, CASE WHEN tenant = 'tenant1' AND seq % 1999 IN (8, 9) THEN seq + 100000000 ELSE seq END AS seq,
    CASE WHEN tenant = 'tenant0' AND seq % 1999 = 7 OR tenant = 'tenant2' AND seq % 997 = 5 THEN 'forged' ELSE payload END AS payload,
    CASE WHEN tenant IN ('tenant2', 'tenant3') AND seq % 997 = 5 THEN NULL WHEN tenant = 'tenant6' AND seq % 1499 = 11 THEN repeat('0', 64) ELSE prev_hash END AS prev_hash,
    CASE WHEN tenant = 'tenant4' AND seq % 1499 = 3 THEN NULL ELSE entry_hash END AS entry_hash
  FROM {c} WHERE NOT (tenant = 'tenant5' AND seq % 1201 = 2)"""


@query("hash_chain_verify", f"""WITH RECURSIVE {CHAIN}, t AS ({TAMPERED.replace("{c}", "c")}), l AS (SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY tenant ORDER BY seq), CASE WHEN row_number() OVER (PARTITION BY tenant ORDER BY seq) = 1 THEN repeat('0', 64) END) AS due FROM t)
  SELECT tenant, count(*) AS entries, coalesce(min(seq) FILTER (prev_hash IS DISTINCT FROM due OR entry_hash IS DISTINCT FROM sha256(concat(prev_hash, payload))), -1) AS broken_at FROM l GROUP BY tenant""")
def hash_chain(spark, sf):
    tampered = spark.sql(TAMPERED, c=chain(spark, sf))
    return wi.verify(tampered, "tenant", "seq", "payload").withColumn("broken_at", F.coalesce("broken_at", F.lit(-1)))


@query("hash_chain_tail", f"WITH RECURSIVE {CHAIN} SELECT tenant, arg_max(entry_hash, seq) AS last_hash FROM c GROUP BY tenant")
def hash_tail(spark, sf):
    return wi.tail_hash(chain(spark, sf), "tenant", "seq")


@query("loop_detect_lag", "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER w AS a, lag(floor(value)) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = a AND floor(value) = b")
def loop_detect(spark, sf):
    return wi.repeats(view(spark, sf, "events").withColumn("v", F.floor("value")), "user_id", "event_id", "event_type", "v").select("user_id", "event_id")


@query("temporal_split", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= floor(count(*) OVER (PARTITION BY event_type) * 0.75e0) AS train FROM events")
def temporal_split(spark, sf):
    return wi.temporal_split(view(spark, sf, "events"), "event_type", ["ts", "event_id"], 0.75).select("event_id", "event_type", "train")


@query("scratchpad_compress", """WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
  SELECT conv_id, substr(concat(CASE WHEN any_value(n) > 5 THEN concat('[', any_value(n) - 5, ' earlier steps] ') ELSE '' END, string_agg(role, ' | ' ORDER BY turn) FILTER (rn <= 5)), 1, 8000) AS history FROM r GROUP BY conv_id""")
def scratchpad(spark, sf):
    return wi.compressed(view(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("code_context", r"""WITH d AS (SELECT doc_id AS file, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT file, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM d), h AS (SELECT doc_id AS hit_id, doc_id AS file, doc_id % 9 + 1 AS line FROM documents WHERE doc_id IS NOT NULL)
  SELECT hit_id, string_agg(format('{:s} {:4d} | {:s}', CASE WHEN line_no = line THEN '>>>' ELSE '   ' END, line_no, x.text), chr(10) ORDER BY line_no) AS code FROM h JOIN x USING (file) WHERE line_no BETWEEN line - 3 AND line + 3 GROUP BY hit_id""")
def code_context(spark, sf):
    d = view(spark, sf, "documents")
    lines = d.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).select("file", (F.col("i") + 1).cast("bigint").alias("line_no"), "text")
    return wi.context(lines, d.select(F.col("doc_id").alias("hit_id"), F.col("doc_id").alias("file"), (F.col("doc_id") % 9 + 1).alias("line")))


@query("conflict_ids", f"WITH {ctes('requires')}, g AS (SELECT dep, count(DISTINCT package) AS n FROM requires GROUP BY dep HAVING count(DISTINCT package) >= 2) SELECT concat('C', row_number() OVER (ORDER BY dep)) AS conflict_id, dep, n FROM g")
def conflict_ids(spark, sf):
    g = view(spark, sf, "requires").groupBy("dep").agg(F.count_distinct("package").alias("n")).filter("n >= 2")
    return numbered(g, "i", F.col("dep")).select(F.concat(F.lit("C"), F.col("i").cast("string")).alias("conflict_id"), "dep", "n")


@query("plan_step_order", f"WITH {ctes('requires')}, c AS (SELECT dep, count(DISTINCT package) AS rank FROM requires GROUP BY dep) SELECT dep, row_number() OVER (ORDER BY rank DESC, dep) AS step FROM c")
def step_order(spark, sf):
    c = view(spark, sf, "requires").groupBy("dep").agg(F.count_distinct("package").alias("rank"))
    return numbered(c, "step", F.desc("rank"), F.asc("dep")).select("dep", "step")


@query("primary_symbol", f"WITH {ctes('symbols')} SELECT package, fqn FROM (SELECT package, fqn, row_number() OVER (PARTITION BY package ORDER BY contains('fn7 fn11', short_name) DESC, seq) AS rn FROM symbols) WHERE rn = 1")
def primary_symbol(spark, sf):
    match = F.lit("fn7 fn11").contains(F.col("short_name"))
    return view(spark, sf, "symbols").groupBy("package").agg(F.min_by("fqn", F.struct(~match, "seq")).alias("fqn"))


@query("families_hits_first", f"WITH {ctes('findings')}, f AS (SELECT cwe, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') > 20 AS ready FROM findings GROUP BY cwe) SELECT cwe, n, ready, row_number() OVER (ORDER BY ready DESC, cwe) AS place FROM f")
def families_order(spark, sf):
    f = view(spark, sf, "findings").groupBy("cwe").agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(severity = 'CRITICAL') > 20").alias("ready"))
    return f.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ready"), "cwe")))  # one row a weakness


@query("capped_per_group_topk", f"{SCORED} SELECT package, cve_id, raw_risk FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY raw_risk DESC, cve_id) AS rn FROM s) WHERE rn <= 3")
def capped(spark, sf):
    w = Window.partitionBy("package").orderBy(F.desc("raw_risk"), "cve_id")
    return scored(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("package", "cve_id", "raw_risk")


@query("graph_caps_per_label", f"{SCORED}, capped AS (SELECT cve_id, recommendation, row_number() OVER (PARTITION BY recommendation ORDER BY cvss_score DESC, cve_id) AS rn FROM s) SELECT cve_id, recommendation FROM capped WHERE rn <= 24")
def graph_caps(spark, sf):
    w = Window.partitionBy("recommendation").orderBy(F.desc("cvss_score"), "cve_id")
    return scored(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 24").select("cve_id", "recommendation")


@query("scan_results_two_limits", f"WITH {ctes('refs')}, n AS (SELECT file, count(*) FILTER (kind = 'call') AS n FROM refs GROUP BY file) SELECT * FROM (SELECT file, n FROM n WHERE n > 20 ORDER BY n DESC, file LIMIT 15) UNION ALL SELECT * FROM (SELECT file, n FROM n WHERE n <= 20 ORDER BY file LIMIT 5)")
def two_limits(spark, sf):
    n = view(spark, sf, "refs").groupBy("file").agg(F.expr("count_if(kind = 'call')").alias("n"))
    return n.filter("n > 20").orderBy(F.desc("n"), "file").limit(15).unionByName(n.filter("n <= 20").orderBy("file").limit(5))


@query("hits_capped", f"WITH {ctes('refs')} SELECT cve_id, file, line, col, kind FROM refs ORDER BY file, line, col, kind, cve_id, seq LIMIT 25")
def hits_capped(spark, sf):
    return view(spark, sf, "refs").orderBy("file", "line", "col", "kind", "cve_id", "seq").limit(25).select("cve_id", "file", "line", "col", "kind")


@query("changed_symbols_distinct", f"WITH {ctes('symbols')} SELECT DISTINCT short_name, change_type FROM symbols ORDER BY short_name, change_type LIMIT 20")
def changed_distinct(spark, sf):
    return view(spark, sf, "symbols").select("short_name", "change_type").distinct().orderBy("short_name", "change_type").limit(20)


@query("first_ref_chains", f"WITH {ctes('refs')}, f AS (SELECT cve_id, min(seq) AS seq FROM refs GROUP BY cve_id) SELECT cve_id, seq FROM f ORDER BY cve_id LIMIT 10")
def first_refs(spark, sf):
    return view(spark, sf, "refs").groupBy("cve_id").agg(F.min("seq").alias("seq")).orderBy("cve_id").limit(10)


@query("recommended_actions", f"{SCORED} SELECT * FROM (SELECT concat('Fix ', cve_id) AS action, 1 AS priority FROM s WHERE recommendation = 'BLOCK' ORDER BY raw_risk DESC, cve_id LIMIT 4) UNION ALL SELECT * FROM (SELECT concat('Review ', cve_id), 2 FROM s WHERE recommendation = 'REVIEW' ORDER BY raw_risk DESC, cve_id LIMIT 2)")
def actions(spark, sf):
    s = scored(spark, sf)
    top = lambda kind, word, p, n: s.filter(F.col("recommendation") == kind).orderBy(F.desc("raw_risk"), "cve_id").limit(n).select(F.concat(F.lit(word), "cve_id").alias("action"), F.lit(p).alias("priority"))
    return top("BLOCK", "Fix ", 1, 4).unionByName(top("REVIEW", "Review ", 2, 2))


@query("known_cves_hint", f"WITH {ctes('findings')} SELECT array_to_string(list_sort(list(DISTINCT cve_id))[1:25], ', ') AS hint FROM findings WHERE severity = 'CRITICAL'")
def hint(spark, sf):
    first = view(spark, sf, "findings").filter("severity = 'CRITICAL'").select("cve_id").distinct().orderBy("cve_id").limit(25)
    return first.agg(F.array_join(F.array_sort(F.collect_list("cve_id")), ", ").alias("hint"))


@query("references_sorted", f"WITH {ctes('refs')} SELECT cve_id, string_agg(concat(file, ':', line), ',' ORDER BY file, line, col, kind, seq) AS places FROM refs GROUP BY cve_id")
def refs_sorted(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("file", "line", "col", "kind", "seq")))
    return view(spark, sf, "refs").groupBy("cve_id").agg(rows.alias("r")).select("cve_id", F.array_join(F.transform("r", lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string"))), ",").alias("places"))


@query("argmax_breakdown", f"{SCORED} SELECT package, arg_max(cve_id, raw_risk::BIGINT * 10000000 - substr(cve_id, 5)::BIGINT) AS cve_id, max(raw_risk) AS raw_risk FROM s GROUP BY package")
def argmax(spark, sf):
    return scored(spark, sf).groupBy("package").agg(F.expr("max_by(cve_id, cast(raw_risk as bigint) * 10000000 - cast(substr(cve_id, 5) as bigint))").alias("cve_id"), F.max("raw_risk").alias("raw_risk"))


@query("url_canonical_dedupe", r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS canonical FROM pages) SELECT canonical, min(page_id) AS page_id, count(*) AS n FROM c GROUP BY canonical""")
def url_dedupe(spark, sf):
    c = F.regexp_replace(F.regexp_replace(F.lower("url"), "[?#].*$", ""), "/+$", "")
    return view(spark, sf, "pages").groupBy(c.alias("canonical")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query("commit_source_union", f"WITH {ctes('findings')}, u AS (SELECT cve_id, concat('https://nvd/', row_id % 50) AS url, 1 AS rank FROM findings WHERE row_id % 2 = 0 UNION ALL SELECT cve_id, concat('https://osv/', row_id % 50), 2 FROM findings WHERE row_id % 3 = 0 UNION ALL SELECT cve_id, concat('https://nvd/', row_id % 50), 3 FROM findings) SELECT cve_id, url, min(rank) AS rank FROM u GROUP BY ALL")
def source_union(spark, sf):
    f = view(spark, sf, "findings")
    part = lambda where, host, rank: f.filter(where).select("cve_id", F.concat(F.lit(f"https://{host}/"), (F.col("row_id") % 50).cast("string")).alias("url"), F.lit(rank).alias("rank"))
    return part("row_id % 2 = 0", "nvd", 1).unionByName(part("row_id % 3 = 0", "osv", 2)).unionByName(part("true", "nvd", 3)).groupBy("cve_id", "url").agg(F.min("rank").alias("rank"))


@query("key_set_union", f"WITH {ctes('symbols', 'refs')} SELECT cve_id FROM symbols UNION SELECT cve_id FROM refs")
def key_union(spark, sf):
    return view(spark, sf, "symbols").select("cve_id").union(view(spark, sf, "refs").select("cve_id")).distinct()


@query("scope_algebra", f"WITH {ctes('tree_current', 'tree_target', 'requires')} SELECT package FROM (SELECT package FROM tree_current INTERSECT SELECT package FROM tree_target UNION SELECT dep FROM requires) EXCEPT SELECT package FROM requires WHERE row_id % 3 = 0")
def scope(spark, sf):
    both = view(spark, sf, "tree_current").select("package").intersect(view(spark, sf, "tree_target").select("package"))
    r = view(spark, sf, "requires")
    return both.union(r.select(F.col("dep").alias("package"))).distinct().subtract(r.filter("row_id % 3 = 0").select("package"))


@query("names_minus_empty", f"WITH {ctes('findings')} SELECT package, array_to_string(list_sort(list(DISTINCT fixed_version) FILTER (fixed_version <> '')), ';') AS versions FROM findings GROUP BY package")
def names_minus(spark, sf):
    sets = view(spark, sf, "findings").groupBy("package").agg(F.collect_set("fixed_version").alias("v"))
    return sets.select("package", F.array_join(F.array_sort(F.array_except("v", F.array(F.lit("")))), ";").alias("versions"))


@query("scope_intersection_test", f"WITH {ctes('requires')}, g AS (SELECT dep, list(DISTINCT package) AS p FROM requires GROUP BY dep) SELECT dep, list_has_any(p, ['pkg1', 'pkg10', 'pkg100']) AS in_scope FROM g")
def scope_test(spark, sf):
    g = view(spark, sf, "requires").groupBy("dep").agg(F.collect_set("package").alias("p"))
    return g.select("dep", F.arrays_overlap("p", F.array(F.lit("pkg1"), F.lit("pkg10"), F.lit("pkg100"))).alias("in_scope"))


@query("line_set_difference", r"""WITH p AS (SELECT a.doc_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, len(list_distinct(list_filter(x, lambda l: NOT list_contains(y, l)))) AS n_added FROM p""")
def line_difference(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("x"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id").select("doc_id", F.size(F.array_except("x", "y")).cast("bigint").alias("n_added"))


@query("symbol_upsert", f"WITH {ctes('symbols')}, u AS (SELECT fqn, change_type, seq, 1 AS p FROM symbols UNION ALL SELECT fqn, 'MODIFIED', seq, 0 FROM symbols WHERE seq % 3 = 0) SELECT fqn, change_type FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY p, seq) AS rn FROM u) WHERE rn = 1")
def upsert(spark, sf):
    s = view(spark, sf, "symbols").select("fqn", "change_type", "seq", F.lit(1).alias("p"))
    full = s.filter("seq % 3 = 0").withColumns({"change_type": F.lit("MODIFIED"), "p": F.lit(0)})
    return s.unionByName(full).groupBy("fqn").agg(F.min_by("change_type", F.struct("p", "seq")).alias("change_type"))


@query("edge_dedupe", f"WITH {ctes('exposed', 'reach')} SELECT DISTINCT cve_id, service FROM (SELECT cve_id, service FROM exposed UNION ALL SELECT cve_id, service FROM reach)")
def edge_dedupe(spark, sf):
    return view(spark, sf, "exposed").unionByName(view(spark, sf, "reach").select("cve_id", "service")).dropDuplicates(["cve_id", "service"])
