"""Queries of graph operators, dependency trees, exports and report rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import deps, exports, graph
from riskloom.operators import joins as jn
from riskloom.operators.scratch import cut
from riskloom.plans.analogs import CLAUSE, MEETS, ctes, numbers, view
from riskloom.plans.scores import SCORED, scored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def starts(spark, sf):
    return view(spark, sf, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"))


BFS = f"""WITH RECURSIVE {ctes("calls")}, e AS (SELECT DISTINCT src, dst FROM calls), b(start, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 50 = 0 UNION SELECT b.start, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 10),
  r AS (SELECT start, node, min(depth)::INT AS hops FROM b GROUP BY start, node)"""


@query("bounded_bfs", f"{BFS} SELECT * FROM r")
def bounded_bfs(spark, sf):
    return graph.bfs(view(spark, sf, "calls"), starts(spark, sf), 10)


@query("bfs_hop_counts", f"{BFS} SELECT hops, count(*) AS n FROM r GROUP BY hops")
def bfs_counts(spark, sf):
    return graph.bfs(view(spark, sf, "calls"), starts(spark, sf), 10).groupBy("hops").agg(F.count(F.lit(1)).alias("n"))


@query("reachability_query", f"{BFS} SELECT start, node, hops, CASE WHEN hops <= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM r WHERE node % 3 = 1 AND hops > 0")
def reachability(spark, sf):
    return graph.bfs(view(spark, sf, "calls"), starts(spark, sf), 10).filter("node % 3 = 1 and hops > 0").withColumn("confidence", F.when(F.col("hops") <= 3, "HIGH").otherwise("MEDIUM"))


@query("call_path_tainted", f"""WITH RECURSIVE {ctes("calls")}, e AS (SELECT DISTINCT src, dst FROM calls), b(start, node, depth, path) AS (SELECT p_partkey, p_partkey, 0, [p_partkey::VARCHAR] FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT b.start, e.dst, b.depth + 1, list_append(b.path, e.dst::VARCHAR) FROM b JOIN e ON e.src = b.node WHERE b.depth < 25 AND NOT list_contains(b.path, e.dst::VARCHAR)),
  m AS (SELECT start, node, path, row_number() OVER (PARTITION BY start, node ORDER BY depth, path) AS rn FROM b) SELECT start, node AS sink, (len(path) - 1)::INT AS hops, array_to_string(path, '>') AS path, len(list_filter(path, lambda x: x::BIGINT % 5 = 2)) > 0 AS tainted FROM m WHERE rn = 1 AND node % 7 = 3""")
def call_paths(spark, sf):
    part = view(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    paths = graph.bfs_paths(view(spark, sf, "calls"), starts(spark, sf), part.filter("id % 7 = 3"), 25)
    return graph.tainted_paths(paths, part.filter("id % 5 = 2")).withColumn("path", F.array_join("path", ">"))


#: Up to a hundred rounds, folded a round a step; ends in r, the ranks of the last one.
RANKS = f"""WITH RECURSIVE {ctes('exposed')}, e AS (SELECT cve_id AS src, service AS dst FROM exposed), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS (SELECT count(*)::DOUBLE AS n FROM n),
  o AS (SELECT src, count(*) AS d FROM e GROUP BY src), w AS (SELECT e.src, e.dst, count(*) / any_value(o.d)::DOUBLE AS s FROM e JOIN o USING (src) GROUP BY e.src, e.dst),
  it(k, id, r, gap) AS (SELECT 0, id, 1e0 / c.n, 1e0 FROM n, c UNION ALL
    SELECT k + 1, id, r, sum(abs(r - was)) OVER () FROM (
      SELECT d.k, n.id, 0.15e0 / c.n + 0.85e0 * d.m / c.n + 0.85e0 * coalesce(i.v, 0) AS r, x.r AS was
      FROM n CROSS JOIN c CROSS JOIN (SELECT max(k) AS k, max(gap) AS gap, coalesce(sum(r) FILTER (id NOT IN (SELECT src FROM o)), 0) AS m FROM it) d JOIN it x ON x.id = n.id
      LEFT JOIN (SELECT w.dst, sum(it.r * w.s) AS v FROM w JOIN it ON it.id = w.src GROUP BY w.dst) i ON i.dst = n.id WHERE d.k < 100 AND d.gap >= 1e-9)),
  r AS (SELECT id, r FROM it WHERE k = (SELECT max(k) FROM it))"""


def exposed(spark, sf):
    """The view as a written table: ranks read it several times, and each time lineitem would be read and made distinct."""
    return cut(view(spark, sf, "exposed"))


def ranks(held):
    e = held.select(F.col("cve_id").alias("src"), F.col("service").alias("dst"))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst"))
    return graph.pagerank(nodes, e)


@query("pagerank_suppliers", f"{RANKS} SELECT id, round(r, 8) AS rank FROM r")
def pagerank(spark, sf):
    return ranks(exposed(spark, sf)).select("id", F.round("rank", 8).alias("rank"))


@query("service_centrality", f"{RANKS} SELECT id, round(r / (SELECT max(r) FROM r WHERE id LIKE 'svc-%'), 4) AS centrality FROM r WHERE id LIKE 'svc-%'")
def centrality(spark, sf):
    r = ranks(exposed(spark, sf))
    return graph.relative_centrality(r, r.filter("id like 'svc-%'"))


TREE = f"""WITH RECURSIVE {ctes("requires")}, e AS (SELECT DISTINCT package, dep FROM requires), t(root, package, depth) AS (SELECT DISTINCT package, package, 0 FROM requires UNION SELECT t.root, e.dep, t.depth + 1 FROM t JOIN e ON e.package = t.package WHERE t.depth < 15),
  m AS (SELECT root, package, min(depth)::INT AS depth FROM t GROUP BY root, package)"""


def tree(spark, sf):
    r = view(spark, sf, "requires")
    return graph.resolve_tree(r.select("package"), r)


@query("tree_resolve_recursive", f"{TREE} SELECT * FROM m")
def tree_resolve(spark, sf):
    return tree(spark, sf).select("root", "package", "depth")


@query("tree_unresolved", f"{TREE} SELECT root, package FROM m WHERE package NOT IN (SELECT package FROM requires)")
def unresolved(spark, sf):
    return tree(spark, sf).join(view(spark, sf, "requires").select("package").distinct(), "package", "left_anti").select("root", "package")


@query("required_by", f"{TREE} SELECT m.root, m.package, array_to_string(list_sort(list(DISTINCT e.package)), ',') AS required_by FROM m JOIN e ON e.dep = m.package JOIN m p ON p.root = m.root AND p.package = e.package GROUP BY m.root, m.package")
def required_by(spark, sf):
    r = view(spark, sf, "requires")
    return graph.requirers(r.select("package"), r).groupBy("root", "package").agg(F.array_join(F.array_sort(F.collect_set("parent")), ",").alias("required_by"))


LAYERED = "SELECT concat('n', CAST(p_partkey AS STRING)) AS id, concat('n', CAST(p_partkey // 3 AS STRING)) AS on_id FROM {part} WHERE p_partkey > 0"


@query("topological_layers", """WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), d(k, layer) AS (SELECT k, 0 FROM p WHERE k = 0 UNION ALL SELECT p.k, d.layer + 1 FROM p JOIN d ON p.k // 3 = d.k WHERE p.k > 0) SELECT concat('n', k) AS id, layer::INT AS layer FROM d""")
def topo(spark, sf):
    p = view(spark, sf, "part").select("p_partkey")
    nodes = p.select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"))
    on = p.filter("p_partkey > 0").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.expr("p_partkey div 3").cast("string")).alias("on"))
    return graph.layers(nodes, on)


RESOLVED = "SELECT DISTINCT dep AS package, concat(substr(dep, 4)::INT % 5 + 1, '.', substr(dep, 4)::INT % 4, CASE WHEN substr(dep, 4)::INT % 6 = 4 THEN 'rc1' ELSE '' END) AS version FROM requires"


def resolved(spark, sf):
    k = F.substring("dep", 4, 9).cast("int")
    return view(spark, sf, "requires").select(F.col("dep").alias("package"), F.concat((k % 5 + 1).cast("string"), F.lit("."), (k % 4).cast("string"), F.when(k % 6 == 4, "rc1").otherwise("")).alias("version")).distinct()


@query("conflict_detection", f"""WITH {ctes("requires")}, s AS ({RESOLVED}), m AS (SELECT r.*, {CLAUSE}, s.version, {numbers('s.version')} AS v FROM requires r JOIN s ON s.package = r.dep)
  SELECT dep, count(DISTINCT package) AS n, max(version) AS version, true AS would_break FROM m GROUP BY dep HAVING count(DISTINCT package) >= 2 AND NOT bool_and({MEETS})""")
def conflict_detection(spark, sf):
    return deps.conflicts(view(spark, sf, "requires"), resolved(spark, sf))


@query("bump_attribution", f"""WITH {ctes("requires")}, s AS ({RESOLVED}), n AS (SELECT package, version AS from_version, concat(string_split(version, '.')[1]::INT + 1, '.0') AS to_version FROM s),
  m AS (SELECT r.dep, r.package AS parent, {CLAUSE}, {numbers('n.to_version')} AS tv, {numbers('n.from_version')} AS fv FROM requires r JOIN n ON n.package = r.dep),
  k AS (SELECT dep, parent, CASE WHEN parent = 'pkg7' THEN 0 WHEN {re.sub(r"\bv\b", "tv", MEETS)} AND NOT {re.sub(r"\bv\b", "fv", MEETS)} THEN 1 ELSE 2 END AS rank FROM m)
  SELECT dep AS package, parent AS forced_by FROM (SELECT *, row_number() OVER (PARTITION BY dep ORDER BY rank, parent) AS rn FROM k) WHERE rn = 1""")
def attribution(spark, sf):
    n = resolved(spark, sf).select("package", F.col("version").alias("from_version"), F.concat((F.split("version", r"\.")[0].cast("int") + 1).cast("string"), F.lit(".0")).alias("to_version"))
    return deps.forced_by(n, view(spark, sf, "requires"), "pkg7")


@query("upgrade_verdict", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'BLOCK_AS_REQUESTED' WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 1 THEN 'BLOCK_AS_REQUESTED' WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN 'PROCEED_AFTER_RESOLUTION' ELSE 'SAFE' END AS verdict FROM part")
def verdicts(spark, sf):
    k = F.col("p_partkey")
    return view(spark, sf, "part").select(k.alias("id"), deps.verdict(k % 7 == 0, k % 5 == 0, k % 2 == 0, k % 3 == 0).alias("verdict"))


PLAN = f"""WITH {ctes("requires", "tree_current", "tree_target")}, s AS ({RESOLVED}), m AS (SELECT r.*, {CLAUSE}, {numbers('s.version')} AS v FROM requires r JOIN s ON s.package = r.dep),
  c AS (SELECT dep FROM m GROUP BY dep HAVING count(DISTINCT package) >= 2 AND NOT bool_and({MEETS})), b AS (SELECT DISTINCT package FROM requires WHERE dep IN (SELECT dep FROM c) AND package <> 'pkg1'),
  n AS (SELECT package, count(DISTINCT dep) AS k FROM requires WHERE package IN (SELECT package FROM b) AND dep IN (SELECT package FROM b) GROUP BY package),
  u AS (SELECT b.package, 'blocker' AS kind, 0 AS part, -coalesce(n.k, 0) AS a FROM b LEFT JOIN n USING (package) UNION ALL SELECT package, 'target', 1, row_id FROM requires WHERE package NOT IN (SELECT package FROM b)),
  steps AS (SELECT row_number() OVER (ORDER BY part, a, package) AS step, package, kind FROM u)"""


@query("resolution_plan", f"{PLAN} SELECT * FROM steps")
def resolution_plan(spark, sf):
    r = view(spark, sf, "requires")
    return deps.plan(deps.conflicts(r, resolved(spark, sf)), r, r.select("package", "row_id"), "pkg1")


@query("plan_test_surface", f"{PLAN}, ch AS (SELECT c.package FROM tree_current c JOIN tree_target t USING (package) WHERE c.version <> t.version AND c.package LIKE 'pkg1%') SELECT (SELECT count(*) FROM steps) + (SELECT count(*) FROM ch) AS packages_changed, (SELECT count(*) FROM tree_current c JOIN tree_target t USING (package) WHERE c.version <> t.version AND c.package NOT IN (SELECT package FROM steps)) + (SELECT count(*) FROM ch) AS transitive_packages_touched")
def plan_surface(spark, sf):
    cur, tgt = view(spark, sf, "tree_current"), view(spark, sf, "tree_target")
    chain = jn.tree_diff(cur, tgt).filter("change = 'bumped' and package like 'pkg1%'").select("package")
    return deps.test_surface(resolution_plan(spark, sf), chain, cur, tgt)


@query("minimum_safe_version", f"WITH {ctes('tree_current')} SELECT package, version AS minimum_safe FROM tree_current")
def minimum_safe(spark, sf):
    return view(spark, sf, "tree_current").select("package", deps.minimum_safe(F.col("version")).alias("minimum_safe"))


PLACES = "f AS (SELECT cve_id, file, min(line) AS line FROM refs GROUP BY cve_id, file)"


def places(spark, sf):
    return view(spark, sf, "refs").groupBy("cve_id", "file").agg(F.min("line").alias("line"))


@query("sarif_rows", f"{SCORED}, {ctes('refs')}, places AS (SELECT cve_id, file, min(line) AS line FROM refs GROUP BY cve_id, file) SELECT s.cve_id AS rule_id, CASE recommendation WHEN 'BLOCK' THEN 'error' WHEN 'REVIEW' THEN 'warning' ELSE 'note' END AS level, coalesce(p.file, 'requirements.txt') AS uri, greatest(1, coalesce(p.line, 1))::INT AS start_line FROM s LEFT JOIN places p USING (cve_id)")
def sarif(spark, sf):
    return exports.sarif_rows(scored(spark, sf), places(spark, sf))


@query("sarif_results", f"{SCORED}, {ctes('refs')}, places AS (SELECT cve_id, file, min(line) AS line FROM refs GROUP BY cve_id, file), res AS (SELECT s.cve_id AS rule_id, CASE recommendation WHEN 'BLOCK' THEN 'error' WHEN 'REVIEW' THEN 'warning' ELSE 'note' END AS level, coalesce(p.file, 'requirements.txt') AS uri, greatest(1, coalesce(p.line, 1))::INT AS start_line FROM s LEFT JOIN places p USING (cve_id)) SELECT rule_id, to_json(struct_pack(ruleId := rule_id, level := level, locations := list_sort(list(DISTINCT struct_pack(uri := uri, region := struct_pack(startLine := start_line))))))::VARCHAR AS result FROM res GROUP BY rule_id, level")
def sarif_results(spark, sf):
    return exports.sarif_results(scored(spark, sf), places(spark, sf))


VEX = f"{SCORED}, vex AS (SELECT cve_id, package, CASE reachability_kind WHEN 'direct' THEN 'affected' WHEN 'none' THEN 'not_affected' ELSE 'under_investigation' END AS status, concat('pkg:pypi/', lower(trim(package))) AS product FROM s)"


@query("vex_rows", f"{VEX} SELECT * FROM vex")
def vex(spark, sf):
    return exports.vex_rows(scored(spark, sf))


@query("vex_document_id", f"{VEX}, l AS (SELECT substr(sha256(cve_id), 1, 3) AS part, sha256(concat_ws('|', cve_id, product, status)) AS h FROM vex), g AS (SELECT part, sha256(array_to_string(list_sort(list(h)), '')) AS h FROM l GROUP BY part) SELECT substr(sha256(array_to_string(list_sort(list(concat(part, h))), '')), 1, 16) AS document_id FROM g")
def vex_id(spark, sf):
    return exports.vex_document_id(exports.vex_rows(scored(spark, sf)))


@query("cyclonedx_components", f"WITH {ctes('findings')} SELECT DISTINCT package AS name, 'library' AS type, concat('pkg:pypi/', lower(trim(package))) AS purl FROM findings")
def components(spark, sf):
    return exports.components(view(spark, sf, "findings"))


@query("cyclonedx_ratings", f"{SCORED} SELECT cve_id AS id, cvss_score AS score, lower(severity) AS severity, CASE reachability_kind WHEN 'direct' THEN 'exploitable' WHEN 'none' THEN 'not_affected' ELSE 'in_triage' END AS analysis_state FROM s")
def ratings(spark, sf):
    return exports.ratings(scored(spark, sf))


#: In SQL that Spark and DuckDB read alike.
SERVICES = "SELECT s_suppkey AS id, concat('svc', CAST(CAST(floor(s_suppkey / 3e0) AS BIGINT) AS STRING)) AS name, s_suppkey AS seq FROM {supplier}"
EXPOSES = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_orderkey AS seq FROM {lineitem} WHERE l_suppkey % 4 <> 2"
VULNERABLE = "SELECT concat('CVE-', CAST(p_partkey % 100 AS STRING)) AS cve_id, p_partkey AS id FROM {part} WHERE p_partkey % 5 = 0"


@query("dependency_chain", f"""WITH RECURSIVE {ctes("calls")}, sv AS ({SERVICES}), ex AS ({EXPOSES}), vu AS ({VULNERABLE}), one AS (SELECT src, arg_min(dst, (seq, dst)) AS entry FROM ex GROUP BY src),
  en AS (SELECT name, arg_max(entry, seq) AS entry FROM sv JOIN one ON one.src = sv.id GROUP BY name), e AS (SELECT DISTINCT src, dst FROM calls),
  b(start, node, depth, path) AS (SELECT DISTINCT entry, entry, 0, [entry::VARCHAR] FROM en UNION ALL SELECT b.start, e.dst, b.depth + 1, list_append(b.path, e.dst::VARCHAR) FROM b JOIN e ON e.src = b.node WHERE NOT list_contains(b.path, e.dst::VARCHAR)),
  m AS (SELECT start, node, path, row_number() OVER (PARTITION BY start, node ORDER BY depth, path) AS rn FROM b)
  SELECT DISTINCT en.name AS service, vu.cve_id, (len(m.path) - 1)::INT AS hops, array_to_string(m.path, '>') AS path FROM en JOIN m ON m.start = en.entry AND m.rn = 1 JOIN vu ON vu.id = m.node""".replace("{supplier}", "supplier").replace("{lineitem}", "lineitem").replace("{part}", "part"))
def chain(spark, sf):
    table = lambda q, t: spark.sql(q, **{t: view(spark, sf, t)})
    found = graph.dependency_chain(table(SERVICES, "supplier"), table(EXPOSES, "lineitem"), table(VULNERABLE, "part"), view(spark, sf, "calls"))
    return found.withColumn("path", F.array_join("path", ">"))


OUTSIDE = "SELECT concat('m.f', CAST(src AS STRING)) AS src, concat('m.f', CAST(dst AS STRING)) AS dst FROM {calls} UNION ALL SELECT concat('m.f', CAST(p_partkey AS STRING)), concat('ext::lib.mod', CAST(p_partkey % 3 AS STRING), '.fn', CAST(p_partkey % 5 AS STRING)) FROM {part} WHERE p_partkey % 4 = 1"
SYMBOLS = ("fn0", "mod1.fn2", "pkg.lib.mod2.fn3", "lib.mod0.fn4", "d2.fn3")


@query("sink_suffix_paths", f"""WITH RECURSIVE {ctes("calls")}, e AS (SELECT DISTINCT * FROM ({OUTSIDE.replace("{calls}", "calls").replace("{part}", "part")})), t AS (SELECT unnest({list(SYMBOLS)}) AS symbol),
  b(start, node, path) AS (SELECT concat('m.f', p_partkey), concat('m.f', p_partkey), [concat('m.f', p_partkey)] FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT b.start, e.dst, list_append(b.path, e.dst) FROM b JOIN e ON e.src = b.node WHERE len(b.path) <= 26 AND NOT list_contains(b.path, e.dst)),
  m AS (SELECT b.start, t.symbol, b.path, row_number() OVER (PARTITION BY b.start, t.symbol ORDER BY len(b.path), b.path) AS rn FROM b JOIN t ON b.node LIKE 'ext::%' AND (substr(b.node, 6) = t.symbol OR ends_with(substr(b.node, 6), '.' || t.symbol) OR ends_with(t.symbol, '.' || substr(b.node, 6))))
  SELECT start, symbol, (len(path) - 1)::INT AS hops, array_to_string(path, '>') AS path FROM m WHERE rn = 1""")
def sink_paths(spark, sf):
    edges = spark.sql(OUTSIDE, calls=view(spark, sf, "calls"), part=view(spark, sf, "part"))
    symbols = spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")
    found = graph.paths_to_symbols(edges, starts(spark, sf).select(F.concat(F.lit("m.f"), "id").alias("id")), symbols)
    return found.withColumn("path", F.array_join("path", ">"))


@query("centrality_upsert", f"{RANKS}, z AS (SELECT id AS cve_id, round(r, 8) AS centrality FROM r WHERE id LIKE 'CVE-%'), b AS (SELECT cve_id, count(DISTINCT service) AS impacted FROM exposed WHERE service < 'svc-5' GROUP BY 1) SELECT coalesce(z.cve_id, b.cve_id) AS cve_id, coalesce(impacted, 0) AS impacted, coalesce(centrality, 0e0) AS centrality FROM b FULL JOIN z ON z.cve_id = b.cve_id")
def centrality_upsert(spark, sf):
    held = exposed(spark, sf)
    r = ranks(held).filter("id like 'CVE-%'").select(F.col("id").alias("cve_id"), F.round("rank", 8).alias("centrality"))
    b = held.filter("service < 'svc-5'").groupBy("cve_id").agg(F.count_distinct("service").alias("impacted"))
    return b.join(r, "cve_id", "full").select("cve_id", F.coalesce("impacted", F.lit(0)).alias("impacted"), F.coalesce("centrality", F.lit(0.0)).alias("centrality"))


@query("graph_vertices", f"WITH {ctes('findings', 'exposed')} SELECT DISTINCT concat('pkg:', package, '@', installed_version) AS id, 'package' AS label FROM findings UNION ALL SELECT DISTINCT concat('cve:', cve_id), 'cve' FROM findings UNION ALL SELECT DISTINCT concat('svc:', service), 'service' FROM exposed")
def vertices(spark, sf):
    f, e = view(spark, sf, "findings"), view(spark, sf, "exposed")
    part = lambda df, c, label: df.select(c.alias("id"), F.lit(label).alias("label")).distinct()
    return part(f, F.concat(F.lit("pkg:"), "package", F.lit("@"), "installed_version"), "package").union(part(f, F.concat(F.lit("cve:"), "cve_id"), "cve")).union(part(e, F.concat(F.lit("svc:"), "service"), "service"))


@query("reference_graph", f"WITH {ctes('refs')} SELECT concat('entry:', file) AS src, concat('fn:', fqn) AS dst, count(*) AS n FROM refs WHERE in_entry_point GROUP BY ALL UNION ALL SELECT concat('fn:', fqn), concat('cve:', cve_id), count(*) FROM refs GROUP BY ALL")
def reference_graph(spark, sf):
    r = view(spark, sf, "refs")
    a = r.filter("in_entry_point").groupBy(F.concat(F.lit("entry:"), "file").alias("src"), F.concat(F.lit("fn:"), "fqn").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(r.groupBy(F.concat(F.lit("fn:"), "fqn").alias("src"), F.concat(F.lit("cve:"), "cve_id").alias("dst")).agg(F.count(F.lit(1)).alias("n")))


@query("visual_graph", f"WITH {ctes('exposed')}, n AS (SELECT cve_id AS id FROM exposed GROUP BY cve_id ORDER BY count(*) DESC, cve_id LIMIT 24), v AS (SELECT service AS id FROM exposed GROUP BY service ORDER BY count(*) DESC, service LIMIT 12) SELECT cve_id AS src, service AS dst FROM exposed WHERE cve_id IN (SELECT id FROM n) AND service IN (SELECT id FROM v) ORDER BY 1, 2 LIMIT 160")
def visual(spark, sf):
    e = view(spark, sf, "exposed")
    top = lambda c, k: e.groupBy(F.col(c).alias("id")).count().orderBy(F.desc("count"), "id").limit(k).select("id")
    nodes = top("cve_id", 24).union(top("service", 12))
    return jn.both_ends(e.select(F.col("cve_id").alias("src"), F.col("service").alias("dst")), nodes).select("src", "dst").orderBy("src", "dst").limit(160)


@query("change_entry_blocks", f"WITH {ctes('symbols', 'refs')}, r AS (SELECT cve_id, count(*) AS n_blocks FROM refs GROUP BY 1), s AS (SELECT cve_id, count(*) FILTER (change_type = 'SIGNATURE_CHANGED') AS n_signatures, array_to_string(list_sort(list(DISTINCT change_type)), ',') AS kinds FROM symbols GROUP BY 1) SELECT s.*, coalesce(n_blocks, 0) AS n_blocks FROM s LEFT JOIN r USING (cve_id)")
def change_entries(spark, sf):
    s = view(spark, sf, "symbols").groupBy("cve_id").agg(F.expr("count_if(change_type = 'SIGNATURE_CHANGED')").alias("n_signatures"), F.array_join(F.array_sort(F.collect_set("change_type")), ",").alias("kinds"))
    r = view(spark, sf, "refs").groupBy("cve_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return s.join(r, "cve_id", "left").select("cve_id", "n_signatures", "kinds", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


@query("pipeline_coverage", f"WITH {ctes('findings', 'reach', 'exposed', 'kev')} SELECT 'findings' AS phase, (SELECT count(*) FROM findings) > 0 AS done UNION ALL SELECT 'reachability', (SELECT count(*) FROM reach) > 0 UNION ALL SELECT 'blast', (SELECT count(*) FROM exposed) > 0 UNION ALL SELECT 'kev', (SELECT count(*) FROM kev) > 0")
def coverage(spark, sf):
    out = None
    for name, phase in (("findings", "findings"), ("reach", "reachability"), ("exposed", "blast"), ("kev", "kev")):
        one = view(spark, sf, name).limit(1).agg((F.count(F.lit(1)) > 0).alias("done")).select(F.lit(phase).alias("phase"), "done")
        out = one if out is None else out.unionByName(one)
    return out


@query("evidence_sources", f"{SCORED} SELECT cve_id, concat_ws(',', CASE WHEN epss > 0 THEN 'EPSS' END, CASE WHEN in_kev THEN 'KEV' END, CASE WHEN reachability_kind = 'direct' THEN 'call graph' END, CASE WHEN impacted_services > 0 THEN 'blast' END) AS sources FROM s")
def sources(spark, sf):
    c = F.col
    return scored(spark, sf).select("cve_id", F.concat_ws(",", F.when(c("epss") > 0, "EPSS"), F.when(c("in_kev"), "KEV"), F.when(c("reachability_kind") == "direct", "call graph"), F.when(c("impacted_services") > 0, "blast")).alias("sources"))


@query("version_jump_card", f"WITH {ctes('findings')} SELECT package, arg_min(installed_version, row_id) AS current, coalesce(arg_min(trim(string_split(fixed_version, ',')[1]), row_id) FILTER (fixed_version <> ''), 'unknown') AS target FROM findings GROUP BY package")
def jump_card(spark, sf):
    fixed = F.when(F.col("fixed_version") != "", F.trim(F.split("fixed_version", ",")[0]))
    return view(spark, sf, "findings").groupBy("package").agg(F.min_by("installed_version", "row_id").alias("current"), F.coalesce(F.min_by(fixed, F.when(fixed.isNotNull(), F.col("row_id"))), F.lit("unknown")).alias("target"))
