"""Queries of the joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import joins as jn
from riskloom.plans.analogs import ctes, view
from riskloom.plans.scores import CLUSTERED, clustered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("tree_diff_full_outer", f"""WITH {ctes("tree_current", "tree_target")} SELECT * FROM (SELECT coalesce(c.package, t.package) AS package, c.version AS from_version, t.version AS to_version,
  CASE WHEN c.package IS NULL THEN 'added' WHEN t.package IS NULL THEN 'removed' WHEN c.version <> t.version THEN 'bumped' END AS change FROM tree_current c FULL JOIN tree_target t ON c.package = t.package) WHERE change IS NOT NULL""")
def tree_diff(spark, sf):
    return jn.tree_diff(view(spark, sf, "tree_current"), view(spark, sf, "tree_target"))


@query("tree_diff_counts", f"""WITH {ctes("tree_current", "tree_target")} SELECT change, count(*) AS n FROM (SELECT
  CASE WHEN c.package IS NULL THEN 'added' WHEN t.package IS NULL THEN 'removed' WHEN c.version <> t.version THEN 'bumped' END AS change FROM tree_current c FULL JOIN tree_target t ON c.package = t.package) WHERE change IS NOT NULL GROUP BY 1""")
def tree_diff_counts(spark, sf):
    return jn.tree_diff(view(spark, sf, "tree_current"), view(spark, sf, "tree_target")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("change_analysis_full_outer", f"""WITH {ctes("symbols", "refs")}, s AS (SELECT upper(cve_id) AS cve, count(*) AS n FROM symbols GROUP BY 1), r AS (SELECT upper(cve_id) AS cve, count(*) AS n FROM refs GROUP BY 1)
  SELECT coalesce(s.cve, r.cve) AS cve, coalesce(s.n, 0) AS n_symbols, coalesce(r.n, 0) AS n_refs FROM s FULL JOIN r ON s.cve = r.cve""")
def change_analysis(spark, sf):
    return jn.changes_by_cve(view(spark, sf, "symbols"), view(spark, sf, "refs"))


@query("change_analysis_totals", f"""WITH {ctes("symbols", "refs")}, s AS (SELECT upper(cve_id) AS cve, count(*) AS n FROM symbols GROUP BY 1), r AS (SELECT upper(cve_id) AS cve, count(*) AS n FROM refs GROUP BY 1)
  SELECT count(*) AS n_cves, sum(coalesce(s.n, 0))::BIGINT AS n_symbols, sum(coalesce(r.n, 0))::BIGINT AS n_refs FROM s FULL JOIN r ON s.cve = r.cve""")
def change_totals(spark, sf):
    return jn.changes_by_cve(view(spark, sf, "symbols"), view(spark, sf, "refs")).agg(F.count(F.lit(1)).alias("n_cves"), F.sum("n_symbols").alias("n_symbols"), F.sum("n_refs").alias("n_refs"))


RANGES = "SELECT p_partkey AS range_id, p_partkey % 40 AS k, CAST(p_size * 3 AS BIGINT) AS low, CAST(p_size * 3 + p_partkey % 37 AS BIGINT) AS high FROM {part}"
POINTS = "SELECT event_id AS hit_id, event_id % 40 AS k, CAST(event_id % 190 AS BIGINT) AS line FROM {events}"


@query("innermost_range_join", f"""WITH g AS ({RANGES.replace("{part}", "part")}), p AS ({POINTS.replace("{events}", "events")})
  SELECT p.hit_id, coalesce(r.range_id, -1) AS range_id FROM p LEFT JOIN (SELECT hit_id, range_id FROM (SELECT p.hit_id, g.range_id, row_number() OVER (PARTITION BY p.hit_id ORDER BY g.low DESC, g.range_id) AS rn
  FROM p JOIN g ON p.k = g.k AND p.line BETWEEN g.low AND g.high) WHERE rn = 1) r ON r.hit_id = p.hit_id""")
def innermost(spark, sf):
    found = jn.innermost(spark.sql(POINTS, events=view(spark, sf, "events")), spark.sql(RANGES, part=view(spark, sf, "part")), "k", "line", "hit_id")
    return found.select("hit_id", F.coalesce("range_id", F.lit(-1)).alias("range_id"))


@query("function_to_cve_edges", f"""WITH g AS ({RANGES.replace("{part}", "part")}), p AS ({POINTS.replace("{events}", "events")}),
  i AS (SELECT hit_id, range_id FROM (SELECT p.hit_id, g.range_id, row_number() OVER (PARTITION BY p.hit_id ORDER BY g.low DESC, g.range_id) AS rn FROM p JOIN g ON p.k = g.k AND p.line BETWEEN g.low AND g.high) WHERE rn = 1)
  SELECT DISTINCT concat('fn:', coalesce(range_id::VARCHAR, concat('<module>.line_', p.line))) AS fn, concat('CVE-', p.hit_id % 300) AS cve_id FROM p LEFT JOIN i USING (hit_id)""")
def function_edges(spark, sf):
    points = spark.sql(POINTS, events=view(spark, sf, "events"))
    found = jn.innermost(points, spark.sql(RANGES, part=view(spark, sf, "part")), "k", "line", "hit_id").join(points, "hit_id")
    fn = F.concat(F.lit("fn:"), F.coalesce(F.col("range_id").cast("string"), F.concat(F.lit("<module>.line_"), F.col("line").cast("string"))))
    return found.select(fn.alias("fn"), F.concat(F.lit("CVE-"), (F.col("hit_id") % 300).cast("string")).alias("cve_id")).distinct()


@query("snapshot_as_of", """WITH r AS (SELECT event_id, user_id, ts AS asked_at FROM events WHERE event_id % 2 = 0), s AS (SELECT user_id, ts AS fetched_at, max(concat('v', event_id)) AS snapshot FROM events WHERE event_id % 2 = 1 AND user_id % 5 > 0 GROUP BY 1, 2)
  SELECT event_id, r.user_id, asked_at, fetched_at, snapshot, CASE WHEN fetched_at IS NULL THEN 'missing' WHEN asked_at - fetched_at < INTERVAL 6 HOUR THEN 'fresh' ELSE 'stale' END AS state FROM r ASOF LEFT JOIN s ON r.user_id = s.user_id AND r.asked_at >= s.fetched_at""")
def snapshot_as_of(spark, sf):
    events = view(spark, sf, "events")
    requests = events.filter("event_id % 2 = 0").select("event_id", "user_id", F.col("ts").alias("asked_at"))
    snapshots = events.filter("event_id % 2 = 1 and user_id % 5 > 0").select("user_id", F.col("ts").alias("fetched_at"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("snapshot"))
    return jn.as_of(requests, snapshots, "user_id", 6 * 3600)


@query("suffix_theta_join", f"""WITH {ctes("symbols", "refs")}, h AS (SELECT seq AS hit_id, CASE WHEN l % 3 = 0 THEN concat('brand', l % 25, '.mod', l % 12, '.fn', l % 31) ELSE fqn END AS fqn FROM (SELECT *, substr(cve_id, 5)::BIGINT AS l FROM refs)),
  e AS (SELECT DISTINCT hit_id, s.cve_id AS s_cve, 'exact' AS how FROM h JOIN symbols s ON s.fqn = h.fqn)
  SELECT * FROM e UNION ALL SELECT DISTINCT hit_id, s.cve_id, 'short' FROM h JOIN symbols s ON s.short_name = string_split(h.fqn, '.')[-1] WHERE contains(h.fqn, '.') AND h.fqn NOT IN (SELECT fqn FROM symbols)""")
def suffix_join(spark, sf):
    l = F.substring("cve_id", 5, 20).cast("bigint")  # noqa: E741
    fqn = F.when(l % 3 == 0, F.concat(F.lit("brand"), (l % 25).cast("string"), F.lit(".mod"), (l % 12).cast("string"), F.lit(".fn"), (l % 31).cast("string"))).otherwise(F.col("fqn"))
    return jn.match_symbols(view(spark, sf, "refs").select(F.col("seq").alias("hit_id"), fqn.alias("fqn")), view(spark, sf, "symbols"))




def _evidence(spark, sf, source: str, where: str) -> DataFrame:
    return view(spark, sf, "reach").filter(where).select("cve_id", "service", "vuln_fn", "file", "hops", "confidence", "tainted", "seq", F.lit(source).alias("source"))




@query("evidence_anti_merge", f"""WITH {ctes("reach")}, g AS (SELECT cve_id, count(*) AS n FROM reach WHERE hops <= 2 GROUP BY 1), s AS (SELECT DISTINCT cve_id FROM reach WHERE hops > 2)
  SELECT cve_id, n, 'graph' AS source FROM g UNION ALL SELECT cve_id, 1, 'symbol' FROM s WHERE cve_id NOT IN (SELECT cve_id FROM g)""")
def evidence_merge(spark, sf):
    merged = jn.merge_evidence(_evidence(spark, sf, "graph", "hops <= 2"), _evidence(spark, sf, "symbol", "hops > 2"))
    return merged.groupBy("cve_id", "source").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_enrich_replace", f"""WITH {ctes("reach")}, c AS (SELECT DISTINCT cve_id, service, vuln_fn, file FROM reach WHERE tainted), g AS (SELECT DISTINCT cve_id, service, vuln_fn, file FROM reach)
  SELECT cve_id, service, vuln_fn, file, 'call_graph' AS source FROM c UNION ALL SELECT *, 'graph' FROM g WHERE cve_id NOT IN (SELECT cve_id FROM c)""")
def evidence_enrich(spark, sf):
    return jn.enrich(_evidence(spark, sf, "graph", "true"), _evidence(spark, sf, "call_graph", "tainted")).select("cve_id", "service", "vuln_fn", "file", "source")


@query("evidence_group_index", f"WITH {ctes('reach')} SELECT cve_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT service)), ',') AS services, min(hops) AS min_hops FROM reach GROUP BY cve_id")
def evidence_index(spark, sf):
    return view(spark, sf, "reach").groupBy("cve_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"), F.min("hops").alias("min_hops"))


@query("best_rule_per_family", f"""{CLUSTERED}, {ctes("rules")}, w AS (SELECT DISTINCT family, cwe FROM c)
  SELECT family, rule_id FROM (SELECT family, rule_id, row_number() OVER (PARTITION BY family ORDER BY CASE r.severity WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END DESC, r.row_id) AS rn
  FROM w JOIN rules r ON r.cwe = w.cwe WHERE r.language IN ('python', 'generic')) WHERE rn = 1""")
def best_rule(spark, sf):
    return jn.best_rule(clustered(spark, sf).select("family", "cwe").distinct(), view(spark, sf, "rules"), "python")


@query("family_rule_matches", f"""{CLUSTERED}, {ctes("rules", "refs")}, w AS (SELECT family, count(*) AS n FROM c GROUP BY 1), m AS (SELECT c.family, count(DISTINCT r.seq) AS hits FROM (SELECT DISTINCT family, cve_id FROM c) c JOIN refs r ON r.cve_id = c.cve_id GROUP BY 1)
  SELECT w.family, w.n, coalesce(m.hits, 0) AS hits, coalesce(m.hits, 0) > 0 AS ready FROM w LEFT JOIN m USING (family)""")
def family_matches(spark, sf):
    c = clustered(spark, sf)
    hits = c.select("family", "cve_id").distinct().join(view(spark, sf, "refs"), "cve_id").groupBy("family").agg(F.count_distinct("seq").alias("hits"))
    return c.groupBy("family").agg(F.count(F.lit(1)).alias("n")).join(hits, "family", "left").select("family", "n", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) > 0).alias("ready"))


@query("depends_on_cross_join", "WITH p AS (SELECT DISTINCT p_brand AS package FROM part) SELECT a.package AS src, b.package AS dst FROM p a CROSS JOIN p b")
def depends_on(spark, sf):
    # both sides are the brands, a fixed set of 25: the product is the operator's meaning
    brands = view(spark, sf, "part").select("p_brand").distinct()
    return brands.select(F.col("p_brand").alias("src")).crossJoin(brands.select(F.col("p_brand").alias("dst")))


OLD = "SELECT p_partkey AS k, concat(p_brand, '.f', CAST(p_partkey % 700 AS STRING)) AS symbol, concat('a,b', CAST(p_partkey % 3 AS STRING)) AS signature FROM {part} WHERE p_partkey % 3 <> 0"
NEW = "SELECT p_partkey AS k, concat(p_brand, '.f', CAST(p_partkey % 700 AS STRING)) AS symbol, concat('a,b', CAST(p_partkey % 2 AS STRING)) AS signature FROM {part} WHERE p_partkey % 4 <> 0"


@query("api_diff", f"""WITH o0 AS ({OLD.replace("{part}", "part")}), n0 AS ({NEW.replace("{part}", "part")}), o AS (SELECT symbol, arg_min(signature, k) AS s FROM o0 GROUP BY 1), n AS (SELECT symbol, arg_min(signature, k) AS s FROM n0 GROUP BY 1)
  SELECT coalesce(o.symbol, n.symbol) AS symbol, CASE WHEN n.symbol IS NULL THEN 'removed' WHEN o.symbol IS NULL THEN 'added' ELSE 'signature_changed' END AS change FROM o FULL JOIN n ON o.symbol = n.symbol WHERE o.s IS NULL OR n.s IS NULL OR o.s <> n.s""")
def api_diff(spark, sf):
    part = view(spark, sf, "part")
    one = lambda q: spark.sql(q, part=part).groupBy("symbol").agg(F.min_by("signature", "k").alias("signature"))
    return jn.api_changes(one(OLD), one(NEW))


OLD_SIG = "named_struct('args', array('self', concat('a', p_partkey % 3), 'b'), 'kwonly', array(concat('k', p_partkey % 2)), 'has_kwargs', p_partkey % 5 = 0)"
NEW_SIG = "named_struct('args', array('self', concat('a', p_partkey % 2), 'b'), 'kwonly', array(concat('k', p_partkey % 3)), 'pos_defaults', if(p_partkey % 4 = 0, array('a0', 'a1'), array('b')), 'kw_defaults', if(p_partkey % 6 = 0, array('k0', 'k1', 'k2'), array('x')), 'has_varargs', p_partkey % 7 = 0, 'has_kwargs', p_partkey % 11 = 0)"


@query("signature_compare", """WITH s AS (SELECT p_partkey AS id, ['self', concat('a', p_partkey % 3), 'b'] AS oa, [concat('k', p_partkey % 2)] AS ok, p_partkey % 5 = 0 AS ow, ['self', concat('a', p_partkey % 2), 'b'] AS na, [concat('k', p_partkey % 3)] AS nk,
    CASE WHEN p_partkey % 4 = 0 THEN ['a0', 'a1'] ELSE ['b'] END AS pd, CASE WHEN p_partkey % 6 = 0 THEN ['k0', 'k1', 'k2'] ELSE ['x'] END AS kd, p_partkey % 7 = 0 AS nv, p_partkey % 11 = 0 AS nw FROM part),
  d AS (SELECT id, ow AND NOT nw AS lost, CASE WHEN nv OR nw THEN [] ELSE list_filter(oa, lambda x: NOT list_contains(na, x)) END AS g, CASE WHEN nw THEN [] ELSE list_filter(ok, lambda x: NOT list_contains(nk, x)) END AS gk,
    list_filter(na, lambda x: NOT list_contains(oa, x) AND NOT list_contains(ok, x) AND x NOT IN ('self', 'cls') AND NOT list_contains(pd, x)) AS c, list_filter(nk, lambda x: NOT list_contains(oa, x) AND NOT list_contains(ok, x) AND NOT list_contains(kd, x)) AS ck FROM s)
  SELECT id, concat_ws('; ', CASE WHEN len(g) > 0 THEN 'Removed positional arguments: ' || array_to_string(g, ', ') END, CASE WHEN len(gk) > 0 THEN 'Removed keyword arguments: ' || array_to_string(gk, ', ') END,
    CASE WHEN len(c) > 0 THEN 'Added required positional arguments: ' || array_to_string(c, ', ') END, CASE WHEN len(ck) > 0 THEN 'Added required keyword arguments: ' || array_to_string(ck, ', ') END,
    CASE WHEN lost THEN 'Removed variable keyword arguments (**kwargs)' END) AS difference FROM d""")
def signature_compare(spark, sf):
    p = view(spark, sf, "part").selectExpr("p_partkey as id", f"{OLD_SIG} as o", f"{NEW_SIG} as n")
    return p.select("id", jn.compare_signatures(F.col("o"), F.col("n")).alias("difference"))


@query("signature_render", "SELECT p_partkey AS id, replace(concat_ws(', ', concat('args: [~self~, ~a', p_partkey % 2, '~, ~b~]'), concat('kwonly: [~k', p_partkey % 3, '~]'), CASE WHEN p_partkey % 7 = 0 THEN '*args' END, CASE WHEN p_partkey % 11 = 0 THEN '**kwargs' END), '~', chr(39)) AS text FROM part")
def signature_render(spark, sf):
    return view(spark, sf, "part").selectExpr("p_partkey as id", f"{NEW_SIG} as n").select("id", jn.render_signature(F.col("n")).alias("text"))


@query("requirement_rewrite", """WITH l AS (SELECT p_partkey AS line_no, CASE p_partkey % 6 WHEN 0 THEN '# comment' ELSE concat('Pkg_', p_partkey % 40, '==1.', p_partkey % 9) END AS line FROM part), s AS (SELECT DISTINCT concat('pkg-', p_partkey % 20) AS package, concat('2.', p_partkey % 20) AS to_version FROM part)
  SELECT l.line_no, CASE WHEN s.package IS NULL THEN l.line ELSE concat(regexp_extract(l.line, '^([A-Za-z0-9._-]+)', 1), '==', s.to_version) END AS line FROM l LEFT JOIN s ON s.package = lower(regexp_replace(regexp_extract(l.line, '^([A-Za-z0-9._-]+)', 1), '[-_.]+', '-', 'g'))""")
def requirement_rewrite(spark, sf):
    part = view(spark, sf, "part")
    lines = part.selectExpr("p_partkey as line_no", "if(p_partkey % 6 = 0, '# comment', concat('Pkg_', p_partkey % 40, '==1.', p_partkey % 9)) as line")
    return jn.rewrite_lines(lines, part.selectExpr("concat('pkg-', p_partkey % 20) as package", "concat('2.', p_partkey % 20) as to_version").distinct())


@query("advisory_join", f"""WITH {ctes("tree_target", "tree_current")}, a AS (SELECT DISTINCT concat('GHSA-', p_partkey % 500) AS advisory, concat('pkg', p_partkey) AS package, concat(p_partkey % 7 + 1, '.', p_partkey % 10) AS version FROM part)
  SELECT advisory, min(package) AS package, min(version) AS version FROM tree_target JOIN a USING (package, version) WHERE package IN (SELECT package FROM tree_current) GROUP BY advisory""")
def advisory_join(spark, sf):
    a = view(spark, sf, "part").selectExpr("concat('GHSA-', p_partkey % 500) as advisory", "concat('pkg', p_partkey) as package", "concat(p_partkey % 7 + 1, '.', p_partkey % 10) as version").distinct()
    return jn.advisories_of_tree(view(spark, sf, "tree_target"), a, view(spark, sf, "tree_current").select("package"))


@query("version_theta_join", f"""WITH {ctes("tree_target")}, a AS (SELECT concat('A', p_partkey) AS advisory, concat('pkg', p_partkey) AS package, p_partkey % 7 AS fixed FROM part)
  SELECT advisory, package FROM tree_target JOIN a USING (package) WHERE string_split(version, '.')[1]::INT >= fixed""")
def version_theta(spark, sf):
    a = view(spark, sf, "part").selectExpr("concat('A', p_partkey) as advisory", "concat('pkg', p_partkey) as package", "p_partkey % 7 as fixed")
    return view(spark, sf, "tree_target").join(a, "package").filter(F.split("version", r"\.")[0].cast("int") >= F.col("fixed")).select("advisory", "package")


@query("edge_double_semi_join", f"WITH {ctes('calls')} SELECT src, dst FROM calls WHERE src % 3 <> 0 AND dst % 5 <> 0 AND src IN (SELECT p_partkey FROM part WHERE p_size > 10) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def edge_semi(spark, sf):
    nodes = view(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"))
    return jn.both_ends(view(spark, sf, "calls").filter("src % 3 <> 0 and dst % 5 <> 0"), nodes).select("src", "dst")


@query("orphan_pruning", f"WITH {ctes('calls')}, n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'cve' ELSE 'fn' END AS kind FROM part), e AS (SELECT * FROM calls WHERE src % 7 = 1) SELECT id, kind FROM n WHERE kind = 'cve' OR id IN (SELECT src FROM e) OR id IN (SELECT dst FROM e)")
def orphans(spark, sf):
    nodes = view(spark, sf, "part").selectExpr("p_partkey as id", "if(p_partkey % 4 = 0, 'cve', 'fn') as kind")
    return jn.connected_or(nodes, view(spark, sf, "calls").filter("src % 7 = 1"), "cve")


@query("call_name_resolution", f"""WITH {ctes("refs")}, f AS (SELECT DISTINCT file, concat('m.fn', line % 31) AS name, min(seq) OVER (PARTITION BY file, line % 31) AS fn_id FROM refs)
  SELECT r.seq, f.fn_id FROM refs r JOIN f ON f.file = r.file AND f.name = r.fqn""")
def call_names(spark, sf):
    refs = view(spark, sf, "refs")
    fns = refs.groupBy("file", F.concat(F.lit("m.fn"), (F.col("line") % 31).cast("string")).alias("fqn")).agg(F.min("seq").alias("fn_id"))
    return refs.join(fns, ["file", "fqn"]).select("seq", "fn_id")


@query("blast_radius", f"""WITH {ctes("exposed", "reach")}, u AS (SELECT cve_id, service FROM exposed UNION ALL SELECT cve_id, service FROM reach) SELECT cve_id, count(DISTINCT service) AS impacted_services, array_to_string(list_sort(list(DISTINCT service)), ',') AS service_names FROM u GROUP BY cve_id""")
def blast_radius(spark, sf):
    u = view(spark, sf, "exposed").select("cve_id", "service").unionByName(view(spark, sf, "reach").select("cve_id", "service"))
    return u.groupBy("cve_id").agg(F.count_distinct("service").alias("impacted_services"), F.array_join(F.array_sort(F.collect_set("service")), ",").alias("service_names"))


@query("fixed_by_package", f"""WITH {ctes("findings")} SELECT lower(regexp_replace(package, '[#_.]+', '-', 'g')) AS package, array_to_string(list_sort(list(DISTINCT cve_id)), ',') AS cves FROM findings WHERE severity IN ('CRITICAL', 'HIGH') GROUP BY 1""")
def fixed_by_package(spark, sf):
    return view(spark, sf, "findings").filter("severity in ('CRITICAL', 'HIGH')").groupBy(F.lower(F.regexp_replace("package", "[#_.]+", "-")).alias("package")).agg(F.array_join(F.array_sort(F.collect_set("cve_id")), ",").alias("cves"))


@query("pin_relaxation_anti", f"""WITH {ctes("requires")}, up AS (SELECT DISTINCT package FROM requires WHERE row_id % 10 = 0), pins AS (SELECT DISTINCT package FROM requires) SELECT package FROM pins WHERE package NOT IN (SELECT dep FROM requires WHERE package IN (SELECT package FROM up) AND dep NOT IN (SELECT package FROM up))""")
def pin_relaxation(spark, sf):
    r = view(spark, sf, "requires")
    up = r.filter("row_id % 10 = 0").select("package").distinct()
    loose = r.join(up, "package", "left_semi").select(F.col("dep").alias("package")).join(up, "package", "left_anti")
    return r.select("package").distinct().join(loose, "package", "left_anti")


@query("usage_change_match", """WITH u AS (SELECT conv_id * 1000 + turn AS id, concat('requests.', CASE turn % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'sessions.Session' ELSE 'Session' END) AS used FROM conversations), c(symbol, change) AS (VALUES ('requests.get', 'signature_changed'), ('requests.Session', 'removed'))
  SELECT id, c.symbol, c.change FROM u JOIN c ON c.symbol = replace(u.used, 'sessions.Session', 'Session')""")
def usage_change(spark, sf):
    u = view(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn as id", "concat('requests.', element_at(array('get', 'sessions.Session', 'Session'), cast(turn % 3 as int) + 1)) as used")
    c = spark.sql("SELECT * FROM VALUES ('requests.get', 'signature_changed'), ('requests.Session', 'removed') AS c(symbol, change)")
    return u.join(c, F.replace("used", F.lit("sessions.Session"), F.lit("Session")) == F.col("symbol")).select("id", "symbol", "change")


@query("reachable_cve_table", f"""WITH {ctes("findings", "refs")}, f AS (SELECT cve_id, min(file) AS file, count(*) AS n FROM refs GROUP BY 1) SELECT x.cve_id, x.package, f.file, f.n FROM (SELECT DISTINCT cve_id, arg_min(package, row_id) AS package FROM findings GROUP BY cve_id) x LEFT JOIN f USING (cve_id) WHERE f.n IS NOT NULL ORDER BY f.n DESC, x.cve_id LIMIT 20""")
def reachable_table(spark, sf):
    f = view(spark, sf, "refs").groupBy("cve_id").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n"))
    return view(spark, sf, "findings").groupBy("cve_id").agg(F.min_by("package", "row_id").alias("package")).join(f, "cve_id").orderBy(F.desc("n"), "cve_id").limit(20)
