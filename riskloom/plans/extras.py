"""Queries of commit discovery, rule resolution, entity checks, specifier samples and report texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions import versions as ve
from riskloom.operators import commits as co
from riskloom.plans.analogs import CLAUSE, MEETS, ctes, numbers, view
from riskloom.plans.scores import CLUSTERED, SCORED, clustered, scored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("satisfied_versions_filter", f"""WITH {ctes("requires")}, s AS (SELECT row_id, {CLAUSE} FROM requires), c AS (SELECT s.*, unnest(['1.0', '2.0rc1', '2.0', '3.1', '10.2']) AS c FROM s), k AS (SELECT *, {numbers("c")} AS v FROM c)
  SELECT row_id, coalesce(string_agg(c, ',' ORDER BY v) FILTER ({MEETS}), '') AS versions FROM k GROUP BY row_id""")
def satisfied_sample(spark, sf):
    sample = F.array(*map(F.lit, ("1.0", "2.0rc1", "2.0", "3.1", "10.2")))
    return view(spark, sf, "requires").select("row_id", F.array_join(F.filter(sample, lambda v: ve.satisfies(v, F.col("spec"))), ",").alias("versions"))


@query("commit_reference_scan", "SELECT p_partkey AS cve, concat('https://github.com/o/r/commit/', substr(md5(p_partkey::VARCHAR), 1, 12)) AS url FROM part WHERE p_partkey % 2 = 0")
def commit_refs(spark, sf):
    rows = view(spark, sf, "part").selectExpr("p_partkey as cve_id", "array('https://example.com/x', if(p_partkey % 2 = 0, concat('https://github.com/o/r/commit/', substr(md5(cast(p_partkey as string)), 1, 12)), 'https://github.com/o/r')) as references")
    return co.of_references(rows).withColumnRenamed("cve_id", "cve")


@query("commit_range_synthesis", "SELECT p_partkey AS cve, concat('https://github.com/o/r/commit/', substr(md5(p_partkey::VARCHAR), 1, 40)) AS url FROM part WHERE p_partkey % 3 = 0")
def commit_ranges(spark, sf):
    rows = view(spark, sf, "part").selectExpr("p_partkey as cve_id", "'https://github.com/o/r.git' as repo", "array(named_struct('fixed', if(p_partkey % 3 = 0, md5(cast(p_partkey as string)), '1.2.3'))) as events")
    return co.of_ranges(rows).withColumnRenamed("cve_id", "cve")


@query("commit_discovery_ranked", f"WITH {ctes('findings')}, u AS (SELECT cve_id, concat('https://github.com/o/r/commit/', substr(md5((row_id % 40)::VARCHAR), 1, 12)) AS url, 0 AS rank FROM findings WHERE row_id % 2 = 0 UNION ALL SELECT cve_id, concat('https://github.com/o/r/commit/', substr(md5((row_id % 40)::VARCHAR), 1, 12)), 1 FROM findings) SELECT cve_id, url, min(rank) AS rank FROM u GROUP BY ALL")
def commit_discovery(spark, sf):
    u = view(spark, sf, "findings").selectExpr("cve_id", "concat('https://github.com/o/r/pull/7/commits/', substr(md5(cast(row_id % 40 as string)), 1, 12)) as url", "row_id")
    return co.discovered(u.filter("row_id % 2 = 0"), u)


@query("import_roots", "WITH p AS (SELECT DISTINCT p_brand AS package FROM part), k(dist, module) AS (VALUES ('brand#1', 'one'), ('brand#2', 'two')) SELECT package, coalesce(k.module, replace(lower(package), '-', '_')) AS module FROM p LEFT JOIN k ON k.dist = lower(package)")
def import_roots(spark, sf):
    known = spark.sql("SELECT * FROM VALUES ('brand#1', 'one'), ('brand#2', 'two') AS k(dist, module)")
    return co.import_roots(view(spark, sf, "part").select(F.col("p_brand").alias("package")).distinct(), known)


@query("entity_whitelist_anti", f"WITH {ctes('findings')} SELECT concat('CVE-', p_partkey) AS entity FROM part WHERE concat('CVE-', p_partkey) NOT IN (SELECT cve_id FROM findings)")
def entities(spark, sf):
    args = view(spark, sf, "part").select(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("entity"))
    return co.unknown_entities(args, view(spark, sf, "findings").select(F.col("cve_id").alias("entity")))


@query("rule_schema_predicate", "SELECT p_partkey AS id, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AS valid FROM part")
def rule_schema(spark, sf):
    rule = "named_struct('id', 'r', 'languages', if(p_partkey % 2 = 0, array('python'), cast(array() as array<string>)), 'severity', if(p_partkey % 3 = 0, 'HUGE', 'ERROR'), 'message', 'm', 'pattern', if(p_partkey % 5 = 0, null, 'f(...)'), 'patterns', cast(null as array<string>)) as rule"
    return view(spark, sf, "part").selectExpr("p_partkey as id", rule).select("id", co.valid_rule(F.col("rule")).alias("valid"))


@query("rule_resolution_chain", f"{CLUSTERED}, f AS (SELECT DISTINCT family FROM c), a AS (SELECT family, 'cached' AS rule_id FROM f WHERE length(family) % 2 = 0), r AS (SELECT family, 'known' AS rule_id FROM f WHERE length(family) % 3 = 0) SELECT f.family, coalesce(a.rule_id, r.rule_id, '') AS rule_id, CASE WHEN a.rule_id IS NOT NULL THEN 'cache' WHEN r.rule_id IS NOT NULL THEN 'registry' ELSE 'none' END AS source FROM f LEFT JOIN a USING (family) LEFT JOIN r USING (family)")
def rule_chain(spark, sf):
    f = clustered(spark, sf).select("family").distinct()
    return co.resolved_rules(f, f.filter("length(family) % 2 = 0").withColumn("rule_id", F.lit("cached")), f.filter("length(family) % 3 = 0").withColumn("rule_id", F.lit("known")))


@query("patch_rule_override", f"{CLUSTERED}, {ctes('symbols')}, f AS (SELECT DISTINCT family FROM c), p AS (SELECT family, array_to_string(list_sort(list(DISTINCT concat(s.fqn, '(...)'))), ',') AS patterns FROM c JOIN symbols s ON s.cve_id = c.cve_id WHERE s.change_type = 'REMOVED' AND s.seq % 3 = 0 GROUP BY family) SELECT f.family, CASE WHEN p.family IS NOT NULL THEN concat('symbol-', f.family, '-python') WHEN length(f.family) % 2 = 0 THEN 'cached' WHEN length(f.family) % 3 = 0 THEN 'known' ELSE '' END AS rule_id, CASE WHEN p.family IS NOT NULL THEN 'symbol' WHEN length(f.family) % 2 = 0 THEN 'cache' WHEN length(f.family) % 3 = 0 THEN 'registry' ELSE 'none' END AS source, coalesce(p.patterns, '') AS patterns FROM f LEFT JOIN p USING (family)")
def rule_override(spark, sf):
    known = view(spark, sf, "symbols").filter("change_type = 'REMOVED' and seq % 3 = 0").select("cve_id", F.concat("fqn", F.lit("(...)")).alias("pattern"))
    sinks = clustered(spark, sf).select("family", "cve_id").distinct().join(known, "cve_id").select("family", "pattern")
    return co.symbol_rules(rule_chain(spark, sf), sinks, "python").withColumn("patterns", F.array_join("patterns", ","))


@query("remediation_lookup", "WITH u AS (SELECT event_id AS usage_id, concat('s', event_id % 9) AS symbol FROM events), c AS (SELECT concat('s', p_partkey % 6) AS symbol, CASE WHEN p_partkey % 4 < 2 THEN 'removed' ELSE 'signature_changed' END AS change, p_partkey AS row_id FROM part), l AS (SELECT symbol, arg_max(change, row_id) AS change FROM c GROUP BY symbol) SELECT usage_id, CASE change WHEN 'removed' THEN concat('Replace ', u.symbol, ', which is gone.') WHEN 'signature_changed' THEN concat('Adjust the arguments of ', u.symbol, '.') ELSE 'No change is needed.' END AS advice FROM u LEFT JOIN l ON l.symbol = u.symbol")
def remediation(spark, sf):
    u = view(spark, sf, "events").selectExpr("event_id as usage_id", "concat('s', event_id % 9) as symbol")
    c = view(spark, sf, "part").selectExpr("concat('s', p_partkey % 6) as symbol", "if(p_partkey % 4 < 2, 'removed', 'signature_changed') as change", "p_partkey as row_id")
    return co.remediation(u, c)


@query("symbol_input_filter", f"WITH {ctes('symbols')}, p AS (SELECT cve_id, list(fqn) AS s FROM symbols GROUP BY cve_id) SELECT f.cve_id, coalesce(len(p.s), 0) AS n FROM (SELECT DISTINCT concat('CVE-', p_partkey) AS cve_id FROM part) f JOIN p ON p.cve_id = f.cve_id WHERE len(p.s) > 0")
def symbol_inputs(spark, sf):
    p = view(spark, sf, "symbols").groupBy("cve_id").agg(F.collect_list("fqn").alias("s")).filter("size(s) > 0")
    return p.select("cve_id", F.size("s").cast("bigint").alias("n"))


@query("symbol_pattern_map", f"WITH {ctes('symbols')} SELECT DISTINCT short_name, concat(short_name, '(...)') AS pattern FROM symbols")
def symbol_patterns(spark, sf):
    return view(spark, sf, "symbols").select("short_name", tx.alias_pattern(F.col("short_name")).alias("pattern")).distinct()


@query("default_headline", f"{SCORED} SELECT CASE WHEN count(*) FILTER (reachability_kind = 'direct') > 0 THEN concat(count(*) FILTER (reachability_kind = 'direct'), ' of ', count(*), ' CVEs are reachable in your application code.') WHEN count(*) > 0 THEN concat('Scanned ', count(*), ' dependency CVEs; none are directly referenced in application code.') ELSE 'No CVEs detected for this dependency upgrade.' END AS headline FROM s")
def headline(spark, sf):
    one = scored(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(reachability_kind = 'direct')").alias("r"))
    text = F.when(F.col("r") > 0, F.concat(F.col("r").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" CVEs are reachable in your application code."))).when(F.col("n") > 0, F.concat(F.lit("Scanned "), F.col("n").cast("string"), F.lit(" dependency CVEs; none are directly referenced in application code."))).otherwise("No CVEs detected for this dependency upgrade.")
    return one.select(text.alias("headline"))


@query("public_tree", f"WITH {ctes('tree_current', 'requires')} SELECT t.package, t.version, coalesce(string_agg(DISTINCT concat(r.dep, '=', r.spec), ',' ORDER BY concat(r.dep, '=', r.spec)) FILTER (r.dep IS NOT NULL), '') AS requires FROM tree_current t LEFT JOIN requires r ON r.package = t.package GROUP BY t.package, t.version")
def public_tree(spark, sf):
    r = view(spark, sf, "requires").groupBy("package").agg(F.array_join(F.array_sort(F.collect_set(F.concat("dep", F.lit("="), "spec"))), ",").alias("requires"))
    return view(spark, sf, "tree_current").join(r, "package", "left").select("package", "version", F.coalesce("requires", F.lit("")).alias("requires"))


@query("verdict_class", f"{SCORED} SELECT DISTINCT upper(recommendation) AS recommendation, CASE upper(recommendation) WHEN 'BLOCK' THEN 'block' WHEN 'REVIEW' THEN 'review' ELSE 'proceed' END AS class FROM s")
def verdict_class(spark, sf):
    r = F.upper("recommendation")
    return scored(spark, sf).select(r.alias("recommendation"), F.when(r == "BLOCK", "block").when(r == "REVIEW", "review").otherwise("proceed").alias("class")).distinct()


@query("next_action", f"WITH {ctes('requires')}, g AS (SELECT dep, count(DISTINCT package) AS n FROM requires GROUP BY dep ORDER BY n DESC, dep LIMIT 5) SELECT concat('Upgrade in order: ', string_agg(dep, ' -> ' ORDER BY n DESC, dep)) AS action FROM g")
def next_action(spark, sf):
    g = view(spark, sf, "requires").groupBy("dep").agg(F.count_distinct("package").alias("n")).orderBy(F.desc("n"), "dep").limit(5)
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "dep"))), lambda x: x["dep"])
    return g.agg(F.concat(F.lit("Upgrade in order: "), F.array_join(order, " -> ")).alias("action"))


@query("api_differences", f"WITH {ctes('symbols')} SELECT cve_id, fqn, change_type = 'SIGNATURE_CHANGED' AS signature_changed FROM symbols WHERE change_type NOT IN ('ADDED', 'REMOVED')")
def api_differences(spark, sf):
    return view(spark, sf, "symbols").filter("change_type not in ('ADDED', 'REMOVED')").select("cve_id", "fqn", (F.col("change_type") == "SIGNATURE_CHANGED").alias("signature_changed"))


@query("mitigations_capped", f"{SCORED} SELECT * FROM (SELECT 'Patch known exploited packages' AS mitigation, 1 AS place WHERE (SELECT count(*) FROM s WHERE in_kev) > 0 UNION ALL SELECT 'Limit network exposure', 2 UNION ALL SELECT 'Pin dependencies', 3 UNION ALL SELECT 'Monitor advisories', 4) ORDER BY place LIMIT 6")
def mitigations(spark, sf):
    some = scored(spark, sf).filter("in_kev").limit(1).select(F.lit("Patch known exploited packages").alias("mitigation"), F.lit(1).alias("place"))
    rest = spark.sql("SELECT * FROM VALUES ('Limit network exposure', 2), ('Pin dependencies', 3), ('Monitor advisories', 4) AS m(mitigation, place)")
    return some.unionByName(rest).orderBy("place").limit(6)


@query("candidate_versions_sorted", f"""WITH {ctes("requires")}, v AS (SELECT DISTINCT dep, unnest(regexp_extract_all(spec, '([0-9]+(?:\\.[0-9]+)*)', 1)) AS v FROM requires) SELECT dep, string_agg(v, ',' ORDER BY list_transform(string_split(v, '.'), lambda x: x::INT)) AS candidates FROM v GROUP BY dep""")
def candidates(spark, sf):
    v = view(spark, sf, "requires").select("dep", F.explode(tx.version_literals(F.col("spec"))).alias("v")).distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(ve.release_key(F.col("v")).alias("k"), "v"))), lambda x: x["v"])
    return v.groupBy("dep").agg(F.array_join(ordered, ",").alias("candidates"))
