"""Queries of aggregates and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import metrics as me
from riskloom.plans.analogs import ctes, view
from riskloom.plans.scores import SCORED, scored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


STRATEGIES = "SELECT *, unnest(['severity_only', 'epss_threshold', 'kev_only', 'reachability_aware']) AS strategy, unnest([n_chars > 2500, n_chars % 10 = 0, doc_id % 97 = 0, n_chars > 1500 AND doc_id % 3 <> 0]) AS y_pred FROM (SELECT doc_id, n_chars, y_true FROM cases)"
M = "count(*) FILTER (y_true AND y_pred) AS tp, count(*) FILTER (NOT y_true AND y_pred) AS fp, count(*) FILTER (NOT y_true AND NOT y_pred) AS tn, count(*) FILTER (y_true AND NOT y_pred) AS fn"
RATES = """round(CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END, 4) AS recall,
  round(CASE WHEN tp = 0 THEN 0e0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 4) AS f1, round(CASE WHEN fp + tn = 0 THEN 0e0 ELSE fp / (fp + tn) END, 4) AS fpr,
  round(CASE WHEN fn + tp = 0 THEN 0e0 ELSE fn / (fn + tp) END, 4) AS fnr, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy, round(CASE WHEN tn + fp = 0 THEN 0e0 ELSE tn / (tn + fp) END, 4) AS specificity"""


def strategies(spark, sf):
    c = view(spark, sf, "cases").select("doc_id", "n_chars", "y_true")
    return c.selectExpr("y_true", "stack(4, 'severity_only', n_chars > 2500, 'epss_threshold', n_chars % 10 = 0, 'kev_only', doc_id % 97 = 0, 'reachability_aware', n_chars > 1500 and doc_id % 3 <> 0) as (strategy, y_pred)")


@query("confusion_by_strategy", f"WITH {ctes('cases')}, s AS ({STRATEGIES}), m AS (SELECT strategy, {M} FROM s GROUP BY strategy) SELECT *, {RATES} FROM m")
def confusion_by_strategy(spark, sf):
    return me.rates(me.confusion(strategies(spark, sf), "strategy"))


@query("confusion_matrix", f"WITH {ctes('cases')} SELECT {M} FROM cases")
def confusion_matrix(spark, sf):
    return me.confusion(view(spark, sf, "cases"))


@query("strategy_noise_reduction", f"WITH {ctes('cases')}, s AS ({STRATEGIES}), a AS (SELECT strategy, count(*) FILTER (y_pred) AS alerts FROM s GROUP BY 1) SELECT strategy, alerts, round(100 * (1 - alerts / (SELECT alerts FROM a WHERE strategy = 'severity_only')), 4) AS noise_reduction FROM a")
def noise_reduction(spark, sf):
    a = strategies(spark, sf).groupBy("strategy").agg(F.expr("count_if(y_pred)").alias("alerts"))
    base = a.filter("strategy = 'severity_only'").select(F.col("alerts").alias("base"))
    return a.join(F.broadcast(base)).select("strategy", "alerts", F.round(100 * (1 - F.col("alerts") / F.col("base")), 4).alias("noise_reduction"))  # base is one row


@query("brier_by_lang", f"WITH {ctes('cases')} SELECT lang, round(avg(pow(y_prob - y_true::INT, 2)), 4) AS brier, count(*) AS n FROM cases GROUP BY lang")
def brier_by_lang(spark, sf):
    return me.brier(view(spark, sf, "cases"), "lang")


BINS = "b AS (SELECT least(floor(y_prob * 10), 9)::INT AS bin, count(*) AS count, round(avg(y_prob), 4) AS mean_predicted, round(avg(y_true::INT), 4) AS observed_rate FROM cases GROUP BY 1)"


@query("reliability_bins", f"WITH {ctes('cases')}, {BINS} SELECT r.bin::INT AS bin, coalesce(b.count, 0) AS count, mean_predicted, observed_rate FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin")
def reliability(spark, sf):
    return me.bins(view(spark, sf, "cases"), 10)


@query("ece", f"WITH {ctes('cases')}, {BINS} SELECT round(sum(count * abs(mean_predicted - observed_rate)) / sum(count), 4) AS ece FROM b")
def ece(spark, sf):
    return me.calibration_error(me.bins(view(spark, sf, "cases"), 10))


PER_CVE = f"""{ctes("refs", "symbols")}, l AS (SELECT *, CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS lv FROM refs),
  f AS (SELECT cve_id, count(*) AS n, coalesce(max(lv) FILTER (kind <> 'import'), max(lv)) AS lv, arg_min(fqn, seq * 1000 + substr(fqn, 5)::INT) FILTER (kind = 'call') AS best FROM l GROUP BY cve_id),
  p AS (SELECT s.cve_id, coalesce(n, 0) AS reference_count, n IS NOT NULL AS is_reachable, CASE coalesce(lv, 3) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, coalesce(best, '') AS best_call FROM (SELECT DISTINCT cve_id FROM symbols) s LEFT JOIN f USING (cve_id))"""


@query("findings_per_cve", f"WITH {PER_CVE} SELECT * FROM p")
def per_cve(spark, sf):
    return me.findings_per_cve(view(spark, sf, "symbols").select("cve_id").distinct(), view(spark, sf, "refs"))


@query("scan_noise_summary", f"WITH {PER_CVE} SELECT count(*) AS total, count(*) FILTER (is_reachable) AS reachable, count(*) FILTER (NOT is_reachable) AS unreachable, round(100 * count(*) FILTER (NOT is_reachable) / count(*), 1) AS noise_reduction_percent FROM p")
def scan_summary(spark, sf):
    return me.scan_summary(per_cve(spark, sf))


@query("language_detection", "WITH f AS (SELECT source, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'java' WHEN 'fr' THEN 'go' ELSE 'ruby' END AS l FROM documents), c AS (SELECT source, l, count(*) AS n FROM f GROUP BY ALL) SELECT source, l AS language FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, l DESC) AS rn FROM c) WHERE rn = 1")
def language(spark, sf):
    f = view(spark, sf, "documents").selectExpr("source", "case lang when 'en' then 'python' when 'de' then 'java' when 'fr' then 'go' else 'ruby' end as l")
    return f.groupBy("source", "l").count().groupBy("source").agg(F.max_by("l", F.struct("count", "l")).alias("language"))


@query("sbom_rollup", f"WITH {ctes('requires', 'findings')} SELECT (SELECT count(DISTINCT package) FROM requires) AS total, (SELECT count(DISTINCT package) FROM requires WHERE package NOT IN (SELECT dep FROM requires)) AS direct, (SELECT count(DISTINCT package) FROM requires WHERE package IN (SELECT dep FROM requires)) AS transitive, (SELECT count(DISTINCT package) FROM findings WHERE regexp_matches(package, '^Brand#1')) AS vulnerable")
def sbom(spark, sf):
    r = view(spark, sf, "requires")
    packages = r.select("package").distinct().join(r.select(F.col("dep").alias("package"), F.lit(True).alias("child")).distinct(), "package", "left")
    one = packages.agg(F.count(F.lit(1)).alias("total"), F.expr("count_if(child is null)").alias("direct"), F.expr("count_if(child)").alias("transitive"))
    return one.join(view(spark, sf, "findings").filter("package rlike '^Brand#1'").agg(F.count_distinct("package").alias("vulnerable")))  # one row with one row


@query("graph_stats_pivot", f"WITH {ctes('calls', 'exposed', 'requires')} SELECT (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM exposed) AS exposes, (SELECT count(*) FROM requires) AS depends_on")
def graph_stats(spark, sf):
    kinds = None
    for name, kind in (("calls", "calls"), ("exposed", "exposes"), ("requires", "depends_on")):
        part = view(spark, sf, name).select(F.lit(kind).alias("kind"))
        kinds = part if kinds is None else kinds.unionByName(part)
    return kinds.groupBy().pivot("kind", ["calls", "exposes", "depends_on"]).count()


@query("constraint_collection", f"WITH {ctes('requires')} SELECT dep, array_to_string(list_sort(list(DISTINCT concat(package, ' ', spec))), '; ') AS constraints, count(DISTINCT package) AS n FROM requires GROUP BY dep HAVING count(DISTINCT package) >= 2")
def constraints(spark, sf):
    return me.constraint_groups(view(spark, sf, "requires"))


@query("tree_merge_max_version", """WITH t AS (SELECT concat('pkg', l_partkey) AS package, l_linenumber AS major, l_orderkey % 20 AS minor FROM lineitem), p AS (SELECT concat('pkg', p_partkey) AS package, '99.0' AS pin FROM part WHERE p_partkey % 11 = 0)
  SELECT package, coalesce(any_value(pin), concat(max(major * 1000 + minor) // 1000, '.', max(major * 1000 + minor) % 1000)) AS version FROM t LEFT JOIN p USING (package) GROUP BY package""")
def tree_merge(spark, sf):
    t = view(spark, sf, "lineitem").selectExpr("concat('pkg', l_partkey) as package", "cast(l_linenumber as bigint) as major", "l_orderkey % 20 as minor").groupBy("package").agg(F.max(F.struct("major", "minor")).alias("v"))
    p = view(spark, sf, "part").filter("p_partkey % 11 = 0").selectExpr("concat('pkg', p_partkey) as package", "'99.0' as pin")
    return t.join(p, "package", "left").select("package", F.coalesce("pin", F.concat(F.col("v.major").cast("string"), F.lit("."), F.col("v.minor").cast("string"))).alias("version"))


@query("structural_hash", f"""WITH {ctes('symbols')}, l AS (SELECT package, fqn, arg_max(change_type, seq) AS t FROM symbols GROUP BY package, fqn), j AS (SELECT package, string_agg(concat('"', fqn, '": "', t, '"'), ', ' ORDER BY fqn) AS c, string_agg(concat('"', fqn, '"'), ', ' ORDER BY fqn) AS f FROM l GROUP BY package)
  SELECT package, substr(sha256(concat('{{"classes": {{', c, '}}, "fqns": [', f, ']}}')), 1, 16) AS structural_hash FROM j""")
def structural(spark, sf):
    return me.structural_hash(view(spark, sf, "symbols"), "package")


@query("guard_fingerprint", f"WITH {ctes('symbols')} SELECT package, substr(sha256(array_to_string(list_sort(list(DISTINCT fqn)), '|')), 1, 12) AS fingerprint FROM symbols WHERE change_type = 'HARDENED_ONLY' GROUP BY package")
def guards(spark, sf):
    return view(spark, sf, "symbols").filter("change_type = 'HARDENED_ONLY'").groupBy("package").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set("fqn")), "|"), 256), 1, 12).alias("fingerprint"))


@query("scaler_fit", "WITH u AS (SELECT unnest(['p_size', 'p_retailprice']) AS feature, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part) SELECT feature, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END, 6) AS std FROM u GROUP BY feature")
def scaler(spark, sf):
    return me.scale_fit(view(spark, sf, "part"), ["p_size", "p_retailprice"])


@query("flywheel_counts", f"{SCORED} SELECT recommendation, reachability_kind = 'direct' AS reachable, count(*) AS n, count(DISTINCT package) AS packages FROM s GROUP BY ALL")
def flywheel(spark, sf):
    return scored(spark, sf).groupBy("recommendation", (F.col("reachability_kind") == "direct").alias("reachable")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("package").alias("packages"))


@query("flywheel_rate", f"{SCORED} SELECT count(*) FILTER (reachability_kind = 'direct') AS reachable, count(*) FILTER (reachability_kind <> 'direct') AS unreachable, round(count(*) FILTER (reachability_kind = 'direct') / count(*), 4) AS rate FROM s")
def flywheel_rate(spark, sf):
    return scored(spark, sf).agg(F.expr("count_if(reachability_kind = 'direct')").alias("reachable"), F.expr("count_if(reachability_kind <> 'direct')").alias("unreachable")).withColumn("rate", F.round(F.col("reachable") / (F.col("reachable") + F.col("unreachable")), 4))


@query("cascade_affected", f"WITH {ctes('requires')} SELECT dep AS package, count(DISTINCT package) + 1 AS total_packages_affected FROM requires GROUP BY dep")
def affected(spark, sf):
    return view(spark, sf, "requires").groupBy(F.col("dep").alias("package")).agg((F.count_distinct("package") + 1).alias("total_packages_affected"))


@query("test_surface_counts", f"WITH {ctes('refs')} SELECT file, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'import') AS imports, count(*) FILTER (in_entry_point) AS entry_points FROM refs GROUP BY file")
def surface(spark, sf):
    return view(spark, sf, "refs").groupBy("file").agg(F.expr("count_if(kind = 'call')").alias("calls"), F.expr("count_if(kind = 'import')").alias("imports"), F.expr("count_if(in_entry_point)").alias("entry_points"))


@query("cache_hit_rate", "WITH k AS (SELECT sha256(concat('scan@1:', sha256(text))) AS key, doc_id FROM documents), h AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0) SELECT count(*) FILTER (h.key IS NOT NULL) AS hits, count(*) FILTER (h.key IS NULL) AS misses, round(count(*) FILTER (h.key IS NOT NULL) / count(*), 4) AS hit_rate FROM k LEFT JOIN h USING (key)")
def cache_hits(spark, sf):
    k = view(spark, sf, "documents").select(F.sha2(F.concat(F.lit("scan@1:"), F.sha2("text", 256)), 256).alias("key"), "doc_id")
    return me.cache_stats(k, k.filter("doc_id % 3 = 0"))


@query("fix_plan_minutes", f"WITH {ctes('requires')}, d AS (SELECT DISTINCT package, dep FROM requires), n AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY dep) AS i, count(*) OVER (PARTITION BY package) AS n FROM d) SELECT package, sum(CASE WHEN i = n THEN 30 ELSE 15 END)::BIGINT AS minutes, count(*) AS steps FROM n GROUP BY package")
def fix_minutes(spark, sf):
    d = view(spark, sf, "requires").select("package", "dep").distinct().groupBy("package").agg(F.count(F.lit(1)).alias("steps"))
    return d.select("package", (15 * (F.col("steps") - 1) + 30).alias("minutes"), "steps")


@query("sink_pattern_union", f"WITH {ctes('symbols', 'refs')}, u AS (SELECT cve_id, concat(short_name, '(...)') AS p FROM symbols UNION SELECT cve_id, concat(fqn, '(...)') FROM refs WHERE kind = 'call') SELECT cve_id, array_to_string(list_sort(list(p)), ',') AS patterns FROM u GROUP BY cve_id")
def sink_patterns(spark, sf):
    u = view(spark, sf, "symbols").select("cve_id", F.concat("short_name", F.lit("(...)")).alias("p")).unionByName(view(spark, sf, "refs").filter("kind = 'call'").select("cve_id", F.concat("fqn", F.lit("(...)")).alias("p")))
    return u.groupBy("cve_id").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("patterns"))


@query("specifier_intersection", f"WITH {ctes('requires')} SELECT dep, array_to_string(list_sort(list(DISTINCT spec)), ',') AS specifiers, count(DISTINCT spec) AS clauses, count(DISTINCT spec) = 0 AS empty FROM requires GROUP BY dep")
def intersection(spark, sf):
    return view(spark, sf, "requires").groupBy("dep").agg(F.array_join(F.array_sort(F.collect_set("spec")), ",").alias("specifiers"), F.count_distinct("spec").alias("clauses"), (F.count_distinct("spec") == 0).alias("empty"))
