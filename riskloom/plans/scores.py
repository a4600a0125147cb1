"""Queries of the scoring chain: filter, families, first rows, joins of evidence, factors, recommendation, ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions import scoring
from riskloom.operators import findings as fi
from riskloom.plans.analogs import ctes, view

FAMILY_SQL = ", ".join(f"('{k}', '{v}')" for k, v in fi.CWE_FAMILY.items())


def scored(spark: SparkSession, sf: str) -> DataFrame:
    first = fi.first_by(view(spark, sf, "findings"), "cve_id")
    return scoring.score(first, view(spark, sf, "epss"), view(spark, sf, "kev"), view(spark, sf, "reach"), view(spark, sf, "exposed"))


#: The stored model's logit of a finding f and its EPSS row e; the age is that of a new finding.
LEARNT = " + ".join([repr(scoring.EXPLOIT_MODEL["bias"]) + "::DOUBLE"] + [
    f"{w!r}::DOUBLE * (({x}) - {m!r}::DOUBLE) / {d!r}::DOUBLE"
    for x, m, d, w in zip(("coalesce(f.cvss_score, 0e0)", "coalesce(e.epss, 0e0)", "coalesce(e.percentile, 0e0)", "CASE WHEN f.cwe <> '' THEN 1e0 ELSE 0e0 END", "30e0 / 3650e0"), *(scoring.EXPLOIT_MODEL[k] for k in ("means", "scales", "weights")))
])

#: The scoring chain as CTEs that end in one named s.
SCORED = f"""WITH {ctes("findings", "epss", "kev", "reach", "exposed")},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY row_id) AS rn FROM findings) WHERE rn = 1),
lv AS (SELECT *, CASE confidence WHEN 'HIGH' THEN 1e0 WHEN 'MEDIUM' THEN 0.6e0 ELSE 0.3e0 END AS lvl FROM reach),
r AS (SELECT cve_id, count(*) AS n_paths, max(lvl * exp(-0.5e0 * (greatest(1, hops) - 1))) AS best, max(lvl) AS lvl, bool_or(tainted) AS taint FROM lv GROUP BY cve_id),
b AS (SELECT cve_id, count(DISTINCT service) AS svc FROM exposed GROUP BY cve_id),
j AS (
  SELECT f.*, coalesce(e.epss, 0e0) AS ep, {LEARNT} AS z, k.cve_id IS NOT NULL AS kv, r.n_paths IS NOT NULL AS has_path, r.best, r.lvl, r.taint, coalesce(b.svc, 0) AS svc
  FROM f LEFT JOIN epss e USING (cve_id) LEFT JOIN kev k USING (cve_id) LEFT JOIN r USING (cve_id) LEFT JOIN b USING (cve_id)
), w AS (
  SELECT *, CASE WHEN attack_vector IS NOT NULL OR privileges_required IS NOT NULL THEN
      least(1e0, greatest(0e0, CASE coalesce(attack_vector, 'network') WHEN 'network' THEN 0.85e0 WHEN 'adjacent' THEN 0.62e0 WHEN 'local' THEN 0.55e0 ELSE 0.2e0 END
        * CASE coalesce(privileges_required, 'none') WHEN 'none' THEN 0.85e0 WHEN 'low' THEN 0.62e0 ELSE 0.27e0 END
        * CASE WHEN user_interaction THEN 0.62e0 ELSE 0.85e0 END / (0.85e0 * 0.85e0 * 0.85e0))) * 0.85e0
      ELSE least(1e0, cvss_score / 10e0) * 0.85e0 END AS prior,
    CASE WHEN confidentiality IS NULL AND integrity IS NULL AND availability IS NULL THEN least(1e0, cvss_score / 10e0) ELSE least(1e0,
      0.3334e0 * CASE confidentiality WHEN 'high' THEN 1e0 WHEN 'low' THEN 0.5e0 ELSE 0e0 END + 0.3333e0 * CASE integrity WHEN 'high' THEN 1e0 WHEN 'low' THEN 0.5e0 ELSE 0e0 END
      + 0.3333e0 * CASE availability WHEN 'high' THEN 1e0 WHEN 'low' THEN 0.5e0 ELSE 0e0 END) END AS i,
    CASE WHEN has_path THEN least(1e0, best * CASE WHEN taint THEN 1.15e0 ELSE 1e0 END) WHEN svc > 0 THEN 0.15e0 WHEN package <> '' THEN 0.05e0 ELSE 0e0 END AS rr,
    CASE WHEN has_path THEN 'direct' WHEN svc > 0 OR package <> '' THEN 'transitive' ELSE 'none' END AS kind,
    1e0 - exp(-0.5e0 * svc) AS sat,
    pow(CASE WHEN ep > 0 THEN 1e0 ELSE 0.7e0 END * CASE WHEN has_path THEN 1e0 ELSE 0.6e0 END * CASE WHEN has_path THEN lvl ELSE 0.3e0 END, 1e0 / 3e0) AS phi
  FROM j
), x AS (
  SELECT *, least(1e0, 1e0 - (1e0 - ep) * (1e0 - CASE WHEN kv THEN 0.99e0 ELSE 0e0 END) * (1e0 - prior) * (1e0 - 1e0 / (1e0 + exp(-z)))) AS e, phi * rr + (1e0 - phi) * 0.05e0 AS re, 1e0 + 0.5e0 * sat AS bf FROM w
), y AS (SELECT *, e * i * re AS loss, least(1e0, e * i * re * bf) AS unit, round_even(100e0 * least(1e0, e * i * re * bf), 0)::INT AS raw FROM x
), s AS (
  SELECT cve_id, package, severity, cvss_score, raw AS raw_risk, round_even(i * 40, 0)::INT AS severity_score, round_even(e * 20, 0)::INT AS exploit_score,
    round_even(re * 25, 0)::INT AS reachability_score, round_even(sat * 15, 0)::INT AS blast_radius_score, round(e, 4) AS exploitability, round(i, 4) AS impact, round(rr, 4) AS reachability,
    round(re, 4) AS reachability_eff, round(bf, 4) AS blast_factor, round(sat, 4) AS blast_normalized, round(loss, 4) AS expected_loss, round(unit, 4) AS risk_unit, round(phi, 3) AS confidence,
    kind AS reachability_kind, CASE WHEN e >= greatest(i, re) THEN 'exploitability' WHEN i >= re THEN 'impact' ELSE 'reachability' END AS dominant_factor,
    CASE WHEN raw >= 70 THEN 'BLOCK' WHEN raw >= 40 THEN 'REVIEW' WHEN has_path AND cvss_score >= 4 THEN 'REVIEW' ELSE 'PROCEED' END AS recommendation,
    kv AS in_kev, ep AS epss, svc AS impacted_services
  FROM y
)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("score_findings", f"{SCORED} SELECT * FROM s")
def score_findings(spark, sf):
    return scored(spark, sf)


@query("assessment_summary", f"""{SCORED} SELECT max(raw_risk) AS overall_raw_risk, CASE WHEN max(raw_risk) >= 70 THEN 'BLOCK' WHEN max(raw_risk) >= 40 THEN 'REVIEW' ELSE 'PROCEED' END AS overall_recommendation,
  round(avg(confidence), 3) AS overall_confidence, count(*) AS total, count(*) FILTER (recommendation = 'BLOCK') AS block_count, count(*) FILTER (recommendation = 'REVIEW') AS review_count FROM s""")
def assessment_summary(spark, sf):
    s = scored(spark, sf).agg(F.max("raw_risk").alias("overall_raw_risk"), F.round(F.avg("confidence"), 3).alias("overall_confidence"), F.count(F.lit(1)).alias("total"), F.expr("count_if(recommendation = 'BLOCK')").alias("block_count"), F.expr("count_if(recommendation = 'REVIEW')").alias("review_count"))
    return s.withColumn("overall_recommendation", scoring.recommendation(F.col("overall_raw_risk")))


@query("upgrade_order", f"{SCORED} SELECT cve_id, raw_risk, reachability_score, row_number() OVER (ORDER BY raw_risk DESC, reachability_score DESC, cve_id) AS place FROM s ORDER BY place LIMIT 100")
def upgrade_order(spark, sf):
    top = scored(spark, sf).select("cve_id", "raw_risk", "reachability_score").orderBy(F.desc("raw_risk"), F.desc("reachability_score"), "cve_id").limit(100)
    # a hundred rows are numbered, not the table
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("raw_risk"), F.desc("reachability_score"), "cve_id")))


for _n, _k in (("topk_risk", 8), ("topk_concerns", 3), ("recent_assessments", 10)):
    query(_n, f"{SCORED} SELECT cve_id, package, raw_risk, recommendation FROM s ORDER BY raw_risk DESC, reachability_score DESC, cve_id LIMIT {_k}")(
        lambda spark, sf, k=_k: scored(spark, sf).orderBy(F.desc("raw_risk"), F.desc("reachability_score"), "cve_id").limit(k).select("cve_id", "package", "raw_risk", "recommendation"))


@query("factor_unpivot", f"""{SCORED}, u AS (SELECT cve_id, unnest(['exploitability', 'impact', 'reachability', 'blast', 'confidence']) AS factor, unnest([exploitability, impact, reachability_eff, blast_normalized, confidence]) AS value FROM s)
  SELECT cve_id, factor, value, CASE WHEN value >= 0.66e0 THEN 'HIGH' WHEN value >= 0.33e0 THEN 'MODERATE' ELSE 'LOW' END AS band FROM u""")
def factor_unpivot(spark, sf):
    rows = scored(spark, sf).selectExpr("cve_id", "stack(5, 'exploitability', exploitability, 'impact', impact, 'reachability', reachability_eff, 'blast', blast_normalized, 'confidence', confidence) as (factor, value)")
    return rows.withColumn("band", scoring.factor_band(F.col("value")))


@query("legacy_points_unpivot", f"""{SCORED} SELECT cve_id, unnest(['severity', 'exploit', 'reachability', 'blast']) AS part, unnest([severity_score, exploit_score, reachability_score, blast_radius_score]) AS points FROM s""")
def legacy_points(spark, sf):
    return scored(spark, sf).selectExpr("cve_id", "stack(4, 'severity', severity_score, 'exploit', exploit_score, 'reachability', reachability_score, 'blast', blast_radius_score) as (part, points)")


@query("risk_intelligence", f"""{SCORED} SELECT arg_max(cve_id, raw_risk::BIGINT * 1000000000 - substr(cve_id, 5)::BIGINT) AS top_cve, 100 - max(raw_risk) AS readiness, count(DISTINCT package) AS packages,
  count(*) FILTER (reachability_kind = 'direct') AS reachable, count(*) FILTER (in_kev) AS in_kev, sum(impacted_services)::BIGINT AS services FROM s""")
def risk_intelligence(spark, sf):
    return scored(spark, sf).agg(F.expr("max_by(cve_id, cast(raw_risk as bigint) * 1000000000L - cast(substr(cve_id, 5) as bigint))").alias("top_cve"), (100 - F.max("raw_risk")).alias("readiness"), F.count_distinct("package").alias("packages"), F.expr("count_if(reachability_kind = 'direct')").alias("reachable"), F.expr("count_if(in_kev)").alias("in_kev"), F.sum("impacted_services").alias("services"))


@query("explanations", f"""{SCORED} SELECT cve_id, concat(cve_id, ' in ', package, ' scores ', raw_risk, '/100 (', recommendation, '): ', CASE reachability_kind WHEN 'direct' THEN 'reachable from application code' ELSE 'no direct path found' END, CASE WHEN in_kev THEN ', known to be exploited' ELSE '' END, '.') AS text FROM s""")
def explanations(spark, sf):
    path = F.when(F.col("reachability_kind") == "direct", "reachable from application code").otherwise("no direct path found")
    return scored(spark, sf).select("cve_id", F.concat("cve_id", F.lit(" in "), "package", F.lit(" scores "), F.col("raw_risk").cast("string"), F.lit("/100 ("), "recommendation", F.lit("): "), path, F.when(F.col("in_kev"), ", known to be exploited").otherwise(""), F.lit(".")).alias("text"))


@query("score_single", f"""WITH {ctes("findings")} SELECT row_id, round_even(100e0 * i * e, 0)::INT AS unreached_score FROM (SELECT row_id,
  CASE WHEN confidentiality IS NULL AND integrity IS NULL AND availability IS NULL THEN least(1e0, cvss_score / 10e0) ELSE least(1e0, 0.3334e0 * CASE confidentiality WHEN 'high' THEN 1e0 WHEN 'low' THEN 0.5e0 ELSE 0e0 END
    + 0.3333e0 * CASE integrity WHEN 'high' THEN 1e0 WHEN 'low' THEN 0.5e0 ELSE 0e0 END + 0.3333e0 * CASE availability WHEN 'high' THEN 1e0 WHEN 'low' THEN 0.5e0 ELSE 0e0 END) END AS i, cvss_score / 10e0 * 0.5e0 + 0.25e0 AS e FROM findings)""")
def score_single(spark, sf):
    i = scoring.impact(F.col("confidentiality"), F.col("integrity"), F.col("availability"), F.col("cvss_score"))
    return view(spark, sf, "findings").select("row_id", F.rint(100 * i * (F.col("cvss_score") / 10.0 * 0.5 + 0.25)).cast("int").alias("unreached_score"))


@query("exploit_probability", f"""WITH {ctes("findings", "epss")}, z AS (SELECT row_id, -1.2667112909688898e0 + 0.8463764529989726e0 * ((cvss_score - 5.523222222222222e0) / 2.5567089643514493e0)
  + 0.3032069195710389e0 * ((coalesce(epss, 0e0) - 0.137872e0) / 0.10073819674118982e0) + 0.02176221477662943e0 * ((coalesce(percentile, 0e0) - 0.41983244444444445e0) / 0.14106371039995536e0)
  + 0.36407798963245613e0 * ((1e0 - 1.5122222222222221e0) / 1.1405970929276743e0) + 0.014381905377966351e0 * ((30e0 / 3650e0 - 0.48868819541728636e0) / 0.28801823425743917e0) AS z
  FROM findings LEFT JOIN epss USING (cve_id)) SELECT row_id, round(1e0 / (1e0 + exp(-z)), 6) AS probability FROM z""")
def exploit_probability(spark, sf):
    rows = view(spark, sf, "findings").join(view(spark, sf, "epss"), "cve_id", "left")
    return rows.select("row_id", F.round(scoring.exploit_probability(F.col("cvss_score"), F.coalesce("epss", F.lit(0.0)), F.coalesce("percentile", F.lit(0.0)), F.lit(1)), 6).alias("probability"))


@query("severity_filter", f"WITH {ctes('findings')} SELECT row_id, cve_id, severity, cwe FROM findings WHERE cwe <> '' AND severity NOT IN ('LOW', 'NEGLIGIBLE')")
def severity_filter(spark, sf):
    return fi.severe(view(spark, sf, "findings")).select("row_id", "cve_id", "severity", "cwe")


CLUSTERED = f"WITH {ctes('findings')}, dim(cwe, family) AS (VALUES {FAMILY_SQL}), c AS (SELECT f.*, coalesce(d.family, replace(lower(f.cwe), '-', '_')) AS family FROM findings f LEFT JOIN dim d USING (cwe) WHERE f.cwe <> '' AND severity NOT IN ('LOW', 'NEGLIGIBLE'))"


def clustered(spark, sf):
    return fi.with_family(fi.severe(view(spark, sf, "findings")), fi.families(spark))


@query("cluster_by_family", f"{CLUSTERED} SELECT family, array_to_string(list_sort(list(DISTINCT cwe)), ',') AS cwe_ids, array_to_string(list_sort(list(DISTINCT package)), ',') AS packages, count(*) AS n_cves FROM c GROUP BY family")
def cluster_by_family(spark, sf):
    return fi.clusters(clustered(spark, sf)).select("family", F.array_join("cwe_ids", ",").alias("cwe_ids"), F.array_join("packages", ",").alias("packages"), "n_cves")


@query("normalise_stats", f"{CLUSTERED} SELECT (SELECT count(*) FROM findings) AS total, count(*) AS filtered, count(DISTINCT cwe) AS unique_cwes, count(DISTINCT family) AS families FROM c")
def normalise_stats(spark, sf):
    one = clustered(spark, sf).agg(F.count(F.lit(1)).alias("filtered"), F.count_distinct("cwe").alias("unique_cwes"), F.count_distinct("family").alias("families"))
    return view(spark, sf, "findings").agg(F.count(F.lit(1)).alias("total")).join(one)  # one row with one row


@query("topk_families", f"{CLUSTERED} SELECT family, count(*) AS n_cves FROM c GROUP BY family ORDER BY n_cves DESC, family LIMIT 12")
def topk_families(spark, sf):
    return clustered(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("n_cves")).orderBy(F.desc("n_cves"), "family").limit(12)


@query("first_row_per_cve", f"WITH {ctes('findings')} SELECT cve_id, row_id, package FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY row_id) AS rn FROM findings) WHERE rn = 1")
def first_row(spark, sf):
    return fi.first_by(view(spark, sf, "findings"), "cve_id").select("cve_id", "row_id", "package")


@query("package_of_cve_last_wins", f"WITH {ctes('findings')} SELECT upper(cve_id) AS cve, arg_max(package, row_id) AS package FROM findings GROUP BY 1")
def package_of_cve(spark, sf):
    return fi.package_of_cve(view(spark, sf, "findings"))


@query("upgrade_targets", f"WITH {ctes('findings', 'reach')} SELECT package, arg_min(trim(string_split(fixed_version, ',')[1]), row_id) AS version, min(row_id) AS row_id FROM findings WHERE fixed_version <> '' AND cve_id IN (SELECT cve_id FROM reach) GROUP BY package")
def upgrade_targets(spark, sf):
    return fi.upgrade_targets(view(spark, sf, "findings"), view(spark, sf, "reach"))


@query("severity_labels", f"WITH {ctes('findings')} SELECT CASE WHEN cvss_score >= 9 THEN 'CRITICAL' WHEN cvss_score >= 7 THEN 'HIGH' WHEN cvss_score >= 4 THEN 'MODERATE' WHEN cvss_score > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS label, count(*) AS n FROM findings GROUP BY 1")
def severity_labels(spark, sf):
    return view(spark, sf, "findings").groupBy(scoring.severity_label(F.col("cvss_score")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("kev_left_join", f"WITH {ctes('findings', 'kev')} SELECT f.row_id, k.cve_id IS NOT NULL AS in_kev FROM findings f LEFT JOIN kev k ON k.cve_id = f.cve_id")
def kev_left_join(spark, sf):
    kev = view(spark, sf, "kev").select(F.col("cve_id").alias("k"))
    return view(spark, sf, "findings").join(kev, F.col("cve_id") == F.col("k"), "left").select("row_id", F.col("k").isNotNull().alias("in_kev"))


@query("cvss_vector_parse", f"""WITH v AS (SELECT p_partkey AS row_id, concat('CVSS:3.1/AV:', CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'L' ELSE 'P' END, '/AC:L/PR:', CASE p_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END, '/UI:', CASE WHEN p_partkey % 2 = 0 THEN 'R' ELSE 'N' END, '/S:U/C:H/I:L/A:N') AS v FROM part)
  SELECT row_id, CASE regexp_extract(v, 'AV:(.)', 1) WHEN 'N' THEN 'network' WHEN 'A' THEN 'adjacent' WHEN 'L' THEN 'local' ELSE 'physical' END AS av, CASE regexp_extract(v, 'PR:(.)', 1) WHEN 'N' THEN 'none' WHEN 'L' THEN 'low' ELSE 'high' END AS pr, v LIKE '%UI:R%' AS ui, 'high' AS c, 'low' AS i, 'none' AS a FROM v""")
def cvss_vector_parse(spark, sf):
    k = F.col("p_partkey")
    vector = F.concat(F.lit("CVSS:3.1/AV:"), F.expr("element_at(array('N', 'A', 'L', 'P'), cast(p_partkey % 4 as int) + 1)"), F.lit("/AC:L/PR:"), F.expr("element_at(array('N', 'L', 'H'), cast(p_partkey % 3 as int) + 1)"), F.lit("/UI:"), F.when(k % 2 == 0, "R").otherwise("N"), F.lit("/S:U/C:H/I:L/A:N"))
    p = view(spark, sf, "part").select(k.alias("row_id"), fi.parse_cvss(vector).alias("p"))
    return p.select("row_id", F.col("p.attack_vector").alias("av"), F.col("p.privileges_required").alias("pr"), F.col("p.user_interaction").alias("ui"), F.col("p.impact.confidentiality").alias("c"), F.col("p.impact.integrity").alias("i"), F.col("p.impact.availability").alias("a"))
