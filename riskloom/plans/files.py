"""Queries of readers and writers: rows are written in a source's own format, a document for about a thousand of them, and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import canonical as js
from riskloom.operators import windows as wi
from riskloom.operators.commits import of_findings
from riskloom.operators.scratch import folder
from riskloom.plans.analogs import ctes, view
from riskloom.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def documents(rows: DataFrame, doc: str, item: Column, text: Callable[[Column], Column]) -> str:
    """A folder with one document for each value of doc, made by text of the list of its items."""
    path = folder(rows.sparkSession, "files")
    listed = rows.groupBy(F.expr(doc).alias("doc")).agg(F.collect_list(item).alias("items"))
    listed.select("doc", text(F.col("items")).alias("value")).write.partitionBy("doc").text(path)
    return path


def under(name: str) -> Callable[[Column], Column]:
    return lambda items: F.to_json(F.struct(items.alias(name)))


@query("read_findings_files", f"WITH {ctes('findings')} SELECT cve_id, package, installed_version, fixed_version, severity, cvss_score, attack_vector, cwe FROM findings")
def findings_files(spark, sf):
    item = F.struct("cve_id", "package", "installed_version", "fixed_version", "severity", "cvss_score", F.struct("attack_vector").alias("parsed_cvss"), F.array("cwe").alias("cwe"))
    path = documents(view(spark, sf, "findings"), "floor(row_id / 1000)", item, F.to_json)
    return readers.read_findings(spark, path).select("cve_id", "package", "installed_version", "fixed_version", "severity", "cvss_score", "parsed_cvss.attack_vector", F.col("cwe")[0].alias("cwe"))


@query("raw_scan_files", f"WITH {ctes('findings')} SELECT cve_id, package, CASE WHEN row_id % 2 = 0 THEN cvss_score ELSE 1e0 END AS cvss_score, CASE WHEN row_id % 3 = 0 THEN 'physical' ELSE 'network' END AS attack_vector, row_id % 3 = 0 AS user_interaction, CASE WHEN row_id % 4 = 0 THEN 1 ELSE 0 END AS n_commits FROM findings WHERE row_id % 7 > 0")
def raw_scan_files(spark, sf):
    k = F.col("row_id")
    vector = F.when(k % 3 == 0, "CVSS:3.1/AV:P/UI:R/C:H").otherwise("CVSS:3.1/AV:N/UI:N/C:L")
    side = lambda score: F.struct(vector.alias("V3Vector"), score.alias("V3Score"))
    cvss = F.struct(F.when(k % 2 == 0, side(F.col("cvss_score"))).alias("nvd"), side(F.lit(1.0)).alias("ghsa"))
    urls = F.when(k % 4 == 0, F.array(F.lit("https://github.com/o/r/commit/abcdef1"), F.lit("https://o.r/notes"))).otherwise(F.array(F.lit("https://o.r/notes")))
    item = F.struct(F.when(k % 7 > 0, F.col("cve_id")).otherwise("").alias("VulnerabilityID"), F.col("package").alias("PkgName"), cvss.alias("CVSS"), urls.alias("References"))
    path = documents(view(spark, sf, "findings"), "floor(row_id / 1000)", item, lambda items: F.to_json(F.struct(F.array(F.struct(items.alias("Vulnerabilities"))).alias("Results"))))
    return readers.read_raw_scan(spark, path).select("cve_id", "package", "cvss_score", "parsed_cvss.attack_vector", "parsed_cvss.user_interaction", F.size("commit_urls").alias("n_commits"))


@query("commit_urls_of_cve", f"WITH {ctes('findings')} SELECT cve_id, concat('https://github.com/o/r/commit/', row_id) AS url FROM findings WHERE cve_id = 'CVE-3' AND lower(package) = (SELECT lower(package) FROM findings WHERE row_id = 3)")
def commit_urls(spark, sf):
    rows = view(spark, sf, "findings").withColumn("commit_urls", F.array(F.concat(F.lit("https://github.com/o/r/commit/"), F.col("row_id").cast("string"))))
    return of_findings(rows, "CVE-3", rows.filter("row_id = 3").select(F.upper("package").alias("package")))


@query("epss_files", f"WITH {ctes('epss')} SELECT * FROM epss")
def epss_files(spark, sf):
    rows = view(spark, sf, "epss")
    item = F.struct("cve_id", F.struct("epss", "percentile").alias("v"))
    return readers.read_epss(spark, documents(rows, "floor(substr(cve_id, 5) / 1000)", item, lambda items: F.to_json(F.map_from_entries(F.concat(items, F.array(F.struct(F.lit("snapshot").alias("cve_id"), F.struct(F.lit(0.0).alias("epss"), F.lit(0.0).alias("percentile")).alias("v"))))))))


@query("kev_files", f"WITH {ctes('kev')} SELECT cve_id FROM kev")
def kev_files(spark, sf):
    return readers.read_kev(spark, documents(view(spark, sf, "kev"), "floor(substr(cve_id, 5) / 1000)", F.col("cve_id"), under("catalog")))


@query("dependency_graph_files", f"WITH {ctes('requires')} SELECT package AS parent, '1.0' AS parent_version, dep, CASE WHEN row_id % 5 = 0 THEN '==2.1' ELSE spec END AS spec, '2.1' AS dep_version FROM requires WHERE row_id % 4 > 0")
def dependency_graphs(spark, sf):
    node = lambda relation, name, version: F.struct(F.lit(relation).alias("relation"), F.struct(name.alias("name"), F.lit(version).alias("version")).alias("versionKey"))
    k = F.col("row_id")
    ends = F.array(node("INDIRECT", F.lit("other"), "1"), node("SELF", F.initcap("package"), "1.0"), F.when(k % 4 > 0, node("DIRECT", F.col("dep"), "2.1")).otherwise(node("INDIRECT", F.col("dep"), "2.1")))
    wanted = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat("spec", F.lit(" ; python_version > '3'")))
    item = F.struct(ends.alias("nodes"), F.array(F.struct(F.lit(1).alias("fromNode"), F.lit(2).alias("toNode"), wanted.alias("requirement")), F.struct(F.lit(0).alias("fromNode"), F.lit(2).alias("toNode"), F.lit("x").alias("requirement"))).alias("edges"))
    return readers.direct_dependencies(readers.read_dependency_graphs(spark, documents(view(spark, sf, "requires"), "floor(row_id / 1000)", item, F.to_json)))


@query("advisory_files", "SELECT CASE WHEN p_partkey % 2 = 0 THEN concat('CVE-', p_partkey) ELSE concat('GHSA-', p_partkey) END AS cve, CASE WHEN p_partkey % 3 = 0 THEN repeat('n', 200) ELSE p_name END AS note, CASE WHEN p_partkey % 5 = 0 THEN 0e0 ELSE p_partkey % 10 / 2e0 END AS cvss FROM part")
def advisories(spark, sf):
    k = F.col("p_partkey")
    alias = F.when(k % 2 == 0, F.array(F.lit("PYSEC-1"), F.concat(F.lit("CVE-"), k.cast("string")))).otherwise(F.array(F.lit("PYSEC-1")))
    rating = F.array(F.struct(F.lit("CVSS_V2").alias("type"), F.lit("9").alias("score")), F.struct(F.lit("CVSS_V3").alias("type"), F.when(k % 5 == 0, "CVSS:3.1/AV:N").otherwise((k % 10 / 2).cast("string")).alias("score")))
    item = F.struct(F.concat(F.lit("GHSA-"), k.cast("string")).alias("id"), alias.alias("aliases"), F.when(k % 3 > 0, F.col("p_name")).alias("summary"), F.repeat(F.lit("n"), F.lit(300)).alias("details"), rating.alias("severity"))
    return readers.read_advisories(spark, documents(view(spark, sf, "part"), "floor(p_partkey / 1000)", item, under("vulns")))


@query("requirement_files", "SELECT concat('pkg-', p_partkey) AS package, concat('1.', p_partkey % 9) AS version FROM part WHERE p_partkey % 4 < 2")
def requirement_files(spark, sf):
    line = "CASE p_partkey % 4 WHEN 0 THEN concat('Pkg_', p_partkey, '==1.', p_partkey % 9, '  # pinned') WHEN 1 THEN concat('pkg.', p_partkey, '[a,b] == 1.', p_partkey % 9, ' ; os') WHEN 2 THEN concat('-e ./pkg', p_partkey) ELSE concat('# pkg', p_partkey, '==1') END"
    path = documents(view(spark, sf, "part"), "floor(p_partkey / 1000)", F.expr(line), lambda items: F.array_join(items, "\n"))
    return readers.read_requirements(spark, path)


@query("manifest_pins", "SELECT concat('m', p_partkey) AS path, concat('dep-', p_partkey % 7) AS package, concat('2.', p_partkey % 5) AS version, CASE p_partkey % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'poetry' ELSE 'pipfile' END AS kind FROM part WHERE p_partkey % 4 < 3")
def manifest_pins(spark, sf):
    text = """CASE p_partkey % 4 WHEN 0 THEN concat('[project]', char(10), 'dependencies = ["Dep_', p_partkey % 7, '==2.', p_partkey % 5, '", "free>=1"]', char(10))
      WHEN 1 THEN concat('[tool.poetry.dependencies]', char(10), 'python = "^3.9"', char(10), 'dep_', p_partkey % 7, ' = "^2.', p_partkey % 5, '"', char(10), 'any = "*"', char(10))
      WHEN 2 THEN concat('[packages]', char(10), '"dep.', p_partkey % 7, '" = {version = "==2.', p_partkey % 5, '"}', char(10)) ELSE '[broken' END"""
    return readers.pins_of_toml(view(spark, sf, "part").selectExpr("concat('m', p_partkey) as path", f"{text} as text"))


@query("manifest_first_usable", "SELECT 2 AS priority, concat('pkg', p_partkey) AS package, '1' AS version FROM part WHERE p_partkey % 3 = 0")
def first_usable(spark, sf):
    return readers.first_usable(view(spark, sf, "part").filter("p_partkey % 3 < 2").selectExpr("if(p_partkey % 3 = 0, 2, 5) as priority", "concat('pkg', p_partkey) as package", "'1' as version"))


@query("source_tree_files", "SELECT count(*) AS n, sum(p_partkey)::BIGINT AS total FROM part WHERE floor(p_partkey / 100) % 3 = 0")
def source_tree(spark, sf):
    k = F.col("p_partkey")
    line = F.when(F.floor(k / 100) % 3 == 1, F.concat(F.lit("x"), F.expr("char(0)"), k.cast("string"))).otherwise(k.cast("string"))
    path = documents(view(spark, sf, "part"), "concat(floor(p_partkey / 100), if(floor(p_partkey / 100) % 3 = 2, '.big', ''))", line, lambda items: F.concat(F.array_join(items, "\n"), F.when(F.col("doc").endswith(".big"), F.repeat(F.lit("\n"), F.lit(readers.MAX_SOURCE_BYTES))).otherwise("")))
    lines = readers.read_sources(spark, path, suffix=".txt").select(F.explode(F.split(F.trim(F.rtrim("text")), r"\s+")).alias("k")).filter("k != ''")
    return lines.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("k").cast("bigint")).alias("total"))


@query("corpus_files", "SELECT concat('CVE-', p_partkey) AS cve_id, p_brand AS package, p_size / 5e0 AS cvss, p_partkey % 3 = 0 AS must_fix FROM part")
def corpus_files(spark, sf):
    item = F.struct(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cve_id"), F.col("p_brand").alias("package"), (F.col("p_size") / F.lit(5.0)).alias("cvss"), (F.col("p_partkey") % 3 == 0).alias("must_fix"))
    path = documents(view(spark, sf, "part"), "floor(p_partkey / 1000)", item, lambda items: F.to_json(F.struct(F.lit("1").alias("version"), items.alias("cases"))))
    return readers.read_corpus(spark, path).select("cve_id", "package", "cvss", "must_fix")


@query("corpus_metadata_files", "SELECT '1' AS version, count(DISTINCT p_partkey // 1000) AS documents FROM part")
def corpus_head(spark, sf):
    path = documents(view(spark, sf, "part"), "floor(p_partkey / 1000)", F.struct(F.col("p_brand").alias("package")), lambda items: F.to_json(F.struct(F.lit("1").alias("version"), items.alias("cases"))))
    return readers.corpus_metadata(spark, path).groupBy("version").agg(F.count(F.lit(1)).alias("documents"))


#: DuckDB SQL: an audit entry's text before and after its predecessor's hash, as Python's json module writes it.
HEAD = """concat('{"action":"', action, '","actor":"', actor, '","details":{"note":"', CASE WHEN seq % 3 = 0 THEN 'caf\\u00e9 \\ud83d\\ude00 \\"q\\"\\n' ELSE 'plain' END, '","seq":"', seq, '"},"prev_hash":"')"""
TAIL = """concat('","tenant":"', tenant, '","timestamp":"', seq, '"}')"""


def audit_entries(spark, sf) -> DataFrame:
    note = F.when(F.col("seq") % 3 == 0, 'café 😀 "q"\n').otherwise("plain")
    log = view(spark, sf, "log").select("seq", F.col("seq").cast("string").alias("timestamp"), "tenant", F.col("actor").cast("string").alias("actor"), "action", F.create_map(F.lit("seq"), F.col("seq").cast("string"), F.lit("note"), note).alias("details"))
    return log


@query("audit_files", f"""WITH RECURSIVE {ctes('log')}, p AS (SELECT tenant, row_number() OVER (PARTITION BY tenant ORDER BY seq) AS n, {HEAD} AS a, {TAIL} AS b FROM log),
  c(tenant, n, h) AS (SELECT tenant, n, sha256(concat(repeat('0', 64), a, repeat('0', 64), b)) FROM p WHERE n = 1 UNION ALL SELECT p.tenant, p.n, sha256(concat(c.h, a, c.h, b)) FROM c JOIN p ON p.tenant = c.tenant AND p.n = c.n + 1)
  SELECT tenant, count(*) AS entries, -1 AS broken_at, arg_max(h, n) AS last_hash FROM c GROUP BY tenant""")
def audit_files(spark, sf):
    said = js.audit_payload(*map(F.col, ("timestamp", "tenant", "actor", "action", "details")))
    path = folder(spark, "files")
    writers.append_audit(wi.chained(audit_entries(spark, sf).withColumn("payload", said), "tenant", "seq", "payload").drop("payload", "seq"), path)
    read = readers.read_audit(spark, path).withColumn("payload", said).withColumn("seq", F.col("timestamp").cast("bigint"))
    state = wi.verify(read, "tenant", "seq", "payload").select("tenant", "entries", F.coalesce("broken_at", F.lit(-1)).alias("broken_at"))
    return state.join(wi.tail_hash(read, "tenant", "seq"), "tenant")


@query("snapshot_files", f"WITH {ctes('exposed')} SELECT 'exposes' AS kind, service AS src, cve_id AS dst FROM exposed")
def snapshot_files(spark, sf):
    item = F.struct(F.col("service").alias("from"), F.col("cve_id").alias("to"))
    path = documents(view(spark, sf, "exposed"), "floor(substr(cve_id, 5) / 100)", item, lambda items: F.to_json(F.struct(F.create_map(F.lit("exposes"), items).alias("edges"))))
    return readers.read_snapshot_edges(spark, path)


@query("graph_tables", f"WITH {ctes('exposed')} SELECT 'cve' AS label, cve_id AS id, count(DISTINCT service) AS degree FROM exposed GROUP BY cve_id UNION ALL SELECT 'service', service, count(DISTINCT cve_id) FROM exposed GROUP BY service")
def graph_tables(spark, sf):
    e, path = view(spark, sf, "exposed").select(F.lit("exposes").alias("kind"), F.col("service").alias("src"), F.col("cve_id").alias("dst")), folder(spark, "files")
    nodes = e.select(F.lit("service").alias("label"), F.col("src").alias("id")).unionByName(e.select(F.lit("cve").alias("label"), F.col("dst").alias("id")))
    writers.write_graph(nodes, e.unionByName(e), path)
    held, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return held.select("label", "id").join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id")


@query("patch_cache_tables", f"WITH {ctes('symbols')} SELECT DISTINCT cve_id, CASE WHEN seq % 8 = 1 THEN 'new' ELSE 'old' END AS status FROM symbols")
def patch_cache(spark, sf):
    rows, path = view(spark, sf, "symbols").select("cve_id", "seq").distinct(), folder(spark, "files")
    old, new = rows.select("cve_id", F.lit("old").alias("status")), rows.select("cve_id", F.when(F.col("seq") % 8 == 1, "new").otherwise("old").alias("status"))
    writers.write_patches(old, path)
    writers.write_patches(new, path)
    return spark.read.parquet(path).select("cve_id", "status")


@query("read_patch_files", f"WITH {ctes('symbols')} SELECT cve_id, max(package) AS package, 'ok' AS status, count(*) AS n_symbols, min(fqn) AS least FROM symbols WHERE seq % 3 > 0 GROUP BY cve_id")
def read_patch_files(spark, sf):
    """A file of its own for each patch, of which those of a third of the ids are corrupt and skipped."""
    s, path = view(spark, sf, "symbols"), folder(spark, "files")
    named = s.groupBy("cve_id").agg(F.max("package").alias("package"), F.min("seq").alias("seq"), F.collect_list(F.struct(F.col("fqn").alias("fully_qualified_name"), "short_name")).alias("vulnerable_symbols"))
    text = F.to_json(F.struct("cve_id", "package", F.lit("ok").alias("status"), "vulnerable_symbols"))
    writers.write_patch_files(named.select("cve_id", F.when(F.col("seq") % 3 == 0, F.lit('{"cve_id": ')).otherwise(text).alias("text")), path)
    read = readers.read_patches(spark, path)
    return read.select("cve_id", "package", "status", F.size("vulnerable_symbols").cast("long").alias("n_symbols"), F.array_min(F.transform("vulnerable_symbols", lambda x: x["fully_qualified_name"])).alias("least"))


@query("patch_lookup", "SELECT concat('CVE-', p_partkey) AS cve_id, CASE WHEN p_partkey % 5 = 0 THEN 'not_fetched' WHEN p_partkey % 3 = 0 THEN 'no_patch_found' ELSE 'ok' END AS status, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 3 > 0 THEN concat('c', p_partkey) END AS patch_commit FROM part WHERE p_partkey % 2 = 0")
def patch_lookup(spark, sf):
    part, path = view(spark, sf, "part"), folder(spark, "files")
    found = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("c"), F.col("p_partkey").cast("string")))
    writers.write_patches(part.filter("p_partkey % 5 > 0").select(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cve_id"), F.when(F.col("p_partkey") % 3 == 0, "no_patch_found").otherwise("ok").alias("status"), found.alias("patch_commit")), path)
    asked = part.filter("p_partkey % 2 = 0").select(F.concat(F.when(F.col("p_partkey") % 4 == 0, "cve-").otherwise("CVE-"), F.col("p_partkey").cast("string")).alias("cve_id"))
    return readers.lookup_patches(spark, path, asked.unionByName(asked))


@query("scan_cache_tables", "SELECT p_partkey AS id, 2 AS n FROM part")
def scan_cache(spark, sf):
    rows, path = view(spark, sf, "part").select(F.col("p_partkey").alias("id")), folder(spark, "files")
    for _ in range(2):
        writers.append_cache(rows, path)
    return spark.read.parquet(path).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("json_documents", f"WITH {ctes('findings')} SELECT row_id, cve_id, severity, cvss_score FROM findings")
def json_documents(spark, sf):
    rows, path = view(spark, sf, "findings").select("row_id", "cve_id", "severity", "cvss_score"), folder(spark, "files")
    writers.write_json(rows, path, ["cve_id", "row_id"])
    return spark.read.schema(rows.schema).json(path)


@query("export_files", f"WITH {ctes('findings')} SELECT 'sarif' AS export, count(*) AS n FROM findings UNION ALL SELECT 'vex', count(*) FROM findings WHERE row_id % 2 = 0 UNION ALL SELECT 'cyclonedx', count(*) FROM findings WHERE row_id % 3 = 0")
def export_files(spark, sf):
    f, path = view(spark, sf, "findings").select("row_id", "cve_id"), folder(spark, "files")
    writers.write_exports(f, f.filter("row_id % 2 = 0"), f.filter("row_id % 3 = 0"), path)
    n = lambda k: spark.read.schema(f.schema).json(f"{path}/{k}").agg(F.count("cve_id").alias("n")).select(F.lit(k).alias("export"), "n")
    return n("sarif").unionByName(n("vex")).unionByName(n("cyclonedx"))


@query("flywheel_file", f"WITH {ctes('findings')} SELECT (SELECT count(*) FROM findings) AS total_scans, severity, count(*) AS n FROM findings GROUP BY severity")
def flywheel(spark, sf):
    by, path = view(spark, sf, "findings").groupBy("severity").agg(F.count(F.lit(1)).alias("n")), folder(spark, "files")
    store = by.agg(F.sum("n").alias("total_scans"), F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("recommendations"))  # a handful of severities
    writers.write_json(store, path)
    return readers.read_flywheel(spark, path).select("total_scans", F.explode("recommendations").alias("severity", "n"))


@query("rule_texts", "SELECT concat('r', p_partkey) AS rule_id, concat('rules:', chr(10), '  - id: r', p_partkey, chr(10), '    languages: [python]', chr(10), '    severity: ERROR', chr(10), '    message: m', chr(10), '    pattern-either:', chr(10), '      - pattern: a', p_partkey % 4, '(...)', chr(10), '      - pattern: b(...)', chr(10)) AS text FROM part")
def rule_texts(spark, sf):
    return writers.rule_yaml(view(spark, sf, "part").selectExpr("concat('r', p_partkey) as rule_id", "'python' as language", "'ERROR' as severity", "'m' as message", "array(concat('a', p_partkey % 4, '(...)'), 'b(...)') as patterns"))


@query("rules_of_weakness", f"WITH {ctes('rules')} SELECT cwe, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM rules GROUP BY cwe")
def rules_of_weakness(spark, sf):
    rows = view(spark, sf, "rules").select("rule_id", "language", "severity", F.array(F.concat(F.lower("cwe"), F.lit(": a name")), F.lit("none")).alias("cwe"))
    return readers.rules_by_cwe(rows).select("cwe", F.array_join(F.transform("rules", lambda r: r["rule_id"]), ",").alias("rules"))
