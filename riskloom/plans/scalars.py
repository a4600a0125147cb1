"""Queries of the scalar functions and line scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions import versions as ve
from riskloom.plans.analogs import CLAUSE, MEETS, ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


NAMES = "SELECT p_partkey AS id, concat('_My.', p_name, '__Lib-', p_partkey % 9, '-') AS name FROM {part}"


@query("name_normalise", f"""WITH n AS ({NAMES.replace("{part}", "part")}) SELECT id, lower(regexp_replace(name, '[-_.]+', '-', 'g')) AS pep503, regexp_replace(lower(regexp_replace(name, '[-_.]+', '-', 'g')), '^-+|-+$', '', 'g') AS dist,
  regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS alnum, replace(lower(name), '-', '_') AS import_name FROM n""")
def names(spark, sf):
    n = spark.sql(NAMES, part=view(spark, sf, "part"))
    c = F.col("name")
    return n.select("id", tx.normalize_name(c).alias("pep503"), tx.normalize_dist(c).alias("dist"), tx.alnum_name(c).alias("alnum"), tx.import_name(c).alias("import_name"))


@query("cwe_extract", "SELECT p_partkey AS id, upper(regexp_extract(concat('see cwe-', p_partkey, ': text'), '(?i)(CWE-[0-9]+)', 1)) AS cwe FROM part")
def cwe(spark, sf):
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.cwe_id(F.concat(F.lit("see cwe-"), F.col("p_partkey").cast("string"), F.lit(": text"))).alias("cwe"))


URLS = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('https://github.com/org', CAST(p_partkey % 17 AS STRING), '/repo/commit/', substr(md5(CAST(p_partkey AS STRING)), 1, 20)) WHEN 1 THEN concat('http://github.com/o/r/pull/', CAST(p_partkey AS STRING), '/commits/', md5(CAST(p_partkey AS STRING))) ELSE concat('https://example.com/', CAST(p_partkey AS STRING)) END AS url FROM {part}"
COMMIT = r"'github\.com/([^/]+)/([^/]+)/(?:commit|pull/[0-9]+/commits)/([0-9a-f]{7,40})'"


@query("commit_url_parse", f"""WITH u AS ({URLS.replace("{part}", "part")}), p AS (SELECT id, url, regexp_extract(url, {COMMIT}, 1) AS owner, regexp_extract(url, {COMMIT}, 2) AS repo, regexp_extract(url, {COMMIT}, 3) AS sha FROM u)
  SELECT id, owner, repo, sha, substr(sha, 1, 12) AS short, CASE WHEN sha <> '' THEN concat('https://github.com/', owner, '/', repo, '/commit/', sha) ELSE url END AS canonical FROM p""")
def commit_urls(spark, sf):
    p = tx.commit_parts(F.col("url"))
    return spark.sql(URLS, part=view(spark, sf, "part")).select("id", *[c.alias(k) for k, c in p.items()], F.substring(p["sha"], 1, 12).alias("short"), tx.canonical_commit(F.col("url")).alias("canonical"))


@query("github_url_normalise", r"""SELECT p_partkey AS id, regexp_replace(regexp_replace(regexp_replace(concat('git@github.com:o/r', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '.git' ELSE '/' END), '^git@github\.com:', 'https://github.com/'), '/+$', ''), '\.git$', '') AS url FROM part""")
def github(spark, sf):
    raw = F.concat(F.lit("git@github.com:o/r"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".git").otherwise("/"))
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.github_url(raw).alias("url"))


@query("path_fqn_clean", """WITH s AS (SELECT p_partkey AS id, ['src', concat('a', p_partkey % 3), concat('a', p_partkey % 2), 'lib', 'b', 'b', concat('f', p_partkey % 5)] AS x FROM part), k AS (SELECT id, list_filter(x, lambda s: s NOT IN ('src', 'lib', 'lib2', 'lib3')) AS x FROM s)
  SELECT id, array_to_string(list_filter(x, lambda s, i: i = 1 OR x[i - 1] <> s), '.') AS fqn FROM k""")
def fqn(spark, sf):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("src.a"), (k % 3).cast("string"), F.lit(".a"), (k % 2).cast("string"), F.lit(".lib.b.b.f"), (k % 5).cast("string"))
    return view(spark, sf, "part").select(k.alias("id"), tx.clean_fqn(raw).alias("fqn"))


@query("module_from_path", r"""WITH p AS (SELECT p_partkey AS id, concat('pkg/m', p_partkey % 20, CASE WHEN p_partkey % 3 = 0 THEN '/__init__.py' ELSE '/x.py' END) AS p FROM part) SELECT id, regexp_replace(replace(regexp_replace(p, '\.py$', ''), '/', '.'), '\.__init__$', '') AS module FROM p""")
def modules(spark, sf):
    p = view(spark, sf, "part").selectExpr("p_partkey as id", "concat('pkg/m', p_partkey % 20, if(p_partkey % 3 = 0, '/__init__.py', '/x.py')) as p")
    return p.select("id", tx.module_name(F.col("p")).alias("module"))


@query("cve_id_extract", r"""WITH t AS (SELECT conv_id, turn, concat(text, ' CVE-2023-', 10000 + turn, ' cve-2024-', 20000 + turn % 3, ' CVE-2023-', 10000 + turn) AS t FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(t), '(CVE-[0-9]{4}-[0-9]{4,})', 1))), ',') AS cves FROM t""")
def cve_extract(spark, sf):
    t = view(spark, sf, "conversations").selectExpr("conv_id", "turn", "concat(text, ' CVE-2023-', 10000 + turn, ' cve-2024-', 20000 + turn % 3, ' CVE-2023-', 10000 + turn) as t")
    return t.select("conv_id", "turn", F.array_join(F.array_sort(tx.cve_ids(F.col("t"))), ",").alias("cves"))


@query("version_literals", f"WITH {ctes('requires')} SELECT row_id, array_to_string(regexp_extract_all(concat(spec, ',!=1.2.3'), '([0-9]+(?:\\.[0-9]+)*)', 1), ' ') AS literals FROM requires")
def literals(spark, sf):
    return view(spark, sf, "requires").select("row_id", F.array_join(tx.version_literals(F.concat("spec", F.lit(",!=1.2.3"))), " ").alias("literals"))


@query("version_sort", f"""WITH {ctes("findings")}, v AS (SELECT package, installed_version AS v, list_transform(string_split(installed_version, '.'), lambda x: x::INT) AS k FROM findings) SELECT package, arg_max(v, k) AS newest, arg_min(v, k) AS oldest FROM v GROUP BY package""")
def version_sort(spark, sf):
    k = ve.release_key(F.col("installed_version"))
    return view(spark, sf, "findings").withColumn("k", k).groupBy("package").agg(F.max_by("installed_version", "k").alias("newest"), F.min_by("installed_version", "k").alias("oldest"))


@query("specifier_satisfied", f"""WITH {ctes("requires")}, s AS (SELECT row_id, spec, {CLAUSE}, [(row_id % 6)::INT, (row_id % 3)::INT, CASE WHEN row_id % 4 = 1 THEN -1 ELSE 0 END] AS v FROM requires) SELECT row_id, {MEETS} AS satisfied FROM s""")
def satisfied(spark, sf):
    v = F.concat((F.col("row_id") % 6).cast("string"), F.lit("."), (F.col("row_id") % 3).cast("string"), F.when(F.col("row_id") % 4 == 1, "rc1").otherwise(""))
    return view(spark, sf, "requires").select("row_id", ve.satisfies(v, F.col("spec")).alias("satisfied"))


RUNS = f"{CLAUSE}, [3, 9, 0] AS v"


@query("python_requires_compatible", f"""WITH {ctes("requires")}, s AS (SELECT row_id, {RUNS} FROM requires) SELECT row_id, {MEETS} AS compatible FROM s""")
def python_requires(spark, sf):
    return view(spark, sf, "requires").select("row_id", ve.satisfies(F.lit("3.9"), F.col("spec")).alias("compatible"))


@query("runtime_conflicts", f"""WITH {ctes("requires")}, s AS (SELECT DISTINCT package, spec, {RUNS} FROM requires WHERE row_id % 3 = 0 AND package IN (SELECT dep FROM requires)) SELECT package, spec FROM s WHERE NOT {MEETS}""")
def runtime_conflicts(spark, sf):
    r = view(spark, sf, "requires")
    return r.filter("row_id % 3 = 0").join(r.select(F.col("dep").alias("package")).distinct(), "package", "left_semi").filter(~ve.satisfies(F.lit("3.9"), F.col("spec"))).select("package", "spec").distinct()


@query("major_jump", f"WITH {ctes('tree_current', 'tree_target')} SELECT package, string_split(t.version, '.')[1]::INT > string_split(c.version, '.')[1]::INT AS jump FROM tree_current c JOIN tree_target t USING (package)")
def jump(spark, sf):
    both = view(spark, sf, "tree_current").withColumnRenamed("version", "a").join(view(spark, sf, "tree_target").withColumnRenamed("version", "b"), "package")
    return both.select("package", tx.major_jump(F.col("a"), F.col("b")).alias("jump"))


@query("html_escape", """SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'))::BIGINT AS n, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM pages""")
def html_escape(spark, sf):
    e = tx.escape_html(F.col("html"))
    return view(spark, sf, "pages").select("page_id", F.length(e).cast("bigint").alias("n"), F.md5(e).alias("digest"))


@query("fence_strip", r"""WITH t AS (SELECT conv_id, turn, concat('```yaml', chr(10), text, chr(10), '```') AS t FROM conversations) SELECT conv_id, turn, md5(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT starts_with(ltrim(x), '```')), chr(10))) AS digest FROM t""")
def fences(spark, sf):
    t = F.concat(F.lit("```yaml\n"), "text", F.lit("\n```"))
    return view(spark, sf, "conversations").select("conv_id", "turn", F.md5(tx.strip_fences(t)).alias("digest"))


@query("backoff_seconds", r"""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('rate limit, retry in ', event_id % 60, '.5s') ELSE 'error' END AS e, event_id % 5 AS n FROM events) SELECT event_id, CASE WHEN regexp_matches(e, 'retry in') THEN regexp_extract(e, 'retry in ([0-9]+(?:\.[0-9]+)?)s', 1)::DOUBLE ELSE pow(2e0, n) END AS seconds FROM e""")
def backoff(spark, sf):
    e = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("rate limit, retry in "), (F.col("event_id") % 60).cast("string"), F.lit(".5s"))).otherwise("error")
    return view(spark, sf, "events").select("event_id", tx.backoff_seconds(e, F.col("event_id") % 5).alias("seconds"))


@query("cache_freshness", "SELECT event_id, ts > TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY AS fresh FROM events")
def freshness(spark, sf):
    return view(spark, sf, "events").select("event_id", tx.fresh(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("2024-02-10 00:00:00").cast("timestamp")).alias("fresh"))


@query("file_digest_key", "SELECT doc_id, sha256(concat('scan@1:', sha256(text))) AS key FROM documents")
def digest(spark, sf):
    return view(spark, sf, "documents").select("doc_id", tx.cache_key(F.col("text"), "scan", "1").alias("key"))


@query("purl_and_ids", f"WITH {ctes('findings')} SELECT row_id, concat('pkg:pypi/', lower(trim(package)), CASE WHEN installed_version <> '' THEN concat('@', installed_version) ELSE '' END) AS purl, concat_ws(':', 'pkg', concat(package, '@', installed_version)) AS node, concat_ws(':', 'cve', cve_id) AS cve_node FROM findings")
def purls(spark, sf):
    return view(spark, sf, "findings").select("row_id", tx.purl(F.col("package"), F.col("installed_version")).alias("purl"), tx.node_id("pkg", F.concat("package", F.lit("@"), "installed_version")).alias("node"), tx.node_id("cve", F.col("cve_id")).alias("cve_node"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return view(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("requirement_line_parse", r"""WITH l AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '# note' WHEN 1 THEN concat('Pkg_', p_partkey, '[x]==1.', p_partkey % 9, '  # c') WHEN 2 THEN '-e ./local' WHEN 3 THEN concat('other>=', p_partkey % 4) ELSE concat('lib.', p_partkey, ' == 2.0') END AS line FROM part)
  SELECT id, lower(regexp_replace(regexp_extract(line, '^([A-Za-z0-9._-]+)(\[[^\]]*\])?\s*==\s*([^\s#;]+)', 1), '[-_.]+', '-', 'g')) AS package, regexp_extract(line, '^([A-Za-z0-9._-]+)(\[[^\]]*\])?\s*==\s*([^\s#;]+)', 3) AS version FROM l WHERE regexp_matches(line, '^([A-Za-z0-9._-]+)(\[[^\]]*\])?\s*==\s*([^\s#;]+)')""")
def requirement_lines(spark, sf):
    from riskloom.sources.readers import pins_of_lines

    lines = view(spark, sf, "part").selectExpr("p_partkey as id", "case p_partkey % 5 when 0 then '# note' when 1 then concat('Pkg_', p_partkey, '[x]==1.', p_partkey % 9, '  # c') when 2 then '-e ./local' when 3 then concat('other>=', p_partkey % 4) else concat('lib.', p_partkey, ' == 2.0') end as line")
    return pins_of_lines(lines).select("id", "package", "version")


@query("line_scan_regex", r"""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\s*The\b') THEN 'start' WHEN regexp_matches(line, '\bLicensed\b') THEN 'license' ELSE 'mail' END AS pattern FROM l
  WHERE regexp_matches(line, '^\s*The\b') OR regexp_matches(line, '\bLicensed\b') OR regexp_matches(line, '[a-z]@[a-z]')""")
def line_scan(spark, sf):
    from riskloom.operators.extract import scan_lines

    hits = scan_lines(view(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text"), [("start", r"^\s*The\b"), ("license", r"\bLicensed\b"), ("mail", "[a-z]@[a-z]")])
    return hits.select(F.col("file").alias("doc_id"), "line_no", "pattern")


@query("import_scan_totals", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS hits, true AS is_used FROM l WHERE regexp_matches(line, '\bLicensed\b') GROUP BY doc_id""")
def import_scan(spark, sf):
    from riskloom.operators.extract import scan_lines

    return scan_lines(view(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text"), [("license", r"\bLicensed\b")]).groupBy(F.col("file").alias("doc_id")).agg(F.count(F.lit(1)).alias("hits"), F.lit(True).alias("is_used"))


@query("hardening_predicate", "WITH p AS (SELECT part.p_partkey AS id, ['x = 1', concat('raise E', p_partkey % 2)] AS b, list_concat(['x = 1', concat('raise E', p_partkey % 2)], CASE WHEN p_partkey % 3 = 0 THEN ['if not ok:', '# why'] ELSE ['y = 2'] END) AS a FROM part) SELECT id, len(list_filter(a, lambda l: NOT list_contains(b, l) AND NOT regexp_matches(l, '^#|if not|raise'))) = 0 AS hardened FROM p")
def hardening(spark, sf):
    p = view(spark, sf, "part").selectExpr("p_partkey as id", "array('x = 1', concat('raise E', p_partkey % 2)) as b", "concat(array('x = 1', concat('raise E', p_partkey % 2)), if(p_partkey % 3 = 0, array('if not ok:', '# why'), array('y = 2'))) as a")
    return p.select("id", F.forall(F.array_except("a", "b"), lambda x: x.rlike("^#|if not|raise")).alias("hardened"))


@query("ignore_globs", "SELECT page_id, list_has_any(string_split(url, '/'), ['www', 'blog', 'docs']) OR regexp_matches(url, '/(test|item)[^/]*$') AS ignored FROM pages")
def ignores(spark, sf):
    parts = F.split("url", "/")
    return view(spark, sf, "pages").select("page_id", (F.arrays_overlap(parts, F.array(F.lit("www"), F.lit("blog"), F.lit("docs"))) | F.col("url").rlike("/(test|item)[^/]*$")).alias("ignored"))


@query("diff_header_names", r"""WITH h AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('@@ -1,2 +1,3 @@ def f', p_partkey, '(a):') WHEN 1 THEN concat('@@ -1 +1 @@ class C', p_partkey, ':') ELSE '@@ -1 +1 @@' END AS h FROM part) SELECT id, regexp_extract(h, '(?:def|class)\s+([A-Za-z_]\w*)', 1) AS name, CASE WHEN contains(h, 'class ') THEN 'class' WHEN contains(h, 'def ') THEN 'function' ELSE '' END AS kind FROM h""")
def headers(spark, sf):
    h = view(spark, sf, "part").selectExpr("p_partkey as id", "case p_partkey % 3 when 0 then concat('@@ -1,2 +1,3 @@ def f', p_partkey, '(a):') when 1 then concat('@@ -1 +1 @@ class C', p_partkey, ':') else '@@ -1 +1 @@' end as h")
    name, kind = tx.defined_name(F.col("h"))
    return h.select("id", name.alias("name"), kind.alias("kind"))


@query("number_format", "SELECT p_partkey AS id, printf('%.2f', p_retailprice) AS n, concat(printf('%.1f', p_size / 50e0 * 100), '%') AS pct FROM part")
def number_format(spark, sf):
    return view(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.format_string("%.2f", "p_retailprice").alias("n"), F.concat(F.format_string("%.1f", F.col("p_size") / 50.0 * 100), F.lit("%")).alias("pct"))


@query("reproducibility_hash", f"WITH {ctes('findings')} SELECT package, substr(sha256(concat(string_agg(DISTINCT cve_id, ',' ORDER BY cve_id), '|repo')), 1, 16) AS hash FROM findings GROUP BY package")
def repro(spark, sf):
    return view(spark, sf, "findings").groupBy("package").agg(F.substring(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set("cve_id")), ","), F.lit("|repo")), 256), 1, 16).alias("hash"))


@query("vector_dot_product", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (i % 7 + 1))), 3) AS score FROM embeddings")
def dot(spark, sf):
    return view(spark, sf, "embeddings").select("vec_id", F.round(F.expr("aggregate(transform(embedding, (x, i) -> cast(x as double) * ((i + 1) % 7 + 1)), 0d, (a, x) -> a + x)"), 3).alias("score"))
