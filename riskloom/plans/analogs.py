"""Views that give the TPC-H-like tables the shape of risk data, in SQL that Spark and DuckDB read alike.

A view is named with its tables in braces; the same text becomes a DataFrame on Spark and a common table expression of
the DuckDB counterparts. All numbers come from keys by plain arithmetic, and literals are doubles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "findings": """
        SELECT p_partkey AS row_id, concat('CVE-', CAST(CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 1 ELSE p_partkey END AS STRING)) AS cve_id,
               p_brand AS package, concat(CAST(p_partkey % 4 + 1 AS STRING), '.', CAST(p_partkey % 11 AS STRING), '.', CAST(p_partkey % 7 AS STRING)) AS installed_version,
               CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat(CAST(p_partkey % 5 + 1 AS STRING), '.', CAST(p_partkey % 13 AS STRING), '.0, 9.9.9') END AS fixed_version,
               CASE WHEN p_size >= 45 THEN 'CRITICAL' WHEN p_size >= 35 THEN 'HIGH' WHEN p_size >= 20 THEN 'MEDIUM' WHEN p_size >= 5 THEN 'LOW' ELSE 'NEGLIGIBLE' END AS severity,
               p_size / 5e0 AS cvss_score,
               CASE p_partkey % 5 WHEN 0 THEN 'network' WHEN 1 THEN 'adjacent' WHEN 2 THEN 'local' WHEN 3 THEN 'physical' END AS attack_vector,
               CASE p_partkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'high' END AS privileges_required,
               p_partkey % 3 = 0 AS user_interaction,
               CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'none' END AS confidentiality,
               CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS integrity,
               CASE p_partkey % 8 WHEN 0 THEN 'high' WHEN 3 THEN 'none' END AS availability,
               CASE WHEN p_partkey % 10 = 9 THEN '' ELSE concat('CWE-', CASE p_partkey % 9 WHEN 0 THEN '89' WHEN 1 THEN '79' WHEN 2 THEN '22' WHEN 3 THEN '78' WHEN 4 THEN '502' WHEN 5 THEN '20' WHEN 6 THEN '400' WHEN 7 THEN '9999' ELSE '287' END) END AS cwe
        FROM {part}""",
    "epss": """
        SELECT concat('CVE-', CAST(p_partkey AS STRING)) AS cve_id, ((p_partkey * 37) % 1000) / 1009e0 AS epss, ((p_partkey * 53) % 1000) / 1009e0 AS percentile
        FROM {part} WHERE p_partkey % 4 <> 3""",
    "kev": "SELECT concat('CVE-', CAST(p_partkey AS STRING)) AS cve_id FROM {part} WHERE p_partkey % 97 = 0",
    "reach": """
        SELECT concat('CVE-', CAST(l_partkey AS STRING)) AS cve_id, concat('svc-', CAST(l_suppkey AS STRING)) AS service, concat('fn', CAST(l_partkey % 50 AS STRING)) AS vuln_fn,
               concat('src/m', CAST(l_orderkey % 9 AS STRING), '.py') AS file, CAST(l_orderkey % 400 AS INT) AS line_start, l_linenumber AS hops,
               CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'LOW' END AS confidence, l_linestatus = 'O' AS tainted,
               CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq
        FROM {lineitem} WHERE l_partkey % 3 = 0 AND l_quantity > 30e0""",
    "exposed": """
        SELECT DISTINCT concat('CVE-', CAST(l_partkey AS STRING)) AS cve_id, concat('svc-', CAST(l_suppkey AS STRING)) AS service
        FROM {lineitem} WHERE l_partkey % 2 = 0 AND l_quantity > 44e0""",
    "tree_current": """
        SELECT concat('pkg', CAST(l_partkey AS STRING)) AS package, concat(CAST(max(l_linenumber) AS STRING), '.', CAST(count(*) % 10 AS STRING)) AS version
        FROM {lineitem} WHERE l_returnflag = 'A' AND l_partkey % 4 <> 0 GROUP BY l_partkey""",
    "tree_target": """
        SELECT concat('pkg', CAST(l_partkey AS STRING)) AS package, concat(CAST(max(l_linenumber) AS STRING), '.', CAST(count(*) % 10 AS STRING)) AS version
        FROM {lineitem} WHERE l_returnflag = 'N' AND l_partkey % 5 <> 0 GROUP BY l_partkey""",
    "cases": """
        SELECT d.doc_id, d.lang, d.source, l.quality = 0 AS y_true, least(d.n_chars / 5000e0, 1e0) AS y_prob, d.n_chars > 2500 AS y_pred, d.n_chars
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "calls": """
        SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM {part}) AS dst FROM {part} WHERE p_partkey % 2 = 0
        UNION ALL SELECT p_partkey, (p_partkey * 11 + 5) % (SELECT count(*) FROM {part}) FROM {part} WHERE p_partkey % 3 = 0""",
    "requires": """
        SELECT concat('pkg', CAST(p_partkey AS STRING)) AS package, concat('pkg', CAST(CAST(greatest(floor((p_partkey + 1) / 3e0) - 1, 0e0) AS BIGINT) AS STRING)) AS dep,
               concat(CASE p_partkey % 9 WHEN 0 THEN '>=' WHEN 1 THEN '<' WHEN 2 THEN '~=' WHEN 3 THEN '!=' WHEN 4 THEN '>' WHEN 5 THEN '<=' WHEN 7 THEN '!=' ELSE '==' END, CAST(p_partkey % 5 + 1 AS STRING),
                      CASE WHEN p_partkey % 9 >= 7 THEN '.*' ELSE concat('.', CAST(p_partkey % 4 AS STRING)) END, CASE WHEN p_partkey % 9 < 7 AND p_partkey % 7 = 2 THEN 'rc1' ELSE '' END) AS spec, p_partkey AS row_id
        FROM {part}
        UNION ALL
        SELECT concat('pkg', CAST(p_partkey AS STRING)), concat('pkg', CAST(CAST(floor(p_partkey / 5e0) AS BIGINT) AS STRING)), concat('<=', CAST(p_partkey % 6 + 2 AS STRING), '.0'), p_partkey + 1000000000000
        FROM {part} WHERE p_partkey % 2 = 0
        UNION ALL
        SELECT concat('pkg', CAST(p_partkey AS STRING)), concat('pkg', CAST(p_partkey * 3 + 2 AS STRING)), concat('>=', CAST(p_partkey % 3 AS STRING), '.1'), p_partkey + 2000000000000
        FROM {part} WHERE p_partkey % 10 = 1""",
    "rules": """
        SELECT p_partkey AS row_id, concat('CWE-', CASE p_partkey % 6 WHEN 0 THEN '89' WHEN 1 THEN '79' WHEN 2 THEN '22' WHEN 3 THEN '78' WHEN 4 THEN '502' ELSE '20' END) AS cwe,
               concat('rule-', CAST(p_partkey AS STRING)) AS rule_id, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'generic' END AS language,
               CASE p_partkey % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity
        FROM {part} WHERE p_partkey % 10 = 1""",
    "symbols": """
        SELECT concat('CVE-', CAST(p_partkey AS STRING)) AS cve_id, p_brand AS package, concat(lower(replace(p_brand, '#', '')), '.mod', CAST(p_partkey % 12 AS STRING), '.fn', CAST(p_partkey % 31 AS STRING)) AS fqn,
               concat('fn', CAST(p_partkey % 31 AS STRING)) AS short_name, p_partkey AS seq,
               CASE p_partkey % 7 WHEN 0 THEN 'REMOVED' WHEN 1 THEN 'ADDED' WHEN 2 THEN 'SIGNATURE_CHANGED' WHEN 3 THEN 'HARDENED_ONLY' WHEN 4 THEN 'RETURN_TYPE_CHANGED' WHEN 5 THEN 'DEFAULT_CHANGED' ELSE 'MODIFIED' END AS change_type
        FROM {part} WHERE p_partkey % 4 = 1""",
    "refs": """
        SELECT concat('CVE-', CAST(l_partkey AS STRING)) AS cve_id, CASE l_linenumber % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'import' ELSE 'attribute' END AS kind,
               concat('app/f', CAST(l_suppkey AS STRING), '.py') AS file, CAST(l_orderkey % 300 + 1 AS INT) AS line, l_linenumber AS col,
               CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'LOW' END AS confidence, concat('m.fn', CAST(l_partkey % 31 AS STRING)) AS fqn,
               CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq, l_linestatus = 'O' AS in_entry_point
        FROM {lineitem} WHERE l_partkey % 8 = 1 AND l_quantity > 25e0""",
    "log": "SELECT event_id AS seq, concat('tenant', CAST(user_id % 7 AS STRING)) AS tenant, event_type AS action, user_id AS actor, value, props FROM {events}",
}


def _tables(sql: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", sql))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of its name where there is none, over the tables in sf_dir."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(sql)})


def ctes(*names: str) -> str:
    """The views as common table expressions, to follow WITH."""
    return ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in names)


#: DuckDB SQL: a clause of requires as op, b (its version) and wild, and whether the version v meets it. Versions are [major, minor, 0], or [major, minor, -1] for a pre-release.
CLAUSE = (
    "regexp_extract(spec, '^(~=|[=<>!]+)', 1) AS op, spec LIKE '%.*' AS wild,"
    " [regexp_extract(spec, '^[~=<>!]+([0-9]+)', 1)::INT, coalesce(try_cast(regexp_extract(spec, '\\.([0-9]+)', 1) AS INT), 0), CASE WHEN spec LIKE '%rc1' THEN -1 ELSE 0 END] AS b"
)
MEETS = (
    "CASE WHEN wild THEN (v[1] = b[1]) = (op = '==') WHEN op = '>=' THEN v >= b WHEN op = '<=' THEN v <= b WHEN op = '==' THEN v = b WHEN op = '!=' THEN v <> b WHEN op = '>' THEN v > b"
    " WHEN op = '~=' THEN v >= b AND v[1] = b[1] ELSE v < b AND NOT (b[3] = 0 AND v[1:2] = b[1:2]) END"
)


def numbers(version: str) -> str:
    """DuckDB SQL: a version's text as such a list."""
    return f"[string_split({version}, '.')[1]::INT, regexp_extract({version}, '\\.([0-9]+)', 1)::INT, CASE WHEN {version} LIKE '%rc1' THEN -1 ELSE 0 END]"
