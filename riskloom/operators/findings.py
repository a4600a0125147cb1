"""Findings: flattening raw scans, CVSS vectors, severity filter, CWE families, first rows, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The family of each weakness.
CWE_FAMILY = {
    "CWE-89": "sql_injection", "CWE-564": "sql_injection", "CWE-79": "xss", "CWE-87": "xss", "CWE-22": "path_traversal", "CWE-23": "path_traversal",
    "CWE-36": "path_traversal", "CWE-78": "os_command_injection", "CWE-77": "os_command_injection", "CWE-94": "code_injection", "CWE-95": "code_injection",
    "CWE-74": "injection", "CWE-502": "deserialization", "CWE-611": "xxe", "CWE-20": "input_validation", "CWE-798": "hardcoded_credentials",
    "CWE-522": "weak_credentials", "CWE-400": "resource_exhaustion", "CWE-770": "resource_exhaustion", "CWE-674": "resource_exhaustion",
    "CWE-407": "resource_exhaustion", "CWE-287": "auth_bypass", "CWE-306": "auth_bypass", "CWE-862": "missing_authorization", "CWE-276": "incorrect_permissions",
    "CWE-120": "buffer_overflow", "CWE-125": "buffer_overflow", "CWE-787": "buffer_overflow", "CWE-190": "integer_overflow", "CWE-476": "null_dereference",
    "CWE-640": "weak_password_recovery", "CWE-319": "cleartext_transmission", "CWE-539": "session_management", "CWE-524": "information_exposure",
    "CWE-203": "information_exposure", "CWE-1321": "prototype_pollution", "CWE-494": "integrity_check", "CWE-117": "log_injection", "CWE-843": "type_confusion",
    "CWE-385": "timing_attack",
}
IGNORED = ("LOW", "NEGLIGIBLE")
CVSS_WORDS = {"AV": {"N": "network", "A": "adjacent", "L": "local", "P": "physical"}, "PR": {"N": "none", "L": "low", "H": "high"}, "CIA": {"N": "none", "L": "low", "H": "high"}}


def families(spark: SparkSession) -> DataFrame:
    """cwe and family: the fixed dimension of 40 rows."""
    return spark.createDataFrame(list(CWE_FAMILY.items()), T.StructType([T.StructField("cwe", T.StringType()), T.StructField("family", T.StringType())]))


def _word(kind: str, code: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in CVSS_WORDS[kind].items() for x in kv])
    return words[code]


def parse_cvss(vector: Column) -> Column:
    """The struct of a CVSS vector string; parts that it lacks are null."""
    parts = F.str_to_map(F.coalesce(vector, F.lit("")), F.lit("/"), F.lit(":"))
    return F.struct(
        _word("AV", parts["AV"]).alias("attack_vector"), _word("PR", parts["PR"]).alias("privileges_required"), (parts["UI"] == "R").alias("user_interaction"),
        F.struct(_word("CIA", parts["C"]).alias("confidentiality"), _word("CIA", parts["I"]).alias("integrity"), _word("CIA", parts["A"]).alias("availability")).alias("impact"),
    )


def flatten_scan(raw: DataFrame) -> DataFrame:
    """Flat findings of raw scanner output, Results[].Vulnerabilities[]; rows without an id go."""
    v = raw.select(F.explode("Results").alias("r")).select(F.explode("r.Vulnerabilities").alias("v")).filter(F.coalesce("v.VulnerabilityID", F.lit("")) != "")
    vector, score = F.coalesce("v.CVSS.nvd.V3Vector", "v.CVSS.ghsa.V3Vector"), F.coalesce("v.CVSS.nvd.V3Score", "v.CVSS.ghsa.V3Score")
    return v.select(
        F.col("v.VulnerabilityID").alias("cve_id"), F.col("v.PkgName").alias("package"), F.col("v.InstalledVersion").alias("installed_version"), F.col("v.FixedVersion").alias("fixed_version"),
        F.col("v.Severity").alias("severity"), vector.alias("cvss_vector"), score.alias("cvss_score"), parse_cvss(vector).alias("parsed_cvss"), F.col("v.CweIDs").alias("cwe"),
        F.filter(F.coalesce("v.References", F.array().cast("array<string>")), lambda u: u.contains("commit")).alias("commit_urls"), F.col("v.PrimaryURL").alias("primary_url"),
    )


def severe(findings: DataFrame, include_low: bool = False) -> DataFrame:
    """Findings with a weakness; low and negligible ones only if asked for."""
    known = findings.filter(F.coalesce("cwe", F.lit("")) != "")
    return known if include_low else known.filter(~F.upper("severity").isin(*IGNORED))


def with_family(findings: DataFrame, dim: DataFrame) -> DataFrame:
    """family of the primary weakness: by the dimension, else its own name in lower case with underscores. dim has 40 rows."""
    return findings.join(F.broadcast(dim), "cwe", "left").withColumn("family", F.coalesce("family", F.translate(F.lower("cwe"), "-", "_")))


def first_by(rows: DataFrame, key: str, order: str = "row_id") -> DataFrame:
    """The first row of each key; a window, so that all columns come from one row."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_rank = 1").drop("_rank")


def clusters(findings: DataFrame) -> DataFrame:
    """One row a family: its weaknesses, packages and number of findings."""
    return findings.groupBy("family").agg(F.array_sort(F.collect_set("cwe")).alias("cwe_ids"), F.array_sort(F.collect_set("package")).alias("packages"), F.count(F.lit(1)).alias("n_cves"))


def package_of_cve(findings: DataFrame) -> DataFrame:
    """cve (upper case) and its package by the last row."""
    return findings.groupBy(F.upper("cve_id").alias("cve")).agg(F.max_by("package", "row_id").alias("package"))


def upgrade_targets(findings: DataFrame, reachable: DataFrame) -> DataFrame:
    """The first fixed version of each package with a reachable, fixable finding: that of its first such row."""
    fixable = findings.filter("fixed_version != ''").join(reachable.select("cve_id").distinct(), "cve_id", "left_semi")
    return fixable.groupBy("package").agg(F.min_by(F.trim(F.split("fixed_version", ",")[0]), "row_id").alias("version"), F.min("row_id").alias("row_id"))
