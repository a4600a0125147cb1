"""Export rows: SARIF, OpenVEX, CycloneDX, and the documents made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import purl


def sarif_level(recommendation: Column) -> Column:
    return F.when(recommendation == "BLOCK", "error").when(recommendation == "REVIEW", "warning").otherwise("note")


def sarif_rows(assessment: DataFrame, places: DataFrame) -> DataFrame:
    """rule_id, level, uri, start_line: a result for each place of a CVE, or the manifest where it has none."""
    rows = assessment.join(places.filter("file is not null"), "cve_id", "left")
    return rows.select(F.col("cve_id").alias("rule_id"), sarif_level(F.col("recommendation")).alias("level"), F.coalesce("file", F.lit("requirements.txt")).alias("uri"), F.greatest(F.lit(1), F.coalesce("line", F.lit(1))).alias("start_line"))


def sarif_results(assessment: DataFrame, places: DataFrame) -> DataFrame:
    """rule_id and result: one JSON result a CVE with all its locations in order."""
    rows = sarif_rows(assessment, places)
    location = F.struct("uri", F.struct(F.col("start_line").alias("startLine")).alias("region"))
    grouped = rows.groupBy("rule_id", "level").agg(F.array_sort(F.collect_set(location)).alias("locations"))
    return grouped.select("rule_id", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", "locations")).alias("result"))


def vex_status(kind: Column, recommendation: Column) -> Column:
    return F.when(kind == "direct", "affected").when(kind == "none", "not_affected").otherwise("under_investigation")


def vex_rows(assessment: DataFrame) -> DataFrame:
    return assessment.select("cve_id", "package", vex_status(F.col("reachability_kind"), F.col("recommendation")).alias("status"), purl(F.col("package"), F.lit("")).alias("product"))


def vex_document_id(rows: DataFrame) -> DataFrame:
    """The first 16 hex digits of the SHA-256 over 4096 hashes, each of the statements in order whose CVE hashes to it."""
    line = F.sha2(F.concat_ws("|", "cve_id", "product", "status"), 256)
    return rows.groupBy(F.substring(F.sha2("cve_id", 256), 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("h")).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("part", "h"))), ""), 256), 1, 16).alias("document_id"))


def components(findings: DataFrame) -> DataFrame:
    """CycloneDX components: distinct packages with their purl."""
    return findings.select("package").distinct().select(F.col("package").alias("name"), F.lit("library").alias("type"), purl(F.col("package"), F.lit("")).alias("purl"))


def ratings(assessment: DataFrame) -> DataFrame:
    state = F.when(F.col("reachability_kind") == "direct", "exploitable").when(F.col("reachability_kind") == "none", "not_affected").otherwise("in_triage")
    return assessment.select(F.col("cve_id").alias("id"), F.col("cvss_score").alias("score"), F.lower("severity").alias("severity"), state.alias("analysis_state"))
