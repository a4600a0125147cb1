"""Commit URLs of findings and advisories, import roots of packages, entity checks, rule structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import canonical_commit, normalize_dist


def of_references(rows: DataFrame, references: str = "references") -> DataFrame:
    """cve_id and url of references that are commits (rows: cve_id, references array)."""
    return rows.select("cve_id", F.explode(references).alias("url")).filter(F.col("url").rlike(r"github\.com/[^/]+/[^/]+/(commit|pull/\d+/commits)/"))


def of_ranges(rows: DataFrame) -> DataFrame:
    """cve_id and url made of a repository and the fixing commit of each range event (rows: cve_id, repo, events of fixed)."""
    fixed = rows.select("cve_id", "repo", F.explode("events").alias("e")).filter(F.col("e.fixed").rlike("^[0-9a-f]{7,40}$"))
    return fixed.select("cve_id", F.concat(F.regexp_replace("repo", r"(\.git)?/*$", ""), F.lit("/commit/"), "e.fixed").alias("url"))


def of_findings(findings: DataFrame, cve: str, package: str | DataFrame | None = None) -> DataFrame:
    """Commit URLs that findings of a CVE, and of a package in any case, carry. package: a name, or rows of package."""
    mine = findings.filter(F.col("cve_id") == cve)
    if isinstance(package, DataFrame):
        wanted = package.select(F.lower("package").alias("_package")).distinct()
        mine = mine.join(wanted, F.lower("package") == F.col("_package"), "left_semi")
    elif package is not None:
        mine = mine.filter(F.lower("package") == package.lower())
    return mine.select("cve_id", F.explode("commit_urls").alias("url"))


def discovered(*sources: DataFrame) -> DataFrame:
    """cve_id, url and rank of all sources in order of priority; a URL keeps its best rank."""
    all_ = None
    for k, s in enumerate(sources):
        part = s.select("cve_id", canonical_commit(F.col("url")).alias("url"), F.lit(k).alias("rank"))
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.groupBy("cve_id", "url").agg(F.min("rank").alias("rank"))


def import_roots(packages: DataFrame, known: DataFrame) -> DataFrame:
    """package and module: the module of the dimension, else the name with underscores."""
    named = packages.withColumn("dist", normalize_dist(F.col("package")))
    return named.join(known.select(F.col("dist"), F.col("module").alias("known")), "dist", "left").select("package", F.coalesce("known", F.translate("dist", "-", "_")).alias("module"))


def unknown_entities(arguments: DataFrame, entities: DataFrame) -> DataFrame:
    """Arguments whose entity nobody has mentioned before."""
    return arguments.join(entities.select("entity").distinct(), "entity", "left_anti")


def valid_rule(rule: Column) -> Column:
    """Whether a rule (struct of id, languages, severity, message, pattern, patterns) has all that a rule needs."""
    has_pattern = (F.coalesce(rule["pattern"], F.lit("")) != "") | (F.coalesce(F.size(rule["patterns"]), F.lit(0)) > 0)
    return (F.coalesce(rule["id"], F.lit("")) != "") & (F.coalesce(F.size(rule["languages"]), F.lit(0)) > 0) & rule["severity"].isin("ERROR", "WARNING", "INFO") & (F.coalesce(rule["message"], F.lit("")) != "") & has_pattern


def resolved_rules(families: DataFrame, cache: DataFrame, registry: DataFrame) -> DataFrame:
    """family, rule_id, source: from the cache, else the registry, else none."""
    rows = families.join(cache.select("family", F.col("rule_id").alias("c")), "family", "left").join(registry.select("family", F.col("rule_id").alias("r")), "family", "left")
    return rows.select("family", F.coalesce("c", "r", F.lit("")).alias("rule_id"), F.when(F.col("c").isNotNull(), "cache").when(F.col("r").isNotNull(), "registry").otherwise("none").alias("source"))


def remediation(usage: DataFrame, changes: DataFrame) -> DataFrame:
    """usage_id and advice: what the last known change of a used symbol asks for."""
    last = changes.groupBy("symbol").agg(F.max_by("change", "row_id").alias("change"))
    advice = F.when(F.col("change") == "removed", F.concat(F.lit("Replace "), "symbol", F.lit(", which is gone."))).when(F.col("change") == "signature_changed", F.concat(F.lit("Adjust the arguments of "), "symbol", F.lit("."))).otherwise("No change is needed.")
    return usage.join(last, "symbol", "left").select("usage_id", advice.alias("advice"))


def symbol_rules(resolved: DataFrame, sinks: DataFrame, language: str) -> DataFrame:
    """resolved rules (family, rule_id, source) with patterns; families with known sinks (family, pattern) get a rule of these instead."""
    own = sinks.filter("pattern != ''").groupBy("family").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    both = resolved.join(own, "family", "full")
    known, none = F.col("patterns").isNotNull(), F.array().cast("array<string>")
    rule = F.when(known, F.concat(F.lit("symbol-"), "family", F.lit(f"-{language}"))).otherwise(F.col("rule_id"))
    return both.select("family", rule.alias("rule_id"), F.when(known, "symbol").otherwise(F.col("source")).alias("source"), F.coalesce("patterns", none).alias("patterns"))
