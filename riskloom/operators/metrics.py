"""Aggregates and metrics: confusion matrices, calibration, counters, rollups, structural hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import canonical as js
from riskloom.operators.windows import digests


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), 4)


def confusion(rows: DataFrame, *by: str, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """tp, fp, tn, fn of each group."""
    n = lambda c, name: F.coalesce(F.sum(F.expr(f"cast({c} as bigint)")), F.lit(0)).alias(name)
    return rows.groupBy(*by).agg(n(f"{truth} and {predicted}", "tp"), n(f"not {truth} and {predicted}", "fp"), n(f"not {truth} and not {predicted}", "tn"), n(f"{truth} and not {predicted}", "fn"))


def rates(matrix: DataFrame) -> DataFrame:
    """precision, recall, f1, fpr, fnr, accuracy, specificity; 0 where a denominator is empty; four places."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = F.when(tp + fp == 0, F.lit(0.0)).otherwise(tp / (tp + fp)), F.when(tp + fn == 0, F.lit(0.0)).otherwise(tp / (tp + fn))
    return matrix.withColumns({
        "precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), 4), "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp),
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "specificity": _ratio(tn, tn + fp),
    })


def brier(rows: DataFrame, *by: str, truth: str = "y_true", probability: str = "y_prob") -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.coalesce(F.avg(F.pow(F.col(probability) - F.col(truth).cast("double"), 2)), F.lit(0.0)), 4).alias("brier"), F.count(F.lit(1)).alias("n"))


def bins(rows: DataFrame, n: int, truth: str = "y_true", probability: str = "y_prob") -> DataFrame:
    """n equal bins of the probability, the last closed: count, mean probability, observed share; empty bins have nulls."""
    k = F.least(F.floor(F.col(probability) * n), F.lit(n - 1)).cast("int")
    held = rows.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(probability), 4).alias("mean_predicted"), F.round(F.avg(F.col(truth).cast("double")), 4).alias("observed_rate"))
    spark = rows.sparkSession
    return spark.range(n).select(F.col("id").cast("int").alias("bin")).join(held, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def calibration_error(binned: DataFrame) -> DataFrame:
    """Expected calibration error of bins: the absolute gaps, weighed by count."""
    return binned.agg(F.round(F.coalesce(F.sum(F.col("count") * F.abs(F.col("mean_predicted") - F.col("observed_rate"))) / F.sum("count"), F.lit(0.0)), 4).alias("ece"))


def findings_per_cve(cves: DataFrame, refs: DataFrame) -> DataFrame:
    """One row a CVE, hits or none: count, reachability, confidence (imports count only if there is nothing else), first call's name."""
    rank = lambda c: F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).otherwise(1)
    not_import = F.max(F.when(F.col("kind") != "import", rank(F.col("confidence"))))
    level = F.coalesce(not_import, F.max(rank(F.col("confidence"))), F.lit(3))
    found = refs.groupBy("cve_id").agg(F.count(F.lit(1)).alias("reference_count"), level.alias("level"), F.min_by(F.when(F.col("kind") == "call", F.col("fqn")), F.when(F.col("kind") == "call", F.struct("seq", "fqn"))).alias("best_call"))
    rows = cves.join(found, "cve_id", "left")
    return rows.select("cve_id", F.coalesce("reference_count", F.lit(0)).alias("reference_count"), F.col("reference_count").isNotNull().alias("is_reachable"), F.when(F.coalesce("level", F.lit(3)) == 3, "HIGH").when(F.col("level") == 2, "MEDIUM").otherwise("LOW").alias("confidence"), F.coalesce("best_call", F.lit("")).alias("best_call"))


def scan_summary(per_cve: DataFrame) -> DataFrame:
    """Counts of reachable and unreachable CVEs and the noise that leaving the latter out saves, in percent."""
    one = per_cve.agg(F.count(F.lit(1)).alias("total"), F.expr("count_if(is_reachable)").alias("reachable"))
    return one.select("total", "reachable", (F.col("total") - F.col("reachable")).alias("unreachable"), F.round(F.when(F.col("total") == 0, F.lit(0.0)).otherwise(100 * (F.col("total") - F.col("reachable")) / F.col("total")), 1).alias("noise_reduction_percent"))


def constraint_groups(requires: DataFrame) -> DataFrame:
    """Dependencies that two packages or more constrain, with all constraints."""
    return requires.groupBy("dep").agg(F.array_join(F.array_sort(F.collect_set(F.concat("package", F.lit(" "), "spec"))), "; ").alias("constraints"), F.count_distinct("package").alias("n")).filter("n >= 2")


def structural_hash(symbols: DataFrame, by: str) -> DataFrame:
    """by and structural_hash: the first 16 hex digits of the SHA-256 of the JSON text of a group's names and change types.

    The text is {"classes": {name: change type, ...}, "fqns": [name, ...]} in order of the names, of which the last change
    type by seq counts. It is written as rows and folded, so a group may hold any number of names.
    """
    last = symbols.filter("fqn != ''").groupBy(by, "fqn").agg(F.max_by("change_type", "seq").alias("change_type"))
    first = last.groupBy(by).agg(F.min("fqn").alias("first")).withColumnRenamed(by, "_by")
    named = last.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn("between", F.when(F.col("fqn") == F.col("first"), "").otherwise(", "))
    name = js.string(F.col("fqn"))
    row = lambda df, part, fqn, text: df.select(by, F.lit(part).alias("part"), fqn.alias("fqn"), text.alias("text"))
    mark = lambda part, text: row(first.withColumnRenamed("_by", by), part, F.lit(""), F.lit(text))
    rows = mark(0, '{"classes": {').unionByName(row(named, 1, F.col("fqn"), F.concat("between", name, F.lit(": "), js.string(F.col("change_type"))))).unionByName(mark(2, '}, "fqns": ['))
    rows = rows.unionByName(row(named, 3, F.col("fqn"), F.concat("between", name))).unionByName(mark(4, "]}"))
    return digests(rows, by, ["part", "fqn"], "text", 16).withColumnRenamed("digest", "structural_hash")


def scale_fit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean and population standard deviation (1 where it is 0): one row a feature."""
    one = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    stack = ", ".join(f"'{c}', m_{c}, s_{c}" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {stack}) as (feature, mean, std)").select("feature", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")), 6).alias("std"))


def cache_stats(files: DataFrame, cache: DataFrame) -> DataFrame:
    """hits, misses and hit_rate of files against a cache by content key."""
    held = cache.select("key", F.lit(True).alias("hit")).distinct()
    one = files.join(held, "key", "left").agg(F.expr("count_if(hit is not null)").alias("hits"), F.expr("count_if(hit is null)").alias("misses"))
    return one.withColumn("hit_rate", F.round(F.when(F.col("hits") + F.col("misses") == 0, F.lit(0.0)).otherwise(F.col("hits") / (F.col("hits") + F.col("misses"))), 4))
