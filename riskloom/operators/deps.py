"""Upgrade simulation: conflicts, bump attribution, cascades, verdicts, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.versions import satisfies
from riskloom.operators.scratch import numbered


def conflicts(requires: DataFrame, resolved: DataFrame) -> DataFrame:
    """dep, n, resolved version and would_break of dependencies that two packages or more constrain and whose version some constraint rejects.

    requires: package, dep, spec; resolved: package, version.
    """
    met = requires.join(resolved.select(F.col("package").alias("dep"), "version"), "dep", "left").withColumn("met", satisfies(F.col("version"), F.col("spec")))
    grouped = met.groupBy("dep").agg(F.count_distinct("package").alias("n"), F.max("version").alias("version"), F.coalesce(F.bool_and("met"), F.lit(True)).alias("all_met"))
    return grouped.filter("n >= 2 and version is not null and not all_met").select("dep", "n", "version", F.lit(True).alias("would_break"))


def forced_by(bumped: DataFrame, requires: DataFrame, trigger: str) -> DataFrame:
    """package and forced_by: the trigger if it requires the package itself, else the first parent whose constraint admits the new version and not the old, else the first parent, else the trigger.

    bumped: package, from_version, to_version.
    """
    parents = requires.select(F.col("dep").alias("package"), F.col("package").alias("parent"), "spec").join(bumped, "package")
    new, old = satisfies(F.col("to_version"), F.col("spec")), satisfies(F.col("from_version"), F.col("spec"))
    ranked = parents.withColumn("rank", F.when(F.col("parent") == trigger, 0).when(new & ~old, 1).otherwise(2))
    first = ranked.groupBy("package").agg(F.min(F.struct("rank", "parent")).alias("f"))
    return bumped.join(first, "package", "left").select("package", F.coalesce("f.parent", F.lit(trigger)).alias("forced_by"))


def verdict(incompatible_runtime: Column, has_conflicts: Column, feasible: Column, has_chain: Column) -> Column:
    """The upgrade's verdict; the first rule that holds wins."""
    return (
        F.when(incompatible_runtime, "BLOCK_AS_REQUESTED").when(has_conflicts & ~feasible, "BLOCK_AS_REQUESTED").when(has_conflicts, "PROCEED_AFTER_RESOLUTION")
        .when(has_chain, "PROCEED_AFTER_RESOLUTION").otherwise("SAFE")
    )


def plan(conflicting: DataFrame, requires: DataFrame, targets: DataFrame, primary: str) -> DataFrame:
    """step, package, kind: the packages that constrain conflicting dependencies, then the targets in input order.

    Of the former, those that require the most of the others come first, then by name; the primary target is none of
    them.
    """
    blockers = requires.join(conflicting.select("dep"), "dep", "left_semi").select("package").distinct().filter(F.col("package") != primary)
    inner = requires.join(blockers, "package", "left_semi").join(blockers.select(F.col("package").alias("dep")), "dep", "left_semi").groupBy("package").agg(F.count_distinct("dep").alias("n"))
    first = blockers.join(inner, "package", "left").select("package", F.lit("blocker").alias("kind"), F.lit(0).alias("part"), (-F.coalesce("n", F.lit(0))).cast("bigint").alias("a"))
    then = targets.join(blockers, "package", "left_anti").select("package", F.lit("target").alias("kind"), F.lit(1).alias("part"), F.col("row_id").cast("bigint").alias("a"))
    return numbered(first.unionByName(then), "step", F.col("part"), F.col("a"), F.col("package")).select("step", "package", "kind")


def test_surface(steps: DataFrame, chain: DataFrame, current: DataFrame, target: DataFrame) -> DataFrame:
    """packages_changed and transitive_packages_touched of a plan's steps and a cascade's chain (package)."""
    both = current.select("package", F.col("version").alias("a")).join(target.select("package", F.col("version").alias("b")), "package").filter("a != b").join(steps.select("package"), "package", "left_anti")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = n(steps, "s").join(n(chain, "c")).join(n(both, "t"))  # single rows
    return one.select((F.col("s") + F.col("c")).alias("packages_changed"), (F.col("t") + F.col("c")).alias("transitive_packages_touched"))


def minimum_safe(current: Column) -> Column:
    """The least version known to be safe: the current one, as no better is known."""
    return current
