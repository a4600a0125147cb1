"""Upgrade simulation of many projects at once: trees before and after, what they change, conflicts, cascades, steps, verdicts.

Inputs: pins (project, package, version), upgrades (project, package, target_version, position; the one at the least
position is the primary one), direct (parent, parent_version, dep, spec, dep_version; each release's own dependencies)
and releases (package, version, python_requires).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.versions import compare_key, satisfies
from riskloom.operators import deps
from riskloom.operators.graph import layers
from riskloom.operators.scratch import Grown, cut

NODE = ["project", "package"]


def trees(pins: DataFrame, direct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (project, package, version) and edges (project, package, dep, spec) of the trees that the pins lead to.

    A package that is reached in several versions takes the greatest, a pin before all; an edge takes the constraint of
    the greatest version that was reached of its package. Trees grow until a round reaches no new release, however deep
    they are; each release of a project is reached once, so cycles end as well.
    """
    release = [*NODE, "version"]
    below = direct.select(F.col("parent").alias("package"), F.col("parent_version").alias("version"), "dep", "spec", "dep_version").distinct()
    held = Grown(pins.select(*release).distinct())
    while True:
        step = held.last.join(below, ["package", "version"]).select("project", F.col("dep").alias("package"), F.col("dep_version").alias("version")).distinct()
        if not held.add(step.join(held.all(), release, "left_anti")).limit(1).count():
            break
    reached = held.all()
    newest = F.struct(compare_key(F.col("version")), "version")
    found = reached.groupBy(*NODE).agg(F.max_by("version", newest).alias("found"))
    pinned = pins.groupBy(*NODE).agg(F.max_by("version", newest).alias("pin"))
    nodes = found.join(pinned, NODE, "left").select(*NODE, F.coalesce("pin", "found").alias("version"))
    edges = reached.join(below, ["package", "version"]).groupBy(*NODE, "dep").agg(F.max_by("spec", F.struct(compare_key(F.col("version")), "version", "spec")).alias("spec"))
    return cut(nodes), cut(edges)


def upgraded_pins(pins: DataFrame, upgrades: DataFrame, direct: DataFrame) -> DataFrame:
    """The pins with the upgrades' versions, without those that an upgraded package requires itself, which move freely."""
    new = upgrades.filter("package != '' and target_version != ''").groupBy(*NODE).agg(F.min_by("target_version", "position").alias("target"))
    wanted = pins.groupBy(*NODE).agg(F.max("version").alias("version")).join(new, NODE, "full").select(*NODE, F.coalesce("target", "version").alias("version"), "target")
    freed = new.join(direct, (F.col("package") == F.col("parent")) & (F.col("target") == F.col("parent_version"))).select("project", F.col("dep").alias("package")).distinct().withColumn("free", F.lit(True))
    return wanted.join(freed, NODE, "left").filter("target is not null or free is null").select(*NODE, "version")


def changes(current: DataFrame, target: DataFrame) -> DataFrame:
    """project, package, from_version, to_version, change of nodes that two trees don't share."""
    both = current.withColumnRenamed("version", "from_version").join(target.withColumnRenamed("version", "to_version"), NODE, "full")
    change = F.when(F.col("from_version").isNull(), "added").when(F.col("to_version").isNull(), "removed").when(F.col("from_version") != F.col("to_version"), "bumped")
    return both.select(*NODE, "from_version", "to_version", change.alias("change")).filter("change is not null")


def forced_by(bumped: DataFrame, before: DataFrame, after: DataFrame, primary: DataFrame) -> DataFrame:
    """project, package, forced_by: who made a bumped package move.

    The primary upgrade, if its constraint on the package changed or admits only the new version; else the first parent
    whose constraint admits only the new version; else the first parent; else the primary upgrade.
    """
    edge = lambda df, spec: df.select("project", F.col("package").alias("parent"), F.col("dep").alias("package"), F.col("spec").alias(spec))
    asked = bumped.join(primary.select("project", F.col("package").alias("primary")), "project", "left")
    new, old = satisfies(F.col("to_version"), F.col("spec")), satisfies(F.col("from_version"), F.col("spec"))
    rank = F.when((F.col("parent") == F.col("primary")) & ~F.col("spec").eqNullSafe(F.col("was")), 0).when((F.col("parent") == F.col("primary")) & new & ~old, 1).when(new & ~old, 2).when(F.col("spec").isNotNull(), 3)
    both = edge(after, "spec").join(edge(before, "was"), ["project", "parent", "package"], "full")
    first = asked.join(both, NODE).withColumn("rank", rank).filter("rank is not null").groupBy(*NODE).agg(F.min(F.struct("rank", "parent")).alias("f"))
    return asked.join(first, NODE, "left").select(*NODE, F.coalesce("f.parent", "primary").alias("forced_by"))


def chain(bumped: DataFrame, before: DataFrame, after: DataFrame, primary: DataFrame) -> DataFrame:
    """project, package, from_version, to_version, layer, forced_by of the bumps that a primary upgrade brings about.

    (layer, package) is the order of a project's chain: what a package requires comes before it.
    """
    moved = cut(bumped.select(*NODE, "from_version", "to_version").join(primary, NODE, "left_anti"))
    order = layers(moved.select("project", F.col("package").alias("id")), after.select("project", F.col("package").alias("id"), F.col("dep").alias("on")), ("project",))
    return moved.join(order.withColumnRenamed("id", "package"), NODE).join(forced_by(moved, before, after, primary), NODE)


def conflicts(nodes: DataFrame, edges: DataFrame, scope: DataFrame) -> DataFrame:
    """project, dep, n of dependencies that two packages or more constrain and whose version some constraint rejects, if they or a parent are in scope."""
    inside = scope.select(*NODE).distinct().withColumn("inside", F.lit(True))
    met = edges.join(nodes.select("project", F.col("package").alias("dep"), "version"), ["project", "dep"]).join(inside, NODE, "left").join(inside.select("project", F.col("package").alias("dep"), F.col("inside").alias("dep_inside")), ["project", "dep"], "left")
    seen = F.coalesce("inside", F.lit(False)) | F.coalesce("dep_inside", F.lit(False))
    grouped = met.groupBy("project", "dep").agg(F.count(F.lit(1)).alias("n"), F.bool_and(satisfies(F.col("version"), F.col("spec"))).alias("met"), F.bool_or(seen).alias("seen"))
    return grouped.filter("n >= 2 and not met and seen").select("project", "dep", "n")


def steps(conflicting: DataFrame, before: DataFrame, after: DataFrame, upgrades: DataFrame, primary: DataFrame) -> DataFrame:
    """project, package, kind, part, place: the packages to upgrade, in the order of part, place and package.

    Those that constrain conflicting dependencies come first, of them those that require the most others; then the
    upgrades asked for, by position.
    """
    blockers = cut(after.join(conflicting.select("project", "dep"), ["project", "dep"], "left_semi").select(*NODE).distinct().join(primary, NODE, "left_anti"))
    inner = before.join(blockers, NODE, "left_semi").join(blockers.select("project", F.col("package").alias("dep")), ["project", "dep"], "left_semi").groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"))
    first = blockers.join(inner, NODE, "left").select(*NODE, F.lit("blocker").alias("kind"), F.lit(0).alias("part"), (-F.coalesce("n", F.lit(0))).cast("bigint").alias("place"))
    rest = upgrades.join(blockers, NODE, "left_anti").groupBy(*NODE).agg(F.min("position").cast("bigint").alias("place"))
    return first.unionByName(rest.select(*NODE, F.lit("target").alias("kind"), F.lit(1).alias("part"), "place"))


PARTS = ("current", "target", "tree_diff", "conflicts", "chain", "steps", "unresolved", "runtime_conflicts", "summary")


def simulate(pins: DataFrame, upgrades: DataFrame, direct: DataFrame, releases: DataFrame, python_version: str, wanted: tuple[str, ...] = PARTS) -> dict[str, DataFrame]:
    """The wanted ones of the simulation's parts: current, target, tree_diff, conflicts, chain, steps, unresolved, runtime_conflicts, and summary, a row for each project.

    A project's status is degraded if a pin of either tree isn't among the releases. What the wanted parts don't need isn't computed.
    """
    pins, upgrades = pins.select(*NODE, "version"), upgrades.select(*NODE, "target_version", "position")
    need = lambda *names: bool({"summary", *names} & {*wanted})
    primary = cut(upgrades.groupBy("project").agg(F.min_by("package", F.struct("position", "package")).alias("package")))
    later = cut(upgraded_pins(pins, upgrades, direct))
    # both trees of all projects grow in the same rounds
    side = lambda df, k: df.select(F.struct(F.lit(k).alias("tree"), F.col("project").alias("name")).alias("project"), "package", "version")
    nodes, edges = trees(side(pins, 0).unionByName(side(later, 1)), direct)
    of = lambda df, k: df.filter(F.col("project")["tree"] == k).withColumn("project", F.col("project")["name"])
    (current, before), (target, after) = ((of(nodes, k), of(edges, k)) for k in (0, 1))
    out = {"current": current, "target": target}
    diff = cut(changes(current, target))
    bumped, asked = diff.filter("change = 'bumped'"), upgrades.select(*NODE)
    out["tree_diff"] = diff
    if need("conflicts", "steps"):
        out["conflicts"] = cut(conflicts(target, after, asked.unionByName(diff.filter("change != 'removed'").select(*NODE))))
    if need("chain"):
        out["chain"] = cut(chain(bumped, before, after, primary))
    if need("steps"):
        out["steps"] = cut(steps(out["conflicts"], before, after, upgrades, primary))
    if need("unresolved"):
        out["unresolved"] = cut(pins.unionByName(later).distinct().join(releases.select("package", "version"), ["package", "version"], "left_anti").select(*NODE).distinct())
    if need("runtime_conflicts"):
        scope = pins.select(*NODE).unionByName(primary.select(*NODE)).unionByName(bumped.select(*NODE)).distinct()
        spec = releases.groupBy("package", "version").agg(F.max("python_requires").alias("python_requires"))
        run = target.join(scope, NODE, "left_semi").join(spec, ["package", "version"]).filter(~satisfies(F.lit(python_version), F.col("python_requires")))
        out["runtime_conflicts"] = cut(run.select(*NODE, "version", "python_requires"))
    if need():
        out["summary"] = _summary(pins, upgrades, out)
    return {k: v for k, v in out.items() if k in wanted}


def _summary(pins: DataFrame, upgrades: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """A row for each project: how many rows each part has for it, its status and its verdict."""
    n = lambda df, name: df.groupBy("project").agg(F.count(F.lit(1)).alias(name))
    out = pins.select("project").unionByName(upgrades.select("project")).distinct()
    out = out.join(parts["tree_diff"].groupBy("project").agg(*(F.count_if(F.col("change") == k).alias(k) for k in ("bumped", "added", "removed"))), "project", "left")
    for name in ("conflicts", "chain", "steps", "unresolved", "runtime_conflicts"):
        out = out.join(n(parts[name], name), "project", "left")
    out = out.na.fill(0)
    feasible = (F.col("steps") > 0) | (F.col("conflicts") == 0)
    said = deps.verdict(F.col("runtime_conflicts") > 0, F.col("conflicts") > 0, feasible, F.col("chain") > 0)
    return out.withColumn("feasible", feasible).withColumn("status", F.when(F.col("unresolved") > 0, "degraded").otherwise("ok")).withColumn("verdict", said)
