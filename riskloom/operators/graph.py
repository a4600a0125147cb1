"""Graph operators: bounded searches, PageRank, dependency trees, orders; set-oriented loops whose lineage is cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riskloom.operators.scratch import Grown, cut


def bfs(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """start, node, hops: the least number of edges, at most max_hops, from each start; a start reaches itself in 0.

    All starts advance together: a round joins the frontier with the edges and leaves out what is already reached.
    """
    edges = edges.select("src", "dst").distinct()
    reached = Grown(starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, max_hops + 1):
        step = reached.last.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = reached.add(step.join(reached.all().select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if not frontier.limit(1).count():
            break
    return reached.all()


def bfs_paths(edges: DataFrame, starts: DataFrame, sinks: DataFrame | None, max_hops: int) -> DataFrame:
    """start, sink, hops and path: a shortest path to each sink, or to each node where no sinks are given, the least by its text of those of one length."""
    edges = edges.select("src", "dst").distinct()
    found = Grown(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array(F.col("id").cast("string")).alias("path")).distinct())
    for _ in range(max_hops):
        step = found.last.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst").cast("string")).alias("path"))
        step = step.join(found.all().select("start", "node"), ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path"))
        if not found.add(step).limit(1).count():
            break
    reached = found.all()
    if sinks is not None:
        reached = reached.join(sinks.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    return reached.select("start", F.col("node").alias("sink"), (F.size("path") - 1).alias("hops"), "path")


def paths_to_symbols(edges: DataFrame, starts: DataFrame, symbols: DataFrame, max_hops: int = 25) -> DataFrame:
    """start, symbol, hops, path: a shortest path from each start to an outside function (ext::name) that a symbol names.

    A name and a symbol (column symbol) match if they are equal or either ends in the other after a dot, so they share
    their last segment, which is joined on. Paths don't lead through outside functions; max_hops counts the edges before
    the last one.
    """
    outside = F.col("dst").startswith("ext::")
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    name = edges.filter(outside).select(F.col("src").alias("node"), F.col("dst"), F.expr("substr(dst, 6)").alias("name")).distinct()
    wanted = symbols.select(F.ltrim(F.col("symbol"), F.lit(".")).alias("symbol")).distinct()
    ends = (F.col("name") == F.col("symbol")) | F.col("name").endswith(F.concat(F.lit("."), "symbol")) | F.col("symbol").endswith(F.concat(F.lit("."), "name"))
    sinks = name.withColumn("last", last(F.col("name"))).join(wanted.withColumn("last", last(F.col("symbol"))), "last").filter(ends).groupBy("node", "symbol").agg(F.min("dst").alias("dst"))
    reached = bfs_paths(edges.filter(~outside), starts, None, max_hops)
    whole = reached.join(sinks, F.col("sink") == F.col("node")).select("start", "symbol", F.array_append("path", F.col("dst")).alias("path"))
    best = whole.groupBy("start", "symbol").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("b"))
    return best.select("start", "symbol", (F.col("b.n") - 1).alias("hops"), F.col("b.path").alias("path"))


def dependency_chain(services: DataFrame, exposes: DataFrame, vulnerable: DataFrame, calls: DataFrame, max_hops: int = 100) -> DataFrame:
    """service, cve_id, hops, path: a shortest path from a service's entry to each function that a CVE lies in.

    services: id, name, seq; exposes: src, dst, seq; vulnerable: cve_id, id. A name's entry is the first function exposed
    by the last service of that name that exposes any.
    """
    first = exposes.groupBy(F.col("src").alias("id")).agg(F.min_by("dst", F.struct("seq", "dst")).alias("entry"))
    entry = cut(services.join(first, "id").groupBy("name").agg(F.max_by("entry", F.struct("seq", "id")).alias("entry")))
    paths = bfs_paths(calls, entry.select(F.col("entry").alias("id")), vulnerable, max_hops)
    found = paths.join(vulnerable.select("cve_id", F.col("id").alias("sink")).distinct(), "sink").join(entry, F.col("start") == F.col("entry"))
    return found.select(F.col("name").alias("service"), "cve_id", "hops", "path")


def tainted_paths(paths: DataFrame, tainted: DataFrame) -> DataFrame:
    """paths with tainted: whether any node of the path is."""
    steps = paths.select("start", "sink", F.explode("path").alias("id")).join(tainted.select(F.col("id").cast("string")).distinct(), "id", "left_semi").select("start", "sink").distinct().withColumn("tainted", F.lit(True))
    return paths.join(steps, ["start", "sink"], "left").withColumn("tainted", F.coalesce("tainted", F.lit(False)))


#: Rounds of PageRank that are made from powers of the edges' shares; graphs without longer paths need no others.
POWERS = 8


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """id and rank. Parallel edges count as often as they occur, edges with unknown ends not; the mass of nodes without edges out is spread evenly.

    All nodes start alike and get alike what is spread, so the ranks of a round are a sum of weighted powers: what each node
    gets over all paths of no edge, one, two and so on, if every node sends 1. The weights need one number of each power, its sum over
    nodes without edges out. So a graph without paths of over POWERS edges has all of its rounds from these few tables, and
    one pass over them gives the change of every round; others go on from there round by round.

    Ranks stay distributed; the driver sees the dangling mass and the change of a round, two numbers that are observed while
    the round is written. The edges' shares are dealt by source once and kept there, so a round moves ranks and what they
    send, never the edges; lost parts of them are dealt again from the written table.
    """
    ids = cut(nodes.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    counted = known.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    out = counted.groupBy("src").agg(F.sum("times").alias("out"))
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = cut(counted.join(out, "src").select("src", "dst", (F.col("times") / F.col("out")).alias("share"))).repartition(parts, "src").persist()
    linked = out.select(F.col("src").alias("id"), F.lit(True).alias("linked"))
    powers = Grown(ids.join(linked, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(0).alias("k"), F.lit(1.0).alias("u")))
    every, loose = powers.last.select("id", "linked"), [powers.last.filter("not linked").count()]
    for k in range(1, min(POWERS, iterations) + 1):
        sent = shares.join(powers.last, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("u") * F.col("share")).alias("u"))
        seen = Observation()
        powers.add(every.join(sent, "id").withColumn("k", F.lit(k)).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(~F.col("linked"), F.col("u"))), F.lit(0.0)).alias("loose")))
        if not seen.get["n"]:
            break
        loose.append(seen.get["loose"])
    # no path is longer: later powers are empty
    whole = powers.rounds > len(loose)
    weights = [[1.0 / n] + [0.0] * (len(loose) - 1)]
    for _ in range(iterations if whole else len(loose) - 1):
        spread = sum(w * x for w, x in zip(weights[-1], loose))
        weights.append([(1 - damping) / n + damping * spread / n, *(damping * w for w in weights[-1][:-1])])
    held = cut(powers.all().groupBy("id", "linked").agg(*[F.sum(F.when(F.col("k") == k, F.col("u")).otherwise(0.0)).alias(f"u{k}") for k in range(len(loose))]))
    last, changed = len(weights) - 1, False
    if last:
        steps = ids.sparkSession.createDataFrame([(r, [y - x for x, y in zip(*pair)]) for r, pair in enumerate(zip(weights, weights[1:]), 1)], "round int, w array<double>")
        change = F.abs(sum((F.col("w")[k] * F.col(f"u{k}") for k in range(1, len(loose))), F.col("w")[0] * F.col("u0")))
        # a row for each round
        ended = held.join(F.broadcast(steps)).groupBy("round").agg(F.sum(change).alias("change")).filter(F.col("change") < tolerance).agg(F.min("round")).first()[0]
        last, changed = (last, True) if ended is None else (ended, False)
    ranks = held.select("id", sum((F.lit(weights[last][k]) * F.col(f"u{k}") for k in range(1, len(loose))), F.lit(weights[last][0]) * F.col("u0")).alias("rank"), "linked")
    if changed and not whole and last < iterations:
        dangling, ranks = sum(w * x for w, x in zip(weights[last], loose)), cut(ranks)
        for _ in range(last, iterations):
            came = shares.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
            base = (1 - damping) / n + damping * dangling / n
            new = ranks.join(came, F.col("id") == F.col("dst"), "left").select("id", "linked", F.col("rank").alias("old"), (F.lit(base) + damping * F.coalesce("came", F.lit(0.0))).alias("rank"))
            seen = Observation()
            ranks = cut(new.observe(seen, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change"), F.coalesce(F.sum(F.when(~F.col("linked"), F.col("rank"))), F.lit(0.0)).alias("loose"))).select("id", "rank", "linked")
            dangling = seen.get["loose"]
            if seen.get["change"] < tolerance:
                break
    shares.unpersist()
    return ranks.select("id", "rank")


def relative_centrality(ranks: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and centrality: the rank over the greatest among the wanted nodes, four places."""
    mine = ranks.join(wanted.select("id").distinct(), "id", "left_semi")
    top = mine.agg(F.max("rank").alias("top"))
    return mine.join(F.broadcast(top)).select("id", F.round(F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(F.lit(0.0)), 4).alias("centrality"))  # top is one row


def resolve_tree(roots: DataFrame, requires: DataFrame, max_depth: int = 15) -> DataFrame:
    """root, package, depth, path and status of each package that a root needs, by its first and shortest path; cycles end.

    requires: package, dep. A level at a time; a package already on the path ends it as a cycle.
    """
    edges = requires.select("package", "dep").distinct()
    seen = Grown(roots.select(F.col("package").alias("root"), "package", F.lit(0).alias("depth"), F.array("package").alias("path")).distinct())
    for depth in range(1, max_depth + 1):
        step = seen.last.join(edges, "package").select("root", F.col("dep").alias("package"), F.lit(depth).alias("depth"), F.array_append("path", F.col("dep")).alias("path"))
        step = step.join(seen.all().select("root", "package"), ["root", "package"], "left_anti").groupBy("root", "package").agg(F.min("path").alias("path"), F.first("depth").alias("depth"))
        if not seen.add(step).limit(1).count():
            break
    return seen.all()


def requirers(roots: DataFrame, requires: DataFrame, max_depth: int = 15) -> DataFrame:
    """root, package, parent: what a root's tree holds and each package of that tree that requires it.

    Trees grow as in resolve_tree, but without paths. What a package above the last level requires is in the tree, so only
    what the last level requires is looked up there.
    """
    edges = requires.select("package", "dep").distinct()
    seen = Grown(roots.select(F.col("package").alias("root"), "package", F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        step = seen.last.join(edges, "package").select("root", F.col("dep").alias("package")).distinct()
        if not seen.add(step.join(seen.all().select("root", "package"), ["root", "package"], "left_anti").withColumn("depth", F.lit(depth))).limit(1).count():
            break
    below = lambda rows: rows.join(edges, "package").select("root", F.col("dep").alias("package"), F.col("package").alias("parent"))
    held = seen.all()
    last = below(held.filter(F.col("depth") == max_depth)).join(held.select("root", "package"), ["root", "package"], "left_semi")
    return below(held.filter(F.col("depth") < max_depth)).unionByName(last)


def cycles(requires: DataFrame, tree: DataFrame) -> DataFrame:
    """root, package: edges of a resolved tree that lead back onto their own path."""
    back = tree.join(requires.select("package", "dep").distinct(), "package").filter(F.array_contains("path", F.col("dep")))
    return back.select("root", F.col("dep").alias("package")).distinct()


def layers(nodes: DataFrame, depends: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """id and layer, and the group's columns: a node's layer comes after those of all it depends on; of a cycle the least node goes first.

    depends: id, on. Each round places all nodes whose dependencies are placed, until none is left; groups are ordered
    apart from each other, all in the same rounds.
    """
    keys, on = [*group, "id"], [*group, "on"]
    left = cut(nodes.select(*keys).distinct())
    edges = depends.select(*keys, "on").distinct().filter("id != on").join(left, keys, "left_semi").join(left.withColumnRenamed("id", "on"), on, "left_semi")
    edges, placed, layer = cut(edges), Grown(left.limit(0).withColumn("layer", F.lit(0))), 0
    while left.limit(1).count():
        ready = left.join(edges.select(*keys).distinct(), keys, "left_anti")
        if group:
            stuck = left.join(ready.select(*group).distinct(), list(group), "left_anti")
            ready = ready.unionByName(stuck.groupBy(*group).agg(F.min("id").alias("id")))
        elif not ready.limit(1).count():
            ready = left.agg(F.min("id").alias("id"))
        ready = placed.add(ready.withColumn("layer", F.lit(layer)))
        left = cut(left.join(ready, keys, "left_anti"))
        edges = cut(edges.join(ready.select(*group, F.col("id").alias("on")), on, "left_anti").join(ready.select(*keys), keys, "left_anti"))
        layer += 1
    return placed.all()
