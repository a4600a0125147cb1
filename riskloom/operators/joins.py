"""Joins: tree diffs, innermost ranges, suffix matches, evidence merges, best rules, rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tree_diff(current: DataFrame, target: DataFrame) -> DataFrame:
    """Full outer join by package: bumped, added or removed; equal versions go."""
    both = current.select("package", F.col("version").alias("from_version")).join(target.select("package", F.col("version").alias("to_version")), "package", "full")
    change = F.when(F.col("from_version").isNull(), "added").when(F.col("to_version").isNull(), "removed").when(F.col("from_version") != F.col("to_version"), "bumped")
    return both.withColumn("change", change).filter("change is not null")


def changes_by_cve(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Full outer join of patched symbols and code hits by upper-case CVE; n of either side."""
    s = symbols.groupBy(F.upper("cve_id").alias("cve")).agg(F.count(F.lit(1)).alias("n_symbols"))
    r = refs.groupBy(F.upper("cve_id").alias("cve")).agg(F.count(F.lit(1)).alias("n_refs"))
    return s.join(r, "cve", "full").select("cve", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def dyadic(low: Column, high: Column) -> Column:
    """The fewest aligned strips that make up the whole numbers from low to high: an array of (level, slot), a strip being 2**level wide and slot its number.

    At a level the strips inside begin at a and end before e; those that no wider strip inside holds are a, if it is odd,
    and the last one, if e is odd. There are at most two a level, and as many levels as the range's length has digits.
    """
    end = high + 1

    def at(level: Column) -> Column:
        wide = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        a, e = F.call_function("shiftright", low + wide - 1, level), F.call_function("shiftright", end, level)
        strip = lambda n: F.struct(level.alias("level"), n.alias("slot"))
        first = F.when((a < e) & (a.bitwiseAND(1) == 1), strip(a))
        last = F.when((a < e) & (e.bitwiseAND(1) == 1), strip(e - 1))
        return F.array_compact(F.array_distinct(F.array(first, last)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(F.greatest(end - low, F.lit(1))))), at))


def innermost(points: DataFrame, ranges: DataFrame, key: str, at: str, point_id: str) -> DataFrame:
    """Of each point the range of its key that holds it and starts last; ties go to the first range.

    Ranges are cut into aligned strips, of which each keeps its best range alone; a point looks up the strip that holds
    it at each of its key's levels. All joins are equalities and a point meets one row a level at most, however many ranges hold it.
    """
    whole = lambda c: F.col(c).cast("long")
    cut = ranges.filter("low <= high").select(key, "range_id", whole("low").alias("_low"), whole("high").alias("_high")).withColumn("x", F.explode(dyadic(F.col("_low"), F.col("_high"))))
    best = F.struct(F.col("_low"), -F.col("range_id"))
    strips = cut.groupBy(key, "x.level", "x.slot").agg(F.max_by(F.struct(F.col("_low").alias("low"), "range_id"), best).alias("r"))
    levels = strips.groupBy(key).agg(F.collect_set("level").alias("levels"))
    held = points.join(levels, key).select(point_id, key, whole(at).alias("_at"), F.explode("levels").alias("level")).withColumn("slot", F.call_function("shiftright", F.col("_at"), F.col("level")))
    found = held.join(strips, [key, "level", "slot"]).groupBy(point_id).agg(F.max_by("r.range_id", F.struct(F.col("r.low"), -F.col("r.range_id"))).alias("range_id"))
    return points.select(point_id).join(found, point_id, "left")


def as_of(requests: DataFrame, snapshots: DataFrame, key: str, seconds: int, strip: int = 86_400) -> DataFrame:
    """requests (key, asked_at and others) with fetched_at, snapshot and state: the newest snapshot that was there when it was asked for.

    state is fresh if the snapshot is less than so many seconds old, stale if it is older, missing if there is none; its
    snapshot then is null. snapshots: key, fetched_at, snapshot; of those fetched at one time the greatest counts. Time is cut into
    strips: within a strip of a key the last snapshot is carried along, and what no snapshot of its strip precedes takes
    the last one of the strips before, of which each key has one row. So a key with very many rows is many groups.
    """
    number = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (strip * 1_000_000)).cast("long")
    kept = F.struct("fetched_at", "snapshot")
    newest = snapshots.filter("fetched_at is not null").groupBy(key, "fetched_at").agg(F.max("snapshot").alias("snapshot"))
    there = newest.select(F.col(key).alias("_key"), number("fetched_at").alias("_strip"), F.col("fetched_at").alias("_at"), F.lit(0).alias("_kind"), kept.alias("_s"), F.lit(None).cast(requests.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_r"))
    asked = requests.select(F.col(key).alias("_key"), number("asked_at").alias("_strip"), F.col("asked_at").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(there.schema["_s"].dataType).alias("_s"), F.struct(*requests.columns).alias("_r"))
    before = Window.partitionBy("_key", "_strip").orderBy("_at", "_kind")
    met = there.unionByName(asked).withColumn("_own", F.last("_s", True).over(before)).filter("_kind = 1")
    ends = there.groupBy("_key", "_strip").agg(F.max_by("_s", "_at").alias("_end")).unionByName(asked.select("_key", "_strip").distinct().withColumn("_end", F.lit(None).cast(there.schema["_s"].dataType)))
    earlier = Window.partitionBy("_key").orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.groupBy("_key", "_strip").agg(F.max("_end").alias("_end")).withColumn("_carried", F.last("_end", True).over(earlier)).select(F.col("_key").alias("_k"), F.col("_strip").alias("_n"), "_carried")
    found = met.join(carried, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_strip") == F.col("_n")), "left").withColumn("_s", F.coalesce("_own", "_carried"))
    age = F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("_s")["fetched_at"].cast("timestamp"))
    state = F.when(F.col("_s").isNull(), "missing").when(age < seconds * 1_000_000, "fresh").otherwise("stale")
    return found.select("_r.*", F.col("_s")["fetched_at"].alias("fetched_at"), F.col("_s")["snapshot"].alias("snapshot"), state.alias("state"))


#: Hits and CVEs of a key meet in parts of at most so many of either (on average), in more and smaller ones (not below the second number)
#: where the copies that this takes are no more rows than the key has. CVEs are kept in blocks of so many.
PART, SMALL, BLOCK = 65_536, 1024, 512


def _by_keys(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """rows (how, key, name and what depends on the key; distinct) of the names that have one key a how, and of those that have several."""
    rest = [c for c in rows.columns if c not in ("how", "key", name)]
    ends = rows.groupBy("how", name).agg(F.min("key").alias("key"), F.max("key").alias("last"), *[F.min(c).alias(c) for c in rest])
    several = ends.filter("key < last").select(F.col("how").alias("_how"), F.col(name).alias("_name"))
    return ends.filter("key = last").select("how", "key", name, *rest), rows.join(several, (F.col("how") == F.col("_how")) & F.col(name).eqNullSafe(F.col("_name")), "left_semi")


def _cut(n: str, other: str) -> Column:
    """Into how many parts n rows of a key are cut that meet so many others, of which each part gets a copy."""
    least, cheap = F.ceil(F.col(n) / PART), F.least(F.floor(F.col(n) / F.col(other)), F.ceil(F.col(n) / SMALL))
    return F.greatest(least, cheap).cast("int")


def _all_pairs(hits: DataFrame, cves: DataFrame) -> DataFrame:
    """hit_id, s_cve, how of all hits (hit_id, how, key, which may repeat) and CVEs (s_cve, how, key; distinct) of a key, which both sides say how to cut (n_hits, n_cves).

    A key's pairs are a multiple of both sides: hits and CVEs are shuffled, pairs never. A key is cut into a grid, so that a hot
    one is the work of many tasks, as many as are set here: Spark would merge them by what they read, which says nothing of what they return.
    Rows come hit by hit for a block of CVEs, which files then hold as runs of hits and short repeats of CVEs, a fraction of a byte a row.
    """
    unit = ["how", "key", "_u", "_v"]
    spark = hits.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    own = lambda name, n: F.expr(f"cast(pmod(xxhash64({name}), {n}) as int)")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = hits.select("hit_id", "how", "key", own("hit_id", "n_hits").alias("_u"), each("n_cves").alias("_v")).repartition(tasks, *unit).distinct()
    right = cves.select("s_cve", "how", "key", each("n_hits").alias("_u"), own("s_cve", "n_cves").alias("_v")).repartition(tasks, *unit)
    at = F.row_number().over(Window.partitionBy(*unit).orderBy("s_cve"))
    blocks = right.withColumn("_block", F.floor((at - 1) / BLOCK)).groupBy(*unit, "_block").agg(F.collect_list(F.struct("s_cve")).alias("_cves"))
    return blocks.hint("merge").join(left, unit).select("hit_id", F.explode("_cves").alias("_x"), "how").select("hit_id", "_x.s_cve", "how")


def match_symbols(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """hit_id, s_cve, how: the symbols that resolved names call, exactly, else by short name if the name ends in it after a dot.

    A name leads to one key, itself or its last segment, by which hits meet the symbols. A hit may have several names; it meets a
    symbol's CVE once each way, whichever of them lead to it. If either has one key, they meet once; only a hit and a
    CVE of several keys each may meet twice, and theirs alone are made distinct.
    """
    tagged = lambda how, name: symbols.select(F.lit(how).alias("how"), F.col(name).alias("key"), F.col("cve_id").alias("s_cve")).filter("key is not null")
    of_keys = tagged("exact", "fqn").unionByName(tagged("short", "short_name"))
    known = symbols.select("fqn").distinct().withColumn("_known", F.lit(True))
    how = F.when(F.col("_known"), "exact").when(F.col("fqn").contains("."), "short")
    names = hits.groupBy("fqn").agg(F.count(F.lit(1)).alias("_n")).join(known, "fqn", "left").select("fqn", "_n", how.alias("how"), F.when(F.col("_known"), F.col("fqn")).otherwise(F.element_at(F.split("fqn", r"\."), -1)).alias("key"))
    met = names.groupBy("how", "key").agg(F.sum("_n").alias("_n")).join(of_keys.groupBy("how", "key").agg(F.count(F.lit(1)).alias("_m")), ["how", "key"])
    keys = met.select("how", "key", _cut("_n", "_m").alias("n_hits"), _cut("_m", "_n").alias("n_cves"))
    cves = of_keys.join(keys, ["how", "key"]).distinct()
    plain, wide = _by_keys(cves, "s_cve")
    named = names.join(keys, ["how", "key"]).select("fqn", "how", "key", "n_hits", "n_cves")
    resolved = lambda some: hits.select("hit_id", "fqn").join(some, "fqn").drop("fqn")
    one, several = _by_keys(resolved(named.join(wide.select("how", "key"), ["how", "key"], "left_semi")).distinct(), "hit_id")
    twice = several.select("how", "key", "hit_id").join(wide, ["how", "key"]).select("hit_id", "s_cve", "how").distinct()
    return _all_pairs(resolved(named), plain).unionByName(_all_pairs(one, wide)).unionByName(twice)


def merge_evidence(graph: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """graph evidence, and of CVEs that it lacks the first symbol row of each."""
    new = symbol_rows.join(graph.select("cve_id").distinct(), "cve_id", "left_anti")
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy("cve_id").orderBy("seq"))).filter("_r = 1").drop("_r")
    return graph.unionByName(first)


def enrich(graph: DataFrame, call_graph: DataFrame) -> DataFrame:
    """Evidence rows of the call graph where it has any, which replace all others; else the graph's, without repeats."""
    keys = ["cve_id", "service", "vuln_fn", "file"]
    mine = call_graph.dropDuplicates(keys)
    rest = graph.dropDuplicates(keys).join(call_graph.select("cve_id").distinct(), "cve_id", "left_anti")
    return mine.unionByName(rest)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "ERROR", 3).when(severity == "WARNING", 2).when(severity == "INFO", 1).otherwise(0)


def best_rule(wanted: DataFrame, rules: DataFrame, language: str) -> DataFrame:
    """Of each family the rule of the highest severity for one of its weaknesses, in the language or generic; the first on ties."""
    fit = rules.filter(F.col("language").isin(language, "generic"))
    return wanted.join(fit, "cwe").groupBy("family").agg(F.max_by("rule_id", F.struct(severity_rank(F.col("severity")), -F.col("row_id"))).alias("rule_id"))


def api_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol and change: removed (anti join), added, or signature_changed (inner join with a comparison)."""
    o, n = old.select("symbol", F.col("signature").alias("old_signature")), new.select("symbol", F.col("signature").alias("new_signature"))
    gone = o.join(n, "symbol", "left_anti").select("symbol", F.lit("removed").alias("change"))
    came = n.join(o, "symbol", "left_anti").select("symbol", F.lit("added").alias("change"))
    other = o.join(n, "symbol").filter("old_signature <> new_signature").select("symbol", F.lit("signature_changed").alias("change"))
    return gone.unionByName(came).unionByName(other)


def compare_signatures(old: Column, new: Column) -> Column:
    """What breaks callers between two signatures; '' if nothing does.

    A signature is a struct of args, kwonly, pos_defaults, kw_defaults (arrays of names), has_varargs and has_kwargs.
    """
    none = F.array().cast("array<string>")
    gone = F.when(new["has_varargs"] | new["has_kwargs"], none).otherwise(F.filter(old["args"], lambda x: ~F.array_contains(new["args"], x)))
    gone_kw = F.when(new["has_kwargs"], none).otherwise(F.filter(old["kwonly"], lambda x: ~F.array_contains(new["kwonly"], x)))
    known = F.concat(old["args"], old["kwonly"])
    came = F.filter(new["args"], lambda x: ~F.array_contains(F.concat(known, new["pos_defaults"], F.array(F.lit("self"), F.lit("cls"))), x))
    came_kw = F.filter(new["kwonly"], lambda x: ~F.array_contains(F.concat(known, new["kw_defaults"]), x))
    said = lambda what, names: F.when(F.size(names) > 0, F.concat(F.lit(f"{what}: "), F.array_join(names, ", ")))
    return F.concat_ws(
        "; ", said("Removed positional arguments", gone), said("Removed keyword arguments", gone_kw), said("Added required positional arguments", came), said("Added required keyword arguments", came_kw),
        F.when(old["has_kwargs"] & ~new["has_kwargs"], F.lit("Removed variable keyword arguments (**kwargs)")),
    )


def render_signature(sig: Column) -> Column:
    """A signature as text."""
    listed = lambda what, names: F.when(F.size(names) > 0, F.concat(F.lit(f"{what}: ['"), F.array_join(names, "', '"), F.lit("']")))
    text = F.concat_ws(", ", listed("args", sig["args"]), listed("kwonly", sig["kwonly"]), F.when(sig["has_varargs"], "*args"), F.when(sig["has_kwargs"], "**kwargs"))
    return F.when(text == "", "()").otherwise(text)


def rewrite_lines(lines: DataFrame, steps: DataFrame) -> DataFrame:
    """Requirement lines with the versions of the steps: those of a package to upgrade are replaced, others stay."""
    name = F.regexp_extract("line", r"^([A-Za-z0-9._-]+)", 1)
    return lines.withColumn("package", F.lower(F.regexp_replace(name, "[-_.]+", "-"))).join(steps, "package", "left").select("line_no", F.coalesce(F.concat(name, F.lit("=="), "to_version"), "line").alias("line"))


def advisories_of_tree(tree: DataFrame, advisories: DataFrame, scope: DataFrame) -> DataFrame:
    """Advisories of the tree's packages at or above the first fixed version's predecessor, in scope, one row an advisory."""
    return tree.join(scope, "package", "left_semi").join(advisories, ["package", "version"]).groupBy("advisory").agg(F.min("package").alias("package"), F.min("version").alias("version"))


def both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def connected_or(nodes: DataFrame, edges: DataFrame, kept_kind: str) -> DataFrame:
    """Nodes of the kept kind, and others that an edge touches."""
    touched = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.filter(F.col("kind") == kept_kind).unionByName(nodes.filter(F.col("kind") != kept_kind).join(touched, "id", "left_semi"))
