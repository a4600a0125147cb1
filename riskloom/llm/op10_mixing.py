"""Mixing sources to target weights.

Every row gets a random key, the MD5 of its id and text. Keys are uniform, so 4096 equal ranges of the key cut each
source into even parts, the hot ones too: rows are in order of source and range, sizes are summed per range, a prefix
sum over the ranges finds the range in which a source's budget ends, and only that range's rows are sorted and summed
one by one. What is left is one row per source: whole epochs, and the key at which the last, partial epoch ends.

Targets: sources in order of their code points, null last, weigh 1, 2, 3 and so on in turn and share the sizes of all
documents. No source gets more than three times its own size; what that leaves is shared anew by weight, which settles
at target = least(3 * size, level * weight) with one level for all.

The main path is DataFrame operations only.

Defined cases: a null text has no words; a null source is a source of its own; rows that repeat doc_id and text share
the words taken at the cut evenly, rounded down; a source without words has target 0. Empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import documents, n_words, written

WEIGHTS, MAX_EPOCHS, RANGE_DIGITS = 3, 3, 3


def _key():
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key of each row."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _key().alias("key"))


def targets(sizes: DataFrame) -> DataFrame:
    """source_size rows (source, source_size) with target: one row a source, so sorting them in one task is no burden."""
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = MAX_EPOCHS * F.col("source_size")
    ranked = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", ((F.col("place") - 1) % WEIGHTS + 1).cast("double")).withColumn("ratio", cap / F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("own", level)
    shared = levelled.withColumn("level", F.min(F.when(F.col("own") <= F.col("ratio") * (1 + 1e-12), F.struct("ratio", "place", "own"))).over(every)["own"])
    return shared.select("source", "source_size", F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def cuts(rows: DataFrame) -> DataFrame:
    """source, source_size, target, epochs, cut and part: of rows with a lesser key than cut an epoch more, at cut part words."""
    parts = written(rows.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("words")), "ranges")
    goal = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = goal.withColumn("budget", F.floor(F.col("target") + 0.5)).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
    goal = written(goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).withColumn("held", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()), "goals")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    summed = parts.withColumn("upto", upto).withColumn("held", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).drop("source")
    ends = summed.join(goal, ["held", "none"]).filter("upto - words <= rest and rest < upto").select("source", "range", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    inside = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)).alias("r").join(ends.alias("e"), F.expr("r.source <=> e.source and r.range = e.range")).select("r.source", "r.range", "r.key", "r.size", "e.left")
    ties = inside.groupBy("source", "range", "key", "left").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    run = ties.withColumn("upto", F.sum("size").over(Window.partitionBy("source", "range").orderBy("key")))
    cut = run.filter("upto - size <= left and left < upto").select(F.col("source").alias("s"), F.col("key").alias("cut"), F.expr("(left - upto + size) div n").alias("part"))
    return goal.join(cut, F.expr("source <=> s"), "left").select("source", "source_size", "target", "epochs", "cut", "part")


def _taken():
    return (F.col("epochs") * F.col("size") + F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.col("part")).otherwise(F.lit(0))).cast("long")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(keyed(documents(spark, sf_dir)), "keyed")
    found = written(cuts(rows), "cuts")
    return rows.alias("r").join(found.alias("c"), F.expr("r.source <=> c.source")).select("r.doc_id", "r.size", "c.source_size", "c.target", _taken().alias("taken"), "r.source")


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; at the cut, a row stays whole if at least half of it is taken."""
    found = written(cuts(written(keyed(docs), "keyed")), "cuts").withColumnRenamed("source", "cut_source")
    # the row travels as one struct, so no column of it can clash with the names used here
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.col("source").cast("string").alias("source"))
    rows = rows.select("row", "source", _key().alias("key"), n_words(F.col("text")).alias("size"))
    more = F.when(F.col("key") < F.col("cut"), 1).when((F.col("key") == F.col("cut")) & (F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    taken = rows.join(found, F.expr("source <=> cut_source")).withColumn("copies", (F.col("epochs") + more).cast("int")).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("row.*")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s
), w AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size / ((place - 1) % 3 + 1)::DOUBLE AS ratio FROM r
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS own
  FROM w WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (SELECT own AS level FROM l WHERE own <= ratio * (1 + 1e-12) ORDER BY ratio, place LIMIT 1
), g AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM l, v
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs, floor(target + 0.5)::BIGINT AS budget FROM g
), k AS (
  SELECT source, key, sum(size) AS size, count(*) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) AS upto FROM d GROUP BY source, key
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (b.epochs * d.size + CASE WHEN k.upto <= b.budget - b.epochs * b.source_size THEN d.size
                                 WHEN k.upto - k.size <= b.budget - b.epochs * b.source_size THEN (b.budget - b.epochs * b.source_size - k.upto + k.size)::BIGINT // k.n
                                 ELSE 0 END)::BIGINT AS taken, d.source
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.key = d.key
"""
