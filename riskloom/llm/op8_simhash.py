"""SimHash near-duplicates through a segment-popcount embedding.

Each text becomes a 64-bit fingerprint of its word shingles. The fingerprint's 22 segments of three bits (one of one)
are mapped to their bit counts, a point of a 22-dimensional grid. One differing bit moves one coordinate by at most one, so the
Manhattan distance of two points never exceeds the Hamming distance of their fingerprints. Points within a distance of
two share a grid cell once each point is dealt to its own cell and to the cells one step away: the range join. Pairs of
distinct fingerprints that meet in a cell are compared by Manhattan distance first and by their bits last.

A cell that more than 64 fingerprints meet in makes no pairs, as these would grow with the square of its size. Its
fingerprints take an exact way of their own: each enumerates the 65 values at Hamming distance 0 or 1. Two fingerprints
share one of these values exactly if they differ in at most two bits, and all that share a value are within two bits of
each other, so linking each to the least of them keeps every connection with a number of rows linear in the
fingerprints. Components follow by alternating large-star and small-star rounds.

Defined cases: a null text has no words; texts without words have fingerprint zero and link like any other; repeated
doc_ids are rows of their own; a null doc_id takes part, and component_id is the least doc_id that isn't null (null if
there is none). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import documents, written

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SEGMENT_BITS = 3
#: Fingerprints that a cell compares pair by pair; beyond, they are linked by the values about them.
CELL = 64
#: Stands for a null doc_id, which comes last in order.
LAST = 2**63 - 1
FINGERPRINT = "doc_id long, crc long, fp long"


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text's lower-cased word shingles, repeats included. text: in UTF-8."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return hashed(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    values = [hashed(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    n = len(values)
    packed = np.zeros((-(-n // 255) * 255, 8), np.uint8)
    packed[:n] = np.array(values, "<u8").view(np.uint8).reshape(n, 8)
    # blocks of 255 rows can't overflow the byte sums
    counts = np.unpackbits(packed, axis=1, bitorder="little").reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, crc (of the text) and fp, the fingerprint's bits as a signed long, of each row."""

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            values = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.int64())], ["doc_id", "crc", "fp"])

    return keyed(docs).mapInArrow(batches, FINGERPRINT)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, crc and text of each row: what tells rows apart, and the text in UTF-8."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_crc().alias("crc"), F.col("text").cast("binary").alias("text"))


def text_crc() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _spans() -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    return [(low, min(SEGMENT_BITS, 64 - low)) for low in range(0, 64, SEGMENT_BITS)]


#: Bits that hold the count of a segment in a packed point.
WIDE = SEGMENT_BITS.bit_length()


def cells(fps: DataFrame) -> DataFrame:
    """fp, point and cell, one row for each grid cell within one step of the fingerprint's point; points and cells are numbers with a digit for each segment."""
    counts = [f"bit_count(shiftrightunsigned(fp, {low}) & {(1 << n) - 1})" for low, n in _spans()]
    digits = [f"shiftleft(cast({c} as bigint), {i * WIDE})" for i, c in enumerate(counts)]
    steps = ["0L", *[s for i, (c, (_, n)) in enumerate(zip(counts, _spans())) for s in (f"if({c} < {n}, shiftleft(1L, {i * WIDE}), null)", f"if({c} > 0, -shiftleft(1L, {i * WIDE}), null)")]]
    point = fps.selectExpr("fp", " + ".join(digits) + " as point", f"array_compact(array({', '.join(steps)})) as steps")
    return point.selectExpr("fp", "point", "explode(steps) as step").selectExpr("fp", "point", "point + step as cell")


def manhattan(a: str, b: str) -> str:
    """SQL: the Manhattan distance of two packed points."""
    digit = lambda x, i: f"(shiftrightunsigned({x}, {i * WIDE}) & {(1 << WIDE) - 1})"
    return " + ".join(f"abs({digit(a, i)} - {digit(b, i)})" for i in range(len(_spans())))


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b), a > b, of distinct fingerprints, whose components are those of all pairs within two bits."""
    # fingerprints and the cells of each are distinct; a cell's rows meet once, where they are counted
    counted = cells(fps).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell")))
    members = written(counted.filter("n > 1"), "members")
    few = members.filter(F.col("n") <= cell)
    near = F.expr(f"x.cell = y.cell and x.fp > y.fp and {manhattan('x.point', 'y.point')} <= {MAX_BITS} and bit_count(x.fp ^ y.fp) <= {MAX_BITS}")
    pairs = few.alias("x").join(few.alias("y").hint("merge"), near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = ["fp", *[f"fp ^ shiftleft(1L, {i})" for i in range(64)]]
    ball = members.filter(F.col("n") > cell).select("fp").distinct().selectExpr("fp", f"explode(array({', '.join(flips)})) as mid")
    least = ball.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("hi")).filter("b < hi").select("mid", "b")
    about = ball.join(least.hint("merge"), "mid").filter("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(about).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component, for nodes that have a link. edges: a and b of each link, read more than once.

    Each round links every node's larger neighbours, then its smaller ones, to the least node it sees; a written table
    cuts the lineage after each round. Rounds grow with the logarithm of the size of a component. Links stay as they are
    once no lower end sees a node below it and no node has two lower ones; that is observed while the round is written.
    """
    edges = edges.select("a", "b")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = both.join(least.hint("merge"), "a").filter("b > a").selectExpr("b as a", "m as b", "m < a as moved")
        # every node that has a smaller neighbour hands these on to the least of them
        low = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = low.selectExpr("inline(array_compact(array(if(b > m, struct(b as a, m as b, true as moved), null), struct(a, m as b, moved or b > m as moved))))").groupBy("a", "b").agg(F.max("moved").alias("moved"))
        seen = Observation()
        edges = written(small.observe(seen, F.count_if("moved").alias("moved")).select("a", "b"), "links")
        if not seen.get["moved"]:
            return edges.selectExpr("a as node", "b as root")
    raise RuntimeError("links did not settle")


def rooted(docs: DataFrame) -> DataFrame:
    """doc_id, crc, fp and root of each row of docs: rows with one root are one component."""
    held = written(fingerprints(docs), "fingerprints")
    fps = held.select("fp").distinct()
    # each row is about to make forty; a set number of partitions keeps them apart
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = components(written(links(fps.repartition(n, "fp")), "links"))
    return held.join(roots.hint("merge"), held.fp == roots.node, "left").select("doc_id", "crc", "fp", F.coalesce("root", "fp").alias("root"))


def clusters(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = rooted) -> DataFrame:
    """The rows of grouped(docs), with component_id."""
    rows = written(grouped(docs), "rooted")
    named = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named.hint("merge"), "root").drop("root")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = rooted) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, nulls last, and of the least text hash among these.

    grouped: gives doc_id, crc and root of each row. Of rows that repeat doc_id and text the least one by the other
    columns stays. Each component keeps exactly one row, also if all its doc_ids are null.
    """
    rows = grouped(docs).groupBy("root", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "crc").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc", "crc", "n")).alias("k"))
    on = ["kept_doc", "kept_crc"]
    kept = written(first.select(F.col("k.doc").alias(on[0]), F.col("k.crc").alias(on[1]), "k.n"), "kept").hint("merge")
    # the documents that stay grow with the input, so they are merged at every size and never broadcast; a row's own columns lie in a struct, whatever their names
    keys = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias(on[0]), text_crc().alias(on[1]))
    alone = keys.join(kept.filter("n = 1"), on, "left_semi").select("row.*")
    again = keys.join(kept.filter("n > 1"), on, "left_semi").groupBy(*on).agg(F.min("row").alias("row")).select("row.*")
    return alone.unionByName(again)
