"""Audit of how filters interact, over a packed bitmap index.

One pass over the texts gives each document a bit for each filter that it fails. The index holds them partition by
partition as bitsets: a row for each part (source) and batch of documents, with a bitset for each filter and for the two
labels. What a filter removes after others is an AND-NOT of bitsets and a popcount: for each of the 32 sets of filters
that may stand before it, the documents left are those before the last filter of the set AND NOT its failures. Counts of
the 80 pairs (set, next filter) are summed over the partitions, and every order of the filters is read off these sums, so
120 orders cost no more than 32 sets, and no text is read again.

Filters (a document fails): A under 200 words; B distinct words are under half of the words; C over 2% of the code points
are A-Z; D any of #$%&*|; E the text is that of a smaller doc_id, wherever that lies and whether it was removed or not.

Texts are told apart by 128-bit digests. The least doc_id of each text that occurs twice is joined by digest, and labels
by doc_id, in sort-merge joins that Spark can split where one text or id holds many rows.

Defined cases: a null text is an empty one and a null source the part ''; a null doc_id is no smaller or greater than any
other, so it never fails E, and has no label; rows that repeat doc_id and text aren't copies of each other; of labels
that repeat a doc_id any 1 counts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import documents, table, written

FILTERS = "ABCDE"
MARKS = (*FILTERS, "good", "toxic")
FACTS = "doc_id long, part string, digest binary, fails int"
INDEX = "part string, n int, " + ", ".join(f"{m} binary" for m in MARKS)
COUNTS = "part string, subset int, filter int, kept long, removed long, failed long, good long, toxic long"
SYMBOLS, CAPITALS = b"#$%&*|", bytes(range(0x41, 0x5B))
#: Bytes that continue a character of UTF-8.
CONTINUE = bytes(range(0x80, 0xC0))
#: Parts whose sums a task holds before it hands them on.
HELD = 4_096


def failures(text: bytes) -> int:
    """The bits of filters A to D that a text in UTF-8 fails."""
    words = text.split()
    n = len(words)
    capitals, points = len(text) - len(text.translate(None, CAPITALS)), len(text.translate(None, CONTINUE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | (symbols > 0) << 3


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, the text's digest and its failure bits, for each row."""

    def batches(parts: Iterator) -> Iterator:
        from hashlib import blake2b

        import pyarrow as pa

        for batch in parts:
            texts = [t.as_py() for t in batch.column(2)]
            digests = pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array([failures(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "fails"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text).mapInArrow(batches, FACTS)


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and bits (of MARKS, from the first on) of each row."""
    held = written(facts(docs), "facts")
    copies = held.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    copies = written(copies.select("digest", "first"), "copies").hint("merge")
    named = labels.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.expr("if(quality = 1, 32, 0)")).alias("q"), F.max(F.expr("if(toxic = 1, 64, 0)")).alias("t"))
    named = written(named.selectExpr("l_id", "q + t as label").filter("label > 0 and l_id is not null"), "label").hint("merge")
    known = held.join(copies, "digest", "left").select("doc_id", "part", F.expr("fails + if(first < doc_id, 16, 0) as fails"))
    return known.join(named, F.expr("doc_id = l_id"), "left").select("part", F.expr("cast(fails + coalesce(label, 0) as int)").alias("bits"))


def index(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bitmap index: for each part and batch of rows, a packed bitset for each filter and label."""

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            names, at = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            bits, order = batch.column(1).to_numpy(), np.argsort(at, kind="stable")
            cuts, rows = np.searchsorted(at[order], np.arange(len(names) + 1)), []
            for k, name in enumerate(names):
                own = bits[order[cuts[k] : cuts[k + 1]]]
                rows.append({"part": name, "n": len(own)} | {m: np.packbits(own >> j & 1, bitorder="little").tobytes() for j, m in enumerate(MARKS)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.string()), ("n", pa.int32()), *((m, pa.binary()) for m in MARKS)]))

    return marked(docs, labels).sortWithinPartitions("part").mapInArrow(batches, INDEX)


#: (filters before as bits, next filter) for all 80 pairs.
PAIRS = [(s, f) for s in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not s >> f & 1]


def popcounts(n: int, sets: list) -> object:
    """Counts (kept, removed, failed, good, toxic) of each of PAIRS over n documents. sets: the bitset of each of MARKS, as bytes."""
    import numpy as np

    held = [np.frombuffer(s, np.uint8) for s in sets]
    alive = np.empty((1 << len(FILTERS), len(held[0])), np.uint8)
    alive[0] = np.packbits(np.ones(n, np.uint8), bitorder="little")
    for s in range(1, len(alive)):
        last = s.bit_length() - 1
        alive[s] = alive[s ^ 1 << last] & ~held[last]
    fails = np.stack(held[: len(FILTERS)])
    before, after, own = (np.array(x) for x in zip(*((s, s | 1 << f, f) for s, f in PAIRS)))
    gone = alive[before] & fails[own]
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    return np.stack([count(alive)[after], count(gone), count(fails)[own], count(gone & held[-2]), count(gone & held[-1])])


def subset_counts(bitmaps: DataFrame) -> DataFrame:
    """For each part, set of filters before (subset, bits) and next filter: what it keeps, removes, fails in all, and the good and toxic ones that it removes."""

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = [f.split(" ")[0] for f in COUNTS.split(", ")]

        def handed(sums: dict) -> object:
            own = np.concatenate([*sums.values()], axis=1)
            pairs = [pa.array(np.tile(np.array(x, np.int32), len(sums))) for x in zip(*PAIRS)]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([*sums], object), len(PAIRS)), pa.string()), *pairs, *(pa.array(x) for x in own)], names)

        sums: dict = {}
        for batch in parts:
            for row in batch.to_pylist():
                sums[row["part"]] = sums.get(row["part"], 0) + popcounts(row["n"], [row[m] for m in MARKS])
            if len(sums) > HELD:
                yield handed(sums)
                sums = {}
        if sums:
            yield handed(sums)

    total = [F.sum(c).alias(c) for c in ("kept", "removed", "failed", "good", "toxic")]
    return bitmaps.mapInArrow(batches, COUNTS).groupBy("part", "subset", "filter").agg(*total)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    counts = written(subset_counts(written(index(docs, labels), "bitmaps")), "counts")
    return of_orders(counts)


def of_orders(counts: DataFrame) -> DataFrame:
    """What each step of each order removes, read off the sums of subset_counts."""
    n, spark = len(FILTERS), counts.sparkSession
    # a set stands before a filter in as many orders as its members and the rest can be arranged
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("subset") + 1)
    alone = F.col("subset") == (2**n - 1) - F.expr("shiftleft(1, filter)")
    whole = counts.groupBy("part", "filter").agg(F.sum(weight * F.col("removed")).alias("shapley"), F.sum(F.when(alone, F.col("removed")).otherwise(0)).alias("unique_fails"))
    steps = [("".join(o), k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), FILTERS.index(o[k])) for o in permutations(FILTERS) for k in range(n)]
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, subset int, filter int"))
    found = counts.join(whole, ["part", "filter"]).join(orders, ["subset", "filter"])
    return found.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failed") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, FALSE)::INT AS bits
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), h AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bits
), x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM x a, x b, x c, x d, x e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31
), s AS (SELECT filter_order, k::INT AS step, bs[k] AS own, coalesce(list_sum(bs[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) r(k)
), g AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN bits & before <> 0 AND bits & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN bits = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM h, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""
