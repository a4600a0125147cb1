"""Sharding by fixed virtual slots.

Every row is hashed into one of 8192 virtual slots by its doc_id. Bytes and rows are aggregated per slot, and the
slot-to-shard map, a versioned table of 8192 rows, deals the slots out: the largest first, each to the shard that holds
the fewest bytes. Rebalancing edits the map and moves whole slots; rows are never hashed anew. A row's place in its shard
is the number of rows in the shard's earlier slots plus its rank in its own slot, so no task ever sorts a whole shard.

The map is a table: store() appends a version of it to a folder, stored() reads one, and rebalance() gives the next
version with the slots moved that even out the shards, or fill new ones.

The main path is DataFrame operations only. The driver sees the 8192 rows of the map and nothing else.

Defined cases: a null text counts no bytes, so its size is 8 and its crc32 is 0, as for the empty text; a null doc_id
hashes by its text; rows that repeat a doc_id share a slot and take places of their own (so a doc_id with more than a
shard's share of all bytes leaves the shards uneven). Empty tables give no rows. Extra columns are ignored, or carried
along, and input columns named like results are not read.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import documents, scratch_root, written

SLOTS, SHARDS, OVERHEAD = 8192, 24, 8
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version", "rank", "first")


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def slotted(docs: DataFrame, slots: int = SLOTS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row; carry: with all columns that have other names than results."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), text)
    held = [c for c in docs.columns if c not in RESULTS] if carry else ["doc_id"]
    return docs.select(*held, (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot(key, slots).alias("virtual_slot"))


def slot_sums(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(virtual_slot, bytes, rows): as many entries as there are slots, at most."""
    return [tuple(r) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()]


def assign(sums: list[tuple[int, int, int]], shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: the largest slot first, to the shard with the fewest bytes, the lower number on ties."""
    held = {s: b for s, b, _ in sums}
    loads = [(0, k) for k in range(shards)]
    shard_of = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-held.get(s, 0), s)):
        load, k = heapq.heappop(loads)
        shard_of[slot] = k
        heapq.heappush(loads, (load + held.get(slot, 0), k))
    return shard_of


def even(shard_of: list[int], sums: list[tuple[int, int, int]], shards: int, tolerance: float = 0.01) -> tuple[list[int], list[int]]:
    """An edited map and the slots that moved: slots go from the fullest shard to the emptiest while that evens them out.

    shards may be larger than before (new shards begin empty) or smaller (their slots move first).
    """
    held, out, moved = {s: b for s, b, _ in sums}, list(shard_of), []
    loads = [0] * shards
    homeless = [s for s, k in enumerate(out) if k >= shards]
    for slot, k in enumerate(out):
        if k < shards:
            loads[k] += held.get(slot, 0)
    for slot in sorted(homeless, key=lambda s: (-held.get(s, 0), s)):
        out[slot] = k = min(range(shards), key=lambda x: (loads[x], x))
        loads[k] += held.get(slot, 0)
        moved.append(slot)
    mean = sum(loads) / max(1, shards)
    for _ in range(len(out)):
        most, least = max(range(shards), key=lambda x: (loads[x], -x)), min(range(shards), key=lambda x: (loads[x], x))
        gap = loads[most] - loads[least]
        if gap <= tolerance * mean:
            break
        fit = [s for s, k in enumerate(out) if k == most and 0 < held.get(s, 0) < gap]
        if not fit:
            break
        slot = min(fit, key=lambda s: (abs(gap - 2 * held[s]), s))
        out[slot] = least
        loads[most] -= held[slot]
        loads[least] += held[slot]
        moved.append(slot)
    return out, moved


def slot_map(spark: SparkSession, shard_of: list[int], sums: list[tuple[int, int, int]], version: int = 1) -> DataFrame:
    """version, virtual_slot, shard, bytes, n and first, the shard's rows in its earlier slots: one row a slot."""
    size, count = {s: b for s, b, _ in sums}, {s: n for s, _, n in sums}
    first, seen = [], {}
    for slot, k in enumerate(shard_of):
        first.append(seen.get(k, 0))
        seen[k] = first[-1] + count.get(slot, 0)

    def listed(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",")[F.col("id").cast("int")].cast("long")

    slots = range(len(shard_of))
    return spark.range(len(shard_of)).select(
        F.lit(version).alias("version"),
        F.col("id").cast("int").alias("virtual_slot"),
        listed(shard_of).cast("int").alias("shard"),
        listed([size.get(s, 0) for s in slots]).alias("bytes"),
        listed([count.get(s, 0) for s in slots]).alias("n"),
        listed(first).alias("first"),
    )


def rebalance(held: DataFrame, shards: int) -> DataFrame:
    """The next version of a slot map, dealt anew over this many shards by moving as few slots as even them out."""
    rows = sorted((r.virtual_slot, r.shard, r.bytes, r.n, r.version) for r in held.collect())  # a row for each slot
    sums = [(s, b, n) for s, _, b, n, _ in rows]
    shard_of, _ = even([k for _, k, *_ in rows], sums, shards)
    return slot_map(held.sparkSession, shard_of, sums, 1 + max((v for *_, v in rows), default=0))


def store(held: DataFrame, path: str) -> None:
    """Adds a version of the map to those under path."""
    held.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map under path, the latest by default."""
    held = spark.read.parquet(path)
    found = held.agg(F.max("version")).first()[0] if version is None else version
    return held.filter(F.col("version") == found).select("version", "virtual_slot", "shard", "bytes", "n", "first")


def placed(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows of slotted() with the shard and place that the map gives them."""
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    # the map has as many rows as there are slots, whatever the input: 8192
    out = rows.withColumn("rank", rank).join(F.broadcast(held.select("virtual_slot", "shard", "first", F.col("version").alias("map_version"))), "virtual_slot")
    return out.withColumns({"law": F.lit("bytes"), "slot": (F.col("first") + F.col("rank") - 1).cast("long"), "grown_shard": F.lit(None).cast("int")})


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, carry: bool = False) -> DataFrame:
    """Each row's size, text_crc32, law, shard, slot, grown_shard, virtual_slot and map_version; carry: beside its own columns."""
    spark = docs.sparkSession
    rows = slotted(docs, slots, carry) if carry else written(slotted(docs, slots), "slotted")
    sums = slot_sums(rows)
    path = f"{scratch_root(spark)}/slot_map-{uuid.uuid4().hex}"
    store(slot_map(spark, assign(sums, shards, slots), sums), path)
    own = [c for c in rows.columns if c not in RESULTS]
    return placed(rows, stored(spark, path)).select(*own, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version")


def op3_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))


#: DuckDB has no crc32: it is folded over the bytes with the table of the reflected polynomial.
OP3_SQL = f"""
WITH RECURSIVE poly AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i))
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, text, ''))[1:8])::BIGINT % {SLOTS} AS vs FROM documents
), bytes AS (
  SELECT text, list_transform(range(octet_length(encode(text))), lambda i: ('0x' || hex(encode(text))[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM (SELECT DISTINCT text FROM d)
), crc AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a // 256, poly.t[(xor(a % 256, x) + 1)::INT])), 4294967295::BIGINT) AS crc FROM bytes, poly
), sums AS (SELECT vs, sum(size)::BIGINT AS b, count(*) AS n FROM d GROUP BY vs
), ordered AS (SELECT *, row_number() OVER (ORDER BY b DESC, vs) AS i FROM sums
), lpt(i, vs, shard, loads) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::INT, list_transform(range({SHARDS}), lambda x: 0::BIGINT)
  UNION ALL
  SELECT o.i, o.vs, list_position(l.loads, list_min(l.loads))::INT - 1,
         list_transform(l.loads, lambda x, k: x + CASE WHEN k = list_position(l.loads, list_min(l.loads)) THEN o.b ELSE 0 END)
  FROM lpt l JOIN ordered o ON o.i = l.i + 1
), placed AS (
  SELECT d.doc_id, d.size, c.crc, p.shard, d.vs FROM d JOIN lpt p ON p.vs = d.vs JOIN crc c ON c.text = d.text
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY vs, doc_id, crc, size) - 1 AS slot,
       NULL::INT AS grown_shard, vs::INT AS virtual_slot, 1 AS map_version
FROM placed
"""
