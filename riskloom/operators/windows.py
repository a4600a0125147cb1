"""Window operators: hash chains, loops, context lines, splits, compressed histories, ids and steps in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from riskloom.functions.canonical import HASH

ZERO = "0" * 64


def chained(log: DataFrame, key: str, order: str, payload: str, tails: DataFrame | None = None) -> DataFrame:
    """Entries with prev_hash and entry_hash, the SHA-256 of the predecessor's hash and the payload. Every key is a chain of its own.

    A payload that says canonical.HASH holds the predecessor's hash there; a null one is empty. A chain goes on from the
    last_hash that tails (key, last_hash) has of its key, or begins with zeros. It is folded from its first entry to its
    last, a row at a time, by the task that gets its key; no chain is held in memory.
    """

    def fold(parts: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        chain, last, begun = None, ZERO, False
        for batch in parts:
            before, own = [], []
            for k, text, tail in zip(batch.column(keyed).to_pylist(), batch.column(said).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if not begun or k != chain:
                    chain, last, begun = k, tail or ZERO, True
                before.append(last)
                last = hashlib.sha256((last + (text or "").replace(HASH, last)).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(before, pa.string()), pa.array(own, pa.string())], [*batch.schema.names[:-1], "prev_hash", "entry_hash"])

    log = log.drop("prev_hash", "entry_hash")
    keyed, said = log.columns.index(key), log.columns.index(payload)
    if tails is None:
        known = log.withColumn("_tail", F.lit(None).cast("string"))
    else:
        last = tails.select(F.col(key).alias("_key"), F.col("last_hash").alias("_tail"))
        known = log.join(last, F.col(key).eqNullSafe(F.col("_key")), "left").select(*log.columns, "_tail")
    sorted_ = known.repartition(key).sortWithinPartitions(key, order)
    return sorted_.mapInArrow(fold, StructType([*log.schema, StructField("prev_hash", StringType()), StructField("entry_hash", StringType())]))


def entry_hash(payload: str) -> Column:
    """The hash that an entry of prev_hash and payload must have; null if prev_hash is."""
    return F.sha2(F.concat("prev_hash", F.replace(F.coalesce(payload, F.lit("")), F.lit(HASH), F.col("prev_hash"))), 256)


def verify(chain: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """key, entries and broken_at: the first entry whose own hash or link to its predecessor doesn't hold; null if all do.

    An entry without prev_hash or entry_hash is broken. An entry's predecessor is looked up by its hash. If each entry but
    one has an earlier predecessor, and no two have the same, the entries are one chain in their order; the first entry at
    which this fails is where it breaks.
    """
    own = ~F.coalesce(entry_hash(payload) == F.col("entry_hash"), F.lit(False))
    place = F.row_number().over(Window.partitionBy(key, "prev_hash").orderBy(order))
    held = chain.select(F.col(key).alias("_key"), F.col(order).alias("_at"), "prev_hash", own.alias("_own"), place.alias("_place"))
    before = chain.groupBy(F.col(key).alias("_k"), F.col("entry_hash").alias("_hash")).agg(F.min(order).alias("_before"))
    held = held.join(before, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("prev_hash") == F.col("_hash")), "left")
    unlinked = F.when(F.col("prev_hash") == ZERO, F.lit(False)).otherwise(F.coalesce(F.col("_before") >= F.col("_at"), F.lit(True)))
    bad = F.col("_own") | (F.col("_place") > 1) | unlinked
    return held.groupBy(F.col("_key").alias(key)).agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(bad, F.col("_at"))).alias("broken_at"))


def tail_hash(chain: DataFrame, key: str, order: str) -> DataFrame:
    return chain.groupBy(key).agg(F.max_by("entry_hash", order).alias("last_hash"))


def repeats(steps: DataFrame, key: str, order: str, *what: str) -> DataFrame:
    """Steps equal to the step before them."""
    w = Window.partitionBy(key).orderBy(order)
    same = None
    for c in what:
        test = F.col(c) == F.lag(c).over(w)
        same = test if same is None else same & test
    return steps.withColumn("_same", same).filter("_same").drop("_same")


def context(lines: DataFrame, hits: DataFrame, before: int = 3) -> DataFrame:
    """hit_id and code: the lines about a hit, numbered, the hit's own marked. lines: file, line_no, text."""
    near = hits.withColumn("line_no", F.explode(F.sequence(F.greatest(F.col("line") - before, F.lit(1)), F.col("line") + before)))
    shown = near.join(lines, ["file", "line_no"]).withColumn("shown", F.format_string("%s %4d | %s", F.when(F.col("line_no") == F.col("line"), ">>>").otherwise("   "), "line_no", "text"))
    return shown.groupBy("hit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "shown"))), lambda x: x["shown"]), "\n").alias("code"))


def temporal_split(rows: DataFrame, key: str, order: list[str], share: float) -> DataFrame:
    """rows with train: true for the first int(n * share) of each key in order."""
    w = Window.partitionBy(key)
    return rows.withColumn("train", F.row_number().over(w.orderBy(*order)) <= F.floor(F.count(F.lit(1)).over(w) * F.lit(share)))


def compressed(steps: DataFrame, key: str, order: str, text: str, last: int = 5, limit: int = 8000) -> DataFrame:
    """key and history: the last steps as they are, how many came before, at most limit characters."""
    ranked = steps.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    kept = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= last, F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))), lambda x: x["t"]).alias("texts"))
    early = F.when(F.col("n") > last, F.concat(F.lit("["), (F.col("n") - last).cast("string"), F.lit(" earlier steps] "))).otherwise("")
    return kept.select(key, F.substring(F.concat(early, F.array_join("texts", " | ")), 1, limit).alias("history"))


def digests(rows: DataFrame, key: str, order: list[str], text: str, size: int = 64) -> DataFrame:
    """key and digest: the first hex digits of the SHA-256 of each key's texts, one after another in order.

    The text of a key is never put together: its rows come sorted and are folded one by one, so a key may hold any number.
    """

    def fold(parts: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        now, state = None, None
        for batch in parts:
            done: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or k != now:
                    if state is not None:
                        done.append((now, state.hexdigest()[:size]))
                    now, state = k, hashlib.sha256()
                state.update((t or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*done)] or [pa.array([], pa.string())] * 2, [key, "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state.hexdigest()[:size]], pa.string())], [key, "digest"])

    sorted_ = rows.select(F.col(key).cast("string").alias(key), text, *[F.col(c).alias(f"_{n}") for n, c in enumerate(order)]).repartition(key).sortWithinPartitions(key, *[f"_{n}" for n in range(len(order))])
    return sorted_.select(key, text).mapInArrow(fold, f"{key} string, digest string")
