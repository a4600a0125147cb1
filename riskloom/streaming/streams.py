"""Structured Streaming forms of the stateful operators, run over what is available."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.canonical import HASH
from riskloom.operators.windows import ZERO, chained


def counters(events: DataFrame, *by: str) -> DataFrame:
    """Running counts and sums of value by key; for update or complete mode."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type and window of event time; what is later than the watermark is left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def first_seen(contents: DataFrame, key: str = "key") -> DataFrame:
    """The first row of each content key: only misses go on to be scanned."""
    return contents.dropDuplicates([key])


def chain_log(entries: DataFrame, key: str = "tenant") -> DataFrame:
    """Entries with prev_hash and entry_hash; each key's chain is its state, so a key has one writer.

    Entries of a batch are chained in order of seq; a null payload is empty. A key's entries of a batch are held as arrays.
    """
    out = f"{key} string, seq long, payload string, prev_hash string, entry_hash string"

    def append(k, parts: Iterator, state) -> Iterator:
        import hashlib

        import pandas as pd

        last = state.get[0] if state.exists else ZERO
        rows = [(int(seq), None if pd.isna(payload) else payload) for part in parts for seq, payload in zip(part.seq, part.payload)]
        done = []
        for seq, payload in sorted(rows, key=lambda r: r[0]):
            entry = hashlib.sha256((last + (payload or "").replace(HASH, last)).encode()).hexdigest()
            done.append((k[0], seq, payload, last, entry))
            last = entry
        state.update((last,))
        yield pd.DataFrame(done, columns=[key, "seq", "payload", "prev_hash", "entry_hash"])

    return entries.select(key, "seq", "payload").groupBy(key).applyInPandasWithState(append, out, "last string", "append", "NoTimeout")


#: The columns of a chained log, and of the tail of each of its chains.
LOG = "tenant STRING, seq BIGINT, payload STRING, prev_hash STRING, entry_hash STRING"
TAILS = "tenant STRING, last_hash STRING, last_seq BIGINT"


def append_batch(entries: DataFrame, batch: int, path: str) -> None:
    """Appends a batch of entries (tenant, seq, payload) to the chained log under path.

    The log is its batches, and so are its tails: each batch leaves the last hash and seq of every chain. A batch goes on
    from the tails that the one before it left, leaves out what these already hold, and writes its folders anew; so one
    that is run again after a failure gives the same log, and another writer's chain isn't forked. The chains are sorted
    and folded by Spark's tasks, a row at a time.
    """
    spark = entries.sparkSession
    tails = _tails(spark, path, batch)
    new = entries.select("tenant", F.col("seq").cast("long").alias("seq"), "payload").dropDuplicates(["tenant", "seq"])
    new = new.join(tails.select(F.col("tenant").alias("_t"), "last_seq"), F.col("tenant").eqNullSafe(F.col("_t")), "left").filter("last_seq is null or seq > last_seq").select("tenant", "seq", "payload")
    chained(new, "tenant", "seq", "payload", tails).write.mode("overwrite").parquet(f"{path}/log/batch={batch}")
    done = spark.read.schema(LOG).parquet(f"{path}/log/batch={batch}")
    ends = done.groupBy("tenant").agg(F.max_by("entry_hash", "seq").alias("last_hash"), F.max("seq").alias("last_seq"))
    both = tails.unionByName(ends).groupBy("tenant").agg(F.max_by("last_hash", "last_seq").alias("last_hash"), F.max("last_seq").alias("last_seq"))
    both.write.mode("overwrite").parquet(f"{path}/tails/batch={batch}")


def _tails(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The tails that the last batch before this one left."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/tails")
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []
    earlier = [n for n in (int(x.split("=")[1]) for x in names if x.startswith("batch=")) if n < batch]
    done = [n for n in earlier if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/tails/batch={n}/_SUCCESS"))]
    return spark.read.schema(TAILS).parquet(f"{path}/tails/batch={max(done)}") if done else spark.createDataFrame([], TAILS)


def append_log(entries: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that a stream of entries has available to the chained log under path, batch by batch, and ends."""
    entries.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: append_batch(df, n, path)).start().awaitTermination()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log under path; its batches are those that left their tails."""
    log, tails = spark.read.schema(f"{LOG}, batch INT").parquet(f"{path}/log"), spark.read.schema(f"{TAILS}, batch INT").parquet(f"{path}/tails")
    return log.join(tails.select("batch").distinct(), "batch", "left_semi").drop("batch")


#: The state store that states with timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scans_due(contents: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Rows (key, ts) whose content must be scanned: the first of a key, and the first at or after so many seconds since its last scan.

    The state of a key is the time of its last scan; a timer of event time drops it once it has expired, so the state
    holds no more than the keys of the last period. A key's times of a batch are taken in order. Rows later than the
    watermark are left out.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Scans(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.last = handle, handle.getValueState("last", "ts long")

        def handleInputRows(self, key, rows, timers) -> Iterator:
            import numpy as np
            import pandas as pd

            # microseconds whatever unit the batch has
            times = np.sort(np.concatenate([r["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) for r in rows]))
            last, due = self.last.get()[0] if self.last.exists() else None, []
            at = 0 if last is None else int(np.searchsorted(times, last + seconds * 1_000_000))
            while at < len(times):
                last = int(times[at])
                due.append(last)
                at = int(np.searchsorted(times, last + seconds * 1_000_000))
            if due:
                for t in [*self.handle.listTimers()]:
                    self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
                self.last.update((last,))
                self.handle.registerTimer(last // 1000 + seconds * 1000)
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(due), dtype=object), "ts": pd.array(np.array(due, np.int64).astype("datetime64[us]"))})

        def handleExpiredTimer(self, key, timers, expired) -> Iterator:
            self.last.clear()
            return iter(())

        def close(self) -> None:
            pass

    timed = contents.select("key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(Scans(), "key string, ts timestamp", "append", "eventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their states in the store that timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is available to Parquet and ends; modes that rewrite results keep the last batch's."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
