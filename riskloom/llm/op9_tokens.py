"""Token counts by a separator scan over flat token files.

Token files hold the ids of all documents of a part one after another, an end-of-document id after each, cut into blocks
of a fixed number of ids wherever that falls; there is no index of where documents begin. The scan finds the separators
of a block by one vector comparison and gives the block's summary: how many separators it has, the ids before the first
and after the last, and the counts between. Documents that straddle blocks are stitched by a prefix scan over the
summaries: the number of separators in earlier blocks numbers a block's documents, and what the blocks since the last
separator have left over is added to its first count.

The token files are a table in the shared folder, one row a block; the names of documents lie beside it in the order of
the files, as plain lists.

Ids come from a public vocabulary whose path is a parameter; it is read on the driver and sent to the executors.

Defined cases: null and empty texts have no tokens; a text that holds the separator's own name is ordinary text; rows
that repeat a doc_id are counted one by one; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import documents, scratch_root

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK = 65_536
FILES = "file long, block int, data binary, ids array<long>"


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(lines: bytes):
    """(encode(text) -> ids, the end-of-document id): the first id that the vocabulary leaves free."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, max(ranks.values()) + 1


_ENCODERS: dict = {}


def token_files(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """The blocks of flat token files of docs, and beside them rows without data that list the documents' names in order."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        key = hash(shared.value)
        if key not in _ENCODERS:
            _ENCODERS[key] = encoder(shared.value)
        encode, end = _ENCODERS[key]
        wide = np.dtype("<u2") if end < 2**16 else np.dtype("<u4")
        file, number, lists = TaskContext.get().partitionId(), 0, 0
        schema = pa.schema([("file", pa.int64()), ("block", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])
        left = np.zeros(0, wide)
        for batch in parts:
            yield pa.RecordBatch.from_pylist([{"file": file, "block": lists, "data": None, "ids": batch.column(0).to_pylist()}], schema=schema)
            lists += 1
            for at in range(0, batch.num_rows, 200):
                ids: list[int] = []
                for text in batch.column(1).slice(at, 200):
                    if t := text.as_py():
                        ids += encode(t.decode("utf-8", "replace"))
                    ids.append(end)
                left = np.concatenate((left, np.array(ids, wide)))
                whole = len(left) // block * block
                if whole:
                    yield pa.RecordBatch.from_pylist([{"file": file, "block": number + k, "data": left[k * block : (k + 1) * block].tobytes(), "ids": None} for k in range(whole // block)], schema=schema)
                    number += whole // block
                    left = left[whole:]
        if len(left):
            yield pa.RecordBatch.from_pylist([{"file": file, "block": number, "data": left.tobytes(), "ids": None}], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(batches, FILES)


SUMMARY = "file long, block int, n int, head long, tail long, inner array<long>"


def scan(blocks: DataFrame, end: int) -> DataFrame:
    """Of each block: its separators, the ids before the first (all, if there is none) and after the last, and the counts between."""

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        wide = np.dtype("<u2") if end < 2**16 else np.dtype("<u4")
        schema = pa.schema([("file", pa.int64()), ("block", pa.int32()), ("n", pa.int32()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))])
        for batch in parts:
            out = []
            for file, number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(data.as_buffer(), wide)
                at = np.flatnonzero(ids == end)
                head, tail = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (len(ids), 0)
                out.append({"file": file, "block": number, "n": len(at), "head": head, "tail": tail, "inner": (np.diff(at) - 1).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return blocks.select("file", "block", "data").mapInArrow(batches, SUMMARY)


def stitched(summaries: DataFrame) -> DataFrame:
    """file, place (of the document in its file, from 0) and n_tokens, by prefix sums over the blocks of a file."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a run of blocks begins with one that has a separator; what follows its last one belongs to the next run's first document
    runs = summaries.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("run", F.coalesce(F.sum((F.col("n") > 0).cast("int")).over(before), F.lit(0)))
    left = F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("head"))
    carried = runs.withColumn("gives", left).withColumn("upto", F.coalesce(F.sum("gives").over(before), F.lit(0)))
    # all given before a block less all given before the last block that had a separator
    since = F.max(F.when(F.col("n") > 0, F.struct("block", F.col("upto").alias("at")))).over(before)["at"]
    counted = carried.withColumn("carry", F.col("upto") - F.coalesce(since, F.lit(0))).filter("n > 0")
    counts = F.concat(F.array(F.col("head") + F.col("carry")), F.col("inner"))
    return counted.select("file", "first", F.posexplode(counts).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("place"), "n_tokens")


def counted(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of each row of docs."""
    import uuid

    spark = docs.sparkSession
    _, end = encoder(vocabulary(path))
    where = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_files(docs, path, block).write.option("compression", "zstd").parquet(where)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    files = spark.read.schema(FILES).parquet(where)
    sums = stitched(scan(files.filter("data is not null"), end))
    lists = files.filter("ids is not null").withColumn("n", F.size("ids"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = lists.withColumn("first", first).select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("place"), "doc_id")
    return names.join(sums, ["file", "place"]).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir))
