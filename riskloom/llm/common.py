"""What the pipeline operators share: word rules, the scratch folder and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words as a long; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset (tests), a temporary one is set."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="riskloom-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back, which cuts lineage; Spark removes it when it ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns whose names an operator is about to add."""
    return df.drop(*[c for c in names if c in df.columns])


def pack(*columns: object) -> bytes:
    """Columns byte by byte, the first, which is sorted, as differences."""
    import numpy as np
    import pyarrow as pa

    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (first, *columns[1:])]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(data: object, n: int, *kinds: object) -> list:
    import numpy as np
    import pyarrow as pa

    raw = np.frombuffer(pa.decompress(data, n * sum(np.dtype(k).itemsize for k in kinds), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind in kinds:
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(kind).reshape(n))
        at += n * wide
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def buckets_of(keys: object, buckets: int) -> object:
    """The bucket of each 64-bit hash, in the order of the hashes."""
    import numpy as np

    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dealt(number: int, buckets: int) -> int:
    """A bucket for a number, whatever its lower digits have in common with others."""
    return ((number * 0x9E3779B97F4A7C15 % 2**64) >> 32) * buckets >> 32


def spans(sorted_values: object) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values, none of which is negative."""
    import numpy as np

    cuts = [*np.flatnonzero(np.diff(sorted_values, prepend=-1)).tolist(), len(sorted_values)]
    return [(int(sorted_values[x]), x, y) for x, y in zip(cuts, cuts[1:])]


def arrow_schema(ddl: str) -> object:
    """For Arrow what says "name type, ..." to Spark, of plain types and array<struct<name:type,...>>."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = []
    for name, kind in (f.split(" ") for f in ddl.split(", ")):
        inner = kind.removeprefix("array<struct<").removesuffix(">>")
        fields.append((name, kinds[kind] if inner == kind or kind in kinds else pa.list_(pa.struct([(n, kinds[t]) for n, t in (f.split(":") for f in inner.split(","))]))))
    return pa.schema(fields)
