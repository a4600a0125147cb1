"""Intermediates of loops, written once under the shared checkpoint folder and read again, which cuts their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where it is unset, as in tests, a temporary one is set."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="riskloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def folder(spark: SparkSession, kind: str = "cut") -> str:
    """A new path under the shared folder; Spark removes it when it ends."""
    path = f"{root(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a written table, which survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: Column | str) -> DataFrame:
    """df dealt by the columns to as many partitions as the session shuffles to, one a core at least, for work that costs more than its rows weigh.

    A small table is often one partition, and AQE would join small ones again; a set number of them stays.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a column that numbers its rows from 1 in this order, which should tell all rows apart.

    Rows are range-sorted and written; the rows of each partition are counted, and a row's number is its place in its
    partition after those before it. No task sees more than a partition.
    """
    place = F.monotonically_increasing_id()
    held = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(place, 33), "_place": place.bitwiseAND((1 << 33) - 1)}))
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


class Grown:
    """A table that a loop adds to: each round's rows are written once, beside those of the rounds before."""

    def __init__(self, first: DataFrame):
        self.path, self.schema, self.rounds, self.spark = folder(first.sparkSession), first.schema, 0, first.sparkSession
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a round's rows and returns them as read back."""
        path = f"{self.path}/{self.rounds}"
        df.select(*self.schema.names).write.parquet(path)
        self.rounds += 1
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{k}" for k in range(self.rounds)))
