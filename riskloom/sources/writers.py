"""Sinks: JSON documents, Parquet tables, graph tables, caches."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scratch import spread

#: What Spark writes as %XX in names of folders, and so do names of files.
UNSAFE = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_json(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Rows as JSON lines with sorted columns."""
    out = df.select(*sorted(df.columns))
    (out.sort(*order) if order else out).write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices by label and edges by kind as Parquet; repeated ids and edges are merged."""
    nodes.dropDuplicates(["label", "id"]).write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.dropDuplicates(["kind", "src", "dst"]).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")


#: Parts of a patch cache.
PARTS = 64


def part_of(cve_id: Column) -> Column:
    """The part of a patch cache that holds an id."""
    return F.abs(F.hash(cve_id)) % PARTS


def write_patches(patches: DataFrame, path: str) -> None:
    """A patch cache in parts by the id's hash, so that rewriting one id touches one part.

    That nothing was found for an id (status no_patch_found) is a row like any other.
    """
    patches.withColumn("part", part_of(F.col("cve_id"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def write_patch_files(patches: DataFrame, path: str) -> None:
    """A file of its own for each patch (cve_id, text), named CVE-....json after its id in capitals, as other tools read them.

    Tasks write the files, each whole before it gets its name, so their number is no work of the driver's. Of ids that
    differ in capitals alone the least text stays. In file systems that only Hadoop reaches Spark writes them, and the
    driver gives them their names.
    """
    from pyarrow import ArrowException
    from pyarrow.fs import FileSystem

    spark = patches.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(hadoop(path))
    named = patches.select(F.coalesce(F.nullif(F.replace(F.upper("cve_id"), F.lit("/"), F.lit("_")), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("name"), F.col("text").alias("value")).groupBy("name").agg(F.min("value").alias("value"))
    where = re.sub("^file:/+", "file:///", store.makeQualified(hadoop(path)).toString())
    try:
        FileSystem.from_uri(where)
    except (ArrowException, OSError):
        _write_through_spark(named, path, store, hadoop)
        return

    def write(parts: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        files, folder = FileSystem.from_uri(where)
        for batch in parts:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", name)
                begun = f"{folder}/_{uuid.uuid4().hex}"
                with files.open_output_stream(begun) as out:
                    out.write(f"{value or ''}\n".encode())
                files.move(begun, f"{folder}/{whole}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    spread(named, "name").mapInArrow(write, "n long").agg(F.sum("n")).first()


def _write_through_spark(named: DataFrame, path: str, store, hadoop) -> None:
    """The files (name, value) as parts that Spark writes and the driver renames."""
    parts = f"{path}/_parts"
    named.write.partitionBy("name").mode("overwrite").option("maxRecordsPerFile", 1).text(parts)
    for folder in store.globStatus(hadoop(f"{parts}/name=*")):
        name = folder.getPath().getName().split("=", 1)[1]
        for file in store.globStatus(hadoop(f"{parts}/name={name}/part-*")):
            store.rename(file.getPath(), hadoop(f"{path}/{name}.json"))
    store.delete(hadoop(parts), True)


def append_cache(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").partitionBy("tenant").json(path)


def write_exports(sarif: DataFrame, vex: DataFrame, components: DataFrame, path: str) -> None:
    for name, df in (("sarif", sarif), ("vex", vex), ("cyclonedx", components)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def rule_yaml(rules: DataFrame) -> DataFrame:
    """rule_id and text: a search rule with its patterns, from rows of rule_id, language, severity, message, patterns."""
    lines = F.transform("patterns", lambda p: F.concat(F.lit("      - pattern: "), p))
    head = F.concat(F.lit("rules:\n  - id: "), "rule_id", F.lit("\n    languages: ["), "language", F.lit("]\n    severity: "), "severity", F.lit("\n    message: "), "message", F.lit("\n    pattern-either:\n"))
    return rules.select("rule_id", F.concat(head, F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
