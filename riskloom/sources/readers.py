"""Readers of the file sources, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.text import normalize_name
from riskloom.sources import schemas as sc
from riskloom.sources.writers import part_of

PIN = r"^([A-Za-z0-9._-]+)(\[[^\]]*\])?\s*==\s*([^\s#;]+)"
MAX_SOURCE_BYTES, NUL_WINDOW = 2_097_152, 8192


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document or array of them; malformed ones are dropped, a missing path has no rows."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED") if _exists(spark, path) else spark.createDataFrame([], schema)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, sc.FINDING)


def read_raw_scan(spark: SparkSession, path: str) -> DataFrame:
    from riskloom.operators.findings import flatten_scan

    return flatten_scan(read_json(spark, path, sc.RAW_SCAN))


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """cve_id, epss, percentile of a snapshot whose keys are the ids."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "cve_id STRING, epss DOUBLE, percentile DOUBLE")
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", sc.EPSS)).alias("cve_id", "v"))
    return whole.filter("cve_id like 'CVE-%'").select("cve_id", "v.epss", "v.percentile")


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, sc.KEV).select(F.explode("catalog").alias("cve_id"))


def read_patches(spark: SparkSession, folder: str) -> DataFrame:
    """All cached patches, CVE-*.json; corrupt files are skipped. The folder is listed once, as a path for each file would be listed by itself."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], sc.PATCH)
    return spark.read.schema(sc.PATCH).json(folder, multiLine=True, mode="DROPMALFORMED", pathGlobFilter="CVE-*.json")


def lookup_patch(spark: SparkSession, path: str, cve_id: str) -> DataFrame:
    """What the patch cache of writers.write_patches holds for an id, in any case: one part is read. No row: it was never looked for."""
    wanted = F.lit(cve_id.upper())
    return spark.read.parquet(path).filter((F.col("part") == part_of(wanted)) & (F.col("cve_id") == wanted)).drop("part")


def lookup_patches(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """cve_id (upper case) of each distinct id, and what the patch cache holds for it; status is not_fetched where it holds nothing.

    Ids and cache meet by part and id, so that parts which no id lies in are pruned when the ids are few.
    """
    wanted = ids.select(F.upper("cve_id").alias("cve_id")).filter("cve_id is not null").distinct().withColumn("part", part_of(F.col("cve_id")))
    found = wanted.join(spark.read.parquet(path), ["part", "cve_id"], "left").drop("part")
    return found.withColumn("status", F.coalesce("status", F.lit("not_fetched")))


def read_dependency_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """Raw graphs with the file they came from."""
    return spark.read.schema(sc.DEPENDENCY_GRAPH).json(folder, multiLine=True, recursiveFileLookup=True, mode="DROPMALFORMED").withColumn("file", F.input_file_name())


def direct_dependencies(graphs: DataFrame) -> DataFrame:
    """parent, parent_version, dep, spec, dep_version: the edges from the graph's own node to direct ones, markers cut off."""
    rows = graphs.withColumn("g", F.monotonically_increasing_id()).withColumn("self", F.coalesce(F.expr("nullif(array_position(transform(nodes, n -> n.relation), 'SELF'), 0) - 1"), F.lit(0)).cast("int"))
    edges = rows.select("nodes", "self", F.explode("edges").alias("e")).filter("e.fromNode = self and e.toNode < size(nodes)")
    ends = edges.select(F.expr("nodes[self].versionKey").alias("p"), F.expr("nodes[e.toNode]").alias("c"), F.col("e.requirement").alias("requirement")).filter("c.relation = 'DIRECT'")
    spec = F.trim(F.split(F.coalesce("requirement", F.lit("")), ";")[0])
    return ends.select(normalize_name(F.col("p.name")).alias("parent"), F.col("p.version").alias("parent_version"), normalize_name(F.col("c.versionKey.name")).alias("dep"), F.when(spec == "", F.concat(F.lit("=="), "c.versionKey.version")).otherwise(spec).alias("spec"), F.col("c.versionKey.version").alias("dep_version"))


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """cve, note (200 characters at most) and cvss of advisories; a score that isn't a number counts 0."""
    rows = read_json(spark, path, sc.ADVISORY).select(F.explode("vulns").alias("v"))
    cve = F.coalesce(F.get(F.filter("v.aliases", lambda a: a.startswith("CVE-")), F.lit(0)), F.col("v.id"))
    score = F.get(F.filter("v.severity", lambda s: s["type"] == "CVSS_V3"), F.lit(0))["score"].try_cast("double")
    return rows.select(cve.alias("cve"), F.substring(F.coalesce("v.summary", "v.details", F.lit("")), 1, 200).alias("note"), F.coalesce(score, F.lit(0.0)).alias("cvss"))


def pins_of_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Pinned requirements: name==version lines; comments, options, ranges and blanks go."""
    return lines.filter(F.col(line).rlike(PIN)).withColumn("package", normalize_name(F.regexp_extract(line, PIN, 1))).withColumn("version", F.regexp_extract(line, PIN, 3))


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    return pins_of_lines(spark.read.text(path).select(F.trim("value").alias("line"))).select("package", "version")


def poetry_pin(spec: Column) -> Column:
    """The version that a poetry specifier names: without caret, tilde and operator; null for * and ranges."""
    plain = F.regexp_replace(F.trim(spec), r"^[\^~=]+\s*", "")
    return F.when(plain.rlike(r"^\d[\w.]*$"), plain)


def pins_of_toml(texts: DataFrame) -> DataFrame:
    """path, package, version, kind of pyproject.toml and Pipfile texts (path, text), parsed in batches."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "package", "version", "kind")])

    def parse(parts):
        import re
        import tomllib

        import pandas as pd

        for pdf in parts:
            out = []
            for path, text in zip(pdf.path, pdf.text):
                try:
                    doc = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                listed = [(m[1], m[3], "project") for d in doc.get("project", {}).get("dependencies", []) if (m := re.match(PIN, d.strip()))]
                tables = [("poetry", doc.get("tool", {}).get("poetry", {}).get("dependencies", {})), ("pipfile", doc.get("packages", {}))]
                for kind, table in tables:
                    for name, raw in table.items():
                        spec = raw.get("version", "") if isinstance(raw, dict) else str(raw)
                        m = re.match(r"^[\^~=]*\s*(\d[\w.]*)$", spec.strip())
                        if m and name.lower() != "python":
                            listed.append((name, m[1], kind))
                out += [(path, re.sub("[-_.]+", "-", n).lower(), v, k) for n, v, k in listed]
            yield pd.DataFrame(out, columns=["path", "package", "version", "kind"])

    return texts.select("path", "text").mapInPandas(parse, schema)


def first_usable(candidates: DataFrame) -> DataFrame:
    """The pins of the source with the least priority that has any. candidates: priority, package, version."""
    return candidates.join(candidates.agg(F.min("priority").alias("priority")), "priority")


def read_sources(spark: SparkSession, folder: str, suffix: str = ".py", ignored: tuple[str, ...] = ("venv", "node_modules", ".git", "__pycache__")) -> DataFrame:
    """path and text of source files: not in ignored folders, at most 2 MiB, text in UTF-8 without NUL at the beginning."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    parts = F.split("path", "/")
    kept = files.filter((F.col("length") <= MAX_SOURCE_BYTES) & ~F.arrays_overlap(parts, F.array(*map(F.lit, ignored))))
    text = F.expr("if(is_valid_utf8(cast(content as string)), cast(content as string), null)")
    return kept.filter(F.expr(f"position(x'00' in substring(content, 1, {NUL_WINDOW})) = 0")).select("path", text.alias("text")).filter("text is not null")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, sc.CORPUS).select(F.explode("cases").alias("c")).select("c.*")


def corpus_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, sc.CORPUS).drop("cases")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(sc.AUDIT).json(path)


def stream_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(sc.AUDIT).json(path)


def read_snapshot_edges(spark: SparkSession, path: str) -> DataFrame:
    """kind, src, dst of a graph snapshot."""
    return read_json(spark, path, sc.SNAPSHOT).select(F.explode("edges").alias("kind", "e")).select("kind", F.explode("e").alias("e")).select("kind", F.col("e.from").alias("src"), F.col("e.to").alias("dst"))


def rules_by_cwe(rules: DataFrame) -> DataFrame:
    """cwe and its rules, from rows of rule_id, language, severity and raw weakness texts."""
    from riskloom.functions.text import cwe_id

    rows = rules.select("rule_id", "language", "severity", F.explode("cwe").alias("raw")).withColumn("cwe", cwe_id(F.col("raw"))).filter("cwe != ''")
    return rows.groupBy("cwe").agg(F.array_sort(F.collect_list(F.struct("rule_id", "language", "severity"))).alias("rules"))


def read_flywheel(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, sc.FLYWHEEL)


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a small YAML list, such as services; needs the yaml package."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]  # one small file
    doc = yaml.safe_load(text) or []
    rows = doc.get("services", []) if isinstance(doc, dict) else doc
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
