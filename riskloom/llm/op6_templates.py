"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: runs of capitalised words, wherever they stand, become a name placeholder,
numbers a number placeholder, the unit after a number a unit placeholder, and what is left is lower-cased and cut into
runs of letters. Windows of five template tokens of the benchmark are hashed and joined with those of all documents. An
occurrence of an item in a document keeps its offset, so matched windows are grouped by document, item and offset, and
the values that stand behind the placeholders are compared there (of a name the last word, as a capitalised word may
precede it in one text only). An occurrence is consistent if each of the item's values maps to one value of the document
and back: the same text, or the same question with other numbers, names or units.

A window counts if its values are the item's own, or if its occurrence is consistent. An item leaks into a document if
such windows are at least half of the item's distinct windows; if values differ, there must also be four of them.

What says too little never matches. Windows need two plain words among their tokens; an item without such windows
matches nothing (see unmatchable). An item of fewer than five tokens leaks only into a text that has the same tokens and
values and no others, if one of them is a plain word: a document that merely holds a number or a common phrase stays.

The main path is DataFrame operations only. The benchmark's windows are broadcast only after they have been counted and
are few enough; otherwise both sides are shuffled by the window's hash.

Defined cases: null texts have no tokens; items without tokens match nothing; characters of the texts that are used as
placeholders count as blanks; rows that repeat doc_id and text are reported once; a null doc_id is reported as null.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import documents, table, written

WINDOW, COVERAGE = 5, 0.5
#: Plain words that a window has at least, and windows that must match if values differ.
WORDS, MATCHED = 2, 4
#: Windows of the benchmark that are broadcast at most, of about 200 bytes each.
MAX_BROADCAST = 500_000
NAME, NUMBER, UNIT, AFTER = "\ue000", "\ue001", "\ue002", "\ue003"
#: A capital that no letter precedes, and what follows; the capital is looked for first, as most places have none.
NAMES = r"\p{Lu}(?<!\p{L}\p{Lu})[\p{L}'-]*(?: \p{Lu}[\p{L}'-]*)*"
NUMBERS = r"[0-9][0-9.,:/]*[0-9]|[0-9]"
#: Unit words that are replaced right after a number.
UNITS = "kilometers|kilometres|kilograms|centimeters|centimetres|millimeters|millimetres|meters|metres|grams|liters|litres|pounds|ounces|inches|seconds|minutes|hours|days|weeks|months|years|dollars|euros|cents|percent|miles|feet|yards|degrees|km|kg|cm|mm|mg|ml|ms|lb|oz|ft|in|mi|gb|mb|kb|usd|eur|m|g|l|s|h"


def valued(text: Column) -> Column:
    """The array of a text's tokens; a placeholder stands on either side of the value it replaces."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), NAME + NUMBER + UNIT, "   ")
    named = F.regexp_replace(plain, F.lit(NAMES), F.lit(f"{NAME}$0{NAME}"))
    numbered = F.regexp_replace(named, F.lit(NUMBERS), F.lit(f"{NUMBER}$0{NUMBER}"))
    united = F.regexp_replace(F.lower(numbered), F.lit(rf"{NUMBER} *({UNITS})([^\p{{L}}]|$)"), F.lit(f"{NUMBER}{UNIT}$1{UNIT}$2"))
    return F.regexp_extract_all(united, F.lit(rf"[{NAME}-{UNIT}][^{NAME}-{UNIT}]+[{NAME}-{UNIT}]|\p{{L}}+"), F.lit(0))


#: SQL on arrays of such tokens: their templates, their values as they are compared, and how many are plain words.
TEMPLATE = f"transform({{0}}, x -> if(x >= '{NAME}' and x < '{AFTER}', left(x, 1), x))"
VALUES = f"transform({{0}}, x -> if(startswith(x, '{NAME}'), concat('{NAME}', substring_index(substring(x, 2), ' ', -1)), x))"
PLAIN = f"size(filter({{0}}, x -> not (x >= '{NAME}' and x < '{AFTER}')))"


#: SQL: the hashes of an array's templates, and that of the tokens of such hashes from a place on.
HASHES = f"transform({{0}}, x -> xxhash64(if(x >= '{NAME}' and x < '{AFTER}', left(x, 1), x)))"


def _hash(hashes: str, at: str, width: int) -> str:
    return f"xxhash64({', '.join(f'{hashes}[{at} + {k}]' for k in range(width))})"


def template(text: Column) -> Column:
    """The array of a text's template tokens."""
    return F.transform(valued(text), lambda x: F.when((x >= NAME) & (x < AFTER), F.left(x, F.lit(1))).otherwise(x))


def _crc() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, at, words, raw, hash and item_windows: the windows of each item that can match, at their offsets from 0, and how many distinct ones the item has."""
    tokens = items.select("item_id", valued(F.col("text")).alias("r")).filter(F.size("r") >= width)
    cut = tokens.select("item_id", F.expr(f"posexplode(transform(sequence(0, size(r) - {width}), i -> slice(r, i + 1, {width})))").alias("at", "raw"))
    cut = cut.filter(F.expr(PLAIN.format("raw")) >= WORDS).distinct().withColumns({"words": F.expr(TEMPLATE.format("raw")), "h": F.expr(HASHES.format("raw"))}).withColumn("hash", F.expr(_hash("h", "0", width))).drop("h")
    sums = cut.groupBy("item_id").agg(F.count_distinct("hash").alias("item_windows"))
    return cut.join(sums, "item_id")


def _short(items: DataFrame, width: int = WINDOW) -> DataFrame:
    tokens = items.select("item_id", valued(F.col("text")).alias("r"))
    return tokens.filter((F.size("r") < width) & (F.expr(PLAIN.format("r")) > 0)).distinct()


def unmatchable(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id of the items that nothing can match, as they say too little."""
    able = item_windows(items, width).select("item_id").unionByName(_short(items, width).select("item_id"))
    return items.select("item_id").distinct().join(able.distinct(), "item_id", "left_anti")


def _few(df: DataFrame) -> bool:
    return df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, width: int = WINDOW) -> DataFrame:
    """doc_id, crc (of the text), item_id, matched, item_windows, covered and kind, for each document and item that leaks into it."""
    windows = written(item_windows(items, width), "windows")
    short = written(_short(items, width), "short")
    some = F.broadcast if _few(windows) else lambda df: df
    brief = F.broadcast if _few(short) else lambda df: df
    rows = docs.select("doc_id", _crc().alias("crc"), valued(F.col("text")).alias("r"))

    # where a document has a window of some item, and whether it is a short item; hash and place only
    hashes = f"if(size(h) < {width}, array(xxhash64(h)), transform(sequence(0, size(h) - {width}), i -> {_hash('h', 'i', width)}))"
    hashed = rows.select("doc_id", "crc", F.expr(HASHES.format("r")).alias("h")).select("doc_id", "crc", (F.size("h") < width).alias("whole"), F.posexplode(F.expr(hashes)).alias("at", "hash"))
    wanted = windows.select("hash", F.lit(False).alias("whole")).unionByName(short.select(F.expr(f"xxhash64({HASHES.format('r')})").alias("hash"), F.lit(True).alias("whole"))).distinct()
    both = F.broadcast if _few(wanted) else lambda df: df
    found = written(hashed.join(both(wanted), ["hash", "whole"], "left_semi").distinct(), "found")

    # pairs that can't reach the coverage are left before any value is looked up
    pairs = found.filter("not whole").join(some(windows.select("hash", "item_id", F.col("at").alias("i_at"), "item_windows")), "hash")
    reach = pairs.groupBy("doc_id", "crc", "item_id").agg(F.count_distinct("hash").alias("m"), F.max("item_windows").alias("n")).filter(F.col("m") >= coverage * F.col("n"))
    reach = written(reach.select("doc_id", "crc", "item_id"), "reach")
    near = pairs.alias("p").join(reach.alias("r"), F.expr("p.doc_id <=> r.doc_id and p.crc = r.crc and p.item_id = r.item_id"), "left_semi")
    near = written(near, "near")

    # the tokens of these documents, cut at the matched places only
    places = near.select("doc_id", "crc", "at").unionByName(found.filter("whole").select("doc_id", "crc", "at")).groupBy("doc_id", "crc").agg(F.collect_set("at").alias("ats"))
    places = places.select(F.col("doc_id").alias("p_doc"), F.col("crc").alias("p_crc"), "ats")
    same_text = F.expr("doc_id <=> p_doc and crc = p_crc")
    texts = docs.select("doc_id", _crc().alias("crc"), "text").join(places, same_text).dropDuplicates(["doc_id", "crc"])
    tokens = texts.select("doc_id", "crc", "ats", valued(F.col("text")).alias("r"))
    cut = written(tokens.select("doc_id", "crc", F.explode(F.expr(f"transform(ats, a -> named_struct('at', a, 'raw', slice(r, a + 1, {width}), 'whole', size(r) < {width}))")).alias("c")).select("doc_id", "crc", "c.*"), "cut")

    held = near.alias("n").join(cut.filter("not whole").alias("c"), F.expr("n.doc_id <=> c.doc_id and n.crc = c.crc and n.at = c.at")).select("n.*", F.col("c.raw").alias("d_raw"))
    held = held.alias("h").join(some(windows.select("item_id", "at", "hash", "raw", "words")).alias("w"), F.expr("h.item_id = w.item_id and h.i_at = w.at and h.hash = w.hash"))
    held = held.filter(F.expr(f"{TEMPLATE.format('h.d_raw')} = w.words"))  # equal hashes of unequal windows
    spot = ["doc_id", "crc", "item_id", "offset"]
    held = held.selectExpr("h.doc_id", "h.crc", "h.item_id", "h.at - h.i_at as offset", "h.hash", "h.item_windows", f"{VALUES.format('w.raw')} as i", f"{VALUES.format('h.d_raw')} as d")
    values = held.select(*spot, F.explode(F.arrays_zip("i", "d")).alias("v")).filter(F.col("v.i") >= NAME).select(*spot, F.col("v.i").alias("i"), F.col("v.d").alias("d")).distinct()
    sound = values.groupBy(*spot).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i").alias("a"), F.count_distinct("d").alias("b")).selectExpr(*spot, "a = n and b = n as consistent")
    met = held.alias("h").join(sound.alias("s"), F.expr("h.doc_id <=> s.doc_id and h.crc = s.crc and h.item_id = s.item_id and h.offset = s.offset"), "left")
    met = met.selectExpr("h.*", "i = d as same", "coalesce(consistent, true) as consistent").filter("same or consistent")
    out = met.groupBy("doc_id", "crc", "item_id", "item_windows").agg(F.count_distinct("hash").alias("matched"), F.count_distinct(F.when(F.col("same"), F.col("hash"))).alias("own"))
    out = out.filter((F.col("own") >= coverage * F.col("item_windows")) | ((F.col("matched") >= coverage * F.col("item_windows")) & (F.col("matched") >= MATCHED)))
    out = out.select("doc_id", "crc", "item_id", "matched", "item_windows", F.when(F.col("own") == F.col("matched"), "verbatim").otherwise("reparameterised").alias("kind"))

    one = F.lit(1).cast("long")
    whole = cut.filter("whole").join(brief(short.select("item_id", F.expr(VALUES.format("r")).alias("i"))), F.expr(f"i = {VALUES.format('raw')}"))
    whole = whole.select("doc_id", "crc", "item_id", one.alias("matched"), one.alias("item_windows"), F.lit("verbatim").alias("kind")).distinct()
    return out.unionByName(whole).withColumn("covered", F.round(F.col("matched") / F.col("item_windows"), 6))


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "item_windows", "covered", "kind").distinct()


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns."""
    bad = written(leaks(docs, items).select(F.col("doc_id").alias("bad_doc"), F.col("crc").alias("bad_crc")).distinct(), "leaks")
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", _crc().alias("crc"))
    # Spark broadcasts the leaking ids if they are below its size threshold, else it sorts and merges
    return row.join(bad, F.expr("doc_id <=> bad_doc and crc = bad_crc"), "left_anti").select("row.*")


OP6_SQL = rf"""
WITH src AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), chr(57344) || chr(57345) || chr(57346), '   ') AS text FROM documents
  UNION ALL SELECT 'i', item_id, translate(coalesce(text, ''), chr(57344) || chr(57345) || chr(57346), '   ') FROM benchmark
), named AS (SELECT DISTINCT kind, id, text, regexp_replace(text, '(^|[^\p{{L}}])(\p{{Lu}}[\p{{L}}''-]*(?: \p{{Lu}}[\p{{L}}''-]*)*)', '\1' || chr(57344) || '\2' || chr(57344), 'g') AS t FROM src
), numbered AS (SELECT kind, id, text, lower(regexp_replace(t, '{NUMBERS}', chr(57345) || '\0' || chr(57345), 'g')) AS t FROM named
), united AS (SELECT kind, id, text, regexp_replace(t, chr(57345) || ' *({UNITS})([^\p{{L}}]|$)', chr(57345) || chr(57346) || '\1' || chr(57346) || '\2', 'g') AS t FROM numbered
), raws AS (
  SELECT kind, id, text, regexp_extract_all(t, '[' || chr(57344) || '-' || chr(57346) || '][^' || chr(57344) || '-' || chr(57346) || ']+[' || chr(57344) || '-' || chr(57346) || ']|\p{{L}}+') AS r FROM united
), tok AS (
  SELECT kind, id, text, list_transform(r, lambda x: CASE WHEN x[1] BETWEEN chr(57344) AND chr(57346) THEN x[1] ELSE x END) AS t,
         list_transform(r, lambda x: CASE WHEN x[1] = chr(57344) THEN chr(57344) || string_split(x[2:], ' ')[-1] ELSE x END) AS v FROM raws WHERE len(r) > 0
), w AS (
  SELECT kind, id, text, j, t[j:j + {WINDOW - 1}] AS t, v[j:j + {WINDOW - 1}] AS v FROM (SELECT *, unnest(range(1, len(t) - {WINDOW - 2})) AS j FROM tok WHERE len(t) >= {WINDOW})
), iw AS (
  SELECT DISTINCT id AS item_id, j, t, v FROM w WHERE kind = 'i' AND len(list_filter(t, lambda x: NOT x BETWEEN chr(57344) AND chr(57346))) >= {WORDS}
), n AS (SELECT item_id, count(DISTINCT t) AS item_windows FROM iw GROUP BY item_id
), pairs AS (SELECT d.id AS doc_id, d.text, d.j - i.j AS o, i.item_id, d.t, i.v AS iv, d.v AS dv FROM w d JOIN iw i ON d.t = i.t WHERE d.kind = 'd'
), vals AS (SELECT DISTINCT doc_id, text, item_id, o, iv, dv FROM (SELECT doc_id, text, item_id, o, unnest(iv) AS iv, unnest(dv) AS dv FROM pairs) WHERE iv >= chr(57344)
), sound AS (SELECT doc_id, text, item_id, o, count(*) = count(DISTINCT iv) AND count(*) = count(DISTINCT dv) AS fits FROM vals GROUP BY ALL
), met AS (
  SELECT p.doc_id, p.text, p.item_id, p.t, p.iv = p.dv AS same FROM pairs p
  LEFT JOIN sound s ON s.doc_id IS NOT DISTINCT FROM p.doc_id AND s.text = p.text AND s.item_id = p.item_id AND s.o = p.o WHERE p.iv = p.dv OR coalesce(fits, true)
), sums AS (
  SELECT doc_id, text, item_id, item_windows, count(DISTINCT t) AS matched, count(DISTINCT t) FILTER (same) AS own FROM met JOIN n USING (item_id) GROUP BY ALL
)
SELECT DISTINCT doc_id, item_id, matched, item_windows, round(matched / item_windows, 6) AS covered, CASE WHEN own = matched THEN 'verbatim' ELSE 'reparameterised' END AS kind
FROM sums WHERE own >= {COVERAGE} * item_windows OR matched >= {COVERAGE} * item_windows AND matched >= {MATCHED}
UNION
SELECT d.id, i.id, 1, 1, 1.0, 'verbatim' FROM tok d JOIN tok i ON d.t = i.t AND d.v = i.v
WHERE d.kind = 'd' AND i.kind = 'i' AND len(i.t) < {WINDOW} AND len(list_filter(i.t, lambda x: NOT x BETWEEN chr(57344) AND chr(57346))) > 0
"""
