"""Line deduplication by winnowing over line hashes: later copies of runs of lines are deleted.

A text is the sequence of its lines that hold a word; a line's hash is that of its words. From each line on, the least
lines that hold WINDOW words are a window, and of each window the line with the least hash (the last on ties) is an
anchor. An anchor's fingerprints are the hashes of what lies about it: the least lines up to it, and from it on, that hold
as many words as a LEVEL. Windows and levels are counted in words, so a long line is a window of its own, and short lines
count only beside others: "Yes." or a rule between paragraphs is never a run.

Fingerprints are joined with their first place in the corpus, in order of doc_id and line. Each match is extended both
ways, as far as the lines of the two places are the same, and the later run is deleted; the first copy of any line stays. Only
the first place is joined, never all places with each other: a fingerprint in n texts makes n matches. Matches of two texts
are put together before their lines are fetched. Fingerprints that are at least 1/2**12 of all (so 2**12 at most) get
their first places by broadcast.

What is guaranteed: a run that holds a window with LEVEL words before and after each of its lines has the same anchor and
fingerprint wherever it stands, so a copy of it is found; with lines of n words at most that is any run of WINDOW +
2 * LEVEL + 2 * n words, and any single line of WINDOW words. The wider level meets the first place that shares more, where a
narrow one may first stand beside other lines.

Defined cases: null and empty texts have no lines; lines without words are never matched, and go only with the lines
about them; texts of under WINDOW words stay; rows that repeat doc_id and text are one document; null doc_ids come last in order; an empty table gives no rows; extra
columns pass through dedup().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import documents, written

SEED, HOT = 0, 2**12
#: Words of a window, and of what lies on either side of an anchor, itself included.
WINDOW, LEVELS = 16, (10, 40)
LAST = 2**63 - 1
FOUND = "doc long, crc long, lines array<long>, numbers array<int>, total int, prints array<long>, places array<int>"
RUNS = "doc long, crc long, start int, end int"


def line_hashes(text: bytes | None) -> tuple[list[int], list[int], list[int], int]:
    """(hash of each line with words, its words, its number among all lines, lines in all); text: in UTF-8."""
    import xxhash

    lines = (text or b"").split(b"\n") if text else []
    words = [x.split() for x in lines]
    numbers = [k for k, w in enumerate(words) if w]
    return [_signed(xxhash.xxh64_intdigest(b" ".join(words[k]), SEED)) for k in numbers], [len(words[k]) for k in numbers], numbers, len(lines)


def anchors(hashes: list[int], words: list[int], window: int = WINDOW) -> list[int]:
    """The lines that are least in some window, in order."""
    from collections import deque

    found, least, end, held = [], deque(), 0, 0
    for start in range(len(hashes)):
        while end < len(hashes) and held < window:
            # the line at the left is the least of the window
            while least and hashes[least[-1]] >= hashes[end]:
                least.pop()
            least.append(end)
            held += words[end]
            end += 1
        if held < window:
            break
        if not found or found[-1] != least[0]:
            found.append(least[0])
        held -= words[start]
        if least[0] == start:
            least.popleft()
    return found


def fingerprints(hashes: list[int], words: list[int], window: int = WINDOW, levels: tuple[int, ...] = LEVELS) -> tuple[list[int], list[int]]:
    """(fingerprints, the lines that they are of) of each anchor at each level that fits into the text."""
    from array import array
    from bisect import bisect_left, bisect_right
    from itertools import accumulate

    import xxhash

    sums, raw = [0, *accumulate(words)], array("q", hashes).tobytes()
    prints, places = [], []
    for m in anchors(hashes, words, window):
        for level in levels:
            end, begin = bisect_left(sums, sums[m] + level), bisect_right(sums, sums[m + 1] - level) - 1
            if end < len(sums) and begin >= 0:
                prints.append(_signed(xxhash.xxh64_intdigest(raw[8 * begin : 8 * end], level)))
                places.append(m)
    return prints, places


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("crc"), F.col("text").cast("binary").alias("text"))


def hashed(docs: DataFrame, window: int = WINDOW, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The line hashes of each row, their numbers among all its lines, how many these are, and its fingerprints with their lines."""

    def batches(parts: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in parts:
            rows = []
            for text in batch.column(2):
                lines, words, numbers, total = line_hashes(text.as_py())
                rows.append((lines, numbers, total, *fingerprints(lines, words, window, levels)))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc", "crc", "lines", "numbers", "total", "prints", "places"])

    return _texts(docs).mapInArrow(batches, FOUND)


def matches(found: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, crc, at (line) of each fingerprint that has an earlier place, and f (doc, crc, at): its first one."""
    prints = found.select("doc", "crc", F.explode(F.arrays_zip("places", "prints")).alias("x")).select("doc", "crc", F.col("x.places").alias("at"), F.col("x.prints").alias("print"))
    counted = prints.groupBy("print").agg(F.min(F.struct("doc", "crc", "at")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = written(counted.filter("n > 1"), "first")
    total = found.agg(F.coalesce(F.sum(F.size("prints")), F.lit(0))).first()[0]
    # a fingerprint with n * hot >= total is 1 / hot of all at least, so there are hot such at most
    common = F.broadcast(first.filter(F.col("n") * hot >= F.lit(total)).select("print", "f"))
    rare = first.filter(F.col("n") * hot < F.lit(total)).select("print", "f").hint("merge")
    met = prints.join(common, "print").unionByName(prints.join(common, "print", "left_anti").join(rare, "print"))
    return met.filter("doc != f.doc or crc != f.crc or at != f.at").select("doc", "crc", "at", "f")


def extended(own: object, other: object, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs (start, end) of own lines about each pair (line of own, line of other), as far as both are the same; each once."""
    import numpy as np

    out, seen = [], {}
    for at, first in sorted(pairs):
        shift = at - first
        # a run along the same shift that already holds the line
        if seen.get(shift, -1) > at:
            continue
        n, before = min(len(own) - at, len(other) - first), min(at, first)
        differ = np.flatnonzero(own[at : at + n] != other[first : first + n])
        back = np.flatnonzero(own[at - before : at][::-1] != other[first - before : first][::-1])
        end, start = at + int(differ[0] if len(differ) else n), at - int(back[0] if len(back) else before)
        seen[shift] = end
        if end > start:
            out.append((start, end))
    return out


def runs(found: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, crc and start, end (in lines with words, end excluded) of each run that repeats lines of an earlier place."""
    pairs = matches(found, hot).groupBy("doc", "crc", F.col("f.doc").alias("f_doc"), F.col("f.crc").alias("f_crc")).agg(F.collect_set(F.struct("at", F.col("f.at").alias("first"))).alias("pairs"))
    lines = found.select("doc", "crc", "lines")
    # texts that very many others repeat are looked up by those; Spark splits such joins
    own = written(pairs.join(lines.hint("merge"), ["doc", "crc"]), "pairs")
    both = own.join(lines.select(F.col("doc").alias("f_doc"), F.col("crc").alias("f_crc"), F.col("lines").alias("other")).hint("merge"), ["f_doc", "f_crc"])

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            rows: list[tuple] = []
            for doc, crc, lines, other, met in zip(*(batch.column(c) for c in ("doc", "crc", "lines", "other", "pairs"))):
                spans = extended(*(np.array(x.values) for x in (lines, other)), [(x["at"], x["first"]) for x in met.as_py()])
                rows += [(doc.as_py(), crc.as_py(), a, b) for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc", "crc", "start", "end"])

    return both.select("doc", "crc", "lines", "other", "pairs").mapInArrow(batches, RUNS)


def removed(docs: DataFrame, hot: int = HOT, window: int = WINDOW, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """doc, crc, total (lines), runs (merged, as numbers of lines among all, end excluded) and words of each text."""
    found = written(hashed(docs, window, levels).dropDuplicates(["doc", "crc"]), "lines")
    spans = runs(found, hot).groupBy("doc", "crc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).end >= x.start,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))),"
        " concat(acc, array(named_struct('start', x.start, 'end', x.end)))))"
    )
    numbered = F.expr("transform(spans, x -> named_struct('start', numbers[x.start], 'end', numbers[x.end - 1] + 1))")
    joined = found.join(spans.withColumn("spans", merged), ["doc", "crc"], "left")
    return joined.select("doc", "crc", "total", F.coalesce(numbered, F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("runs"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the repeated runs of lines deleted from their texts; the other columns are as they were."""
    cut = written(removed(docs).filter("size(runs) > 0").select(F.col("doc").alias("c_doc"), F.col("crc").alias("c_crc"), "runs"), "cut")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("crc"))
    joined = row.join(cut, F.expr("doc = c_doc and crc = c_crc"), "left")
    text = F.expr("if(runs is null, row.text, array_join(filter(split(row.text, '\\n', -1), (x, i) -> not exists(runs, r -> i >= r.start and i < r.end)), '\\n'))")
    return joined.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lines = F.expr("aggregate(runs, 0, (n, r) -> n + r.end - r.start)")
    names = F.expr("array_join(transform(runs, r -> concat(r.start, '-', r.end)), ',')")
    cut = removed(docs).select(F.col("doc").alias("c_doc"), F.col("crc").alias("c_crc"), F.col("total").alias("n_lines"), lines.alias("n_removed"), names.alias("removed"))
    ids = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("crc"))
    return ids.join(cut, F.expr("doc = c_doc and crc = c_crc")).select("doc_id", "n_lines", "n_removed", "removed")
