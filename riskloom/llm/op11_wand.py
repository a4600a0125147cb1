"""Ranked lexical search: WAND over shards of documents.

One pass over the texts cuts each partition into shards and inverts them: for each term that some item asks for, the
documents of the shard that hold it, in order, and how often. The number of documents, their terms and the documents of
each term are summed over the shards; they give the terms' weights. The search then reads the shards alone.

In a shard each term has a maximum impact, the most that it can add to a score. An item's ten best so far are a heap,
whose least score is what a document must reach. Documents are passed window by window. In a window the item's lists are
put in order, longest first, and the pivot is the list at which the sum of the maximum impacts first reaches the heap's
threshold: a document that is in none of the lists from the pivot on can't beat the heap, and is skipped without being
looked at, so the long lists of common terms are not read. If the sum never gets there, the window is skipped whole. The
documents of the lists from the pivot on are candidates; each further list is looked up for those alone that the impacts
still to come can lift over the threshold. The heap goes on from shard to shard in a task; heaps are then merged by item,
first in groups, as there is one for each task.

Items are searched in batches of at most some 500,000 pairs of item and term, each a pass over the documents; the terms,
their weights and the items of a batch are sent to the tasks.

Defined cases: null and empty texts have no terms; items without terms and documents without any of an item's terms give
no rows; rows that repeat an item_id are one item with the terms of its different texts; documents that repeat a doc_id are
documents of their own; a null doc_id comes last in ties; a null item_id is an item. Empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, documents, pack, table, unpack, written

K = 10
#: What stands between terms; all else, and with it everything beyond ASCII, is part of one.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents and postings of a shard at most (one document's are never split), and documents of a window.
SHARD_DOCS, SHARD_POSTINGS, WINDOW = 8_192, 2_000_000, 2_048
#: Pairs of item and term of a batch, and groups in which heaps are merged first.
BATCH, GROUPS = 500_000, 64
#: Stands for a null doc_id, which comes last.
LAST = 2**63 - 1
SHARD = "docs long, total long, n int, postings int, terms array<int>, dfs array<int>, names binary, lists binary"
HEAPS = "item long, doc long, score long, task int"


def _fold() -> bytes:
    """For bytes.translate: capitals to small letters, what isn't part of a term to a blank."""
    term = lambda b: b >= 0x80 or chr(b).isalnum()
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if term(b) else 0x20 for b in range(256))


FOLD = _fold()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return text.translate(FOLD).split()


def asked(items: DataFrame) -> DataFrame:
    """item_id, term and times: how often the item has the term."""
    each = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return each.select("item_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def shards(docs: DataFrame, vocabulary: dict[bytes, int], shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Inverted shards of docs over a vocabulary, with how many documents have terms, and their terms in all."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known = shared.value
        schema = pa.schema([(f.split(" ")[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}.get(f.split(" ")[1], pa.list_(pa.int32()))) for f in SHARD.split(", ")])
        docs, total, ids, sizes, terms, places, times = 0, 0, [], [], [], [], []

        def closed() -> object:
            nonlocal docs, total
            t, p, f = (np.array(x, np.int32) for x in (terms, places, times))
            order = np.lexsort((p, t))
            t, p, f = t[order], p[order], f[order]
            own, dfs = np.unique(t, return_counts=True)
            names, lists = (pack(np.array(ids, np.int64), np.array(sizes, np.int64)), pack(p, f)) if ids else (b"", b"")
            row = {"docs": docs, "total": total, "n": len(ids), "postings": len(t), "terms": own, "dfs": dfs.astype(np.int32), "names": names, "lists": lists}
            docs = total = 0
            for x in (ids, sizes, terms, places, times):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in parts:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                docs, total = docs + 1, total + len(found)
                hits = [(known[t], n) for t, n in Counter(found).items() if t in known]
                if hits:
                    if len(terms) + len(hits) > SHARD_POSTINGS and ids:
                        yield closed()
                        docs, total = 0, 0
                    terms += [t for t, _ in hits]
                    times += [n for _, n in hits]
                    places += [len(ids)] * len(hits)
                    ids.append(doc)
                    sizes.append(len(found))
                    if len(ids) >= shard_docs:
                        yield closed()
        if docs:
            yield closed()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(batches, SHARD)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """A shard's lists: for each of its terms the documents, in order, their impacts for a weight of one, and the most of these."""

    def __init__(self, row: dict, n: int, total: int, window: int) -> None:
        import numpy as np

        self.ids, sizes = unpack(row["names"], row["n"], np.int64, np.int64)
        self.places, times = unpack(row["lists"], row["postings"], np.int32, np.int32)
        length, tf = 25 + 75 * sizes * n // total, times.astype(np.int64)
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 8 * length[self.places])
        self.numbers = {t: k for k, t in enumerate(row["terms"])}
        ends = np.cumsum(row["dfs"])
        starts = ends - np.array(row["dfs"])
        self.most = np.maximum.reduceat(self.impacts, starts) if len(starts) else self.impacts
        # where each list enters each window
        self.window = window
        self.windows = -(-row["n"] // window)
        edges = np.arange(self.windows + 1, dtype=np.int64) * window
        of_list = np.repeat(np.arange(len(ends), dtype=np.int64), row["dfs"])
        wide = self.windows * window + 1
        self.edges = np.searchsorted(of_list * wide + self.places, np.arange(len(ends), dtype=np.int64)[:, None] * wide + edges)


class Heap:
    """An item's k best (score, doc_id): highest score first, then least doc_id."""

    def __init__(self, k: int) -> None:
        import numpy as np

        self.k, self.least, self.scores, self.ids = k, 1, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: object, ids: object) -> None:
        import numpy as np

        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def pass_shard(shard: Shard, query: list[tuple[int, int]], heap: Heap) -> int:
    """Passes an item's lists ((term, weight times its repeats)) and gives how many documents were looked at."""
    import numpy as np

    own = [(shard.numbers[t], w) for t, w in query if t in shard.numbers and w > 0]
    if not own:
        return 0
    lists, weights = (np.array(x, np.int64) for x in zip(*own))
    most, edges, seen = shard.most[lists] * weights, shard.edges[lists], 0
    if most.sum() < heap.least:
        return 0
    for k in range(shard.windows):
        low, high = edges[:, k], edges[:, k + 1]
        there = np.flatnonzero(high > low)
        if most[there].sum() < heap.least:
            continue
        order = there[np.argsort(low[there] - high[there], kind="stable")]
        reach = np.cumsum(most[order])
        pivot = int(np.searchsorted(reach, heap.least))
        sums, base = np.zeros(shard.window, np.int64), k * shard.window
        for j in order[pivot:]:
            sums[shard.places[low[j] : high[j]] - base] += shard.impacts[low[j] : high[j]] * weights[j]
        rest = int(reach[pivot - 1]) if pivot else 0
        left = np.flatnonzero((sums > 0) & (sums + rest >= heap.least))
        seen += len(left)
        # the lists before the pivot, those of the greatest impact first
        for j in sorted(order[:pivot], key=lambda j: -most[j]):
            if not len(left):
                break
            rest -= int(most[j])
            places = shard.places[low[j] : high[j]] - base
            at = np.minimum(np.searchsorted(places, left), len(places) - 1)
            sums[left] += np.where(places[at] == left, shard.impacts[low[j] + at] * weights[j], 0)
            left = left[sums[left] + rest >= heap.least]
        if len(left):
            heap.add(sums[left], shard.ids[base + left])
    return seen


def _batch(docs: DataFrame, rows: list, k: int, window: int) -> DataFrame:
    """item, doc, score and task of each task's heaps, for the (item_id, term, times) of a batch."""
    spark = docs.sparkSession
    vocabulary = {t: n for n, t in enumerate(sorted({r["term"].encode() for r in rows}))}
    index = written(shards(docs, vocabulary), "shards")
    n, total = index.agg(F.sum("docs"), F.sum("total")).first()
    pairs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    weights = {r["terms"]: weight(n, r["df"]) for r in pairs.collect()}
    queries: dict = {}
    for r in rows:
        if (t := vocabulary[r["term"].encode()]) in weights:
            queries.setdefault(r["item_id"], []).append((t, weights[t] * r["times"]))
    shared = spark.sparkContext.broadcast((queries, n, total))

    def batches(parts: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        asked, n, total = shared.value
        heaps = {item: Heap(k) for item in asked}
        for batch in parts:
            for row in batch.to_pylist():
                shard = Shard(row, n, total, window)
                for item, query in asked.items():
                    pass_shard(shard, query, heaps[item])
        task = TaskContext.get().partitionId()
        found = [{"item": i, "doc": d, "score": s, "task": task} for i, h in heaps.items() for d, s in zip(h.ids.tolist(), h.scores.tolist())]
        yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64()), ("task", pa.int32())]))

    return index.filter("n > 0").mapInArrow(batches, HEAPS)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, batch: int = BATCH, window: int = WINDOW) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    pairs = written(asked(items), "asked")
    batches = max(1, -(-pairs.count() // batch))
    number = F.pmod(F.xxhash64("item_id"), F.lit(batches))
    found = None
    for b in range(batches):
        own = _batch(docs, pairs.filter(number == b).collect(), k, window)
        found = own if found is None else found.unionByName(own)
    order = [F.desc("score"), F.asc("doc")]
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    first = best(found.withColumn("part", F.col("task") % GROUPS), "item", "part")
    return best(first, "item").select(F.col("item").alias("item_id"), "rank", F.expr(f"nullif(doc, {LAST})").alias("doc_id"), "score")


def op11_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM a WHERE t IS NOT NULL
), z AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY r, term
), f AS (SELECT term, count(*) AS df FROM p GROUP BY term
), b AS (SELECT DISTINCT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, text FROM benchmark
), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b) GROUP BY item_id, term
), s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         sum(times * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term), z GROUP BY item_id, r
), k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""
