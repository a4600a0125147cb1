"""Exact top-k search by inner product: columnar branch and bound.

Vectors are packed into blocks in a vertical layout, one contiguous run of values for each dimension. A query set is
searched in cells: a group of queries against a slice of the blocks. In a cell, scores are accumulated one block of
dimensions at a time. What is still to come is at most the remaining mass, the product of the lengths of the two vectors
over the dimensions that are left, so after each block of dimensions a candidate stays only if its sum so far and that
bound reach the query's k-th best score. While most candidates stay, a block of dimensions is one matrix product for all
queries; then survivors are compacted query by query, and later blocks of dimensions are read for them alone. Dimensions
come in order of their mass in the slice, candidates in order of their length, so bounds fall early, and a query leaves
out the vectors that are too short for it at once. The k best of each cell are merged.

Every query meets every slice, so the work is that of the query set times the rows; what moves is each slice once for
each group of 2**14 queries, and k rows of each query and slice.

Defined cases: a vector that is null, or holds a null, or a component that isn't finite, takes no part; an empty vector
has score 0 with all; of vectors of unequal lengths the shorter one goes on with zeros; a query's own row is no candidate,
other rows with its vec_id are; repeated query rows have results of their own; null vec_ids are no queries, and come last
in ties; scores are exact below 2**53, and beyond they are rounded as doubles are. Empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import table, written

K, EVERY, SCALE = 20, 20, 64.0
#: Vectors of a block, vectors of a slice at most, queries of a group, and dimensions of a step.
BLOCK, SLICE, GROUP, STEP = 4_096, 2**18, 2**14, 16
#: Candidates and queries that a matrix product takes at once, and the first ones, which find a threshold.
ROWS, BATCH, FIRST = 8_192, 256, 1_024
#: Share of the candidates below which survivors are compacted.
SPARSE = 0.5
#: Stands for a null vec_id, which comes last.
LAST = 2**63 - 1
BLOCKS = "query boolean, block long, n int, dims int, kind string, ids binary, keys binary, data binary"
FOUND = "query_key long, query_id long, vec_id long, score long"


def whole(values: object, scale: float = SCALE) -> object:
    """floor(scale * x) of an array, as doubles."""
    import numpy as np

    return np.floor(scale * values.astype(np.float64))


def blocks(vectors: DataFrame, every: int = EVERY, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """The vectors in vertical blocks, and once more those whose vec_id is divisible by every, as queries."""

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        schema = pa.schema([(f.split(" ")[0], k) for f, k in zip(BLOCKS.split(", "), kinds)])

        def packed(query: bool, ids: object, keys: object, matrix: object) -> dict:
            most = np.abs(matrix).max(initial=0)
            kind = next((k for k, top in (("i1", 2**7), ("i2", 2**15), ("i4", 2**31)) if most < top), "f8")
            nonlocal number
            number += 1
            return {"query": query, "block": number, "n": len(ids), "dims": matrix.shape[1], "kind": kind, "ids": ids.tobytes(), "keys": keys.tobytes(), "data": matrix.T.astype(f"<{kind}").tobytes()}

        for batch in parts:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                lists, rows = part.column(2), []
                # one vector after another only where lengths differ or something is missing
                sizes = np.array([len(x) if x.is_valid else -1 for x in lists])
                flat = np.concatenate([np.zeros(0), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)])
                ends = np.cumsum(np.maximum(sizes, 0))
                wide = int(sizes.max(initial=0))
                matrix = np.zeros((len(sizes), wide))
                if len(sizes) and (sizes == wide).all():
                    matrix = flat.reshape(len(sizes), wide)
                else:
                    for k, (n, end) in enumerate(zip(sizes, ends)):
                        matrix[k, : max(n, 0)] = flat[end - max(n, 0) : end]
                matrix = whole(matrix, scale)
                good = (sizes >= 0) & np.isfinite(matrix).all(axis=1)
                ids, keys, matrix = (x[good] for x in (part.column(0).to_numpy(), part.column(1).to_numpy(), matrix))
                asked = (ids % every == 0) & (ids != LAST)
                rows += [packed(False, ids, keys, matrix)] if len(ids) else []
                rows += [packed(True, ids[asked], keys[asked], matrix[asked])] if asked.any() else []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    own = F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("id")
    return vectors.select(own, F.monotonically_increasing_id().alias("key"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(batches, BLOCKS)


def matrix_of(rows: list[dict], dims: int) -> tuple:
    """ids, keys and the vertical matrix (dims by vectors) of some blocks."""
    import numpy as np

    ids, keys = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[c], np.int64) for r in rows)]) for c in ("ids", "keys"))
    out, at = np.zeros((dims, len(ids))), 0
    for r in rows:
        out[: r["dims"], at : at + r["n"]] = np.frombuffer(r["data"], f"<{r['kind']}").reshape(r["dims"], r["n"])
        at += r["n"]
    return ids, keys, out


def rest_lengths(matrix: object, step: int) -> object:
    """A row for each block of dimensions and a last one of zeros: the length of each column from that block on."""
    import numpy as np

    squares = [(matrix[k : k + step] ** 2).sum(axis=0) for k in range(0, len(matrix), step)]
    return np.sqrt(np.cumsum([np.zeros(matrix.shape[1]), *squares[::-1]], axis=0)[::-1])


class Best:
    """The k best (score, id) of each query so far; the k-th score is what others must reach."""

    def __init__(self, n: int, k: int) -> None:
        import numpy as np

        self.k, self.at_least = k, np.full(n, -np.inf)
        self.held = [(np.zeros(0), np.zeros(0, np.int64))] * n

    def add(self, query: int, scores: object, ids: object) -> None:
        import numpy as np

        scores, ids = np.concatenate((self.held[query][0], scores)), np.concatenate((self.held[query][1], ids))
        if len(scores) > self.k:
            own = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[own], ids[own]
        order = np.lexsort((ids, -scores))[: self.k]
        self.held[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.at_least[query] = scores[order[-1]]


def search(queries: tuple, candidates: tuple, k: int = K, step: int = STEP) -> Best:
    """The k best candidates of each query, both as from matrix_of: branch and bound over blocks of dimensions."""
    import numpy as np

    (_, q_keys, q), (ids, keys, c) = queries, candidates
    best, mass = Best(q.shape[1], k), (c * c).sum(axis=1)
    dims, long = np.argsort(-mass, kind="stable"), np.argsort(-(c * c).sum(axis=0), kind="stable")
    q, c, ids, keys = q[dims], c[dims][:, long], ids[long], keys[long]
    q_rest, c_rest = rest_lengths(q, step), rest_lengths(c, step)
    # sums of whole numbers below 2**24 are exact in single precision
    if q_rest[0].max(initial=0) * c_rest[0].max(initial=0) < 2**24:
        q, c = q.astype(np.float32), c.astype(np.float32)
    steps = [slice(s, s + step) for s in range(0, len(q), step)]
    # room for the rounding of the bounds themselves
    q_rest *= 1 + 1e-6

    start = 0
    while start < len(ids):
        stop = min(len(ids), start + (ROWS if start else FIRST))
        own, own_ids, own_keys, rest = c[:, start:stop], ids[start:stop], keys[start:stop], c_rest[:, start:stop]
        able = np.flatnonzero(q_rest[0] * rest[0].max() >= best.at_least)
        for low in range(0, len(able), BATCH):
            some = able[low : low + BATCH]
            sums, done, stay = np.zeros((len(some), stop - start), q.dtype), 0, None
            # matrix products while most candidates stay
            while done < len(steps):
                sums += q[steps[done]][:, some].T @ own[steps[done]]
                done += 1
                stay = sums + q_rest[done][some][:, None] * rest[done] >= best.at_least[some][:, None]
                if stay.mean() < SPARSE:
                    break
            for i, query in enumerate(some):
                left = np.flatnonzero(stay[i]) if stay is not None else np.arange(stop - start)
                scores = sums[i, left]
                for d in range(done, len(steps)):
                    if not len(left):
                        break
                    scores = scores + q[steps[d], query] @ own[steps[d]][:, left]
                    more = scores + q_rest[d + 1, query] * rest[d + 1, left] >= best.at_least[query]
                    left, scores = left[more], scores[more]
                other = own_keys[left] != q_keys[query]
                if other.any():
                    best.add(query, scores[other].astype(np.float64), own_ids[left[other]])
        start = stop
    return best


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, slice_rows: int = SLICE, group_rows: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    held = written(blocks(vectors, every, scale, block), "blocks")
    n = {r["query"]: r["n"] for r in held.groupBy("query").agg(F.sum("n").alias("n")).collect()}
    rows, asked = n.get(False, 0), n.get(True, 0)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-rows // slice_rows), min(parallel, -(-rows // block)))
    groups = max(1, -(-asked // group_rows))
    # blocks are numbered from their partition's number on, so they are dealt out evenly
    across = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    down = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s")
    left = held.filter("not query").select("*", (F.col("block") % slices).cast("int").alias("s")).select("*", across)
    right = held.filter("query").select("*", (F.col("block") % groups).cast("int").alias("g")).select("*", down)

    def cell(candidates: object, queries: object) -> object:
        import numpy as np
        import pyarrow as pa

        c, q = candidates.to_pylist(), queries.to_pylist()
        schema = pa.schema([(f.split(" ")[0], pa.int64()) for f in FOUND.split(", ")])
        if not c or not q:
            return schema.empty_table()
        dims = max(r["dims"] for r in [*c, *q])
        asking = matrix_of(q, dims)
        best = search(asking, matrix_of(c, dims), k)
        sizes = [len(x[0]) for x in best.held]
        ids, scores = (np.concatenate([x[j] for x in best.held]) for j in (1, 0))
        exact = np.clip(scores, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        return pa.table([np.repeat(asking[1], sizes), np.repeat(asking[0], sizes), ids, exact], schema=schema)

    found = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(cell, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.expr(f"nullif(vec_id, {LAST})").alias("vec_id"), "score")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r
), k AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 20
"""
