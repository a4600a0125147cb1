"""Near copies: components of the texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Every pair that similar is found. Shingles are put into one fixed order, by the number of texts that hold them, then by
hash. Of two sets that similar each holds at least 0.8 of its shingles in the other, so the first ones (a fifth, and
one) of both have a shingle in common: the buckets. A shingle that one text holds is no bucket, so a text whose first
ones are all its own meets nothing, and passages that many texts share come last. The first common shingle's place in
either set bounds how many the two can share, which drops most chance pairs. All others are verified on their whole sets.

How many texts hold a shingle is counted for all of them, in one shuffle of packed hashes: a bucket of hashes counts
what it gets and hands back those that two texts or more hold, by the chunk of texts that they came from.

Pairs come first from op8's method, on SimHashes of these sets: its popcount grid, Manhattan distance and bits link
fingerprints within two bits. What they link is verified like all else, as near fingerprints alone don't make near copies;
most near copies lie further apart, and the buckets find them.

So that n near copies don't make n * n pairs, each set is at first verified against two leaders of its buckets too and the
components of these links are taken; two more rounds verify those outside of a bucket's largest component against other
leaders. Then the pairs that are left are made: those of a bucket whose components still differ, each set outside of the
bucket's largest component with every other one. Beside the places, 512 bits of each set, one for each residue of its
hashes, bound what two sets share: hashes whose bit the other set lacks aren't in it. Only pairs within both bounds go on.

Defined cases: texts of five words or fewer have one shingle, texts without words none, and equal sets are linked; case
is ignored (ASCII); null and repeated doc_ids are as in op8_simhash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_schema, buckets_of, dealt, pack, spans, unpack, written
from riskloom.llm.op8_simhash import LAST, components, keyed, links

SHINGLE, SEED = 5, 42
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
LEADERS, ROUNDS = 2, 2
#: Bits by which sets are compared, in longs of 64.
WIDE = 8
#: Shingles that a task holds at a time (a longer text is held whole), shingles of a bucket, about, and buckets at most.
CHUNK, BUCKET, BUCKETS = 1_000_000, 4_000_000, 2**16
MARKS = [f"s{k}" for k in range(WIDE)]
FACTS = "doc_id:long,crc:long,sid:long,n:int,fp:long," + ",".join(f"{m}:long" for m in MARKS)
HELD = f"bucket int, chunk long, n int, hashes binary, facts array<struct<{FACTS}>>"
SHARED = f"chunk long, n int, hashes binary, facts array<struct<{FACTS}>>"
SETS = FACTS.replace(":", " ").replace(",", ", ") + ", own int, prefix array<long>"


def shingles(text: bytes | None):
    """The sorted distinct hashes of a text's shingles. text: in UTF-8."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(w, SEED) for w in words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    x = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(len(h), SHINGLE)):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    for s, m in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    return np.unique(x ^ (x >> np.uint64(33)))


def similar(a, b) -> bool:
    """Whether two sorted arrays of distinct hashes reach the similarity."""
    import numpy as np

    if DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return DEN * shared >= NUM * (len(a) + len(b) - shared)


def marks(x) -> list[int]:
    """A set's hashes as bits, one for each residue."""
    import numpy as np

    bits = np.zeros(64 * WIDE, bool)
    bits[(x % np.uint64(64 * WIDE)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def fingerprint(x) -> int:
    """The SimHash of a set: bits that are set in over half of its hashes."""
    import numpy as np

    ones = np.unpackbits(x.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x)).view(np.int64)[0])


def first(n: int) -> int:
    """So many shingles of a set of n in the fixed order that any similar set has one of them among its own; none if only an equal set is that similar."""
    if DEN * (n - 1) < NUM * n and DEN * n < NUM * (n + 1):
        return 0
    return n + (-NUM * n) // DEN + 1


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, crc (of the text), sid (of its set of shingles), n of these, the marks of its hashes, own, how many no other text holds, and prefix, those of its first ones that others hold, of each row of docs."""
    rows = keyed(docs)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]  # a shingle for each word, of about five bytes
    wanted = max(size // (5 * BUCKET), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (5 * BUCKET // 20)))
    buckets = min(BUCKETS, max(1, wanted))

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        schema = arrow_schema(HELD)
        chunk = TaskContext.get().partitionId() << 32
        for batch in parts:
            found, facts = [], []

            def out() -> Iterator:
                hashes, text = np.concatenate(found), np.repeat(np.arange(len(found), dtype=np.uint32), [len(x) for x in found])
                order = np.argsort(hashes)
                hashes, text = hashes[order], text[order]
                steps = [(k, chunk, y - x, pack(hashes[x:y], text[x:y])) for k, x, y in spans(buckets_of(hashes, buckets))]
                steps = [(*s, None) for s in steps] + [(dealt(chunk, buckets), chunk, 0, b"", facts)]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*steps), schema)], schema=schema)

            total = 0
            for doc_id, crc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = shingles(text.as_py())
                facts.append((doc_id, crc, int(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), SEED)).view(np.int64)), len(x), fingerprint(x), *marks(x)))
                # sets without a prefix meet nothing, but others' counts don't depend on them either
                found.append(x if first(len(x)) else x[:0])
                total += len(found[-1])
                if total >= CHUNK:
                    yield out()
                    found, facts, total, chunk = [], [], 0, chunk + 1
            if facts:
                yield out()
                chunk += 1

    def bucket(held: object) -> object:
        """The hashes of a bucket that two texts or more hold, with their number, packed by chunk."""
        import numpy as np
        import pyarrow as pa

        schema = arrow_schema(SHARED)
        names = held.column("chunk").to_numpy()
        rows = [(k, unpack(data, n, "u8", "u4")) for k, (n, data) in enumerate(zip(held.column("n").to_pylist(), held.column("hashes").to_pylist())) if n]
        hashes, text = (np.concatenate(c) for c in zip(*((x, y + np.int64(k << 32)) for k, (x, y) in rows))) if rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        _, of, times = np.unique(hashes, return_inverse=True, return_counts=True)
        times = times[of]
        order = np.flatnonzero(times > 1)
        order = order[np.argsort(text[order])]
        hashes, text, times = hashes[order], text[order], times[order]
        steps = [(names[k], y - x, pack(text[x:y].astype(np.uint32), hashes[x:y], times[x:y].astype(np.uint32)), None) for k, x, y in spans(text >> 32)]
        steps += [(c, 0, b"", f) for c, f in zip(names, held.column("facts").to_pylist()) if f is not None]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*steps)) or [[]] * 4, schema)], schema=schema)

    def texts(held: object) -> object:
        import numpy as np
        import pyarrow as pa

        rows = [unpack(data, n, "u4", "u8", "u4") for n, data in zip(held.column("n").to_pylist(), held.column("hashes").to_pylist()) if n]
        text, hashes, times = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        order = np.lexsort((hashes, times, text))
        text, hashes = text[order], hashes[order].view(np.int64)
        facts = next(f for f in held.column("facts").to_pylist() if f is not None)
        ends = np.searchsorted(text, np.arange(len(facts) + 1))
        out = []
        for f, a, b in zip(facts, ends, ends[1:]):
            own = f["n"] - int(b - a)
            out.append((*f.values(), own, hashes[a : min(b, a + max(0, first(f["n"]) - own))]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow_schema(SETS))], schema=arrow_schema(SETS))

    # docs are read from files, so a chunk that is lost is made again from the same texts in the same order
    return rows.mapInArrow(batches, HELD).groupBy("bucket").applyInArrow(bucket, SHARED).groupBy("chunk").applyInArrow(texts, SETS)


def _may(a: str, b: str) -> str:
    """SQL: a pair that meets at its first common shingle can be similar, by the sizes and the places of the shingle."""
    sizes = f"{DEN} * least({a}.n, {b}.n) >= {NUM} * greatest({a}.n, {b}.n)"
    return f"{sizes} and {DEN + NUM} * least({a}.n - {a}.at, {b}.n - {b}.at) >= {NUM} * ({a}.n + {b}.n)"


def _can(a: str, b: str) -> str:
    """SQL: a pair can be similar, by its marks: each bit that only one set has stands for a hash at least that the other lacks."""
    only = lambda x, y: " + ".join(f"bit_count({x}.{m} & ~{y}.{m})" for m in MARKS)
    return f"{DEN + NUM} * least({a}.n - ({only(a, b)}), {b}.n - ({only(b, a)})) >= {NUM} * ({a}.n + {b}.n)"


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of sids whose texts are similar."""

    def batches(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts:
            out, held = [], {}
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns[:2]), *batch.columns[2:]):
                for sid, text in ((a, x), (b, y)):
                    if sid not in held:
                        held[sid] = shingles(text.as_py())
                out.append(similar(held[a], held[b]))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(out, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    left = pairs.join(texts.selectExpr("sid as a", "text as x").hint("merge"), "a")
    return left.join(texts.selectExpr("sid as b", "text as y").hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(batches, "a long, b long")


def by_bits(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sids by op8's popcount grid: sets (sid, fp) of one fingerprint with the least of them, and these if their fingerprints are linked."""
    least = written(sets.groupBy("fp").agg(F.min("sid").alias("lo")), "fingerprints")
    same = sets.join(least.hint("merge"), "fp").filter("sid > lo").selectExpr("sid as a", "lo as b")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = links(least.select("fp").repartition(n, "fp"))
    met = met.join(least.selectExpr("fp as a", "lo as x").hint("merge"), "a").join(least.selectExpr("fp as b", "lo as y").hint("merge"), "b")
    return same.unionByName(met.selectExpr("greatest(x, y) as a", "least(x, y) as b"))


def linked(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(node, root) of the sids that are similar to another one."""
    met = held.filter("size(prefix) > 0").withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    reps = written(met.groupBy("sid").agg(F.min(F.struct("doc", "crc", "n", "own", "prefix", "fp", *MARKS)).alias("r")).select("sid", "r.*"), "sets")
    rows = reps.select("sid", "n", "own", F.posexplode("prefix").alias("at", "key")).withColumn("at", F.col("at") + F.col("own")).drop("own")
    shared = rows.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("key")
    members = written(rows.join(shared.hint("merge"), "key", "left_semi").select("key", "sid", "n", "at"), "members")

    meeting = reps.join(members.select("sid").distinct().hint("merge"), "sid", "left_semi")
    wanted = meeting.select("sid", "doc", "crc")
    source = keyed(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "crc", "text")
    texts = written(source.join(wanted.hint("merge"), ["doc", "crc"]).select("sid", "text").groupBy("sid").agg(F.first("text").alias("text")), "texts")

    marked = reps.select("sid", *MARKS).hint("merge")
    ends = "greatest({0}.sid, {1}.sid) as a", "least({0}.sid, {1}.sid) as b"

    def led(rows: DataFrame, round_: int, leaders: int) -> DataFrame:
        """Pairs (a, b) of rows' sets that aren't of one component with leaders of their buckets."""
        each = range(leaders)
        lead = rows.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("sid", F.lit(round_), F.lit(k)).alias("h"), "sid", "n", "at", "root", *MARKS)).alias(f"l{k}") for k in each])
        found = rows.filter("root != top").alias("m").join(lead.hint("merge"), "key").select(F.struct(*[f"m.{c}" for c in ("sid", "n", "at", "root", *MARKS)]).alias("m"), F.explode(F.array(*[f"l{k}" for k in each])).alias("l"))
        return found.filter(f"m.root != l.root and {_may('m', 'l')} and {_can('m', 'l')}").selectExpr(*[e.format("m", "l") for e in ends]).distinct()

    def mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one component, with their root and that of the bucket's largest one."""
        placed = rows.drop("root", "top").join(roots.selectExpr("node as sid", "root").hint("merge"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("parts"))
        return placed.join(parts.filter("parts > 1").select("key", F.col("top.root").alias("top")).hint("merge"), "key")

    def joined(roots: DataFrame, pairs: DataFrame) -> tuple[DataFrame, bool]:
        """(node, root) with the components that the similar ones of the pairs join, and whether there are any; what a component is made of isn't linked again."""
        seen = Observation()
        near = written(verified(pairs, texts).observe(seen, F.count(F.lit(1)).alias("n")), "near")
        return (components(roots.selectExpr("node as a", "root as b").unionByName(near)), True) if seen.get["n"] else (roots, False)

    # at first every set is a component, and none is the largest
    alone = members.join(marked, "sid").withColumns({"root": F.col("sid"), "top": F.expr("~sid")})
    begun = by_bits(meeting.select("sid", "fp")).unionByName(led(alone, 0, LEADERS)).distinct()
    roots = components(written(verified(begun, texts), "near"))
    rows = written(mixed(members, roots).join(marked, "sid"), "mixed")
    for k in range(1, ROUNDS + 1):
        roots, more = joined(roots, led(rows, k, LEADERS * 2**k))
        # a bucket of one component stays one
        rows = written(mixed(rows, roots), "mixed") if more else rows
    meet = F.expr(f"x.key = y.key and x.root != y.root and (y.root = y.top or x.sid > y.sid) and {_may('x', 'y')} and {_can('x', 'y')}")
    pairs = rows.filter("root != top").alias("x").join(rows.alias("y").hint("merge"), meet).selectExpr(*[e.format("x", "y") for e in ends]).distinct()
    return joined(roots, pairs)[0]


def near_clusters(docs: DataFrame) -> DataFrame:
    """doc_id, crc and root of each row of docs: rows with one root are one component."""
    held = written(sets(docs), "held")
    roots = linked(docs, held)
    return held.join(roots.hint("merge"), held.sid == roots.node, "left").select("doc_id", "crc", F.coalesce("root", "sid").alias("root"))
