"""Language-model scores from a weighted backoff automaton over all bigrams.

Training tokens are the lower-cased words of a text and one end token. Every word is a state of the automaton, and so is
the beginning of a text; the root holds the discounted unigram probabilities p(w) (absolute discounting; the mass taken
off goes to unknown words, which are one class). With c the training counts, state u has for every word w that ever
followed it an arc to state w of the weight
    (c(u w) + MU * p(w)) / (c(u) + MU),
and a failure arc to the root of the weight MU / (c(u) + MU), where the word is then read with p(w). All words of a
state sum to one. A word that training doesn't know leads to a state without arcs, whose failure arc weighs one. A text is
traversed once from left to right; the state carried is its last word's, so a text is a sequence of steps (state, word).

Scale: no bigram is left out, so the automaton grows with the corpus and is never gathered in one place. Steps are dealt
by their word into buckets of some millions: the task that gets a word sees all its training counts and those of every arc
that leads to it, and weighs all steps of all texts that read it; a step's numerator and the denominator of the state it
leads to depend on nothing else. Words are 64-bit hashes. Words with at least 1/2**13 of all tokens (so 2**13 at most) are
counted first and sent to every task; their steps are dealt by state and word, and the arcs between them that hold at
least 1/2**18 of all tokens (so 2**18 at most) are weighed where the text is read. What is left under one key is a share
of 1/2**13 at most. Steps travel in sorted, packed columns, about ten bytes each.

Defined cases: a null text is empty and holds the end token alone; a null doc_id counts as the empty text under crc32;
repeated rows are scored alike; without any training text all tokens are unknown, with a probability of one under the
model; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_schema, buckets_of, dealt, documents, id_crc, pack, spans, unpack, written

FOLDS, HELD_OUT = 7, 2
#: Weight of the root's probabilities against a state's own counts.
MU = 500.0
HEAD, CACHED = 2**13, 2**18
SEED = 0
#: Tokens that a task holds at a time (a longer text is held whole), and steps of a bucket, about.
CHUNK, BUCKET = 2_000_000, 4_000_000
#: Buckets at most; beyond BUCKET * BUCKETS steps, about a terabyte of documents, they get larger.
BUCKETS = 2**16
FACTS = "doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base_score:double,score:double"
PACKED = f"bucket int, chunk long, n_head int, n_tail int, head binary, tail binary, facts array<struct<{FACTS}>>"
MET = f"chunk long, n int, steps binary, facts array<struct<{FACTS}>>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Automaton:
    """The root, and what every task holds: the head's words (sorted hashes), their counts, and the cached arcs (sorted places) with theirs."""

    tokens: int
    total: int
    distinct: int
    texts: int
    discount: float
    words: object
    counts: object
    arcs: object
    arc_counts: object
    mu: float = MU

    def root(self, c: object) -> object:
        """p of words with these training counts."""
        import numpy as np

        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, (c - self.discount) / self.total, self.discount * self.distinct / self.total)


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, SEED)


def _marks() -> tuple[int, int]:
    """The hashes that stand for the end and the beginning: no word is empty or holds a blank."""
    return word_hash(b""), word_hash(b" ")


def chunks(texts: object, size: int = CHUNK) -> Iterator[tuple[int, object, object]]:
    """(place of the first text, its tokens and those of the following texts, tokens of each) for some whole texts at a time."""
    import numpy as np
    import xxhash

    hashed, end = xxhash.xxh64_intdigest, np.array([_marks()[0]], np.uint64)
    held: list = []
    lengths: list[int] = []
    first = tokens = 0
    for k, text in enumerate(texts):
        words = (text.as_py() or b"").lower().split()
        held += [np.fromiter(map(hashed, words), np.uint64, len(words)), end]
        lengths.append(len(words) + 1)
        tokens += len(words) + 1
        if tokens >= size:
            yield first, np.concatenate(held), np.array(lengths)
            held, lengths, first, tokens = [], [], k + 1, 0
    if lengths:
        yield first, np.concatenate(held), np.array(lengths)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (id_crc(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out"))


def _counted(rows: DataFrame, keys: object) -> DataFrame:
    """key, c (in training texts) and n (in all texts) of what keys(words, lengths) gives: the tokens that count, as a mask, and their keys."""

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            trained = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, w, n in chunks(batch.column(1)):
                mask, key = keys(w, n)
                counts = np.repeat(trained[first : first + len(n)], n)[mask]
                for part, one in ((key[counts], 1), (key[~counts], 0)):
                    found, times = np.unique(part, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times * one), pa.array(times)], ["key", "c", "n"])

    return rows.mapInArrow(batches, "key long, c long, n long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """key (a word's hash), c and n, its counts in the training texts and in all."""

    def keys(w: object, n: object) -> tuple:
        return slice(None), w

    return _counted(rows, keys)


def _places(words: object, x: object) -> tuple[object, object]:
    """(place in the sorted words, whether it is one of them) of each of x."""
    import numpy as np

    at = np.searchsorted(words, x)
    at[at == len(words)] = 0
    return at, words[at] == x


def _states(x: object, n: object, begin: object) -> object:
    """x moved on by one token, with begin for the first token of each text: of its state what x says of a word."""
    import numpy as np

    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[np.cumsum(n) - n] = begin
    return out


def _arcs(words: object, w: object, n: object) -> tuple:
    """(place of each word in the head, whether it is there, arc between words of the head as a number, whether the step is one); the beginning is the state after the last word."""
    at, held = _places(words, w)
    arc = _states(at, n, len(words)) * len(words) + at
    return at, held, arc, held & _states(held, n, True)


def automaton(rows: DataFrame, words: DataFrame, head: int = HEAD, cached: int = CACHED, mu: float = MU) -> Automaton:
    import numpy as np

    end = np.uint64(_marks()[0])
    signed = int(end.view(np.int64))
    one = words.agg(*[F.coalesce(x, F.lit(0)).cast("long") for x in (F.sum("c"), F.sum("n"), F.expr("count_if(c > 0)"), F.expr("count_if(c = 1)"), F.expr("count_if(c = 2)"), F.sum(F.when(F.col("key") == signed, F.col("c"))))])
    total, tokens, distinct, ones, twos, texts = one.first()
    # a word with n * head >= tokens has a share of 1 / head at least, so there are head such words at most, and the end
    top = words.filter((F.col("n") * head >= F.lit(tokens)) | (F.col("key") == signed)).toArrow()
    hashes, counts = top.column("key").to_numpy().view(np.uint64), top.column("c").to_numpy()
    if not len(hashes):
        hashes, counts = np.array([end], np.uint64), np.zeros(1, np.int64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    shared = rows.sparkSession.sparkContext.broadcast(hashes)

    def keys(w: object, n: object) -> tuple:
        _, _, arc, inner = _arcs(shared.value, w, n)
        return inner, arc[inner].astype(np.uint64)

    found = _counted(rows, keys).filter(F.col("n") * cached >= F.lit(tokens)).toArrow()
    arcs, arc_counts = found.column("key").to_numpy(), found.column("c").to_numpy()
    order = np.argsort(arcs)
    discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
    return Automaton(tokens=tokens, total=total, distinct=distinct, texts=texts, discount=discount, words=hashes, counts=counts, arcs=arcs[order], arc_counts=arc_counts[order], mu=mu)


def traverse(model: Automaton, w: object, n: object) -> tuple:
    """(known words, base score and score of each text as far as the head tells; of the steps left: key, place in the head or -1, state and text)."""
    import numpy as np

    end, begin = _marks()
    at, is_head, arc, inner = _arcs(model.words, w, n)
    doc = np.repeat(np.arange(len(n)), n)
    c = model.counts[at]
    here = np.zeros(len(w), bool)
    weight, base = np.zeros(len(w)), np.zeros(len(w))
    if len(model.arcs):
        k = np.searchsorted(model.arcs, arc)
        k[k == len(model.arcs)] = 0
        here = inner & (model.arcs[k] == arc)
        weight[here] = np.log10(model.arc_counts[k[here]] + model.mu * model.root(c[here]))
    base[here] = np.log10((c[here] + 1) / (model.total + model.distinct + 1))
    # the state that a word of the head leads to; the end leads to none
    state = is_head & (w != np.uint64(end))
    weight[state] -= np.log10(c[state] + model.mu)
    known, base, weight = (np.bincount(doc, x, len(n)) for x in (here & (c > 0), base, weight))
    left = ~here
    u = _states(w, n, np.uint64(begin))[left]
    w, head = w[left], is_head[left]
    key = np.where(head, w + u * np.uint64(0x9E3779B97F4A7C15), w)
    return known.astype(np.int64), base, weight - math.log10(model.texts + model.mu), key, np.where(head, at[left], -1), u, doc[left]


def met(model: Automaton, head: tuple, tail: tuple) -> tuple:
    """(origin, count of its word, count of its arc, whether the word isn't of the head) of each step of a bucket. head: key, place, origin; tail: key, state, origin; origins are even where training counts them."""
    import numpy as np

    def summed(groups: object, counted: object) -> object:
        return np.bincount(groups, counted)[groups].astype(np.int64) if len(groups) else np.zeros(0, np.int64)

    def runs(*keys: object) -> object:
        new = np.zeros(len(keys[0]), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return np.cumsum(new)

    key, place, origin = head
    order = np.argsort(key)
    key, origin = key[order], origin[order]
    parts = [(origin, model.counts[place[order]], summed(runs(key), origin & 1 == 0), np.zeros(len(key), bool))]
    key, state, origin = tail
    order = np.lexsort((state, key))
    key, state, origin = key[order], state[order], origin[order]
    parts.append((origin, *(summed(g, origin & 1 == 0) for g in (runs(key), runs(key, state))), np.ones(len(key), bool)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def weigh(model: Automaton, c: object, arc: object, tail: object) -> tuple:
    """(known, base score, score) of steps with these counts; a word of the tail also tells the weight of the state it leads to."""
    import numpy as np

    score = np.log10(arc + model.mu * model.root(c)) - np.where(tail, np.log10(c + model.mu), 0)
    return c > 0, np.log10((c + 1) / (model.total + model.distinct + 1)), score


HEAD_KINDS, TAIL_KINDS = ("u8", "u4", "u4"), ("u8", "u8", "u4")


def scored(docs: DataFrame, head: int = HEAD, cached: int = CACHED, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    rows = _rows(docs)
    words = written(vocabulary(rows), "vocabulary")
    model = automaton(rows, words, head, cached, mu)
    shared = spark.sparkContext.broadcast(model)
    wanted = max(-(-model.tokens // BUCKET), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-model.tokens // (BUCKET // 20))))
    buckets = min(BUCKETS, max(1, wanted))

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        model, schema = shared.value, arrow_schema(PACKED)
        chunk = TaskContext.get().partitionId() << 32
        for batch in parts:
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, w, n in chunks(batch.column(1)):
                # a text's number is even if training counts it
                number = ((np.arange(len(n)) << 1) | held[first : first + len(n)]).astype(np.uint32)
                known, base, score, key, place, state, doc = traverse(model, w, n)
                rows = [batch.column(0).slice(first, len(n)), batch.column(2).slice(first, len(n)), *map(pa.array, (n.astype(np.int64), known, base, score))]
                facts = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.StructArray.from_arrays(rows, fields=list(schema.field("facts").type.value_type)))
                out: dict = {}
                for side, mask in enumerate((place >= 0, place < 0)):
                    order = np.argsort(key[mask])
                    columns = [x[mask][order] for x in (key, state if side else place.astype(np.uint32), number[doc])]
                    for k, x, y in spans(buckets_of(columns[0], buckets)):
                        out.setdefault(k, [0, 0, b"", b""])[side::2] = y - x, pack(*(c[x:y] for c in columns))
                steps = [(k, chunk, *v) for k, v in out.items()]
                if steps:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*steps), schema)), pa.nulls(len(steps), facts.type)], schema=schema)
                own = (dealt(chunk, buckets), chunk, 0, 0, b"", b"")
                yield pa.RecordBatch.from_arrays([*(pa.array([c], f.type) for c, f in zip(own, schema)), facts], schema=schema)
                chunk += 1

    def bucket(held: object) -> object:
        """Every chunk's steps of a bucket with the counts that met there, packed again by chunk."""
        import numpy as np
        import pyarrow as pa

        schema = arrow_schema(MET)
        names = held.column("chunk").to_numpy()
        sides = []
        for side, kinds in (("head", HEAD_KINDS), ("tail", TAIL_KINDS)):
            rows = [(k, unpack(data, n, *kinds)) for k, (n, data) in enumerate(zip(held.column(f"n_{side}").to_pylist(), held.column(side).to_pylist())) if n]
            sides.append([np.concatenate(c) for c in zip(*((x, y, z + np.int64(k << 32)) for k, (x, y, z) in rows))] if rows else [np.zeros(0, k) for k in (*kinds[:2], "i8")])
        origin, c, arc, tail = met(shared.value, *sides)
        order = np.argsort(origin)
        origin, c, arc = origin[order], c[order], (arc << 1 | tail)[order]
        steps = [(names[k], y - x, pack(origin[x:y].astype(np.uint32), c[x:y], arc[x:y])) for k, x, y in spans(origin >> 32)]
        facts = held.select(["chunk", "facts"]).filter(pa.compute.is_valid(held.column("facts")))
        own = [facts.column("chunk"), pa.chunked_array([pa.array([0] * len(facts), pa.int32())]), pa.chunked_array([pa.array([b""] * len(facts), pa.binary())]), facts.column("facts")]
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*steps)) or [[]] * 3, schema)] + [pa.nulls(len(steps), schema.field("facts").type)], schema=schema)
        return pa.concat_tables([table, pa.Table.from_arrays(own, schema.names).cast(schema)])

    def texts(held: object) -> object:
        """The scores of a chunk's texts."""
        import numpy as np
        import pyarrow as pa

        model = shared.value
        facts = pa.chunked_array(held.column("facts").chunks, arrow_schema(MET).field("facts").type).combine_chunks().flatten()
        columns = dict(zip([f.name for f in facts.type], facts.flatten()))
        rows = [unpack(data, n, "u4", "i8", "i8") for n, data in zip(held.column("n").to_pylist(), held.column("steps").to_pylist()) if n]
        doc, c, arc = (np.concatenate(x) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 3
        sums = [np.bincount(doc >> 1, x, len(facts)) for x in weigh(model, c, arc >> 1, arc & 1)]
        for name, x in zip(("n_known", "base_score", "score"), sums):
            columns[name] = pa.array(columns[name].to_numpy() + x.astype(columns[name].to_numpy().dtype))
        columns["train_tokens"] = pa.array(np.full(len(facts), model.total))
        return pa.Table.from_pydict({f.name: columns[f.name] for f in arrow_schema(SCORED)})

    # docs are read from files, so a chunk that is lost is made again from the same texts in the same order
    counted = rows.mapInArrow(batches, PACKED).groupBy("bucket").applyInArrow(bucket, MET)
    return counted.groupBy("chunk").applyInArrow(texts, SCORED)


def op1_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
