"""Operators that SQL can't express against plain Python over a generated corpus with copies, junk and toxic words."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from riskloom.llm import common, op1_backoff, op4_pu, op5_crf, op7_lines, op8_simhash, op9_tokens
from tests.llm.conftest import frame


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ter", "os", "un"]) for _ in range(r.randint(1, 4)))
    vocabulary = [word() for _ in range(900)]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(4, 14)))
    shared = [line() for _ in range(5)]
    texts = []
    for k in range(300):
        lines = [line().capitalize() for _ in range(r.randint(1, 14))]
        if k % 11 == 0:
            at = r.randint(0, len(lines))
            lines[at:at] = shared
        texts.append("\n".join(lines))
    for k in range(0, 60, 2):
        texts.append(texts[k])
        texts.append(texts[k].replace(" ", " x ", 1))
    return [(k, t, f"s{k % 5}") for k, t in enumerate(texts)]


def simhash(text: str) -> int:
    w = text.lower().split()
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    values = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values)) if values else 0


def groups(prints: dict) -> dict:
    root = {d: d for d in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in ids}


def test_simhash(spark, corpus):
    want = {d: simhash(t) for d, t, _ in corpus}
    got = op8_simhash.clusters(frame(spark, corpus)).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == groups(want)


@pytest.mark.parametrize("cell", [64, 4, 1])
def test_links_of_dense_and_sparse_fingerprints(spark, cell):
    r = random.Random(1)
    prints = {0, 2**64 - 1, 1, 3, 7, 15}
    for _ in range(40):
        x = r.getrandbits(64)
        prints |= {x, x ^ 1 << r.randrange(64), x ^ 3 << r.randrange(63), x ^ 7 << r.randrange(62)}
    # a ball of 65 and more, all within two bits of its centre
    centre = r.getrandbits(64)
    prints |= {centre} | {centre ^ 1 << k for k in range(64)} | {centre ^ 1 << k ^ 1 << (k + 9) % 64 for k in range(64)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = op8_simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), cell)
    if cell == 64:
        assert all(((x.a ^ x.b) % 2**64).bit_count() <= 2 for x in edges.collect())
    got = {r.node: r.root for r in op8_simhash.components(edges).collect()}
    want = groups({p - 2**64 if p >= 2**63 else p: p for p in prints})
    assert {p: got.get(p, p) for p in signed} == want


def test_points_bound_the_hamming_distance(spark):
    r = random.Random(4)
    rows = [(x, x ^ sum(1 << k for k in r.sample(range(63), r.randrange(5)))) for x in (r.getrandbits(63) for _ in range(300))]
    point = lambda x: [(x >> low & (1 << n) - 1).bit_count() for low, n in op8_simhash._spans()]
    points = {p.fp: p.point for p in op8_simhash.cells(spark.createDataFrame([(x,) for pair in rows for x in pair], "fp long")).collect()}
    far = spark.createDataFrame([(x, y, points[x], points[y]) for x, y in rows], "x long, y long, a long, b long").selectExpr("x", "y", f"{op8_simhash.manhattan('a', 'b')} as d").collect()
    assert all(f.d == sum(abs(i - j) for i, j in zip(point(f.x), point(f.y))) <= (f.x ^ f.y).bit_count() for f in far)


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(200)], "a long, b long")
    assert {r.root for r in op8_simhash.components(edges).collect()} == {0}


def backoff(corpus, mu):
    """The automaton over the training texts as plain dictionaries, and a text's scores by walking it one token at a time."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _, _ in corpus}
    tokens = {d: [*t.lower().split(), "\n"] for d, t, _ in corpus}
    count, follows, begins = Counter(), defaultdict(Counter), 0
    for d, w in tokens.items():
        if not held[d]:
            count.update(w)
            begins += 1
            for u, x in zip(["", *w], w):
                follows[u][x] += 1
    n, v = sum(count.values()), len(count)
    ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
    off = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
    root = lambda w: (count[w] - off) / n if count[w] else off * v / n
    times = lambda u: begins if u == "" else count[u]
    arc = lambda u, w: (follows[u][w] + mu * root(w)) / (times(u) + mu)
    failure = lambda u: mu / (times(u) + mu)

    def walk(words):
        state, score, base = "", 0.0, 0.0
        for w in words:
            score += math.log10(arc(state, w)) if follows[state][w] else math.log10(failure(state)) + math.log10(root(w))
            base += math.log10((count[w] + 1) / (n + v + 1))
            state = w
        return score, base

    return held, tokens, count, follows, root, arc, failure, walk


@pytest.mark.parametrize("head, cached", [(2**13, 2**18), (64, 2**18), (2**13, 512), (1, 1)])
def test_scores_are_the_automatons(spark, corpus, head, cached):
    mu = 40.0
    held, tokens, count, _, _, _, _, walk = backoff(corpus, mu)
    rows = {r.doc_id: r for r in op1_backoff.scored(frame(spark, corpus), head=head, cached=cached, mu=mu).collect()}
    assert len(rows) == len(corpus)
    for d, _, _ in corpus:
        score, base = walk(tokens[d])
        assert math.isclose(rows[d].score, score, rel_tol=1e-9) and math.isclose(rows[d].base_score, base, rel_tol=1e-9)
        assert (rows[d].n_tokens, rows[d].n_known, rows[d].train_tokens, rows[d].held_out) == (len(tokens[d]), sum(count[x] > 0 for x in tokens[d]), sum(count.values()), held[d])
    out = [d for d in rows if held[d]]
    assert sum(rows[d].score for d in out) > sum(rows[d].base_score for d in out)


def test_packed_columns_come_back():
    r = np.random.default_rng(3)
    for n in (1, 500):
        columns = [np.sort(r.integers(0, 2**64, n, np.uint64)), r.integers(0, 9, n).astype(np.uint32), r.integers(0, 2**32, n).astype(np.uint32)]
        assert all(map(np.array_equal, columns, common.unpack(common.pack(*columns), n, "u8", "u4", "u4")))


def test_states_sum_to_one(corpus):
    _, _, count, follows, root, arc, failure, _ = backoff(corpus, 40.0)
    unknown = root("no such word")
    assert math.isclose(sum(map(root, count)) + unknown, 1, rel_tol=1e-9)
    for u in ["", *list(count)[:30]]:
        rest = sum(root(w) for w in count if not follows[u][w]) + unknown
        assert math.isclose(sum(arc(u, w) for w in follows[u]) + failure(u) * rest, 1, rel_tol=1e-9)


def test_long_texts_span_chunks(spark, corpus):
    whole = {r.doc_id: r.score for r in op1_backoff.scored(frame(spark, corpus)).collect()}
    texts = pa.array([t for _, t, _ in corpus], pa.binary())
    small, large = (list(op1_backoff.chunks(texts, size)) for size in (50, 10**9))
    assert len(large) == 1 and all(np.array_equal(np.concatenate([x[k] for x in small]), large[0][k]) for k in (1, 2))
    assert [x[0] for x in small] == np.cumsum([0, *(len(x[2]) for x in small)])[:-1].tolist()
    again = {r.doc_id: r.score for r in op1_backoff.scored(frame(spark, corpus).repartition(5)).collect()}
    assert all(math.isclose(whole[d], again[d], rel_tol=1e-9) for d in whole)


def lines_to_delete(corpus, window=op7_lines.WINDOW, levels=op7_lines.LEVELS):
    """The lines that are deleted from each text, by the rules of the module's docstring and by plain comparisons of lines."""
    texts = {d: [(k, tuple(x.split())) for k, x in enumerate((t or "").split("\n")) if x.split()] for d, t, _ in sorted(corpus)}
    rank = {w: op7_lines.line_hashes(" ".join(w).encode())[0][0] for x in texts.values() for _, w in x}
    n = lambda x: sum(len(w) for _, w in x)
    marks, out = [], {d: set() for d in texts}
    for d, x in texts.items():
        anchors = set()
        for a in range(len(x)):
            b = next((b for b in range(a, len(x) + 1) if n(x[a:b]) >= window), None)
            if b is not None:
                anchors.add(min(range(a, b), key=lambda k: (rank[x[k][1]], -k)))
        for m in sorted(anchors):
            for level in levels:
                end = next((e for e in range(m, len(x) + 1) if n(x[m:e]) >= level), None)
                begin = next((b for b in range(m, -1, -1) if n(x[b : m + 1]) >= level), None)
                if end is not None and begin is not None:
                    marks.append(((level, m - begin, tuple(w for _, w in x[begin:end])), d, m))
    first = {}
    for key, d, m in marks:
        first.setdefault(key, (d, m))
    for key, d, m in marks:
        e, f = first[key]
        if (d, m) != (e, f):
            x, y = texts[d], texts[e]
            a = next((k for k in range(min(m, f)) if x[m - k - 1][1] != y[f - k - 1][1]), min(m, f))
            b = next((k for k in range(min(len(x) - m, len(y) - f)) if x[m + k][1] != y[f + k][1]), min(len(x) - m, len(y) - f))
            out[d] |= {x[k][0] for k in range(m - a, m + b)}
    return out


@pytest.mark.parametrize("hot, window, levels", [(2**12, 16, (10, 40)), (4, 16, (10, 40)), (1, 5, (3,)), (4, 40, (6, 20, 60))])
def test_repeated_runs(spark, corpus, hot, window, levels):
    want, docs = lines_to_delete(corpus, window, levels), frame(spark, corpus)
    got = {r.doc: {k for x in r.runs for k in range(x.start, x.end)} for r in op7_lines.removed(docs, hot, window, levels).collect()}
    assert got == want and any(want.values())
    if (window, levels) == (op7_lines.WINDOW, op7_lines.LEVELS):
        texts = {r.doc_id: r.text for r in op7_lines.dedup(docs).collect()}
        assert all(texts[d] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]) for d, t, _ in corpus)


def test_token_counts(spark, corpus):
    encode, end = op9_tokens.encoder(op9_tokens.vocabulary())
    want = {d: len(encode(t)) for d, t, _ in corpus}
    for block in (7, 1000):
        assert {r.doc_id: r.n_tokens for r in op9_tokens.counted(frame(spark, corpus), block=block).collect()} == want
    blocks = spark.createDataFrame([(0, b, np.array(x, "<u2").tobytes()) for b, x in enumerate([[1, 2], [3], [end, end], [], [4, end, 5], [6, end]])], "file long, block int, data binary")
    assert [r.n_tokens for r in op9_tokens.stitched(op9_tokens.scan(blocks, end)).orderBy("place").collect()] == [3, 0, 1, 2]


def test_quality_held_out(spark, corpus):
    r = random.Random(2)
    rows, marks = [], []
    for d, t, s in corpus:
        bad = d % 4 == 0
        rows.append((d, " ".join(w + r.choice(["***", "###"]) for w in t.split()) if bad else t, s))
        marks.append((d, 0 if bad else 1, 0))
    got = op4_pu.op4_scores(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    out = [(x.predicted, marks[x.doc_id][1]) for x in got if x.held_out]
    assert len(out) > 40 and sum(a == b for a, b in out) / len(out) >= 0.9
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)


def test_class_prior():
    r = np.random.default_rng(0)
    p, u = r.normal(2, 1, 4000), np.concatenate([r.normal(2, 1, 2400), r.normal(-2, 1, 1600)])
    assert abs(op4_pu.class_prior(p, u) - 0.6) < 0.05


def test_toxic_held_out_and_spans(spark, corpus):
    r = random.Random(5)
    rows, marks = [], []
    for d, t, s in corpus:
        bad = d % 3 == 0
        words = t.split(" ")
        for _ in range(3 if bad else 0):
            words.insert(r.randrange(len(words)), "nastyword" + r.choice(["", "s", "ing"]))
        rows.append((d, " ".join(words), s))
        marks.append((d, 1, int(bad)))
    got = op5_crf.tagged(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    out = [(x.predicted, marks[x.doc_id][2]) for x in got if x.held_out]
    assert sum(a == b for a, b in out) / len(out) >= 0.95
    spans = [rows[x.doc_id][1][s.start : s.end] for x in got for s in x.spans]
    assert spans and sum("nastyword" in s for s in spans) / len(spans) >= 0.95


def test_marginals_match_enumeration():
    emission, trans = np.array([0.3, -1.2, 2.0]), np.array([[0.5, -0.4], [-0.2, 0.9]])
    line = [0, 1, 2, 1]
    weight = lambda tags: math.exp(sum(emission[w] * t for w, t in zip(line, tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
    every = [tuple(k >> b & 1 for b in range(4)) for k in range(16)]
    z = sum(map(weight, every))
    want = [sum(weight(t) for t in every if t[k]) / z for k in range(4)]
    (got, empty), pairs = op5_crf.marginals([np.array(line), np.array([], int)], emission, trans, want=True)
    assert np.allclose(got, want) and not len(empty)
    joint = np.array([[sum(weight(t) * sum((x, y) == (a, b) for x, y in zip(t, t[1:])) for t in every) / z for b in (0, 1)] for a in (0, 1)])
    assert np.allclose(pairs, joint)


def test_components_take_few_jobs(spark):
    """Each job leaves its plan and metrics with the driver: a round asks no more of it than its own table."""
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 50), (101, 50), (101, 100), (205, 201), (205, 202), (205, 203)], "a long, b long").repartition(3)
    spark.sparkContext.setJobGroup("components", "counted")
    try:
        roots = op8_simhash.components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    got = {r.node: r.root for r in roots.collect()}
    assert got == {k + 1: 0 for k in range(40)} | {100: 50, 101: 50, 202: 201, 203: 201, 205: 201}
    assert jobs <= 50
