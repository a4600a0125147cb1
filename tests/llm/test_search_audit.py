"""Operators 11 to 13 against brute force, and on nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from riskloom.llm import op11_wand, op12_audit, op13_topk

ITEMS = "item_id long, text string, doc_id long, score long, rank int, term string"
LABELS = "doc_id long, quality int, toxic int, part string, bits int, label int"
VECTORS = "vec_id long, embedding array<float>, label int, key string, id long, v int, score int"


# --- 11: ranked lexical search


def ranked(docs, items, k=10):
    """Scores every document for every item, as the contract says."""
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(d, find((t or "").translate(lower))) for d, t, *_ in docs]
    terms = [(d, Counter(t), len(t)) for d, t in terms if t]
    n_docs, total = len(terms), sum(n for *_, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item in {i for i, _ in items}:
        query = Counter(t for text in {t for i, t in items if i == item} for t in find((text or "").translate(lower)))
        scores = []
        for d, c, n in terms:
            m = 25 + 75 * n * n_docs // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in query.items() if t in c)
            scores += [(-s, d is None, d, s)] if s > 0 else []
        out += [(item, k + 1, d, s) for k, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    draw = lambda m: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(words)], k=m))
    docs = [(k, draw(rng.choice([3, 12, 40])), f"s{k % 3}") for k in range(n)]
    return docs + [(n + k, docs[5][1], "copy") for k in range(30)], [(k, draw(rng.choice([1, 4, 15]))) for k in range(25)]


@pytest.mark.parametrize("seed", range(3))
def test_ranks_as_brute_force(spark, seed):
    docs, items = corpus(seed, 400)
    frame = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc_id long, text string").repartition(3)
    want = ranked(docs, items)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(op11_wand.ranked(frame, asked, window=64)) == want
    # several batches, each a pass over the documents
    assert found(op11_wand.ranked(frame, asked, batch=40)) == want


def test_rank_of_odd_rows(spark, odd, none):
    items = [(1, "SAME Text here"), (1, "same text here"), (1, "same text here"), (2, None), (3, ""), (4, "--- ..."), (None, "one, two"), (5, "中文 é b b b"), (6, "not there"), (7, "word3x3 end")]
    asked = spark.createDataFrame([(*i, 1, 2, 3, "t") for i in items], ITEMS)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(op11_wand.ranked(odd, asked)) == ranked(rows, items)
    assert found(op11_wand.ranked(none, asked)) == [] == found(op11_wand.ranked(odd, asked.limit(0)))


def test_windows_and_documents_are_skipped():
    rng = np.random.default_rng(1)
    lists = {0: np.arange(20_000), 1: np.sort(rng.choice(20_000, 9_000, False)), 2: np.sort(rng.choice(20_000, 60, False))}
    places = np.concatenate([*lists.values()]).astype(np.int32)
    dfs = [len(x) for x in lists.values()]
    row = {"n": 20_000, "postings": len(places), "terms": [0, 1, 2], "dfs": dfs, "names": op11_wand.pack(np.arange(20_000), np.full(20_000, 100)), "lists": op11_wand.pack(places, np.ones(len(places), np.int32))}
    shard = op11_wand.Shard(row, 20_000, 2_000_000, op11_wand.WINDOW)
    heap = op11_wand.Heap(10)
    query = [(0, 1), (1, 5), (2, 900)]
    looked = op11_wand.pass_shard(shard, query, heap)
    sums = np.zeros(20_000, np.int64)
    for (_, w), docs in zip(query, lists.values()):
        sums[docs] += w * shard.impacts[0]
    order = np.lexsort((np.arange(20_000), -sums))[:10]
    assert heap.ids.tolist() == order.tolist() and heap.scores.tolist() == sums[order].tolist()
    # windows until the heap is full of documents with the rare term, then these alone
    assert looked < 20_000 / 5


# --- 12: filter interaction audit


def audited(docs, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    facts = []
    for d, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        least = min((x for x, t, _ in docs if (t or "") == text and x is not None), default=None)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and least < d}
        facts.append((source or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out, sums = [], Counter()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            alive = own
            for k, f in enumerate(order):
                gone, alive = [x for x in alive if f in x[1]], [x for x in alive if f not in x[1]]
                sums[part, f] += len(gone)
                out.append((part, "".join(order), k + 1, len(alive), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
    return sorted((*x[:-1], sums[x[0], x[-1]]) for x in out)


def shown(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_audit_as_brute_force(spark):
    rng = random.Random(4)
    docs = []
    for k in range(600):
        words = [f"w{rng.randrange(rng.choice([40, 4000]))}" for _ in range(rng.choice([20, 199, 200, 260]))]
        docs.append((k, " ".join(words + rng.choice([[], ["#"], ["CAPITALS " * 9]])), rng.choice(["a", "b", "c", None])))
    docs += [(600 + k, docs[k % 7][1], "a") for k in range(200)]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 800, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    assert shown(op12_audit.audit(frame, spark.createDataFrame([(*x, "p", 1, 2) for x in labels], LABELS))) == audited(docs, labels)


def test_audit_of_odd_rows(spark, odd, none):
    labels = [(1, 1, 0), (1, 0, 1), (7, 1, 1), (8, None, None), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*x, "p", 1, 2) for x in labels], LABELS)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert shown(op12_audit.audit(odd, frame)) == audited(rows, labels)
    assert shown(op12_audit.audit(none, frame)) == []
    assert shown(op12_audit.audit(odd, frame.limit(0))) == audited(rows, [])


# --- 13: exact top-k search


def nearest(vectors, k=20, every=20):
    """Every query against every other row, in whole numbers."""
    able = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(able):
        if q is None or q % every:
            continue
        scores = sorted((-sum(p * r for p, r in zip(x, y)), i is None, i or 0) for b, (i, y) in enumerate(able) if b != a)[:k]
        out += [(q, n + 1, None if no else i, -s) for n, (s, no, i) in enumerate(scores)]
    return sorted(out, key=repr)


def best(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "k", 2, 3, 4) for i, v in rows], VECTORS)


@pytest.mark.parametrize("shape", ["even", "clustered", "ties"])
def test_top_k_as_brute_force(spark, shape):
    rng = np.random.default_rng(len(shape))
    v = rng.normal(size=(700, 40)) / 8
    if shape == "clustered":
        v = v * np.geomspace(1, 0.02, 40) + np.sign(rng.normal(size=(700, 1))) * 0.2
    if shape == "ties":
        v[100:400] = v[100]
    rows = [(int(i), [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]
    frame = vectors(spark, rows).repartition(3)
    assert best(op13_topk.top_k(frame)) == nearest(rows)
    # many slices and groups
    assert best(op13_topk.top_k(frame, slice_rows=90, group_rows=9, block=32)) == nearest(rows)


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 2]), (0, [1, 2]), (20, [3]), (40, []), (60, None), (80, [1, None]), (100, [nan, 1]), (1, [inf, 1]), (2, [-1, -1, 5]), (None, [9, 9]), (None, [9, 9]), (120, [0, 0]), (3, [2.0**80, 1])]
    got = best(op13_topk.top_k(vectors(spark, rows)))
    assert [r for r in got if r[3] < 2**53] == [r for r in nearest(rows) if r[3] < 2**53]
    # beyond what a long holds the score is the greatest long's
    assert [(q, n, i) for q, n, i, s in got if s >= 2**53] == [(q, n, i) for q, n, i, s in nearest(rows) if s >= 2**53]
    assert best(op13_topk.top_k(vectors(spark, []))) == [] == best(op13_topk.top_k(vectors(spark, [(1, [1, 2])])))
    assert best(op13_topk.top_k(vectors(spark, [(20, [1, 2])]))) == []


def test_bounds_leave_candidates_out():
    rng = np.random.default_rng(7)
    c = np.floor(64 * rng.normal(size=(64, 6_000)) * np.geomspace(1, 0.01, 64)[:, None])
    keys = np.arange(6_000)
    found = op13_topk.search((keys[:40], keys[:40], c[:, :40]), (keys, keys, c))
    whole = c[:, :40].T @ c
    whole[keys[:40], keys[:40]] = -np.inf
    for k in range(40):
        order = np.lexsort((keys, -whole[k]))[:20]
        assert found.held[k][1].tolist() == order.tolist()
