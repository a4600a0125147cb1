"""The near-duplicate stage against brute-force Jaccard groups on five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from riskloom.llm import near_copies, op8_simhash
from tests.llm.conftest import frame


def gram_set(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    held = {d: gram_set(t) for d, t, _ in rows}
    root = {d: d for d in held}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(held)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if near(held[a], held[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in ids}


@pytest.fixture(scope="module")
def edited():
    """Texts, near copies on either side of the limit, chains of edits, a shared passage and short texts."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    passage = [word() for _ in range(25)]
    texts = [[word() for _ in range(r.randint(30, 160))] for _ in range(60)]
    for k in range(0, 40, 2):
        texts[k][5:5] = passage
    for k in range(60):
        for edits in (1, 2, 3, 5):
            w = list(texts[k])
            for _ in range(edits):
                w[r.randrange(len(w))] = word()
            texts.append(w)
    chain = [word() for _ in range(100)]
    for _ in range(25):
        texts.append(chain)
        chain = [*chain[4:], *(word() for _ in range(4))]
    # a set of four shingles and one of five that holds it
    texts += [list("abcdefgh"), list("abcdefghi"), list("abcd"), list("ABCD"), list("abc"), []]
    return [(k, " ".join(w), "s") for k, w in enumerate(texts)]


@pytest.mark.parametrize("chunk, bucket", [(10**6, 4 * 10**6), (300, 200), (1, 10**4)])
def test_near_copies_match_brute_force(spark, edited, chunk, bucket, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    got = {r.doc_id: r.component_id for r in op8_simhash.clusters(frame(spark, edited), near_copies.near_clusters).collect()}
    assert got == brute(edited)


@pytest.mark.parametrize("rounds", [0, 1])
def test_pairs_beyond_the_leaders(spark, edited, monkeypatch, rounds):
    monkeypatch.setattr(near_copies, "LEADERS", 1)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    got = {r.doc_id: r.component_id for r in op8_simhash.clusters(frame(spark, edited), near_copies.near_clusters).collect()}
    assert got == brute(edited)


def test_marks_never_rule_out_similar_sets(spark):
    r = random.Random(5)
    rows = []
    for k in range(200):
        n = r.randint(3, 900)
        a = [r.getrandbits(64) for _ in range(n)]
        b = [x if r.random() < 0.93 else r.getrandbits(64) for x in a]
        rows.append((*(tuple([len(set(x)), *near_copies.marks(np.array(x, np.uint64))]) for x in (a, b)), near(set(a), set(b))))
    kind = "struct<n:int," + ",".join(f"{m}:long" for m in near_copies.MARKS) + ">"
    got = spark.createDataFrame(rows, f"x {kind}, y {kind}, similar boolean").selectExpr(f"{near_copies._can('x', 'y')} as can", "similar").collect()
    assert all(g.can for g in got if g.similar) and any(g.similar for g in got) and not all(g.can for g in got)


def test_stage_drops_edited_copies(spark, edited):
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, edited), "").collect()}
    assert kept == {d for d, top in brute(edited).items() if d == top}


def test_stage_on_odd_rows(spark, odd, none):
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, "").collect()]
    assert kept.count(7) == 1 and 8 not in kept and 1 in kept and 2 not in kept and 3 not in kept and 9 in kept and 10 not in kept
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0


def test_links_of_the_grid_are_pairs(spark, monkeypatch):
    sets = [(1, 0), (2, 0), (3, 3), (4, 0b11111 << 20), (5, 0b1111 << 20), (6, -1)]
    got = {(r.a, r.b) for r in near_copies.by_bits(spark.createDataFrame(sets, "sid long, fp long")).collect()}
    assert {(2, 1), (3, 1), (5, 4)} == got
    asked = []
    monkeypatch.setattr(near_copies, "by_bits", lambda held, real=near_copies.by_bits: asked.append(held.columns) or real(held))
    words = [f"w{k}" for k in range(60)]
    docs = frame(spark, [(1, " ".join(words), "s"), (2, " ".join([*words[:59], "x"]), "s"), (3, " ".join(reversed(words)), "s")])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3} and asked == [["sid", "fp"]]


def test_fingerprints_are_majorities():
    x = np.array([1, 3, 5], np.uint64)
    bits = np.unpackbits(np.array([near_copies.fingerprint(x)], np.int64).view(np.uint8))
    assert bits.sum() == 1 and near_copies.fingerprint(x[:0]) == 0
