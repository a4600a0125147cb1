"""Line deduplication deletes later copies of runs, and leaves short lines alone outside of them."""

from __future__ import annotations

import random

import pytest

from riskloom.llm import op7_lines
from tests.llm.conftest import frame


def left(spark, texts):
    rows = [(k, "\n".join(t), "s") for k, t in enumerate(texts)]
    return {r.doc_id: r.text.split("\n") if r.text else [] for r in op7_lines.dedup(frame(spark, rows)).collect()}


def said(seed, *lengths):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10**12)}" for _ in range(n)) for n in lengths]


def test_long_lines_and_short_ones(spark):
    (long, other), short = said(1, 16, 30), ["Yes.", "---", "The end."]
    got = left(spark, [[long, *short], ["a b", long, *short[::-1]], [*short, other, long, "z w"], [*short, *said(2, 40), *short], ["", long, "x", long, "", other, ""]])
    # blank lines between two lines that go go with them
    assert got == {0: [long, *short], 1: ["a b", *short[::-1]], 2: [*short, other, "z w"], 3: [*short, *said(2, 40), *short], 4: ["", "x", ""]}


def test_short_lines_go_within_runs(spark):
    (a, b, c, d), run = said(3, 30, 30, 30, 30), ["Yes.", *said(4, 20), "---", *said(5, 18), "The end."]
    got = left(spark, [[a, *run, b], [c, *run, d], ["Yes.", c, "The end."]])
    assert got == {0: [a, *run, b], 1: [c, d], 2: ["Yes.", "The end."]}


def test_repeats_within_a_text(spark):
    a, b = said(6, 20, 20)
    assert left(spark, [[a, a, a, b, "x", a, b, "x", a]]) == {0: [a, b, "x"]}


@pytest.mark.parametrize("n", [1, 3, 5, 8])
def test_runs_of_a_guaranteed_length_are_found(spark, n):
    """Runs of lines of n words, placed in other texts: all of at least WINDOW + 2 * LEVEL + 2 * n words are found whole."""
    rng, least = random.Random(n), op7_lines.WINDOW + 2 * op7_lines.LEVELS[0] + 2 * n
    texts, copies = [said(100 + k, *[rng.randrange(1, n + 1) for _ in range(30)]) for k in range(60)], {}
    for k in range(40):
        run = said(1000 + k, *[n] * -(-least // n))
        for d in (k, 59 - k % 20):
            at = rng.randrange(len(texts[d]) + 1) if d not in copies else 0
            texts[d][at:at] = run
        copies.setdefault(59 - k % 20, []).append(run)
    got = left(spark, texts)
    held = {line for lines in got.values() for line in lines}
    seen = [line for lines in got.values() for line in lines]
    for runs in copies.values():
        for run in runs:
            assert all(line in held for line in run)
    twice = sum(seen.count(line) > 1 for runs in copies.values() for run in runs for line in run)
    assert twice == 0
