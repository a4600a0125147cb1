"""The gradients that the classifiers descend by against finite differences of their risks, written plainly."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from riskloom.llm import op4_pu, op5_crf


def slope(f, w, k, step=1e-5):
    a, b = w.copy(), w.copy()
    a.flat[k] += step
    b.flat[k] -= step
    return (f(a) - f(b)) / (2 * step)


def test_risk_of_positive_and_unlabelled_rows(monkeypatch):
    rng = np.random.default_rng(3)
    p, u = rng.normal(0.6, 1, (60, len(op4_pu.NAMES))), rng.normal(0, 1, (150, len(op4_pu.NAMES)))
    caught, descend = [], op4_pu._descend
    monkeypatch.setattr(op4_pu, "_descend", lambda gradient, size: caught.append(gradient) or descend(gradient, size))
    model = op4_pu.fit(p, u)
    x, y = ((op4_pu._matrix(rows) - model.mean) / model.scale for rows in (p, u))
    loss = lambda z: np.log1p(np.exp(-z)).mean()

    def positive(w):
        return model.prior * loss(x @ w)

    def negative(w):
        return loss(-(y @ w)) - model.prior * loss(-(x @ w))

    both, nonnegative = caught
    seen = set()
    for w in (np.zeros(x.shape[1]), rng.normal(0, 0.1, x.shape[1]), model.weights, model.weights * 3, -model.weights):
        # the risk of telling positives from unlabelled rows, by which the prior is estimated
        assert all(np.isclose(both(w)[k], slope(lambda v: loss(x @ v) + loss(-(y @ v)), w, k), atol=1e-5) for k in range(0, len(w), 3))
        below = negative(w) < 0
        seen.add(bool(below))
        # where the estimate of the negatives' risk is below zero, only that is driven back
        risk = (lambda v: -negative(v)) if below else (lambda v: positive(v) + negative(v))
        assert all(np.isclose(nonnegative(w)[k], slope(risk, w, k), atol=1e-5) for k in range(0, len(w), 3))
    assert False in seen


def test_risk_of_negatives_that_falls_below_zero(monkeypatch):
    rng = np.random.default_rng(5)
    p = rng.normal(0, 1, (30, len(op4_pu.NAMES)))
    u = np.vstack([p[:20], rng.normal(2, 1, (10, len(op4_pu.NAMES)))])
    caught, descend = [], op4_pu._descend
    monkeypatch.setattr(op4_pu, "_descend", lambda gradient, size: caught.append(gradient) or descend(gradient, size))
    monkeypatch.setattr(op4_pu, "class_prior", lambda *scores: 0.95)
    model = op4_pu.fit(p, u)
    x, y = ((op4_pu._matrix(rows) - model.mean) / model.scale for rows in (p, u))
    loss = lambda z: np.logaddexp(0, -z).mean()
    negative = lambda w: loss(-(y @ w)) - 0.95 * loss(-(x @ w))
    w = next(w for w in (rng.normal(0, s, x.shape[1]) for s in np.linspace(0.05, 3, 400)) if negative(w) < -0.01)
    assert all(np.isclose(caught[1](w)[k], -slope(negative, w, k), atol=1e-5) for k in range(len(w)))


def partition(lines, emission, trans):
    """The sum over all taggings of all lines, in logarithms."""
    total = 0.0
    for line in lines:
        scores = [sum(emission[w] * t for w, t in zip(line, tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])) for tags in itertools.product((0, 1), repeat=len(line))]
        total += np.logaddexp.reduce(scores)
    return total


@pytest.mark.parametrize("seed", range(3))
def test_field_by_finite_differences(seed):
    rng = np.random.default_rng(seed)
    lines = [rng.integers(0, 6, n) for n in (1, 2, 5, 7, 3, 3, 0, 6)]
    emission, trans = rng.normal(0, 1.5, 6), rng.normal(0, 1, (2, 2))
    found, pairs = op5_crf.marginals(lines, emission, trans, want=True)
    # marginals and expected pairs are the gradient of the partition's logarithm
    by_word = np.bincount(np.concatenate(lines).astype(int), np.concatenate(found), 6)
    assert all(np.isclose(by_word[k], slope(lambda e: partition(lines, e, trans), emission, k), atol=1e-5) for k in range(6))
    assert all(np.isclose(pairs.flat[k], slope(lambda t: partition(lines, emission, t), trans, k), atol=1e-5) for k in range(4))


def test_a_long_line_beside_short_ones():
    rng = np.random.default_rng(1)
    lines = [rng.integers(0, 50, n) for n in (30_000, *[5] * 40, 1, 0)]
    emission, trans = rng.normal(-1, 1, 50), np.array([[0.4, -0.4], [-0.3, 0.3]])
    found, _ = op5_crf.marginals(lines, emission, trans)
    assert [len(x) for x in found] == [len(x) for x in lines] and all(((x >= 0) & (x <= 1)).all() for x in found)
    alone, _ = op5_crf.marginals([lines[0]], emission, trans)
    assert np.allclose(found[0], alone[0])
