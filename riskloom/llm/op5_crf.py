"""Toxic spans by a linear-chain conditional random field over two tags.

Labelled tokens: labels mark documents only, so a training document's tokens are labelled first. Every token has
features: its letters, lower-cased, and the prefixes of these. A feature that at least five toxic training documents have
and that is at least thirty times as frequent among them as among the others marks the tokens of toxic documents that
have it as toxic; all other tokens are not. The field is fitted on these tags: emission weights of hashed features and
transition weights between neighbouring tags, one chain for each line, by full-batch gradient steps on the conditional
likelihood. Scoring computes each token's marginal by the forward-backward recursions; a document's probability that some
token is toxic comes from the sum of -log(1 - marginal), and two numbers fitted on the training documents turn it into
the score. Tokens with a marginal of one half or more are the offending spans, given as character offsets.

The model is fitted on a bounded sample: at most 800 toxic and 2000 other training documents, the first by the MD5 of
their ids, of at most 8,000 characters each (of rows that repeat an id the least text). All of these choose the marking
features and the score's two numbers; the field's weights are fitted on the first 600 of either kind (FIT_DOCS). Every
document is scored whole.

Defined cases: null and empty texts have no tokens and get the score of a document without toxic tokens; repeated rows
are scored alike; without toxic or without other training documents all scores are the share of toxic ones (0 without
any label); a label of a row without a document is ignored, as are null labels; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import documents, id_crc, table

FOLDS, HELD_OUT = 5, 0
TOXIC_DOCS, OTHER_DOCS, MAX_CHARS = 800, 2000, 8_000
#: The tokens of all sampled documents choose the marking features; the field itself is fitted on these many of either kind.
FIT_DOCS = 600
BUCKETS = 2**18
MIN_DOCS, MIN_RATIO = 5, 30.0
STEPS, RATE, L2 = 25, 0.5, 1e-4
NOT_LETTERS = re.compile(r"[^a-zà-öø-ÿœß]+")


@dataclass
class Field:
    """weights: emission in favour of the toxic tag by hashed feature; bias; trans[i][j]: from tag i to tag j; a, b: of the score."""

    weights: object = None
    bias: float = 0.0
    trans: object = None
    a: float = 0.0
    b: float = -30.0
    known: dict = field(default_factory=dict)


def features(word: str) -> list[str]:
    """A token's letters and their prefixes of three letters and more."""
    core = NOT_LETTERS.sub("", word.lower())
    return [f"={core}", *(core[:k] for k in range(3, min(len(core), 12) + 1))] if core else []


def _coded(names: list[str]) -> list[int]:
    import zlib

    return [zlib.crc32(x.encode()) for x in names]


def marginals(lines: list, emission: object, trans: object, want: bool = False) -> tuple:
    """Of each line (an array of token types): its tokens' marginals of the toxic tag; the log-likelihood's parts with want.

    Lines are taken in order of their length, many at a time, so that each step of the recursions is a vector operation.
    Returns a list of arrays, and with want the summed pair marginals, 2 x 2.
    """
    import numpy as np

    order = sorted(range(len(lines)), key=lambda k: len(lines[k]))
    out: list = [None] * len(lines)
    pairs = np.zeros((2, 2))
    start, t = 0, np.exp(trans - trans.max())
    while start < len(order):
        longest = stop = 0
        first = len(lines[order[start]])
        for stop in range(start, len(order)):
            longest = len(lines[order[stop]])
            if stop - start >= 16 and (longest > 1.25 * first + 4 or longest * (stop - start) > 400_000):
                break
        else:
            stop = len(order)
        group = [lines[k] for k in order[start:stop]]
        longest = len(group[-1])
        if longest:
            n = np.array([len(x) for x in group])
            e = np.zeros((longest, len(group)))
            for c, x in enumerate(group):
                e[: len(x), c] = emission[x]
            on = np.arange(longest)[:, None] < n
            # odds are taken about their own middle, so no product over- or underflows
            p = 1 / (1 + np.exp(-np.clip(e, -40, 40)))
            obs = np.stack([1 - p, p])
            f = np.empty((longest, 2, len(group)))
            f[0] = obs[:, 0]
            f[0] /= f[0].sum(0)
            for i in range(1, longest):
                x = (t.T @ f[i - 1]) * obs[:, i]
                f[i] = x / x.sum(0)
            back = np.ones((2, len(group)))
            m = np.empty((longest, len(group)))
            for i in range(longest - 1, -1, -1):
                x = f[i] * back
                m[i] = x[1] / x.sum(0)
                if i:
                    nxt = obs[:, i] * back
                    if want:
                        joint = f[i - 1][:, None] * t[:, :, None] * nxt[None]
                        pairs += (joint / joint.sum((0, 1)) * on[i]).sum(2)
                    x = t @ nxt
                    # beyond a line's end nothing is known, so the message stays even
                    back = np.where(on[i], x / x.sum(0), 1.0)
            for c, k in enumerate(order[start:stop]):
                out[k] = m[: n[c], c]
        else:
            for k in order[start:stop]:
                out[k] = np.zeros(0)
        start = stop
    return out, pairs


def fit(texts: list[str], toxic: list[int]) -> Field:
    """The field fitted on whole training documents."""
    import numpy as np

    model, y = Field(trans=np.zeros((2, 2))), np.array(toxic)
    if not len(y) or y.min() == y.max():
        rate = min(1 - 1e-6, max(1e-6, float(y.mean()))) if len(y) else 1e-6
        model.weights, model.bias, model.a, model.b = np.zeros(BUCKETS, np.float32), -40.0, 0.0, float(np.log(rate / (1 - rate)))
        return model
    types: dict[str, int] = {}
    docs = [[[types.setdefault(w, len(types)) for w in line.split()] for line in text.split("\n")] for text in texts]
    coded = [_coded(features(w)) for w in types]
    begin = np.concatenate(([0], np.cumsum([len(x) for x in coded]))).astype(np.int64)
    codes = np.array([c for x in coded for c in x], np.int64)
    del coded
    names, place = np.unique(codes, return_inverse=True)
    # how many documents of either kind have a feature
    with_it = np.zeros((2, len(names)), np.int64)
    for doc, label in zip(docs, toxic):
        held = {k for line in doc for k in line}
        if held:
            with_it[label, np.unique(np.concatenate([place[begin[k] : begin[k + 1]] for k in held]))] += 1
    n1, n0 = int(y.sum()), int((1 - y).sum())
    marked = (with_it[1] >= MIN_DOCS) & (with_it[1] / n1 >= MIN_RATIO * (with_it[0] + 0.5) / n0)
    is_toxic = np.array([bool(marked[place[begin[k] : begin[k + 1]]].any()) for k in range(len(types))], bool)
    lines, tags = [], []
    left = [FIT_DOCS, FIT_DOCS]
    for doc, label in zip(docs, toxic):
        left[label] -= 1
        for line in doc:
            if line and left[label] >= 0:
                lines.append(np.array(line))
                tags.append(is_toxic[lines[-1]] & bool(label))
    rows, cols = np.repeat(np.arange(len(types)), np.diff(begin)), codes % BUCKETS
    flat, target = np.concatenate(lines), np.concatenate(tags).astype(float)
    seen = np.zeros((2, 2))
    for tag in tags:
        np.add.at(seen, (tag[:-1].astype(int), tag[1:].astype(int)), 1)
    weights, bias, trans = np.zeros(BUCKETS), -3.0, np.zeros((2, 2))
    moments = [[np.zeros(BUCKETS), np.zeros(BUCKETS)], [0.0, 0.0], [np.zeros((2, 2)), np.zeros((2, 2))]]
    for step in range(1, STEPS + 1):
        emission = bias + np.bincount(rows, weights[cols], len(types))
        found, pairs = marginals(lines, emission, trans, want=True)
        gap = np.bincount(flat, target - np.concatenate(found), len(types))
        scale = 100.0 / len(flat)
        grads = [np.bincount(cols, gap[rows], BUCKETS) * scale - L2 * weights, gap.sum() * scale, (seen - pairs) * scale]
        new = []
        for value, g, m in zip((weights, bias, trans), grads, moments):
            m[0], m[1] = 0.8 * m[0] + 0.2 * g, 0.99 * m[1] + 0.01 * g * g
            new.append(value + RATE * (m[0] / (1 - 0.8**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6))
        weights, bias, trans = new
    model.weights, model.bias, model.trans = weights.astype(np.float32), float(bias), trans
    x = np.array([e for e, _ in evidences(model, texts)])
    model.known.clear()
    model.a, model.b = _logistic(x, y)
    return model


def _logistic(x, y) -> tuple[float, float]:
    import numpy as np

    a, b, n = 1.0, 0.0, len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * x * x).sum() + 1e-3 * n, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6 * n]])
        step = np.linalg.solve(h, np.array([((y - p) * x).sum() - 1e-3 * n * a, (y - p).sum()]))
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, b


def _learn(model: Field, words: set) -> None:
    """Adds the emissions of words to model.known, whose values stand under ''."""
    import numpy as np

    known = model.known
    if "" not in known:
        known[""] = np.zeros(0)
    new = [w for w in words if w not in known]
    if not new:
        return
    codes = [_coded(features(w)) for w in new]
    sizes = np.array([len(c) for c in codes])
    flat = np.array([c for x in codes for c in x], np.int64) % BUCKETS
    values = np.bincount(np.repeat(np.arange(len(new)), sizes), model.weights[flat].astype(float), len(new)) + model.bias
    first = len(known[""])
    known[""] = np.concatenate((known[""], values))
    known.update(zip(new, range(first, first + len(new))))


def evidence(model: Field, text: str) -> tuple[float, list]:
    """log(1 + expected toxic evidence) of a text, and (line, token, marginal) of tokens that are toxic more likely than not."""
    return evidences(model, [text])[0]


def evidences(model: Field, texts: list[str]) -> list[tuple[float, list]]:
    import numpy as np

    split, owner = [], []
    for k, text in enumerate(texts):
        for j, line in enumerate(text.split("\n")):
            if words := line.split():
                split.append(words)
                owner.append((k, j))
    if not split:
        return [(0.0, [])] * len(texts)
    if len(model.known) > 600_000:
        model.known.clear()  # of the words seen so far, no more are held
    _learn(model, {w for words in split for w in words})
    known = model.known
    lines = [np.array([known[w] for w in words]) for words in split]
    found, _ = marginals(lines, known[""], model.trans)
    sums, spans = np.zeros(len(texts)), [[] for _ in texts]
    for (k, j), m in zip(owner, found):
        sums[k] -= np.log1p(-np.minimum(m, 1 - 1e-9)).sum()
        if m.max() >= 0.5:
            spans[k] += [(j, int(i), float(m[i])) for i in np.nonzero(m >= 0.5)[0]]
    return [(float(np.log1p(x)), s) for x, s in zip(sums, spans)]


def offsets(text: str, hits: list) -> list[dict]:
    """Character offsets of the tokens of hits."""
    starts, at = [], 0
    wanted: dict[int, set] = {}
    for j, i, _ in hits:
        wanted.setdefault(j, set()).add(i)
    for line in text.split("\n"):
        starts.append(at)
        at += len(line) + 1
    lines = text.split("\n")
    return [{"start": starts[j] + m.start(), "end": starts[j] + m.end()} for j in sorted(wanted) for i, m in enumerate(re.finditer(r"\S+", lines[j])) if i in wanted[j]]


def training(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded sample: texts and labels of training rows."""
    known = labels.filter("toxic is not null").select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).filter(id_crc(F.col("l_id")) % FOLDS != HELD_OUT).distinct()
    first = F.md5(F.col("l_id").cast("string").cast("binary"))
    # twice as many as needed, as some have no document or a very long one
    picked = [known.filter(F.col("toxic") == k).orderBy(first).limit(2 * n) for k, n in ((1, TOXIC_DOCS), (0, OTHER_DOCS))]
    ids = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).filter(F.length("text") <= MAX_CHARS).groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("r")).select("doc_id", "r.*")
    got = rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).toArrow()
    texts, labels_ = got.column("text").to_pylist(), got.column("toxic").to_pylist()
    kept, left = [], {1: TOXIC_DOCS, 0: OTHER_DOCS}
    for t, y in zip(texts, labels_):
        if left.get(y, 0) > 0:
            left[y] -= 1
            kept.append((t, y))
    return [t for t, _ in kept], [y for _, y in kept]


SCORED = "doc_id long, held_out boolean, score double, predicted int, n_spans int, spans array<struct<start:int,end:int>>"


def tagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans and spans of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(*training(docs, labels)))

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in parts:
            step = 500
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in part.column(1)]
                found = evidences(model, texts)
                x = np.array([e for e, _ in found])
                score = 1 / (1 + np.exp(-np.clip(model.a * x + model.b, -40, 40)))
                spans = [offsets(t, hits) for t, (_, hits) in zip(texts, found)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, kind)],
                    ["doc_id", "held_out", "score", "predicted", "n_spans", "spans"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (id_crc(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(batches, SCORED)


def op5_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
