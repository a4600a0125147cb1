"""Quality scores by positive-unlabelled learning.

Trusted positives are the training rows that labels.quality marks 1; unlabelled are texts of documents, whatever their
labels. The share of positives among the unlabelled, the class prior, is estimated first: a classifier of positives
against unlabelled ranks both, and the prior is the least ratio, over all thresholds, of the unlabelled share below the
threshold's mirror to the positive one, with a slack for the sample's size. Then a logistic model is fitted by
minimising the non-negative unbiased risk
    prior * R(positives, 1) + max(0, R(unlabelled, 0) - prior * R(positives, 0)),
whose second part can't fall below zero; where a step would take it there, the gradient is turned back.
Negative labels are never used.

Features of a text are shares that need no vocabulary: symbols, capitals, repeated windows, repeated neighbours, distinct
words, digits, punctuation, word and line lengths, and so on, with their squares.

The model is fitted on a bounded sample: at most 12,000 positives and 12,000 unlabelled rows, the first by the MD5 of
their ids; of rows that repeat an id the one of the least features counts. Every document is scored whole.

Defined cases: null and empty texts have all features zero and get the model's score of that; repeated rows are scored
alike; without positives all scores are 0; null labels are no positives; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import documents, id_crc, table

FOLDS, HELD_OUT, CUT = 5, 0, 0.3
POSITIVES, UNLABELLED = 12_000, 12_000
STEPS, RATE, L2 = 400, 0.05, 1e-4
NAMES = ("symbols", "pipes", "capitals", "upper_words", "bangs", "repeated", "neighbours", "distinct", "digits", "marks", "word_length", "long_words", "dup_lines", "line_words", "words", "alpha", "one_letter", "top_word", "stop_ends", "non_ascii")
_UPPER, _DIGITS, _MARKS, _SYMBOLS = bytes(range(65, 91)), b"0123456789", b".,;:!?\"'()-", b"#*$%&<>~^=+_{}[]\\/@"
_ALPHA = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])


def features(text: bytes | None) -> list[float]:
    """The features of a text in UTF-8, in the order of NAMES, each about 0 to 1."""
    from collections import Counter
    from math import log1p

    words = (text or b"").split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    joined = b"".join(words)
    size = len(joined)
    count = lambda chars: size - len(joined.translate(None, chars))
    counts = Counter(words)
    windows = list(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        min(count(_SYMBOLS) / n, 3.0) / 3, min(joined.count(b"|") / n, 1.0), count(_UPPER) / size, sum(1 for w in words if len(w) > 2 and w.isupper()) / n, min(joined.count(b"!!") / n, 1.0),
        1 - len(set(windows)) / len(windows) if windows else 0.0, sum(1 for a, b in zip(words, words[1:]) if a == b) / n, len(counts) / n, count(_DIGITS) / size, min(count(_MARKS) / n, 2.0) / 2,
        min(size / n, 20.0) / 20, sum(1 for w in words if len(w) > 14) / n, 1 - len(set(lines)) / len(lines), log1p(n / len(lines)) / 8, log1p(n) / 12,
        count(_ALPHA) / size, sum(1 for w in words if len(w) == 1) / n, counts.most_common(1)[0][1] / n, sum(1 for x in lines if x.rstrip()[-1:] in b".!?") / len(lines), sum(1 for w in words if not w.isascii()) / n,
    ]


def _matrix(rows):
    """Features with their squares and a constant."""
    import numpy as np

    x = np.asarray(rows, float).reshape(-1, len(NAMES))
    return np.hstack([x, x * x, np.ones((len(x), 1))])


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    def __init__(self, weights, mean, scale, prior: float):
        self.weights, self.mean, self.scale, self.prior = weights, mean, scale, prior

    def score(self, rows):
        return _sigmoid(((_matrix(rows) - self.mean) / self.scale) @ self.weights)


def _descend(gradient, size: int):
    """Adam from zero."""
    import numpy as np

    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        g = gradient(w) + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def class_prior(p, u) -> float:
    """The share of positives among the unlabelled, from the scores of either under a classifier of the two.

    Above a high threshold the unlabelled are positives alone, so the share of unlabelled above it over that of positives
    tends to the prior from above; the least ratio is taken, each share with a slack for the sample's size.
    """
    import numpy as np

    p, u = np.sort(p), np.sort(u)
    at = np.quantile(p, np.linspace(0.0, 0.9, 91))
    over_p, over_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = int(np.argmin((over_u + slack) / over_p))
    return float(min(0.99, max(0.05, over_u[best] / over_p[best])))


def fit(positive, unlabelled) -> Model | None:
    """positive, unlabelled: rows of features."""
    import numpy as np

    p, u = _matrix(positive), _matrix(unlabelled)
    if not len(p) or not len(u):
        return None
    mean, scale = np.vstack([p, u]).mean(0), np.vstack([p, u]).std(0) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    p, u = (p - mean) / scale, (u - mean) / scale
    w = _descend(lambda w: ((_sigmoid(p @ w) - 1) @ p) / len(p) + (_sigmoid(u @ w) @ u) / len(u), p.shape[1])
    prior = class_prior(p @ w, u @ w)

    def gradient(w):
        zp, zu = p @ w, u @ w
        positive_part = prior * ((_sigmoid(zp) - 1) @ p) / len(p)
        negative_part = (_sigmoid(zu) @ u) / len(u) - prior * (_sigmoid(zp) @ p) / len(p)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return positive_part + negative_part if risk >= 0 else -negative_part

    return Model(_descend(gradient, p.shape[1]), mean, scale, prior)


def _featured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and x, the features, of each row."""

    def batches(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (id_crc(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, x array<double>")


def training(docs: DataFrame, labels: DataFrame) -> tuple[list, list]:
    """The features of the bounded sample's positives and unlabelled rows."""
    first = F.md5(F.col("s_id").cast("string").cast("binary"))
    positive = labels.filter("quality = 1").select(F.col("doc_id").alias("s_id")).filter(id_crc(F.col("s_id")) % FOLDS != HELD_OUT).distinct().orderBy(first).limit(POSITIVES)
    some = docs.select(F.col("doc_id").alias("s_id")).filter("s_id is not null").distinct().orderBy(F.desc(first)).limit(UNLABELLED)

    def of(ids: DataFrame) -> list:
        # 12,000 ids at most, and one row of each
        got = _featured(docs.join(F.broadcast(ids), F.col("doc_id") == F.col("s_id"), "left_semi")).groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow()
        return got.column("x").to_pylist()

    return of(positive), of(some)


def op4_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(*training(docs, labels)))

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = shared.value
        for batch in parts:
            rows = [features(t.as_py()) for t in batch.column(1)]
            score = model.score(rows) if model and rows else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (id_crc(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")


def op4_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
