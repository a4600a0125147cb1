"""A logistic exploit model: scaling, full-batch gradient steps over a DataFrame, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import metrics as me


def features(cvss: Column, epss: Column, percentile: Column, cwe_count: Column, age_days: Column) -> Column:
    """The feature vector; ages count up to ten years."""
    return F.array(cvss, epss, percentile, cwe_count.cast("double"), F.least(age_days, F.lit(3650.0)) / F.lit(3650.0))


def _dot(x: Column, weights: list[float], bias: float) -> Column:
    z = F.lit(bias)
    for k, w in enumerate(weights):
        z = z + F.lit(w) * x[k]
    return z


def _sigmoid(z: Column) -> Column:
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).otherwise(F.exp(z) / (F.lit(1.0) + F.exp(z)))


def scale(rows: DataFrame, width: int) -> tuple[list[float], list[float]]:
    """Means and population standard deviations (1 where 0) of the elements of x."""
    one = rows.agg(*[f for k in range(width) for f in (F.avg(F.col("x")[k]), F.stddev_pop(F.col("x")[k]))]).first()
    return [one[2 * k] or 0.0 for k in range(width)], [one[2 * k + 1] or 1.0 for k in range(width)]


def scaled(x: Column, means: list[float], stds: list[float]) -> Column:
    return F.array(*[(x[k] - F.lit(m)) / F.lit(s) for k, (m, s) in enumerate(zip(means, stds))])


def fit(rows: DataFrame, width: int, rate: float = 0.1, epochs: int = 50, l2: float = 0.0) -> tuple[list[float], float]:
    """Weights and bias by gradient steps over all rows (x, label); one aggregation an epoch, L2 on weights only."""
    rows, weights, bias = rows.select("x", F.col("label").cast("double").alias("label")).cache(), [0.0] * width, 0.0
    for _ in range(epochs):
        gap = _sigmoid(_dot(F.col("x"), weights, bias)) - F.col("label")
        g = rows.agg(*[F.avg(gap * F.col("x")[k]) for k in range(width)], F.avg(gap)).first()
        weights = [w - rate * ((g[k] or 0.0) + l2 * w) for k, w in enumerate(weights)]
        bias -= rate * (g[width] or 0.0)
    rows.unpersist()
    return weights, bias


def predict(rows: DataFrame, weights: list[float], bias: float) -> DataFrame:
    p = _sigmoid(_dot(F.col("x"), weights, bias))
    return rows.withColumn("y_prob", p).withColumn("y_pred", p >= 0.5)


def evaluate(predicted: DataFrame) -> DataFrame:
    """Confusion rates with the Brier score, that of the base rate, and the calibration error over ten bins; one row."""
    rows = predicted.withColumn("y_true", F.col("label") == 1)
    base = rows.agg(F.avg(F.col("y_true").cast("double")).alias("base"))
    extra = base.select(F.round(F.col("base") * (1 - F.col("base")), 4).alias("brier_baseline"))
    return me.rates(me.confusion(rows)).join(me.brier(rows)).join(me.calibration_error(me.bins(rows, 10))).join(extra)  # single rows


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Seeded records whose label depends on cvss, epss and the number of weaknesses."""
    r = spark.range(n).select(
        F.col("id"), (F.rand(seed) * 10).alias("cvss"), F.pow(F.rand(seed + 1), 3).alias("epss"), F.rand(seed + 2).alias("percentile"), (F.floor(F.rand(seed + 3) * 4) + 1).alias("cwe_count"),
        (F.rand(seed + 4) * 3650).alias("age_days"), F.rand(seed + 5).alias("u"),
    )
    z = F.lit(-5.0) + 0.6 * F.col("cvss") + 3.0 * F.col("epss") + 0.3 * F.col("cwe_count")
    return r.withColumn("label", (F.col("u") < _sigmoid(z)).cast("int")).withColumn("published_ordinal", F.col("id")).drop("u")
