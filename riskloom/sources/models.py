"""Small stored documents that become literals: scoring model, exploit model, traces."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scoring import EXPLOIT_MODEL, MODEL


def _text(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(path, wholetext=True).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return row[0] if row else None


def load_scoring_model(spark: SparkSession, path: str) -> dict:
    """The scoring model at a path; the fixed one where there is none or it lacks its first part."""
    try:
        doc = json.loads(_text(spark, path) or "")
    except ValueError:
        return MODEL
    return {**MODEL, **{k: {**MODEL[k], **v} if isinstance(v, dict) and k in MODEL else v for k, v in doc.items()}} if "exploitability" in doc else MODEL


def load_exploit_model(spark: SparkSession, path: str) -> dict:
    """means, scales, weights and bias of a stored model; the fixed ones where there is none."""
    try:
        return _exploit(_text(spark, path) or "")
    except (ValueError, KeyError):
        return EXPLOIT_MODEL


def ensure_exploit_model(spark: SparkSession, path: str, rows: int = 1200, epochs: int = 50) -> dict:
    """The stored model; where there is none, one is trained on the first three quarters of seeded records, stored and returned."""
    if (text := _text(spark, path)) is not None:
        try:
            return _exploit(text)
        except (ValueError, KeyError):
            pass
    from riskloom.operators import ml

    records = ml.synthetic(spark, rows, 42).filter(F.col("published_ordinal") < int(rows * 0.75))
    train = records.select(ml.features(*map(F.col, ("cvss", "epss", "percentile", "cwe_count", "age_days"))).alias("x"), "label")
    means, scales = ml.scale(train, 5)
    weights, bias = ml.fit(train.withColumn("x", ml.scaled(F.col("x"), means, scales)), 5, rate=0.5, epochs=epochs, l2=0.001)
    save_exploit_model(spark, path, means, scales, weights, bias)
    return {"means": means, "scales": scales, "weights": weights, "bias": bias}


def _exploit(text: str) -> dict:
    doc = json.loads(text)
    return {"means": doc["scaler"]["mean"], "scales": doc["scaler"]["std"], "weights": doc["clf"]["weights"], "bias": doc["clf"]["bias"]}


def save_exploit_model(spark: SparkSession, path: str, means: list[float], scales: list[float], weights: list[float], bias: float) -> None:
    doc = {"clf": {"bias": bias, "weights": weights}, "scaler": {"mean": means, "std": scales}}
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
