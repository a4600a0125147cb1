"""Expected-loss scoring as column expressions: exploitability, impact, reachability, blast, confidence and what follows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scoring model.
MODEL = {
    "model_version": "2.0.0",
    "exploitability": {
        "kev_probability": 0.99, "exploit_evidence_default": 0.0, "epss_floor": 0.0, "cvss_prior_ceiling": 0.85, "use_ml_model": True,
        "av_weight": {"network": 0.85, "adjacent": 0.62, "local": 0.55, "physical": 0.2},
        "pr_weight": {"none": 0.85, "low": 0.62, "high": 0.27},
        "ui_weight": {"none": 0.85, "required": 0.62},
    },
    "impact": {"cia_magnitude": {"high": 1.0, "low": 0.5, "none": 0.0}, "weights": {"confidentiality": 0.3334, "integrity": 0.3333, "availability": 0.3333}},
    "reachability": {"hop_decay_lambda": 0.5, "max_call_hops": 10, "resolution_confidence_numeric": {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}, "taint_boost": 0.15, "transitive_estimate": 0.15, "no_path_prior": 0.05},
    "blast": {"beta": 0.5, "saturation_rate": 0.5},
    "asset": {"default_criticality": 1.0},
    "confidence": {"weight_has_epss": 1.0, "weight_missing_epss": 0.7, "weight_has_path": 1.0, "weight_no_path": 0.6},
    "thresholds": {"BLOCK": 70, "REVIEW": 40, "reachable_review_min_cvss": 4.0},
}


def lookup(values: dict[str, float], key: Column, default: float | None = None) -> Column:
    """values[key], as one CASE expression; default where there is none."""
    chain = reduce(lambda c, kv: c.when(key == kv[0], F.lit(float(kv[1]))), values.items(), F.when(F.lit(False), F.lit(0.0)))
    return chain.otherwise(F.lit(default) if default is None else F.lit(float(default)))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def cvss_prior(av: Column, pr: Column, ui_required: Column, cvss: Column, model: dict = MODEL) -> Column:
    cfg = model["exploitability"]
    a, p, u = cfg["av_weight"], cfg["pr_weight"], cfg["ui_weight"]
    best = a["network"] * p["none"] * u["none"]
    weight = lookup(a, F.coalesce(av, F.lit("network")), a["network"]) * lookup(p, F.coalesce(pr, F.lit("none")), p["none"])
    weight = weight * F.when(F.coalesce(ui_required, F.lit(False)), F.lit(u["required"])).otherwise(F.lit(u["none"]))
    by_vector = clamp(weight / F.lit(best)) * F.lit(cfg["cvss_prior_ceiling"])
    return F.when(av.isNotNull() | pr.isNotNull(), by_vector).otherwise(clamp(F.coalesce(cvss, F.lit(0.0)) / F.lit(10.0)) * F.lit(cfg["cvss_prior_ceiling"]))


def exploitability(epss: Column, in_kev: Column, prior: Column, learnt: Column | None = None, model: dict = MODEL) -> Column:
    """Noisy-OR of independent signals."""
    cfg = model["exploitability"]
    kev = F.when(in_kev, F.lit(cfg["kev_probability"])).otherwise(F.lit(0.0))
    signals = [F.greatest(F.lit(cfg["epss_floor"]), epss), kev, F.lit(cfg["exploit_evidence_default"]), prior, learnt if learnt is not None else F.lit(0.0)]
    return clamp(F.lit(1.0) - reduce(lambda a, b: a * b, [F.lit(1.0) - s for s in signals]))


def impact(confidentiality: Column, integrity: Column, availability: Column, cvss: Column, model: dict = MODEL) -> Column:
    cfg = model["impact"]
    parts = {"confidentiality": confidentiality, "integrity": integrity, "availability": availability}
    weighed = reduce(lambda a, b: a + b, [F.lit(cfg["weights"][k]) * lookup(cfg["cia_magnitude"], F.coalesce(c, F.lit("none")), 0.0) for k, c in parts.items()])
    return F.when(F.coalesce(confidentiality, integrity, availability).isNotNull(), clamp(weighed)).otherwise(clamp(F.coalesce(cvss, F.lit(0.0)) / F.lit(10.0)))


def path_value(hops: Column, confidence: Column, model: dict = MODEL) -> tuple[Column, Column]:
    """(resolution confidence, its product with the decay by hops) of a row of evidence, before taint."""
    cfg = model["reachability"]
    level = lookup(cfg["resolution_confidence_numeric"], F.upper(F.coalesce(confidence, F.lit("HIGH"))), cfg["resolution_confidence_numeric"]["HIGH"])
    return level, level * F.exp(-F.lit(cfg["hop_decay_lambda"]) * (F.greatest(F.lit(1), F.coalesce(hops, F.lit(1))) - 1))


def evidence_by_cve(reach: DataFrame, model: dict = MODEL) -> DataFrame:
    """One row a CVE: rows, best path value, best confidence, whether any path is tainted."""
    level, value = path_value(F.col("hops"), F.col("confidence"), model)
    return reach.groupBy("cve_id").agg(F.count(F.lit(1)).alias("n_paths"), F.max(value).alias("best_path"), F.max(level).alias("best_level"), F.bool_or("tainted").alias("any_taint"))


def blast_by_cve(exposed: DataFrame) -> DataFrame:
    return exposed.groupBy("cve_id").agg(F.count_distinct("service").alias("impacted_services"))


def score(findings: DataFrame, epss: DataFrame, kev: DataFrame, reach: DataFrame, exposed: DataFrame, model: dict = MODEL, centrality: DataFrame | None = None) -> DataFrame:
    """The expected-loss assessment of each CVE: factors, points, recommendation with the reachability floor.

    findings come one row a CVE (see first_by_cve); EPSS and KEV are joined by the id as it is.
    """
    r, c, t = model["reachability"], model["confidence"], model["thresholds"]
    rows = findings.join(epss, "cve_id", "left").join(kev.select("cve_id", F.lit(True).alias("in_kev")).distinct(), "cve_id", "left")
    rows = rows.join(evidence_by_cve(reach, model), "cve_id", "left").join(blast_by_cve(exposed), "cve_id", "left")
    rows = rows.join(centrality.select("cve_id", "centrality"), "cve_id", "left") if centrality is not None else rows.withColumn("centrality", F.lit(0.0))
    has_path, services = F.col("n_paths").isNotNull(), F.coalesce("impacted_services", F.lit(0))
    taint = F.when(F.col("any_taint"), F.lit(1.0 + r["taint_boost"])).otherwise(F.lit(1.0))
    package = F.coalesce("package", F.lit("")) != ""
    reached = F.when(has_path, clamp(F.col("best_path") * taint)).when(services > 0, F.lit(r["transitive_estimate"])).when(package, F.lit(r["no_path_prior"])).otherwise(F.lit(0.0))
    kind = F.when(has_path, "direct").when((services > 0) | package, "transitive").otherwise("none")
    low = r["resolution_confidence_numeric"]["LOW"]
    known = rows.withColumns({"epss_value": F.coalesce("epss", F.lit(0.0)), "in_kev": F.coalesce("in_kev", F.lit(False))})
    known = known.withColumn("E", exploitability(F.col("epss_value"), F.col("in_kev"), cvss_prior(F.col("attack_vector"), F.col("privileges_required"), F.col("user_interaction"), F.col("cvss_score"), model), learnt(rows, model), model))
    known = known.withColumn("I", impact(F.col("confidentiality"), F.col("integrity"), F.col("availability"), F.col("cvss_score"), model)).withColumn("R", reached).withColumn("kind", kind)
    saturation = F.greatest(F.lit(1.0) - F.exp(-F.lit(model["blast"]["saturation_rate"]) * services), clamp(F.coalesce("centrality", F.lit(0.0))))
    known = known.withColumn("S", saturation).withColumn("B", F.lit(1.0) + F.lit(model["blast"]["beta"]) * F.col("S"))
    phi = F.pow(
        F.when(F.col("epss_value") > 0, F.lit(c["weight_has_epss"])).otherwise(F.lit(c["weight_missing_epss"])) * F.when(has_path, F.lit(c["weight_has_path"])).otherwise(F.lit(c["weight_no_path"])) * F.when(has_path, F.col("best_level")).otherwise(F.lit(low)),
        F.lit(1.0 / 3.0),
    )
    known = known.withColumn("phi", clamp(phi)).withColumn("RE", F.col("phi") * F.col("R") + (F.lit(1.0) - F.col("phi")) * F.lit(r["no_path_prior"]))
    known = known.withColumn("loss", F.col("E") * F.col("I") * F.col("RE")).withColumn("unit", clamp(F.col("loss") * F.lit(model["asset"]["default_criticality"]) * F.col("B")))
    known = known.withColumn("raw_risk", F.rint(F.col("unit") * 100).cast("int"))
    plain = recommendation(F.col("raw_risk"), model)
    floored = F.when((plain == "PROCEED") & has_path & (F.coalesce("cvss_score", F.lit(0.0)) >= t["reachable_review_min_cvss"]), "REVIEW").otherwise(plain)
    top = F.greatest("E", "I", "RE")
    dominant = F.when(F.col("E") == top, "exploitability").when(F.col("I") == top, "impact").otherwise("reachability")
    points = {"severity_score": F.col("I") * 40, "exploit_score": F.col("E") * 20, "reachability_score": F.col("RE") * 25, "blast_radius_score": F.col("S") * 15}
    shown = {"exploitability": "E", "impact": "I", "reachability": "R", "reachability_eff": "RE", "blast_factor": "B", "blast_normalized": "S", "expected_loss": "loss", "risk_unit": "unit"}
    return known.select(
        "cve_id", "package", "severity", "cvss_score", "raw_risk", *[F.rint(v).cast("int").alias(k) for k, v in points.items()], *[F.round(c_, 4).alias(k) for k, c_ in shown.items()],
        F.round("phi", 3).alias("confidence"), F.col("kind").alias("reachability_kind"), dominant.alias("dominant_factor"), floored.alias("recommendation"), "in_kev", F.col("epss_value").alias("epss"), services.alias("impacted_services"),
    )


def learnt(rows: DataFrame, model: dict = MODEL) -> Column | None:
    """The stored exploit model's signal from a finding's score, its EPSS value and percentile, and the number of its CWEs; none if the model is switched off."""
    if not model["exploitability"].get("use_ml_model", True):
        return None
    number = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in rows.columns else F.lit(0.0)
    kind = dict(rows.dtypes).get("cwe", "")
    cwes = F.greatest(F.size("cwe"), F.lit(0)) if kind.startswith("array") else F.when(F.coalesce(F.col("cwe"), F.lit("")) != "", 1).otherwise(0) if kind else F.lit(0)
    return exploit_probability(number("cvss_score"), number("epss"), number("percentile"), cwes)


def recommendation(raw_risk: Column, model: dict = MODEL) -> Column:
    t = model["thresholds"]
    return F.when(raw_risk >= t["BLOCK"], "BLOCK").when(raw_risk >= t["REVIEW"], "REVIEW").otherwise("PROCEED")


def severity_label(cvss: Column) -> Column:
    return F.when(cvss >= 9, "CRITICAL").when(cvss >= 7, "HIGH").when(cvss >= 4, "MODERATE").when(cvss > 0, "LOW").otherwise("UNKNOWN")


def factor_band(value: Column) -> Column:
    return F.when(value >= 0.66, "HIGH").when(value >= 0.33, "MODERATE").otherwise("LOW")


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).otherwise(F.exp(z) / (F.lit(1.0) + F.exp(z)))


#: The stored exploit model, over cvss, epss, epss_percentile, cwe_count, age_days_norm.
EXPLOIT_MODEL = {
    "means": [5.523222222222222, 0.137872, 0.41983244444444445, 1.5122222222222221, 0.48868819541728636],
    "scales": [2.5567089643514493, 0.10073819674118982, 0.14106371039995536, 1.1405970929276743, 0.28801823425743917],
    "weights": [0.8463764529989726, 0.3032069195710389, 0.02176221477662943, 0.36407798963245613, 0.014381905377966351],
    "bias": -1.2667112909688898,
}


def exploit_probability(cvss: Column, epss: Column, percentile: Column, cwe_count: Column, age_days: Column | None = None) -> Column:
    """The stored model's exploit probability; the age defaults to 30 days and counts up to ten years."""
    age = F.least(age_days if age_days is not None else F.lit(30.0), F.lit(3650.0)) / F.lit(3650.0)
    return learnt_probability([cvss, epss, percentile, cwe_count.cast("double"), age], **EXPLOIT_MODEL)


def learnt_probability(features: list[Column], means: list[float], scales: list[float], weights: list[float], bias: float) -> Column:
    """A stored logistic model's probability: z-scores, dot product, sigmoid."""
    z = reduce(lambda a, b: a + b, [F.lit(w) * ((x - F.lit(m)) / F.lit(s or 1.0)) for x, m, s, w in zip(features, means, scales, weights)], F.lit(bias))
    return sigmoid(z)
