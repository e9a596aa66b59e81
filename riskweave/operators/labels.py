"""Rule-based labels with confidences, first match first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.expressions import number
from riskweave.operators.joins import best_in_window, dated_hit


def _on(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n), F.lit(0)) == 1 for n in names]


def signal_label(df: DataFrame) -> DataFrame:
    """2 if exploited, 1 if certified or mapped to a technique, else 0."""
    kev, chpl, attack = _on("kev_flag", "chpl_flag", "attack_flag")
    return df.withColumn("signal_label", F.when(kev, 2).when(chpl | attack, 1).otherwise(0).cast("bigint"))


def level_label(df: DataFrame) -> DataFrame:
    """0 to 5 by severity, exploit score and sector signals."""
    curated, kev, health, chpl, attack = _on("is_curated", "kev_flag", "is_healthcare", "chpl_flag", "attack_flag")
    epss, cvss = number("epss_score"), number("cvss")
    rules = [
        (5, (curated & kev & (epss > 0.5) & health & chpl) | (curated & kev & health & attack & (epss > 0.4))),
        (4, (curated & kev) | ((epss > 0.5) & health & chpl) | (attack & kev & health) | (curated & (epss > 0.5) & chpl) | ((epss > 0.5) & health)),
        (3, kev | curated | ((epss > 0.3) & health) | ((cvss >= 9) & health) | (chpl & health & attack) | (epss > 0.6)),
        (2, health | chpl | (epss > 0.1) | (cvss >= 7)),
        (1, (cvss >= 5) | (epss > 0.01)),
    ]
    label = F.when(rules[0][1], rules[0][0])
    for value, test in rules[1:]:
        label = label.when(test, value)
    return df.withColumn("level", label.otherwise(0).cast("bigint"))


def weak_label(df: DataFrame) -> DataFrame:
    """soft_label 0 to 3, confidence and source of the deciding signal."""
    kev, health, chpl, mapped = _on("kev_flag", "is_healthcare", "chpl_flag", "has_attack")
    epss, pct, count = number("epss_score"), number("epss_percentile"), number("attack_technique_count")
    cvss, recency = number("cvss_norm", 0.5), number("recency", 0.5)
    high = (epss >= 0.5) | (pct >= 0.9)
    medium = ((epss >= 0.1) & (epss < 0.5)) | ((pct >= 0.7) & (pct < 0.9))
    technique = (count >= 1) | mapped
    recent = (cvss >= 0.7) & (recency >= 0.4)
    rules = [(kev & (health | chpl), 3, "kev_healthcare"), (kev, 2, "kev_only"), (high & technique, 2, "epss_attack"), (medium, 1, "medium_epss"), (count >= 1, 1, "attack_mapping"), (recent, 1, "cvss_recency")]
    label, source = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, value, name in rules[1:]:
        label, source = label.when(test, value), source.when(test, name)
    source = source.otherwise("none")
    c = F.when(kev, 1.0).otherwise(0.2)
    c = F.when(high & ~kev, F.greatest(c, F.lit(0.75))).otherwise(c)
    c = F.when(medium & ~kev & ~high, F.greatest(c, F.lit(0.55))).otherwise(c)
    c = F.when(technique, F.least(c + 0.10, F.lit(1.0))).otherwise(c)
    c = F.when(health | chpl, F.least(c + 0.10, F.lit(1.0))).otherwise(c)
    c = F.greatest(F.when(source == "cvss_recency", F.least(c, F.lit(0.40))).otherwise(c), F.lit(0.1))
    return df.withColumns({"soft_label": label.otherwise(0).cast("bigint"), "confidence": F.round(c, 6), "label_source": source})


def forward_label(df: DataFrame, history: DataFrame, events: DataFrame, days: int = 30, key: str = "cve_id") -> DataFrame:
    """Label 0 to 3, confidence and source from what happens within ``days`` of publication: exploitation, exploit scores, else severity."""
    best = best_in_window(df, history, days, key)
    out = dated_hit(df, events, days, key).join(best, key, "left")
    cvss = number("cvss", None)
    rules = [
        (F.col("published").isNull(), 0, 0.20, "default"),
        (F.col("within") == 1, 3, 1.0, "kev_within_horizon"),
        (F.col("prior") == 1, 3, 1.0, "kev_prior"),
        (F.col("best") >= 0.5, 2, 0.80, "epss_high_horizon"),
        (F.col("best") >= 0.1, 1, 0.60, "epss_medium_horizon"),
        (cvss >= 9, 1, 0.40, "cvss_critical"),
        (cvss >= 7, 1, 0.35, "cvss_high"),
    ]
    chosen = F.lit(None)
    for test, label, confidence, source in reversed(rules):
        value = F.struct(F.lit(label).cast("bigint").alias("label"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))
        chosen = F.when(test, value).otherwise(chosen if source != "cvss_high" else F.struct(F.lit(0).cast("bigint").alias("label"), F.lit(0.25).alias("confidence"), F.lit("default").alias("source")))
    return out.withColumn("_x", chosen).withColumns({"temporal_label": F.col("_x.label"), "temporal_confidence": F.col("_x.confidence"), "temporal_source": F.col("_x.source")}).drop("_x", "within", "prior", "later", "best")


def curated_label(df: DataFrame, confidence: str = "curated_confidence") -> DataFrame:
    """0 to 5 by severity and confidence of the curated list and exploitation; 0 outside of it."""
    severity, sure = F.lower(F.col("curated_severity")), F.lower(F.col(confidence)) == "high"
    exploited = F.coalesce(F.col("kev_flag"), F.lit(0)) == 1
    label = (
        F.when(severity.isNull(), 0)
        .when((severity == "critical") & sure & exploited, 5)
        .when((severity == "critical") & sure, 4)
        .when(((severity == "high") & exploited) | (severity == "critical"), 3)
        .otherwise(2)
    )
    return df.withColumn("curated_label", label.cast("bigint"))


def label_slices(df: DataFrame, label: str = "soft_label") -> DataFrame:
    """One row: sure positives, unsure rows, rows with any signal."""
    signal = (F.col("kev_flag") == 1) | (F.col("attack_technique_count") > 0) | (F.col("epss_score") > 0)
    return df.agg(F.count_if((F.col(label) >= 2) & (F.col("confidence") > 0.8)).alias("sure_positive"), F.count_if(F.col("confidence") < 0.4).alias("unsure"), F.count_if(signal).alias("any_signal"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.stddev_samp("confidence"), 6).alias("std_confidence"), F.median("confidence").alias("median_confidence"))
