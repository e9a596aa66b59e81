"""Feature builders. Each returns the input with columns added, by expressions of one pass; fitted parameters are broadcast rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import vocabulary as V
from riskweave.functions.expressions import contains_any, days_between, flag, number, sunday_week
from riskweave.operators.filters import one_row
from riskweave.operators.joins import checked

#: Letters and weights of the parts of a severity vector.
# fixed values: codes, levels and weights of the vector's parts
ORDINALS = {
    "cvss_av": ("AV", {"N": 4, "A": 3, "L": 2, "P": 1}, 0.2),
    "cvss_ac": ("AC", {"L": 2, "H": 1}, 0.1),
    "cvss_pr": ("PR", {"N": 3, "L": 2, "H": 1}, 0.15),
    "cvss_ui": ("UI", {"N": 2, "R": 1}, 0.05),
    "cvss_s": ("S", {"C": 2, "U": 1}, 0.0),
    "cvss_c": ("C", {"H": 3, "L": 2, "N": 1}, 0.2),
    "cvss_i": ("I", {"H": 3, "L": 2, "N": 1}, 0.15),
    "cvss_a": ("A", {"H": 3, "L": 2, "N": 1}, 0.15),
}


def vector_features(df: DataFrame, compat: bool = False) -> DataFrame:
    """Eight ordinals of the vector, a weighted score and a category. ``compat`` finds ``C:H`` in ``AC:H`` too, as substring tests do."""
    vector = F.coalesce("cvss_vector", F.lit(""))

    def ordinal(code: str, values: dict[str, int]) -> Column:
        found = F.lit(0)
        for letter, value in reversed(values.items()):
            token = f"{code}:{letter}"
            has = vector.contains(token) if compat else F.concat(F.lit("/"), vector, F.lit("/")).contains(f"/{token}/")
            found = F.when(has, F.lit(value)).otherwise(found)
        return found.cast("double")

    out = df.withColumns({name: ordinal(code, values) for name, (code, values, _) in ORDINALS.items()})
    impact = F.col("cvss_c") + F.col("cvss_i") + F.col("cvss_a")
    score = sum((F.col(name) * weight for name, (_, _, weight) in ORDINALS.items() if weight), F.lit(0.0))
    category = F.when(impact >= 8, 4).when(impact >= 6, 3).when(impact >= 4, 2).when(impact > 0, 1).otherwise(0)
    return out.withColumns({"cvss_derived_score": F.round(score, 6), "cvss_severity_category": category.cast("double")})


def weakness_features(df: DataFrame) -> DataFrame:
    """Eight features of the weakness list; categories have fixed codes by their place in the vocabulary, 0 without one."""
    ids = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce("cwe", F.lit(""))), F.lit(r"(CWE-\d+)"), 1))
    has = lambda names: F.arrays_overlap(ids, F.array(*map(F.lit, names)))
    category = F.lit(0)
    for code, names in reversed(list(enumerate(V.CWE_GROUPS.values(), 1))):
        category = F.when(has(names), F.lit(code)).otherwise(category)
    known = sorted({c for names in V.CWE_GROUPS.values() for c in names})
    severity = F.when(F.size(ids) == 0, 0.0).when(has(V.CWE_TOP_25), 3.0).when(has(known), 2.0).otherwise(1.0)
    flags = {"cwe_is_top25": V.CWE_TOP_25} | {f"cwe_is_{n}": V.CWE_GROUPS[g] for n, g in (("injection", "injection"), ("crypto", "crypto"), ("access_control", "access_control"), ("input_validation", "input_validation"), ("memory_corruption", "memory"))}
    return df.withColumns({n: flag(has(names)).cast("double") for n, names in flags.items()} | {"cwe_category": category.cast("double"), "cwe_severity_score": severity})


def description_features(df: DataFrame) -> DataFrame:
    text = F.lower(F.coalesce("description", F.lit("")))
    return df.withColumns({name: flag(contains_any(text, terms)).cast("double") for name, terms in V.DESCRIPTION_FLAGS.items()})


def vendor_features(df: DataFrame) -> DataFrame:
    text = F.lower(F.coalesce("description", F.lit("")))
    out = df.withColumns({"vendor_is_high_risk": flag(contains_any(text, V.HIGH_RISK_VENDORS)).cast("double"), "vendor_is_healthcare": flag(contains_any(text, V.HEALTHCARE_VENDORS)).cast("double")})
    return out.withColumn("vendor_risk_score", (F.col("vendor_is_high_risk") * 2.0 + F.col("vendor_is_healthcare") * 1.5) / 3.5)


def interaction_features(df: DataFrame) -> DataFrame:
    """Six products of vector, text and sector features."""
    impact = F.col("cvss_c") + F.col("cvss_i") + F.col("cvss_a")
    strong = flag(impact >= 7).cast("double")
    network, open_access = flag(F.col("cvss_av") == 4).cast("double"), flag(F.col("cvss_pr") == 3).cast("double")
    return df.withColumns(
        {
            "ultimate_risk": network * open_access * impact / 3.0,
            "critical_exploitable": strong * F.col("desc_has_rce"),
            "network_accessible": network,
            "auth_not_required": open_access,
            "high_impact_network": network * strong,
            "healthcare_critical": number("is_healthcare") * strong,
        }
    )


# fixed values: names and order of the columns
ENHANCED = [
    *ORDINALS, "cvss_derived_score", "cvss_severity_category", "cwe_is_top25", "cwe_is_injection", "cwe_is_crypto", "cwe_is_access_control", "cwe_is_input_validation", "cwe_is_memory_corruption",
    "cwe_category", "cwe_severity_score", *V.DESCRIPTION_FLAGS, "vendor_is_high_risk", "vendor_is_healthcare", "vendor_risk_score",
    "ultimate_risk", "critical_exploitable", "network_accessible", "auth_not_required", "high_impact_network", "healthcare_critical",
]


def enhanced_features(df: DataFrame, compat: bool = False) -> DataFrame:
    """All features of vector, weakness, text, vendor and their products."""
    return interaction_features(vendor_features(description_features(weakness_features(vector_features(df, compat)))))


def recency_linear(published: Column, reference: date | str, days: int = 180) -> Column:
    """1 on the day of reference, 0 ``days`` before; above 1 for later dates; 0 without a date."""
    age = days_between(F.lit(str(reference)).cast("timestamp"), published)
    return F.coalesce(F.round(F.greatest(F.lit(0.0), 1 - age / F.lit(float(days))), 3), F.lit(0.0))


def record_features(df: DataFrame, reference: date | str) -> DataFrame:
    """Sixteen features with markers of missing values; ages count from the reference date, and the oldest record has recency 0."""
    age = F.greatest(F.lit(0), F.coalesce(days_between(F.lit(str(reference)).cast("timestamp"), F.col("published")), F.lit(0)))
    out = df.withColumns(
        {
            "cvss_missing": flag(F.col("cvss").isNull()),
            "epss_missing": flag(F.col("epss_score").isNull()),
            "cvss": number("cvss", 5.0),
            "epss_score": number("epss_score"),
            "epss_percentile": number("epss_percentile"),
            "has_attack": flag(F.col("attack_technique_count") > 0),
            "days_since_published": age,
            "published_week": sunday_week(F.col("published")),
        }
    )
    oldest = one_row(out, F.max("days_since_published").alias("_oldest"))
    recency = F.when(F.col("_oldest") > 0, 1 - F.col("days_since_published") / F.col("_oldest")).otherwise(1.0)
    out = out.join(oldest).withColumns({"cvss_norm": F.col("cvss") / 10.0, "recency": recency}).drop("_oldest")
    return out.withColumns({"kev_x_cvss": F.col("kev_flag") * F.col("cvss_norm"), "healthcare_x_epss": F.col("is_healthcare") * F.col("epss_score")})


def interactions(df: DataFrame) -> DataFrame:
    """df with the two products of the plain signals; the columns must be there."""
    return df.withColumns({"cvss_epss_product": F.col("cvss_norm") * F.col("epss_score"), "kev_healthcare_interaction": F.col("kev_flag") * F.col("is_healthcare")})


def common_columns(df: DataFrame, reference: date | str, categories: tuple[str, ...] = ("cvss_severity_category", "cwe_category", "curated_severity")) -> DataFrame:
    """df with the columns that all evaluations share: severity (5 where missing) and its share, recency against the oldest record, has_attack, categories as
    codes from 0 by sorted value (``nan`` where missing), and label and confidence with their defaults 0 and 0.2. Columns that the table lacks get the default, categories stay away."""
    have = set(df.columns)
    or_default = lambda c, v: number(c, v) if c in have else F.lit(float(v))
    age = F.greatest(F.lit(0), days_between(F.lit(str(reference)).cast("timestamp"), F.col("published")))
    out = df.withColumns({"cvss": or_default("cvss", 5.0), "_age": age})
    oldest = one_row(out, F.greatest(F.max("_age").cast("double"), F.lit(1.0)).alias("_oldest"))
    out = out.join(oldest).withColumns(
        {
            "cvss_norm": F.col("cvss") / 10.0,
            "recency_score": 1.0 - F.col("_age") / F.col("_oldest"),
            "has_attack": or_default("attack_flag", 0).cast("bigint"),
            "soft_label": or_default("soft_label", 0).cast("bigint"),
            "label_confidence": or_default("label_confidence", 0.2),
        }
    )
    for c in [c for c in categories if c in have]:
        from riskweave.operators.ranking import dense_codes

        named = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("nan")))
        out = named.join(checked(dense_codes(named.select(c), c)), c).withColumn(c, F.col("code") - 1).drop("code")
    return out.drop("_age", "_oldest")


# fixed values: names of the columns
PUBLICATION_TEXT = ["is_high_risk_vendor", "is_healthcare_vendor", "has_exploit_keywords_high", "has_exploit_keywords_med", "has_exploit_keywords_low", "exploit_keyword_count"]


def publication_features(df: DataFrame, reference: date | str, weakness_risk: DataFrame | None = None, vendor_risk: DataFrame | None = None) -> DataFrame:
    """Features known when a record is published. Risk tables are (cwe_id, rate) and (vendor, rate) of earlier records; the vendor table holds the listed vendors only."""
    spaced = lambda terms: "|".join(t.replace("-", r"\-").replace(" ", r"\s+") for t in terms)
    text = F.lower(F.coalesce("description", F.lit("")))
    digits = F.regexp_extract(F.coalesce("cwe", F.lit("")), r"CWE-(\d+)", 1)
    category = F.when(digits == "", "unknown")
    for name, numbers in V.PUBLICATION_GROUPS.items():
        category = category.when(digits.isin(numbers), name)
    score = number("cvss", 5.0)
    age = F.coalesce(days_between(F.lit(str(reference)).cast("timestamp"), F.col("published")), F.lit(0))
    count = F.coalesce(F.col("attack_technique_count").cast("bigint"), F.lit(0))
    health, certified = (F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("is_healthcare", "chpl_flag"))
    out = df.withColumns(
        {
            "cvss_norm": score / 10.0,
            "cvss_critical": flag(score >= 9),
            "cvss_high": flag(score >= 7),
            "cvss_medium": flag((score >= 4) & (score < 7)),
            "cvss_low": flag(score < 4),
            "cwe_id": F.when(digits == "", "UNKNOWN").otherwise(F.concat(F.lit("CWE-"), digits)),
            "cwe_top25": flag(F.concat(F.lit("CWE-"), digits).isin(V.CWE_TOP_25)),
            "cwe_group": category.otherwise("other"),
            "cwe_count": F.size(F.regexp_extract_all(F.coalesce("cwe", F.lit("")), F.lit(r"(CWE-\d+)"), 1)),
            "is_high_risk_vendor": flag(contains_any(text, V.PUBLICATION_HIGH_RISK)),
            "is_healthcare_vendor": flag(contains_any(text, V.PUBLICATION_HEALTHCARE)),
            "desc_length": F.length(F.coalesce("description", F.lit(""))),
            "desc_length_norm": F.least(F.lit(1.0), F.length(F.coalesce("description", F.lit(""))) / 500.0),
            "has_exploit_keywords_high": flag(text.rlike(spaced(V.KEYWORD_TIERS["high"]))),
            "has_exploit_keywords_med": flag(text.rlike(spaced(V.KEYWORD_TIERS["medium"]))),
            "has_exploit_keywords_low": flag(text.rlike(spaced(V.KEYWORD_TIERS["low"]))),
            "days_since_published": age,
            "recency_score": 1.0 / (1.0 + age / 365.0),
            "is_recent": flag(age <= 90),
            "healthcare_critical": flag((health == 1) & (score >= 9)),
            "chpl_critical": flag((certified == 1) & (score >= 9)),
            "has_attack": flag(count > 0),
            "attack_multi": flag(count > 1),
            "attack_healthcare": flag((count > 0) & (health == 1)),
        }
    )
    out = out.withColumn("exploit_keyword_count", F.col("has_exploit_keywords_high") * 2 + F.col("has_exploit_keywords_med") + F.col("has_exploit_keywords_low"))
    if weakness_risk is not None:
        out = out.join(weakness_risk.select("cwe_id", F.col("rate").alias("cwe_risk_score")), "cwe_id", "left")
    out = out.withColumn("cwe_risk_score", F.coalesce("cwe_risk_score", F.lit(0.0)) if weakness_risk is not None else F.lit(0.0))
    if vendor_risk is None:
        return out.withColumn("vendor_risk_score", F.lit(0.0))
    names = sorted({*V.PUBLICATION_HIGH_RISK, *V.PUBLICATION_HEALTHCARE})
    rates = F.broadcast(vendor_risk.where(F.col("vendor").isin(names)).agg(F.map_from_entries(F.collect_list(F.struct("vendor", "rate"))).alias("_rates")))  # the listed vendors
    matched = F.array(*[F.when(text.contains(v), F.col("_rates")[v]) for v in names])
    return out.join(rates).withColumn("vendor_risk_score", F.coalesce(F.array_max(matched), F.lit(0.0))).drop("_rates")


def listed_vendor(description: Column) -> Column:
    """First vendor, by name, of the publication vocabularies that the text holds."""
    text = F.lower(F.coalesce(description, F.lit("")))
    return F.coalesce(*[F.when(text.contains(v), F.lit(v)) for v in sorted({*V.PUBLICATION_HIGH_RISK, *V.PUBLICATION_HEALTHCARE})])


def historical_risk(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exploitation rates of earlier records: (vendor, rate) with 5 records or more, (cwe_id, rate) with 10 or more."""
    from riskweave.operators.aggregates import rate_by

    digits = F.regexp_extract(F.coalesce("cwe", F.lit("")), r"CWE-(\d+)", 1)
    named = history.select(listed_vendor(F.col("description")).alias("vendor"), F.when(digits == "", "UNKNOWN").otherwise(F.concat(F.lit("CWE-"), digits)).alias("cwe_id"), "kev_flag")
    return rate_by(named, "vendor", 5), rate_by(named, "cwe_id", 10)


def temporal_features(df: DataFrame, prediction: date | str) -> DataFrame:
    """Thirteen columns that use nothing from after publication."""
    raw = F.col("cvss")
    age = F.coalesce(days_between(F.lit(str(prediction)).cast("timestamp"), F.col("published")), F.lit(0))
    count, health = (F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("attack_technique_count", "is_healthcare"))
    return df.withColumns(
        {
            "cvss_norm": number("cvss", 5.0) / 10.0,
            "cvss_critical": flag(raw >= 9),
            "cvss_high": flag(raw >= 7),
            "cvss_medium": flag((raw >= 4) & (raw < 7)),
            "is_healthcare": health,
            "attack_technique_count": count,
            "has_attack": flag(count > 0),
            "attack_multi": flag(count > 1),
            "days_since_published": age,
            "recency_score": 1.0 / (1.0 + age / 365.0),
            "is_recent": flag(age <= 90),
            "healthcare_critical": flag((health == 1) & (raw >= 9)),
            "attack_healthcare": flag((count > 0) & (health == 1)),
        }
    )


def legacy_features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 23 columns of thresholds and pair products; days count from 2018-01-01. Columns to keep come along."""
    f = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    cvss, epss = number("cvss"), number("epss_score")
    age = F.coalesce(days_between(F.col("published"), F.lit("2018-01-01").cast("timestamp")), F.lit(0))
    both = lambda a, b: flag((a == 1) & (b == 1))
    return df.select(
        "cve_id",
        *keep,
        *[f(c).alias(c) for c in ("kev_flag", "is_healthcare", "is_curated", "chpl_flag", "attack_flag", "attack_technique_count")],
        epss.alias("epss_score"),
        number("epss_percentile").alias("epss_percentile"),
        cvss.alias("cvss"),
        flag(cvss >= 7).alias("cvss_high"),
        flag(cvss >= 9).alias("cvss_critical"),
        flag(epss >= 0.1).alias("epss_high"),
        flag((f("is_healthcare") == 1) & (cvss >= 9)).alias("healthcare_critical"),
        both(f("kev_flag"), f("is_healthcare")).alias("kev_healthcare"),
        both(f("chpl_flag"), f("is_healthcare")).alias("chpl_healthcare"),
        both(f("attack_flag"), f("is_healthcare")).alias("attack_healthcare"),
        flag(f("attack_technique_count") > 1).alias("attack_multi"),
        (f("is_healthcare") * cvss).alias("healthcare_x_cvss"),
        (f("kev_flag") * epss).alias("kev_x_epss"),
        (f("chpl_flag") * f("attack_flag")).alias("chpl_x_attack"),
        (f("attack_technique_count") * f("is_healthcare")).alias("attack_count_x_healthcare"),
        age.alias("days_since_2018"),
        flag(age > 2500).alias("is_recent"),
    )


PRUNED = ["kev_flag", "epss_score", "is_healthcare", "is_curated", "attack_technique_count", "cvss", "cvss_critical", "epss_high", "healthcare_critical", "kev_healthcare", "attack_multi", "attack_count_x_healthcare", "days_since_2018", "is_recent"]
PRUNED_SCALED = ["cvss", "epss_score", "attack_technique_count", "attack_count_x_healthcare", "days_since_2018"]


def pruned_features(df: DataFrame, fit_on: DataFrame) -> DataFrame:
    """Fourteen of the legacy columns; five of them scaled by mean and deviation of the training rows only."""
    from riskweave.operators.aggregates import scaled, scaling

    params = scaling(legacy_features(fit_on), PRUNED_SCALED)
    return scaled(legacy_features(df).select("cve_id", *PRUNED), params, PRUNED_SCALED)


def removal_features(df: DataFrame) -> DataFrame:
    """Features of the removal ablation: the legacy ones that it uses, with the normalised severity and its product with the exploit score."""
    base = legacy_features(df).withColumnRenamed("attack_flag", "has_attack")
    base = base.withColumn("cvss_norm", F.col("cvss") / 10.0).withColumn("cvss_epss_product", F.col("cvss_norm") * F.col("epss_score"))
    return base.select(
        "cve_id", "cvss", "cvss_norm", "kev_flag", "epss_score", "epss_percentile", "is_healthcare", "is_curated", "chpl_flag", "has_attack", "attack_technique_count",
        "cvss_high", "cvss_critical", "epss_high", "healthcare_critical", "kev_healthcare", "cvss_epss_product", "kev_x_epss", "days_since_2018", "is_recent",
    )


def baseline_features(df: DataFrame, reference: date | str, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """Signals of the first score: linear recency, severity share, membership in the exploited list, latest exploit score."""
    from riskweave.operators.joins import lookup, membership

    flagged = membership(df.drop("kev_flag", "epss_score"), kev, "kev_flag")
    scored = lookup(flagged, epss, "cve_id", {"epss_score": 0.0})
    return scored.withColumns({"recency": recency_linear(F.col("published"), reference), "cvss_norm": number("cvss") / 10.0})
