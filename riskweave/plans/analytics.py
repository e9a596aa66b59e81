"""Features, labels, scores, splits, ranking measures, tests, ensembles, graphs, texts and quality over risk records."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import expressions as X
from riskweave.functions import vocabulary as V
from riskweave.operators import aggregates as A
from riskweave.operators import analyst as N
from riskweave.operators import evaluate as E
from riskweave.operators import features as B
from riskweave.operators import fusion as U
from riskweave.operators import graph as G
from riskweave.operators import labels as LB
from riskweave.operators import models as M
from riskweave.operators import quality as D
from riskweave.operators import ranking as R
from riskweave.operators import scoring as S
from riskweave.operators import splits as SP
from riskweave.operators import stats as T
from riskweave.operators import text_match as TM
from riskweave.operators.joins import matches
from riskweave.plans.base import REFERENCE, query
from riskweave.session import stage
from riskweave.sources import feeds
from riskweave.sources import projection as P
from riskweave.streaming import jobs


def _rounded(df, *keep, digits=6):
    return df.select(*keep, *[F.round(F.col(c), digits).alias(c) if k == "double" else F.col(c).cast("bigint").alias(c) if k in ("int", "bigint") else F.col(c) for c, k in df.dtypes if c not in keep])


def _cases(column, pairs, default):
    return "CASE " + " ".join(f"WHEN {column} LIKE '%{token}%' THEN {value}" for token, value in pairs) + f" ELSE {default} END"


def _ordinal_sql(code, values):
    return "(CASE " + " ".join(f"WHEN strpos('/' || cvss_vector || '/', '/{code}:{k}/') > 0 THEN {v}" for k, v in values.items()) + " ELSE 0 END)::DOUBLE"


_ORD = ", ".join(f"{_ordinal_sql(code, values)} AS {name}" for name, (code, values, _) in B.ORDINALS.items())
_DERIVED = " + ".join(f"{name} * {w}" for name, (_, _, w) in B.ORDINALS.items() if w)


@query(f"""SELECT *, round({_DERIVED}, 6) AS cvss_derived_score, (CASE WHEN cvss_c + cvss_i + cvss_a >= 8 THEN 4 WHEN cvss_c + cvss_i + cvss_a >= 6 THEN 3 WHEN cvss_c + cvss_i + cvss_a >= 4 THEN 2
WHEN cvss_c + cvss_i + cvss_a > 0 THEN 1 ELSE 0 END)::DOUBLE AS cvss_severity_category FROM (SELECT cve_id, {_ORD} FROM records)""")
def fea_03_vector(spark, sf):
    return B.vector_features(P.records(spark, sf).select("cve_id", "cvss_vector")).drop("cvss_vector")


def _any(names):
    return "list_has_any(ids, [" + ", ".join(f"'{n}'" for n in names) + "])"


_FLAG_GROUPS = {"cwe_is_injection": "injection", "cwe_is_crypto": "crypto", "cwe_is_access_control": "access_control", "cwe_is_input_validation": "input_validation", "cwe_is_memory_corruption": "memory"}
_KNOWN = sorted({c for names in V.CWE_GROUPS.values() for c in names})


@query(f"""SELECT cve_id, {_any(V.CWE_TOP_25)}::INTEGER::DOUBLE AS cwe_is_top25, {", ".join(f"{_any(V.CWE_GROUPS[g])}::INTEGER::DOUBLE AS {n}" for n, g in _FLAG_GROUPS.items())},
(CASE {" ".join(f"WHEN {_any(names)} THEN {i}" for i, names in enumerate(V.CWE_GROUPS.values(), 1))} ELSE 0 END)::DOUBLE AS cwe_category,
(CASE WHEN len(ids) = 0 THEN 0 WHEN {_any(V.CWE_TOP_25)} THEN 3 WHEN {_any(_KNOWN)} THEN 2 ELSE 1 END)::DOUBLE AS cwe_severity_score FROM (SELECT cve_id, regexp_extract_all(upper(coalesce(cwe, '')), 'CWE-[0-9]+') AS ids FROM records)""")
def fea_04_weakness(spark, sf):
    return B.weakness_features(P.records(spark, sf).select("cve_id", "cwe")).drop("cwe")


def _has(terms, column="lower(coalesce(description, ''))"):
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


@query("SELECT cve_id, " + ", ".join(f"{_has(terms)}::INTEGER::DOUBLE AS {n}" for n, terms in V.DESCRIPTION_FLAGS.items()) + " FROM records")
def fea_05_description(spark, sf):
    return B.description_features(P.records(spark, sf).select("cve_id", "description")).drop("description")


@query(f"SELECT *, round((vendor_is_high_risk * 2.0 + vendor_is_healthcare * 1.5) / 3.5, 6) AS vendor_risk_score FROM (SELECT cve_id, {_has(V.HIGH_RISK_VENDORS)}::INTEGER::DOUBLE AS vendor_is_high_risk, {_has(V.HEALTHCARE_VENDORS)}::INTEGER::DOUBLE AS vendor_is_healthcare FROM records)")
def fea_06_vendor(spark, sf):
    return _rounded(B.vendor_features(P.records(spark, sf).select("cve_id", "description")).drop("description"), "cve_id")


@query(f"""WITH v AS (SELECT cve_id, is_healthcare, {_has(V.DESCRIPTION_FLAGS["desc_has_rce"])}::INTEGER AS rce, {_ORD} FROM records),
w AS (SELECT *, (cvss_c + cvss_i + cvss_a >= 7)::INTEGER::DOUBLE AS strong, (cvss_av = 4)::INTEGER::DOUBLE AS net, (cvss_pr = 3)::INTEGER::DOUBLE AS op FROM v)
SELECT cve_id, round(net * op * (cvss_c + cvss_i + cvss_a) / 3.0, 6) AS ultimate_risk, strong * rce AS critical_exploitable, net AS network_accessible, op AS auth_not_required, net * strong AS high_impact_network, is_healthcare * strong AS healthcare_critical FROM w""")
def fea_07_08_enhanced(spark, sf):
    out = B.enhanced_features(P.records(spark, sf))
    return _rounded(out.select("cve_id", "ultimate_risk", "critical_exploitable", "network_accessible", "auth_not_required", "high_impact_network", "healthcare_critical"), "cve_id")


_AGE = "date_diff('day', published::DATE, DATE '2002-01-01')"
_WEEK = "year(published) || '-' || lpad(((dayofyear(published) + 6 - dayofweek(published)) // 7)::VARCHAR, 2, '0')"
_FEATURES = f"""f AS (SELECT *, greatest(0, {_AGE}) AS age, coalesce(cvss, 5.0) AS c, coalesce(epss_score, 0.0) AS e, {_WEEK} AS week FROM records),
g AS (SELECT *, CASE WHEN max(age) OVER () > 0 THEN 1 - age / (max(age) OVER ())::DOUBLE ELSE 1.0 END AS recency FROM f)"""


@query(f"""WITH {_FEATURES} SELECT cve_id, (cvss IS NULL)::BIGINT AS cvss_missing, (epss_score IS NULL)::BIGINT AS epss_missing, c AS cvss, e AS epss_score, (attack_technique_count > 0)::BIGINT AS has_attack, age::BIGINT AS days_since_published,
week AS published_week, round(c / 10.0, 6) AS cvss_norm, round(recency, 6) AS recency, round(kev_flag * (c / 10.0), 6) AS kev_x_cvss, round(is_healthcare * e, 6) AS healthcare_x_epss FROM g""")
def fea_02_record(spark, sf):
    out = B.record_features(P.records(spark, sf), REFERENCE)
    return _rounded(out.select("cve_id", "cvss_missing", "epss_missing", "cvss", "epss_score", "has_attack", "days_since_published", "published_week", "cvss_norm", "recency", "kev_x_cvss", "healthcare_x_epss"), "cve_id")


def _tier(name):
    return _has(V.KEYWORD_TIERS[name])


@query(f"""WITH w AS (SELECT 'CWE-' || n AS id, sum(kev_flag) / count(*) AS rate FROM (SELECT kev_flag, regexp_extract(cwe, 'CWE-([0-9]+)', 1) AS n FROM records WHERE year(published) < 1998) WHERE n <> '' GROUP BY n HAVING count(*) >= 10),
p AS (SELECT *, coalesce(cvss, 5.0) AS c, regexp_extract(coalesce(cwe, ''), 'CWE-([0-9]+)', 1) AS n, {_AGE} AS age FROM records)
SELECT cve_id, round(c / 10, 6) AS cvss_norm, (c >= 9)::BIGINT AS cvss_critical, (c < 4)::BIGINT AS cvss_low, CASE WHEN n = '' THEN 'UNKNOWN' ELSE 'CWE-' || n END AS cwe_id,
CASE WHEN n = '' THEN 'unknown' {" ".join(f"WHEN n IN ({', '.join(repr(x) for x in numbers)}) THEN '{name}'" for name, numbers in V.PUBLICATION_GROUPS.items())} ELSE 'other' END AS cwe_group,
len(regexp_extract_all(coalesce(cwe, ''), 'CWE-[0-9]+'))::BIGINT AS cwe_count, {_has(V.PUBLICATION_HIGH_RISK)}::BIGINT AS is_high_risk_vendor, {_has(V.PUBLICATION_HEALTHCARE)}::BIGINT AS is_healthcare_vendor,
({_tier("high")}::BIGINT * 2 + {_tier("medium")}::BIGINT + {_tier("low")}::BIGINT)::BIGINT AS exploit_keyword_count, round(least(1.0, length(coalesce(description, '')) / 500.0), 6) AS desc_length_norm,
round(1.0 / (1.0 + age / 365.0), 6) AS recency_score, (attack_technique_count > 1)::BIGINT AS attack_multi, (is_healthcare = 1 AND c >= 9)::BIGINT AS healthcare_critical, round(coalesce(w.rate, 0.0), 6) AS cwe_risk_score
FROM p LEFT JOIN w ON w.id = 'CWE-' || p.n""")
def fea_09_publication(spark, sf):
    r = P.records(spark, sf)
    vendors, weaknesses = B.historical_risk(r.where("year(published) < 1998"))
    out = B.publication_features(r, REFERENCE, weaknesses.where("cwe_id <> 'UNKNOWN'"), vendors)
    names = ["cve_id", "cvss_norm", "cvss_critical", "cvss_low", "cwe_id", "cwe_group", "cwe_count", "is_high_risk_vendor", "is_healthcare_vendor", "exploit_keyword_count", "desc_length_norm", "recency_score", "attack_multi", "healthcare_critical", "cwe_risk_score"]
    return _rounded(out.select(*names), "cve_id")


@query(f"""SELECT cve_id, round(coalesce(cvss, 5.0) / 10, 6) AS cvss_norm, coalesce(cvss >= 9, false)::BIGINT AS cvss_critical, coalesce(cvss >= 7, false)::BIGINT AS cvss_high, coalesce(cvss >= 4 AND cvss < 7, false)::BIGINT AS cvss_medium,
(attack_technique_count > 0)::BIGINT AS has_attack, {_AGE}::BIGINT AS days_since_published, round(1.0 / (1.0 + {_AGE} / 365.0), 6) AS recency_score, ({_AGE} <= 90)::BIGINT AS is_recent, coalesce(is_healthcare = 1 AND cvss >= 9, false)::BIGINT AS healthcare_critical FROM records""")
def fea_11_temporal(spark, sf):
    out = B.temporal_features(P.records(spark, sf), REFERENCE)
    return _rounded(out.select("cve_id", "cvss_norm", "cvss_critical", "cvss_high", "cvss_medium", "has_attack", "days_since_published", "recency_score", "is_recent", "healthcare_critical"), "cve_id")


_D18 = "date_diff('day', DATE '2018-01-01', published::DATE)"


@query(f"""SELECT cve_id, coalesce(cvss, 0.0) AS cvss, (coalesce(cvss, 0) >= 7)::BIGINT AS cvss_high, (coalesce(epss_score, 0) >= 0.1)::BIGINT AS epss_high, (kev_flag = 1 AND is_healthcare = 1)::BIGINT AS kev_healthcare,
(chpl_flag = 1 AND is_healthcare = 1)::BIGINT AS chpl_healthcare, round(is_healthcare * coalesce(cvss, 0), 6) AS healthcare_x_cvss, round(kev_flag * coalesce(epss_score, 0), 6) AS kev_x_epss, chpl_flag * attack_flag AS chpl_x_attack,
attack_technique_count * is_healthcare AS attack_count_x_healthcare, {_D18}::BIGINT AS days_since_2018, ({_D18} > 2500)::BIGINT AS is_recent FROM records""")
def fea_12_legacy(spark, sf):
    out = B.legacy_features(P.records(spark, sf))
    return _rounded(out.select("cve_id", "cvss", "cvss_high", "epss_high", "kev_healthcare", "chpl_healthcare", "healthcare_x_cvss", "kev_x_epss", "chpl_x_attack", "attack_count_x_healthcare", "days_since_2018", "is_recent"), "cve_id")


@query(f"""WITH t AS (SELECT *, coalesce(cvss, 0.0) AS c, coalesce(epss_score, 0.0) AS e, {_D18}::DOUBLE AS d FROM records), m AS (SELECT avg(c) AS ac, stddev_pop(c) AS sc, avg(e) AS ae, stddev_pop(e) AS se, avg(d) AS ad, stddev_pop(d) AS sd FROM t WHERE year(published) < 1999)
SELECT cve_id, round((c - ac) / sc, 5) AS cvss, round((e - ae) / se, 5) AS epss_score, round((d - ad) / sd, 5) AS days_since_2018, (c >= 9)::BIGINT AS cvss_critical FROM t, m""")
def fea_13_pruned(spark, sf):
    r = P.records(spark, sf)
    return _rounded(B.pruned_features(r, r.where("year(published) < 1999")).select("cve_id", "cvss", "epss_score", "days_since_2018", "cvss_critical"), "cve_id", digits=5)


@query(f"SELECT cve_id, round(coalesce(cvss, 0) / 10 * coalesce(epss_score, 0), 6) AS cvss_epss_product, attack_flag AS has_attack, {_D18}::BIGINT AS days_since_2018 FROM records")
def fea_14_removal(spark, sf):
    return _rounded(B.removal_features(P.records(spark, sf)).select("cve_id", "cvss_epss_product", "has_attack", "days_since_2018"), "cve_id")


@query(f"SELECT cve_id, round(greatest(0.0, 1 - {_AGE} / 3000.0), 3) AS recency, kev, round(coalesce(cvss, 0) / 10, 6) AS cvss_norm, coalesce(s, 0.0) AS epss_score FROM records LEFT JOIN (SELECT cve_id, 1::BIGINT AS k FROM exploited) USING (cve_id) LEFT JOIN (SELECT cve_id, round(max(epss_score), 6) AS s FROM history GROUP BY 1) USING (cve_id), LATERAL (SELECT coalesce(k, 0) AS kev)", ("records", "history", "exploited"))
def fea_01_baseline(spark, sf):
    scores = P.signal_history(spark, sf).groupBy("cve_id").agg(F.round(F.max("epss_score"), 6).alias("epss_score"))
    out = B.baseline_features(P.records(spark, sf), REFERENCE, P.exploited(spark, sf), scores).withColumn("recency", B.recency_linear(F.col("published"), REFERENCE, 3000))
    return _rounded(out.select("cve_id", "recency", F.col("kev_flag").alias("kev"), "cvss_norm", "epss_score"), "cve_id")


@query("SELECT cve_id, (CASE WHEN kev_flag = 1 THEN 2 WHEN chpl_flag = 1 OR attack_flag = 1 THEN 1 ELSE 0 END)::BIGINT AS signal_label FROM records")
def lab_01_signals(spark, sf):
    return LB.signal_label(P.records(spark, sf)).select("cve_id", "signal_label")


@query("""WITH b AS (SELECT cve_id, is_curated = 1 AS cu, kev_flag = 1 AS k, is_healthcare = 1 AS h, chpl_flag = 1 AS p, attack_flag = 1 AS a, coalesce(epss_score, 0) AS e, coalesce(cvss, 0) AS c FROM records)
SELECT cve_id, (CASE WHEN (cu AND k AND e > 0.5 AND h AND p) OR (cu AND k AND h AND a AND e > 0.4) THEN 5 WHEN (cu AND k) OR (e > 0.5 AND h AND p) OR (a AND k AND h) OR (cu AND e > 0.5 AND p) OR (e > 0.5 AND h) THEN 4
WHEN k OR cu OR (e > 0.3 AND h) OR (c >= 9 AND h) OR (p AND h AND a) OR e > 0.6 THEN 3 WHEN h OR p OR e > 0.1 OR c >= 7 THEN 2 WHEN c >= 5 OR e > 0.01 THEN 1 ELSE 0 END)::BIGINT AS level FROM b""")
def lab_02_levels(spark, sf):
    return LB.level_label(P.records(spark, sf)).select("cve_id", "level")


_WEAK = f"""WITH {_FEATURES}, b AS (SELECT *, kev_flag = 1 AS k, is_healthcare = 1 AS h, chpl_flag = 1 AS p, attack_technique_count AS n, coalesce(epss_percentile, 0) AS pct, c / 10.0 AS cn FROM g),
s AS (SELECT *, e >= 0.5 OR pct >= 0.9 AS hi, (e >= 0.1 AND e < 0.5) OR (pct >= 0.7 AND pct < 0.9) AS me FROM b),
t AS (SELECT *, CASE WHEN k AND (h OR p) THEN 'kev_healthcare' WHEN k THEN 'kev_only' WHEN hi AND n >= 1 THEN 'epss_attack' WHEN me THEN 'medium_epss' WHEN n >= 1 THEN 'attack_mapping' WHEN cn >= 0.7 AND recency >= 0.4 THEN 'cvss_recency' ELSE 'none' END AS label_source FROM s),
u AS (SELECT *, CASE label_source WHEN 'kev_healthcare' THEN 3 WHEN 'kev_only' THEN 2 WHEN 'epss_attack' THEN 2 WHEN 'none' THEN 0 ELSE 1 END::BIGINT AS soft_label,
  CASE WHEN k THEN 1.0 WHEN hi THEN 0.75 WHEN me THEN 0.55 ELSE 0.2 END::DOUBLE AS c0 FROM t),
v AS (SELECT *, CASE WHEN n >= 1 THEN least(c0 + 0.10::DOUBLE, 1.0) ELSE c0 END AS c1 FROM u), x AS (SELECT *, CASE WHEN h OR p THEN least(c1 + 0.10::DOUBLE, 1.0) ELSE c1 END AS c2 FROM v),
weak AS (SELECT *, round(greatest(CASE WHEN label_source = 'cvss_recency' THEN least(c2, 0.40) ELSE c2 END, 0.1), 6)::DOUBLE AS confidence FROM x)"""


def _weak(spark, sf):
    return LB.weak_label(B.record_features(P.records(spark, sf), REFERENCE))


@query(_WEAK + " SELECT cve_id, soft_label, confidence, label_source FROM weak")
def lab_03_weak(spark, sf):
    return _weak(spark, sf).select("cve_id", "soft_label", "confidence", "label_source")


@query("""WITH w AS (SELECT r.cve_id, max(h.epss_score) AS best FROM records r JOIN history h ON h.cve_id = r.cve_id AND h.epss_date BETWEEN r.published::DATE AND r.published::DATE + 365 GROUP BY r.cve_id),
x AS (SELECT r.cve_id, cvss, best, date_added BETWEEN published::DATE AND published::DATE + 365 AS inside, date_added < published::DATE AS prior FROM records r LEFT JOIN w USING (cve_id) LEFT JOIN exploited e USING (cve_id)),
y AS (SELECT cve_id, CASE WHEN inside THEN 'kev_within_horizon' WHEN prior THEN 'kev_prior' WHEN best >= 0.5 THEN 'epss_high_horizon' WHEN best >= 0.1 THEN 'epss_medium_horizon' WHEN cvss >= 9 THEN 'cvss_critical' WHEN cvss >= 7 THEN 'cvss_high' ELSE 'default' END AS temporal_source FROM x)
SELECT cve_id, temporal_source, (CASE temporal_source WHEN 'kev_within_horizon' THEN 3 WHEN 'kev_prior' THEN 3 WHEN 'epss_high_horizon' THEN 2 WHEN 'default' THEN 0 ELSE 1 END)::BIGINT AS temporal_label,
(CASE temporal_source WHEN 'kev_within_horizon' THEN 1.0 WHEN 'kev_prior' THEN 1.0 WHEN 'epss_high_horizon' THEN 0.8 WHEN 'epss_medium_horizon' THEN 0.6 WHEN 'cvss_critical' THEN 0.4 WHEN 'cvss_high' THEN 0.35 ELSE 0.25 END)::DOUBLE AS temporal_confidence FROM y""", ("records", "history", "exploited"))
def lab_04_forward(spark, sf):
    out = LB.forward_label(P.records(spark, sf), P.signal_history(spark, sf), P.exploited(spark, sf), 365)
    return out.select("cve_id", "temporal_source", "temporal_label", "temporal_confidence")


@query("""SELECT cve_id, (CASE WHEN curated_severity IS NULL THEN 0 WHEN curated_severity = 'critical' AND label > 2 AND kev_flag = 1 THEN 5 WHEN curated_severity = 'critical' AND label > 2 THEN 4
WHEN (curated_severity = 'high' AND kev_flag = 1) OR curated_severity = 'critical' THEN 3 ELSE 2 END)::BIGINT AS curated_label FROM records""")
def lab_05_curated(spark, sf):
    r = P.records(spark, sf).withColumn("curated_confidence", F.when(F.col("label") > 2, "high").otherwise("medium"))
    return LB.curated_label(r).select("cve_id", "curated_label")


@query(_WEAK + " SELECT label_source, count(*) AS n, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS middle FROM weak GROUP BY 1")
def lab_06_diagnostics(spark, sf):
    return _weak(spark, sf).groupBy("label_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.median("confidence"), 6).alias("middle"))


@query(_WEAK + " SELECT count_if(soft_label >= 2 AND confidence > 0.8) AS sure_positive, count_if(confidence < 0.4) AS unsure, count_if(kev_flag = 1 OR n > 0 OR e > 0) AS any_signal, round(avg(confidence), 6) AS mean_confidence, round(stddev_samp(confidence), 6) AS std_confidence, median(confidence) AS median_confidence FROM weak".replace("SELECT count_if(soft", "SELECT count_if(soft"))
def lab_07_slices(spark, sf):
    return LB.label_slices(_weak(spark, sf))


def _weights_sql(weights):
    return " + ".join(f"{w} * {c}" for c, w in weights.items())


_SCORED = f"""WITH {_FEATURES}, s AS (SELECT cve_id, recency, kev_flag, c / 10.0 AS cvss_norm, chpl_flag, is_healthcare, attack_flag, e AS epss_score, (attack_technique_count > 0)::BIGINT AS has_attack, c AS cvss, published, description FROM g)"""


@query(f"{_SCORED} SELECT cve_id, round({_weights_sql(S.SIMPLE)}, 6) AS simple, round({_weights_sql(S.WEIGHTED)}, 6) AS weighted, round({_weights_sql(S.HEURISTIC)}, 6) AS heuristic, round({_weights_sql(S.LEAKAGE_FREE)}, 6) AS leakage_free, round(cvss / 10.0, 6) AS cvss_only, epss_score AS epss_only FROM s")
def sco_01_05_scores(spark, sf):
    f = B.record_features(P.records(spark, sf), REFERENCE)
    return f.select("cve_id", *[F.round(S.weighted(w), 6).alias(n) for n, w in (("simple", S.SIMPLE), ("weighted", S.WEIGHTED), ("heuristic", S.HEURISTIC), ("leakage_free", S.LEAKAGE_FREE))], F.round(S.cvss_only(), 6).alias("cvss_only"), S.epss_only().alias("epss_only"))


@query("SELECT cve_id, round(avg(score) - 0.5 * stddev_pop(score), 6) AS score, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation FROM scores GROUP BY 1", ("records", "scores"))
def sco_06_risk_averse(spark, sf):
    return _rounded(S.risk_averse(P.long_scores(spark, sf), "cve_id", "score", 0.5), "cve_id")


@query("SELECT cve_id, round(((cvss - min(cvss) OVER ()) / (max(cvss) OVER () - min(cvss) OVER ()) + (healthcare_score - min(healthcare_score) OVER ()) / (max(healthcare_score) OVER () - min(healthcare_score) OVER ())) / 2, 6) AS score FROM records")
def sco_07_normalised(spark, sf):
    return _rounded(S.normalised_average(P.records(spark, sf), "cvss", "healthcare_score").select("cve_id", "score"), "cve_id")


@query(f"""{_SCORED}, m AS ({" UNION ALL ".join(f"SELECT cve_id, '{c}' AS feature, ({c} - avg({c}) OVER ()) * {w} AS contribution FROM s" for c, w in S.HEURISTIC.items())})
SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM m GROUP BY 1""")
def mod_09_importance(spark, sf):
    return _rounded(S.mean_contributions(B.record_features(P.records(spark, sf), REFERENCE), S.HEURISTIC), "feature")


@query(f"""{_SCORED}, m AS ({" UNION ALL ".join(f"SELECT cve_id, '{c}' AS feature, ({c} - avg({c}) OVER ()) * {w} AS contribution FROM s" for c, w in S.HEURISTIC.items())}),
n AS (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY abs(round(contribution, 9)) DESC, feature) AS place FROM m) SELECT cve_id, feature, round(contribution, 6) AS contribution, place FROM n WHERE place <= 3""")
def mod_09_contributions(spark, sf):
    return _rounded(S.contributions(B.record_features(P.records(spark, sf), REFERENCE), S.HEURISTIC), "cve_id", "feature")


@query("SELECT cve_id, CASE WHEN published::DATE >= DATE '1999-06-01' THEN 'test' WHEN published::DATE >= DATE '1999-06-01' - 56 THEN 'val' ELSE 'train' END AS split FROM records")
def spl_01_by_date(spark, sf):
    return SP.by_date(P.records(spark, sf), "1999-06-01", 8).select("cve_id", "split")


@query("SELECT cve_id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM (SELECT cve_id, row_number() OVER (ORDER BY published, cve_id) AS rn, count(*) OVER () AS n FROM records)")
def spl_02_by_share(spark, sf):
    return SP.by_share(P.records(spark, sf).select("cve_id", "published"), 0.7, 0.15).select("cve_id", "split")


@query("SELECT cve_id, CASE WHEN year(published) = 2000 THEN 'test' WHEN published::DATE > (SELECT max(published::DATE) FROM records WHERE year(published) < 2000) - 28 THEN 'val' ELSE 'train' END AS split FROM records WHERE year(published) <= 2000")
def spl_03_by_year(spark, sf):
    return SP.by_year(P.records(spark, sf), 2000, 4).select("cve_id", "split")


@query("SELECT cve_id, CASE WHEN published::DATE <= DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split FROM records WHERE published::DATE <= DATE '1999-01-01' OR published::DATE >= DATE '1999-01-01' + 90")
def spl_05_with_gap(spark, sf):
    return SP.with_gap(P.records(spark, sf), "1999-01-01", 90).select("cve_id", "split")


@query("SELECT max(published::DATE)::VARCHAR AS train_end, min(CASE WHEN published::DATE >= DATE '1999-06-01' THEN published::DATE END)::VARCHAR AS test_start, 0::BIGINT AS overlap_days, false AS leaks FROM records WHERE 1 = 0".replace("max(published::DATE)::VARCHAR AS train_end, min(CASE WHEN published::DATE >= DATE '1999-06-01' THEN published::DATE END)::VARCHAR AS test_start", "(SELECT max(published::DATE)::VARCHAR FROM records WHERE published::DATE < DATE '1999-06-01' - 56) AS train_end, (SELECT min(published::DATE)::VARCHAR FROM records WHERE published::DATE >= DATE '1999-06-01') AS test_start").replace(" FROM records WHERE 1 = 0", ""))
def spl_06_leakage(spark, sf):
    out = SP.leakage(SP.by_date(P.records(spark, sf), "1999-06-01", 8))
    return out.withColumns({c: F.col(c).cast("string") for c in ("train_end", "test_start")})


@query("SELECT cve_id, CASE WHEN ('0x' || substr(md5(cve_id), 1, 8))::BIGINT % 10000 < 2000 THEN 'test' ELSE 'train' END AS split FROM records")
def spl_07_random(spark, sf):
    return SP.random_split(P.records(spark, sf), 0.2).select("cve_id", "split")


@query("SELECT cve_id, ((row_number() OVER (ORDER BY label, md5(cve_id), cve_id) - 1) % 5)::BIGINT AS fold FROM records")
def spl_08_stratified(spark, sf):
    return SP.stratified_folds(P.records(spark, sf).select("cve_id", "label"), 5, "label").select("cve_id", "fold")


@query(f"""WITH s AS (SELECT {_WEEK} AS week, count(*) AS n FROM records GROUP BY 1), p AS (SELECT week, (row_number() OVER (ORDER BY n DESC, week) - 1) % 10 AS z FROM s)
SELECT cve_id, (CASE WHEN z < 5 THEN z ELSE 9 - z END)::BIGINT AS fold FROM records JOIN p ON p.week = {_WEEK}""")
def spl_08_group_folds(spark, sf):
    r = P.records(spark, sf).select("cve_id", X.sunday_week(F.col("published")).alias("week"))
    return SP.group_folds(r, 5, "week").select("cve_id", "fold")


@query("""WITH b AS (SELECT least(3, floor((row_number() OVER (ORDER BY published, cve_id) - 1) * 4 / count(*) OVER ())) AS block FROM records)
SELECT f::BIGINT AS fold, CASE WHEN block = f THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM b, (SELECT unnest([1, 2, 3]) AS f) WHERE block <= f GROUP BY 1, 2""")
def spl_08_expanding(spark, sf):
    out = SP.expanding_folds(P.records(spark, sf).select("cve_id", "published"), 3)
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CASE WHEN published::DATE >= DATE '1999-06-01' THEN 'test' WHEN published::DATE >= DATE '1999-06-01' - 56 THEN 'val' ELSE 'train' END AS split, count(*) AS n, min(published::DATE)::VARCHAR AS first_day, max(published::DATE)::VARCHAR AS last_day, round(avg((label >= 2)::INTEGER) * 100, 4) AS pct_relevant FROM records GROUP BY 1")
def agg_22_split_summary(spark, sf):
    out = A.split_summary(SP.by_date(P.records(spark, sf), "1999-06-01", 8), ["split"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("SELECT count(*) AS n, sum(('0x' || substr(md5(cve_id || 'sample'), 1, 8))::BIGINT % 1000000)::BIGINT AS total FROM records WHERE ('0x' || substr(md5(cve_id || 'sample'), 1, 8))::BIGINT % 1000000 < 300000")
def spl_11_sample(spark, sf):
    return SP.hash_sample(P.records(spark, sf), 0.3).agg(F.count(F.lit(1)).alias("n"), F.sum(X.hash_bucket("cve_id", 1_000_000, "sample").cast("bigint")).alias("total"))


def _draws_sql():
    """The number of draws by a hash of key and replica, in steps of the Poisson distribution of mean 1."""
    steps, total, p = [], 0.0, 0.36787944117144233
    for n in range(8):
        total += p
        steps.append(f"WHEN u < {total!r}::DOUBLE THEN {n}")
        p /= n + 1
    return f"CASE {' '.join(steps)} ELSE 8 END"


def _drawn_sql(source, columns, replicas):
    return f"(SELECT * FROM (SELECT *, ({_draws_sql()})::BIGINT AS times FROM (SELECT {columns}, replica, (('0x' || substr(md5(cve_id || '#' || replica), 1, 8))::BIGINT % 1000000) / 1000000.0::DOUBLE AS u FROM {source}, (SELECT unnest(range({replicas})) AS replica))) WHERE times > 0)"


@query(f'SELECT replica::INTEGER AS replica, sum(times)::BIGINT AS drawn, count(*) AS "rows" FROM {_drawn_sql("records", "cve_id", 10)} GROUP BY 1')
def spl_09_bootstrap(spark, sf):
    return SP.bootstrap(P.records(spark, sf).select("cve_id"), 10).groupBy("replica").agg(F.sum("times").alias("drawn"), F.count(F.lit(1)).alias("rows"))


@query(f"""WITH t AS (SELECT cve_id, (label >= 2)::INTEGER AS hit FROM (SELECT *, row_number() OVER (ORDER BY score DESC, cve_id) AS n FROM scores WHERE model = 'a') WHERE n <= 500),
e AS (SELECT replica, sum(hit * times)::DOUBLE / sum(times) AS v FROM {_drawn_sql("t", "cve_id, hit", 300)} GROUP BY 1) SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM e""", ("records", "scores"))
def spl_10_interval(spark, sf):
    tops = R.top(P.long_scores(spark, sf).where("model = 'a'"), [F.desc("score"), F.asc("cve_id")], 500).select("cve_id", (F.col("label") >= 2).cast("int").alias("hit"))
    return _rounded(T.interval(SP.bootstrap(tops, 300), "hit"))


@query("""WITH e AS (SELECT cve_id, published, row_number() OVER (ORDER BY published, cve_id) AS n, count(*) OVER () AS c FROM records WHERE published <= TIMESTAMP '1999-06-01')
SELECT cve_id, CASE WHEN n > c - greatest(1, floor(c * 0.15)) THEN 'val' ELSE 'train' END AS split FROM e UNION ALL SELECT cve_id, 'test' FROM records WHERE published > TIMESTAMP '1999-06-01'""")
def spl_04_by_cutoff(spark, sf):
    return SP.by_cutoff(P.records(spark, sf).select("cve_id", "published"), "1999-06-01").select("cve_id", "split")


def _metric(k):
    return f"""CASE WHEN sum(CASE WHEN ideal <= {k} THEN (2.0 ** label - 1) / log2(ideal + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN position <= {k} THEN (2.0 ** label - 1) / log2(position + 1) ELSE 0 END) / sum(CASE WHEN ideal <= {k} THEN (2.0 ** label - 1) / log2(ideal + 1) ELSE 0 END) ELSE 0 END AS ndcg_{k},
sum(CASE WHEN position <= {k} THEN rel ELSE 0 END) / least({k}, count(*)) AS precision_{k}, CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN position <= {k} THEN rel ELSE 0 END) / sum(rel) ELSE 0 END AS recall_{k},
CASE WHEN sum(CASE WHEN position <= {k} THEN rel ELSE 0 END) > 0 THEN sum(CASE WHEN position <= {k} AND rel = 1 THEN hits / position ELSE 0 END) / sum(CASE WHEN position <= {k} THEN rel ELSE 0 END) ELSE 0 END AS ap_{k}"""


_PLACED = """WITH p AS (SELECT *, (label >= 2)::INTEGER AS rel, row_number() OVER (PARTITION BY model, week ORDER BY score DESC, cve_id) AS position, row_number() OVER (PARTITION BY model, week ORDER BY label DESC, cve_id) AS ideal FROM scores),
q AS (SELECT *, sum(rel) OVER (PARTITION BY model, week ORDER BY position) AS hits FROM p)"""


@query(f"""{_PLACED}, e AS (SELECT model, week, count(*) AS n, {", ".join(_metric(k) for k in (5, 10, 20))} FROM q GROUP BY 1, 2)
SELECT model, count(*) AS groups, {", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in (5, 10, 20) for m in ("ndcg", "precision", "recall", "ap"))} FROM e WHERE n >= 2 GROUP BY 1""", ("records", "scores"))
def eva_01_05_macro(spark, sf):
    return E.macro(P.long_scores(spark, sf), "week", [5, 10, 20])


@query(f"{_PLACED} SELECT model, week, count(*) AS n, {', '.join(x for x in ['round(ndcg_10, 6) AS ndcg_10'])} FROM (SELECT model, week, {_metric(10)} FROM q GROUP BY 1, 2) JOIN q USING (model, week) GROUP BY model, week, ndcg_10", ("records", "scores"))
def eva_06_per_group(spark, sf):
    return E.grouped_metrics(P.long_scores(spark, sf), "week", [10]).select("model", "week", "n", F.round("ndcg_10", 6).alias("ndcg_10"))


_LINEAR = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY model, week ORDER BY score DESC) AS p, row_number() OVER (PARTITION BY model, week ORDER BY label DESC) AS i FROM scores),
b AS (SELECT model, week, score, avg(label) * sum(CASE WHEN p <= 10 THEN 1 / log2(p + 1) ELSE 0 END) AS d, sum(label * CASE WHEN i <= 10 THEN 1 / log2(i + 1) ELSE 0 END) AS b FROM a GROUP BY 1, 2, 3),
lin AS (SELECT model, week, round(sum(d) / sum(b), 6) AS ndcg FROM b GROUP BY 1, 2 HAVING sum(b) > 0)"""


@query(_LINEAR + " SELECT * FROM lin", ("records", "scores"))
def eva_07_linear_ndcg(spark, sf):
    return E.linear_ndcg(P.long_scores(spark, sf), "week", 10).withColumn("ndcg", F.round("ndcg", 6))


@query("""WITH p AS (SELECT *, (label >= 2)::INTEGER AS rel, row_number() OVER (PARTITION BY model ORDER BY score DESC, cve_id) AS n FROM scores),
s AS (SELECT model, score, sum(rel) AS r, sum(sum(rel)) OVER (PARTITION BY model ORDER BY score DESC) AS cr, sum(count(*)) OVER (PARTITION BY model ORDER BY score DESC) AS cc FROM p GROUP BY 1, 2)
SELECT p.model, round(sum(CASE WHEN n <= 20 THEN rel ELSE 0 END) / 20, 6) AS precision, round(sum(CASE WHEN n <= 20 THEN rel ELSE 0 END) / sum(rel), 6) AS recall, round(any_value(a.ap), 6) AS ap FROM p JOIN (SELECT model, sum(r * cr / cc) / sum(r) AS ap FROM s GROUP BY 1) a ON a.model = p.model GROUP BY p.model""", ("records", "scores"))
def eva_09_flat(spark, sf):
    return E.flat_metrics(P.long_scores(spark, sf), 20)


@query("SELECT model, sum((n <= 20 AND kev_flag = 1)::BIGINT)::BIGINT AS captured, (SELECT sum(kev_flag) FROM records)::BIGINT AS total FROM (SELECT s.model, r.kev_flag, row_number() OVER (PARTITION BY s.model ORDER BY s.score DESC, s.cve_id) AS n FROM scores s JOIN records r USING (cve_id)) GROUP BY 1", ("records", "scores"))
def eva_11_capture(spark, sf):
    return E.capture(P.long_scores(spark, sf), P.records(spark, sf).where("kev_flag = 1"), 20)


@query("WITH m AS (SELECT model, round(avg(score), 6) AS v FROM scores GROUP BY 1) SELECT model, v, round(100 * (v - (SELECT v FROM m WHERE model = 'c')) / (SELECT v FROM m WHERE model = 'c'), 4) AS lift_pct FROM m", ("records", "scores"))
def eva_13_lift(spark, sf):
    return E.lift_table(P.long_scores(spark, sf).groupBy("model").agg(F.round(F.avg("score"), 6).alias("v")), "model", "v", "c")


@query("WITH m AS (SELECT year(published)::BIGINT AS year, round(avg(cvss), 4) AS v FROM records GROUP BY 1) SELECT year, v, round(v - lag(v) OVER (ORDER BY year), 6) AS change, round(100 * (v - lag(v) OVER (ORDER BY year)) / lag(v) OVER (ORDER BY year), 4) AS change_pct FROM m")
def win_07_increments(spark, sf):
    years = P.records(spark, sf).groupBy(F.year("published").cast("bigint").alias("year")).agg(F.round(F.avg("cvss"), 4).alias("v"))
    return E.increments(years, "year", "v")


@query("WITH r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY score DESC) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS a, rank() OVER (PARTITION BY model ORDER BY label DESC) + (count(*) OVER (PARTITION BY model, label) - 1) / 2 AS b FROM scores) SELECT model, round(corr(a, b), 6) AS rho FROM r GROUP BY 1", ("records", "scores"))
def eva_17_spearman(spark, sf):
    return E.spearman(P.long_scores(spark, sf))


_PAIRS = _LINEAR + """, pr AS (SELECT a.model AS model_a, b.model AS model_b, a.ndcg AS a, b.ndcg AS b FROM lin a JOIN lin b ON a.week = b.week AND a.model < b.model)"""


def _pairs(spark, sf):
    from riskweave.operators.joins import paired

    return paired(E.linear_ndcg(P.long_scores(spark, sf), "week", 10).withColumn("ndcg", F.round("ndcg", 6)), ["week"], "model", "ndcg")


@query(_PAIRS + """, d AS (SELECT model_a, model_b, round(a - b, 12) AS d FROM pr WHERE round(a - b, 12) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2 AS r FROM d)
SELECT model_a, model_b, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS w FROM r GROUP BY 1, 2""", ("records", "scores"))
def sig_01_wilcoxon(spark, sf):
    return T.wilcoxon(_pairs(spark, sf), ["model_a", "model_b"]).select("model_a", "model_b", "n", "w")


@query(_PAIRS + " SELECT model_a, model_b, count(*) AS n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 5) AS t FROM pr GROUP BY 1, 2", ("records", "scores"))
def sig_02_paired_t(spark, sf):
    return T.paired_t(_pairs(spark, sf), ["model_a", "model_b"]).select("model_a", "model_b", "n", F.round("t", 5).alias("t"))


@query("""WITH t AS (SELECT cwe AS name, round(avg(epss_score) / 20, 6) AS p FROM records WHERE cwe IS NOT NULL GROUP BY 1), r AS (SELECT name, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)) AS raw FROM t)
SELECT name, p, round(least(1.0, p * count(*) OVER ()), 6) AS p_bonferroni, round(max(raw) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""")
def sig_03_corrections(spark, sf):
    tests = P.records(spark, sf).where("cwe IS NOT NULL").groupBy(F.col("cwe").alias("name")).agg(F.round(F.avg("epss_score") / 20, 6).alias("p"))
    return T.holm(T.bonferroni(tests, 0.05), 0.05, "name").select("name", "p", F.round("p_bonferroni", 6).alias("p_bonferroni"), F.round("p_holm", 6).alias("p_holm"))


@query(_LINEAR + ", v AS (SELECT model, rank() OVER (ORDER BY ndcg) + (count(*) OVER (PARTITION BY ndcg) - 1) / 2 AS r FROM lin WHERE model IN ('a', 'b')), s AS (SELECT sum(r) FILTER (model = 'a') AS r, count(*) FILTER (model = 'a') AS m, count(*) FILTER (model = 'b') AS n FROM v) SELECT round(2 * (r - m * (m + 1) / 2) / (m * n) - 1, 6) AS delta FROM s", ("records", "scores"))
def sig_05_cliffs_delta(spark, sf):
    v = E.linear_ndcg(P.long_scores(spark, sf), "week", 10).withColumn("ndcg", F.round("ndcg", 6)).where("model IN ('a', 'b')")
    return T.cliffs_delta(v, F.col("model") == "a", "ndcg")


_STABILITY = """WITH m AS (SELECT year(published)::VARCHAR AS run, cwe AS feature, round(avg(epss_score), 6) AS v FROM records WHERE cwe IS NOT NULL AND year(published) IN (1996, 1997, 1998) GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY v DESC) + (count(*) OVER (PARTITION BY run, v) - 1) / 2 AS r, row_number() OVER (PARTITION BY run ORDER BY v DESC, feature) <= 5 AS top FROM m),
st AS (SELECT a.run AS run_a, b.run AS run_b, round(corr(a.r, b.r), 6) AS rho, round(100.0 * count_if(a.top AND b.top) / 5, 4) AS overlap_pct FROM r a JOIN r b ON a.feature = b.feature AND a.run < b.run GROUP BY 1, 2)"""


@query(_STABILITY + " SELECT * FROM st")
def sig_06_stability(spark, sf):
    runs = P.records(spark, sf).where("cwe IS NOT NULL AND year(published) IN (1996, 1997, 1998)").groupBy(F.year("published").cast("string").alias("run"), F.col("cwe").alias("feature")).agg(F.round(F.avg("epss_score"), 6).alias("v"))
    return T.stability(runs, "run", "feature", "v", 5)


@query(_STABILITY + " SELECT min(rho) AS least_rho, min(overlap_pct) AS least_overlap, min(rho) >= 0.9 AND min(overlap_pct) >= 80 AS stable FROM st")
def sig_06_rule(spark, sf):
    return T.stable(sig_06_stability(spark, sf))


_Z = "WITH z AS (SELECT cve_id, model, label, (score - avg(score) OVER (PARTITION BY model)) / stddev_pop(score) OVER (PARTITION BY model) AS z FROM scores)"


@query(_Z + " SELECT cve_id, round(avg(z), 6) AS score FROM z GROUP BY 1", ("records", "scores"))
def ens_01_simple_average(spark, sf):
    return _rounded(U.simple_average(P.long_scores(spark, sf)), "cve_id")


@query()
def ens_02_fitted_weights(spark, sf):
    return U.fitted_weights(P.long_scores(spark, sf))


@query("SELECT cve_id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT cve_id, row_number() OVER (PARTITION BY model ORDER BY score DESC, cve_id) AS r FROM scores) GROUP BY 1", ("records", "scores"))
def ens_04_reciprocal_rank(spark, sf):
    return _rounded(U.reciprocal_rank(P.long_scores(spark, sf)), "cve_id")


@query("SELECT cve_id, sum(n - r + 1)::BIGINT AS score FROM (SELECT cve_id, row_number() OVER (PARTITION BY model ORDER BY score DESC, cve_id) AS r, count(*) OVER (PARTITION BY model) AS n FROM scores) GROUP BY 1", ("records", "scores"))
def ens_05_borda(spark, sf):
    return U.borda(P.long_scores(spark, sf)).select("cve_id", F.col("score").cast("bigint").alias("score"))


@query("""WITH t AS (SELECT model, cve_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, cve_id) AS n FROM scores) WHERE n <= 50), c AS (SELECT a.model AS x, b.model AS y, count(*) AS c FROM t a JOIN t b ON a.cve_id = b.cve_id AND a.model < b.model GROUP BY 1, 2)
SELECT a.model AS model_a, b.model AS model_b, round(coalesce(any_value(c.c), 0) / (100 - coalesce(any_value(c.c), 0)), 6) AS jaccard, round(corr(a.score, b.score), 6) AS correlation FROM scores a JOIN scores b ON a.cve_id = b.cve_id AND a.model < b.model LEFT JOIN c ON c.x = a.model AND c.y = b.model GROUP BY 1, 2""", ("records", "scores"))
def ens_06_diversity(spark, sf):
    return U.diversity(P.long_scores(spark, sf), 50)


@query("SELECT cve_id, round(sum(score * w) / sum(w), 6) AS score FROM (SELECT cve_id, score, CASE model WHEN 'a' THEN 0.6 WHEN 'b' THEN 0.3 ELSE 0.45 END::DOUBLE AS w FROM scores) GROUP BY 1", ("records", "scores"))
def ens_07_weighted(spark, sf):
    weights = spark.createDataFrame([("a", 0.6), ("b", 0.3)], "model string, weight double")
    return _rounded(U.weighted_average(P.long_scores(spark, sf), weights), "cve_id")


@query("SELECT DISTINCT cve_id, trim(x) AS item FROM (SELECT cve_id, unnest(string_split(cwe, ',')) AS x FROM records) WHERE lower(trim(x)) NOT IN ('', 'nan', 'none')")
def gra_01_bipartite(spark, sf):
    return G.bipartite(P.records(spark, sf))


def _walk_sql(rounds, restart, base="base", name="r"):
    steps = f"{name}0 AS (SELECT id, s AS score FROM {base})"
    for i in range(1, rounds + 1):
        steps += f", {name}{i} AS (SELECT b.id, (1 - {restart}) * coalesce(sum(r.score * e.share), 0) + {restart} * any_value(b.s) AS score FROM {base} b LEFT JOIN sh e ON e.dst = b.id LEFT JOIN {name}{i - 1} r ON r.id = e.src GROUP BY b.id)"
    return steps


def _base_sql(name, flag):
    seeds = f"(SELECT cve_id FROM records WHERE {flag} = 1)"
    return f"{name} AS (SELECT id, CASE WHEN id IN {seeds} THEN 1.0 ELSE 0.0 END::DOUBLE / (SELECT count(DISTINCT src) FROM sh WHERE src IN {seeds}) AS s FROM (SELECT DISTINCT src AS id FROM sh))"


_EDGES = """WITH ed AS (SELECT DISTINCT cve_id AS src, trim(x) AS dst, 1.0::DOUBLE AS weight FROM (SELECT cve_id, unnest(string_split(cwe, ',')) AS x FROM records) WHERE lower(trim(x)) NOT IN ('', 'nan', 'none')),
bo AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM ed UNION ALL SELECT dst, src, weight FROM ed) GROUP BY 1, 2), sh AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM bo)"""
_KEV_WALK = f"{_EDGES}, {_base_sql('base', 'kev_flag')}"


def _edges(spark, sf):
    """Every record with each of its weaknesses."""
    return G.bipartite(P.records(spark, sf)).select(F.col("cve_id").alias("src"), F.col("item").alias("dst"), F.lit(1.0).alias("weight"))


def _seeds(spark, sf, flag):
    return P.records(spark, sf).where(F.col(flag) == 1).select(F.col("cve_id").alias("id"), F.lit(1.0).alias("score"))


@query(f"{_KEV_WALK}, {_walk_sql(10, 0.4)} SELECT id, round(score, 9) AS score FROM r10")
def gra_04_diffusion(spark, sf):
    return _rounded(G.diffusion(_edges(spark, sf), _seeds(spark, sf, "kev_flag"), restart=0.4, rounds=10, tolerance=0.0), "id", digits=9)


@query(f"{_KEV_WALK}, {_walk_sql(10, 0.15)} SELECT id, round(score, 9) AS score FROM r10")
def gra_05_personalised(spark, sf):
    return _rounded(G.personalised_rank(_edges(spark, sf), _seeds(spark, sf, "kev_flag"), 0.85, rounds=10, tolerance=0.0), "id", digits=9)


@query("""WITH e AS (SELECT cve_id, coalesce(cwe, 'none') AS c FROM records), m AS (SELECT coalesce(cwe, 'none') AS c, avg(coalesce(cvss, 0)) AS v FROM records GROUP BY 1) SELECT cve_id, round(v, 6) AS mean FROM e JOIN m USING (c)""")
def gra_10_neighbours(spark, sf):
    r = P.records(spark, sf).select(F.col("cve_id").alias("id"), F.coalesce("cvss", F.lit(0.0)).alias("x"), F.coalesce("cwe", F.lit("none")).alias("cwe"))
    edges = r.select(F.col("id").alias("src"), F.col("cwe").alias("dst"), F.lit("weakness").alias("relation"))
    nodes = r.select("id", "x").unionByName(r.select(F.col("cwe").alias("id"), F.lit(0.0).alias("x")).distinct())
    out = G.neighbour_means(edges, nodes, ["x"], hops=1)
    back = r.select("id", "cwe").join(out.select(F.col("id").alias("cwe"), F.col("weakness_1_x").alias("mean")), "cwe")
    return back.select(F.col("id").alias("cve_id"), F.round("mean", 6).alias("mean"))


@query("""WITH b AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = 'c1'), h2 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM h1))
SELECT id, min(hop)::BIGINT AS hop FROM (SELECT 'c1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1""", views=())
def gra_11_two_hops(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    edges = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    return G.two_hops(edges, edges.where("src = 'c1'").select(F.col("src").alias("id")))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_inner_product(a.e, b.e), 9) AS w FROM n a JOIN n b ON a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS p FROM s WHERE w >= 0.4)
SELECT src, dst, round(w, 6) AS weight FROM k WHERE p <= 10""", views=())
def gra_02_similar(spark, sf):
    return _rounded(G.similar(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 10, 0.4), "src", "dst")


def _words(term):
    return "\\b" + "\\s+".join(term.split(" ")) + "\\b"


def _regex(terms):
    import re

    return "|".join("\\b" + "\\s+".join(re.escape(w) for w in t.split(" ")) + "\\b" for t in terms).replace("'", "''")


_PRODUCTS = [t for terms in V.HEALTH_PRODUCT_TERMS.values() for t in terms]


def _short_long(terms):
    short, long = [t for t in terms if len(t) <= 4 and t.isalpha()], [t for t in terms if not (len(t) <= 4 and t.isalpha())]
    return f"(regexp_matches(t, '{_regex(short)}') OR {_has(long, 't')})"


_HEALTH = f"""WITH x AS (SELECT cve_id, lower(coalesce(description, '')) AS t FROM records), y AS (SELECT cve_id, CASE {" ".join(f"WHEN regexp_matches(t, '{_regex(terms)}') THEN '{name}'" for name, terms in V.HEALTH_VENDOR_TERMS.items())} END AS matched_vendor,
{_short_long(_PRODUCTS)}::BIGINT AS has_product, {_short_long(V.HEALTH_KEYWORDS)}::BIGINT AS has_keyword FROM x), z AS (SELECT *, round(least(1.0, CASE WHEN matched_vendor IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE + has_product * 0.3::DOUBLE + has_keyword * 0.2::DOUBLE), 6) AS health_score FROM y)"""


@query(_HEALTH + " SELECT *, (health_score > 0.3)::BIGINT AS health_flag FROM z")
def txt_01_04_health(spark, sf):
    return _rounded(TM.health_score(P.records(spark, sf).select("cve_id", "description")).drop("description"), "cve_id")


@query("SELECT p_partkey, (regexp_matches(lower(p_name), '\\bpart\\b') OR contains(lower(p_name), '#1'))::BIGINT AS pattern_flag FROM part", views=())
def txt_06_pattern_flag(spark, sf):
    return TM.pattern_flag(spark.read.parquet(f"{sf}/part.parquet"), ["part", "#1"], "p_name").select("p_partkey", F.col("pattern_flag").cast("bigint").alias("pattern_flag"))


_TERMS = [("infusion pump", "T1"), ("remote code execution", "T2"), ("denial of service", "T3"), ("sql injection", "T2"), ("pump", "T4"), ("linux", "T5")]
_TERM_VALUES = ", ".join(f"('{t}', '{k}')" for t, k in _TERMS)


def _term_table(spark):
    return spark.createDataFrame(_TERMS, "term string, technique string")


@query(f"""WITH v(term, technique) AS (VALUES {_TERM_VALUES}) SELECT cve_id, array_to_string(list_sort(list(DISTINCT technique)), ',') AS ids, count(DISTINCT technique) AS n FROM records JOIN v ON contains(' ' || lower(coalesce(description, '')) || ' ', ' ' || term || ' ') GROUP BY 1""")
def joi_11_techniques(spark, sf):
    out = TM.techniques(P.records(spark, sf).select("cve_id", "description"), "cve_id", "description", _term_table(spark))
    return out.select("cve_id", F.array_join("ids", ",").alias("ids"), F.col("n").cast("bigint").alias("n"))


_INFO = [("T1", "Pump control"), ("T2", "Code injection"), ("T4", "Pump access"), ("T5", "Kernel flaw")]
_LONG_TERMS = [("buffer overflow allows elevated privileges", "T6"), ("missing validation of commands", "T7"), ("in the dicom viewer", "T8"), ("cross-site scripting in comments", "T9")]
_INFO_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _INFO)
_LONG_VALUES = ", ".join(f"('{t}', '{k}')" for t, k in [*_TERMS, *_LONG_TERMS])


@query(f"""WITH v(term, technique) AS (VALUES {_LONG_VALUES}), i(technique, name) AS (VALUES {_INFO_VALUES}), h AS (SELECT DISTINCT cve_id, technique FROM records JOIN v ON contains(' ' || lower(coalesce(description, '')) || ' ', ' ' || term || ' '))
SELECT cve_id, array_to_string(list(technique ORDER BY technique), ',') AS ids, coalesce(array_to_string(list(name ORDER BY technique) FILTER (name IS NOT NULL), ','), '') AS names, count(*) AS n FROM h LEFT JOIN i USING (technique) GROUP BY 1""")
def txt_09_technique_info(spark, sf):
    vocabulary = spark.createDataFrame([*_TERMS, *_LONG_TERMS], "term string, technique string")
    hits = TM.techniques(P.records(spark, sf).select("cve_id", "description"), "cve_id", "description", vocabulary)
    out = TM.technique_info(hits, spark.createDataFrame(_INFO, "technique string, name string"))
    return out.select("cve_id", F.array_join("ids", ",").alias("ids"), F.array_join("names", ",").alias("names"), F.col("n").cast("bigint").alias("n"))


_VENDORS = ["medtronic", "philips", "siemens", "epic", "ge healthcare", "cerner"]
_PRODUCT_NAMES = ["dicom viewer", "database", "linux kernel", "apache server", "exchange remote code execution"]


@query(f"""WITH v AS (SELECT unnest(range(1, {len(_VENDORS) + 1})) AS p, unnest({_VENDORS}) AS name), w AS (SELECT unnest(range(1, {len(_PRODUCT_NAMES) + 1})) AS p, unnest({_PRODUCT_NAMES}) AS name), d AS (SELECT cve_id, lower(coalesce(description, '')) AS t FROM records),
hv AS (SELECT cve_id, list('vendor:' || name ORDER BY p, name)[1:3] AS m FROM d JOIN v ON length(name) > 4 AND contains(t, name) GROUP BY 1),
hp AS (SELECT cve_id, list('product:' || name ORDER BY p, name)[1:3] AS m FROM d JOIN w ON contains(' ' || t || ' ', ' ' || name || ' ') WHERE cve_id NOT IN (SELECT cve_id FROM hv) GROUP BY 1)
SELECT cve_id, (x.m IS NOT NULL)::BIGINT AS flag, coalesce(array_to_string(x.m, ','), '') AS matched FROM d LEFT JOIN (SELECT * FROM hv UNION ALL SELECT * FROM hp) x USING (cve_id)""")
def joi_12_two_stages(spark, sf):
    named = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "name string, priority int")
    out = TM.catalogue_match(P.records(spark, sf), "cve_id", "description", named(_VENDORS), named(_PRODUCT_NAMES))
    return out.select("cve_id", F.col("flag").cast("bigint").alias("flag"), F.array_join("matched", ",").alias("matched"))


@query(f"""WITH v(term, name) AS (VALUES {_TERM_VALUES}), h AS (SELECT DISTINCT cve_id, name, CASE WHEN name = 'T4' THEN 0 ELSE 1 END AS priority FROM records JOIN v ON contains(' ' || lower(coalesce(description, '')) || ' ', ' ' || term || ' '))
SELECT cve_id, array_to_string(list(name ORDER BY priority, name)[1:2], ',') AS products FROM h GROUP BY 1""")
def joi_12_catalogue(spark, sf):
    vocabulary = _term_table(spark).select("term", F.col("technique").alias("name"), F.when(F.col("technique") == "T4", 0).otherwise(1).alias("priority"))
    out = TM.catalogue_hits(P.records(spark, sf).select("cve_id", "description"), "cve_id", "description", vocabulary, 2)
    return out.select("cve_id", F.array_join("products", ",").alias("products"))


@query("WITH b AS (SELECT DISTINCT trim(unnest(string_split(lower(text), '.'))) AS term FROM benchmark) SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM b WHERE length(term) >= 8 AND contains(lower(text), term))", views=())
def joi_10_mentioned(spark, sf):
    sentences = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), r"\.")).alias("s"))
    terms = sentences.select(F.trim("s").alias("term")).distinct()
    return TM.mentioned(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", terms, 8).select("doc_id")


def _grams_sql(table, key, text):
    """(key, g, tf) of the runs of three to five characters of blank-padded words; a longer run only while the padded word is longer than the run before."""
    parts = " UNION ALL ".join(
        f"SELECT k, unnest(list_transform(range(1, greatest(1, length(w) - {n} + 1) + 1), lambda i: substr(w, i, {n}))) AS g FROM w{'' if n == 3 else f' WHERE length(w) > {n - 1}'}" for n in (3, 4, 5)
    )
    return f"""(WITH w AS (SELECT k, ' ' || x || ' ' AS w FROM (SELECT {key} AS k, unnest(string_split(trim(regexp_replace(lower(coalesce({text}, '')), '\\s+', ' ', 'g')), ' ')) AS x FROM {table}) WHERE x <> '')
    SELECT k, g, count(*) AS tf FROM ({parts}) GROUP BY 1, 2)"""


_FUZZY_TERMS = ", ".join(f"('{t}')" for t, _ in _TERMS)
_FUZZY = f"""WITH t(term) AS (VALUES {_FUZZY_TERMS}), tg AS {_grams_sql('t', 'term', 'term')}, idf AS (SELECT g, ln((1 + (SELECT count(*) FROM t)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tg GROUP BY 1),
tw AS (SELECT k, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS w FROM tg JOIN idf USING (g)), dg AS {_grams_sql('records', 'cve_id', 'description')},
dv AS (SELECT k, g, tf * idf AS v FROM dg JOIN idf USING (g)), dl AS (SELECT k, sqrt(sum(v * v)) AS l FROM dv GROUP BY 1),
fz AS (SELECT cve_id, max(dot / l) AS best FROM (SELECT dv.k AS cve_id, tw.k AS term, sum(v * w) AS dot FROM dv JOIN tw USING (g) GROUP BY 1, 2) JOIN dl ON dl.k = cve_id GROUP BY 1)"""


def _fuzzy_terms(spark):
    return spark.createDataFrame([(t,) for t, _ in _TERMS], "term string")


@query(_FUZZY + " SELECT cve_id, round(best, 6) AS best FROM fz")
def txt_07_fuzzy(spark, sf):
    return _rounded(TM.fuzzy_scores(P.records(spark, sf).select("cve_id", "description"), "cve_id", "description", _fuzzy_terms(spark)), "cve_id")


@query(_FUZZY + f""" SELECT r.cve_id, round(coalesce(best, 0.0), 6) AS similarity, ((coalesce(best, 0.0) >= 0.6 OR EXISTS (SELECT 1 FROM t WHERE contains(lower(coalesce(description, '')), term)))
AND ({" OR ".join(f"contains(lower(coalesce(description, '')), '{a}')" for a in V.ANCHORS)}))::BIGINT AS flag FROM records r LEFT JOIN fz USING (cve_id)""")
def txt_07_flag(spark, sf):
    out = TM.fuzzy_flag(P.records(spark, sf).select("cve_id", "description"), "cve_id", "description", _fuzzy_terms(spark), V.ANCHORS)
    return _rounded(out, "cve_id")


_STOPS = ", ".join(f"'{w}'" for w in V.TERM_STOP_WORDS)


@query(f"""WITH x AS (SELECT DISTINCT lower(trim(p_name || ' ' || p_type || ' ' || p_brand)) AS t FROM part), k AS (SELECT t, list_filter(regexp_extract_all(t, '[a-z][a-z0-9_-]{{3,}}'), lambda w: NOT list_contains([{_STOPS}], w)) AS k FROM x),
e AS (SELECT t AS term FROM k WHERE length(t) BETWEEN 1 AND 80 UNION SELECT p FROM (SELECT unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS p FROM k WHERE len(k) > 1) WHERE length(p) >= 8)
SELECT term FROM e WHERE length(term) BETWEEN 5 AND 80 ORDER BY term LIMIT 3000""", views=())
def txt_08_term_list(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return TM.term_list(parts, ["text"], V.TERM_STOP_WORDS)


@query("SELECT cve_id, CASE " + " ".join(f"WHEN contains(lower(coalesce(description, '')), '{v}') THEN '{v}'" for v in sorted({*V.PUBLICATION_HIGH_RISK, *V.PUBLICATION_HEALTHCARE})) + " END AS vendor FROM records")
def txt_11_listed_vendor(spark, sf):
    return P.records(spark, sf).select("cve_id", B.listed_vendor(F.col("description")).alias("vendor"))


def _vendor_sql(text="description"):
    t = f"lower(coalesce({text}, ''))"
    cases = " ".join(f"WHEN length({v}) >= 2 AND {v} NOT IN ({', '.join(repr(x) for x in V.NO_VENDORS)}) THEN {v}" for v in (f"trim(regexp_extract({t}, '{p}', 1))" for p in V.VENDOR_PATTERNS))
    first = f"regexp_replace(regexp_extract(trim({t}), '^\\S+'), '[^a-z0-9]', '', 'g')"
    return f"CASE {cases} WHEN length({first}) >= 2 THEN {first} ELSE 'unknown_vendor' END"


@query(f"SELECT cve_id, {_vendor_sql()} AS vendor FROM records")
def fn_05_vendor(spark, sf):
    return P.records(spark, sf).select("cve_id", X.vendor_of(F.col("description")).alias("vendor"))


_ISSUES = """WITH x AS (SELECT cve_id AS id, description AS d, cvss AS c, published::DATE AS p FROM faulty), iss AS (SELECT 'records' AS feed, s AS severity, i AS issue, n FROM (
SELECT 'error' AS s, 'repeated_id' AS i, count(*) - count(DISTINCT id) AS n FROM x UNION ALL SELECT 'error', 'bad_id', count_if(NOT regexp_matches(id, '^CVE-[0-9]{4}-[0-9]{4,}$')) FROM x UNION ALL SELECT 'warning', 'missing_cvss', count(*) - count(c) FROM x
UNION ALL SELECT 'error', 'bad_cvss', count_if(c < 0 OR c > 10) FROM x UNION ALL SELECT 'error', 'missing_date', count_if(p IS NULL) FROM x
UNION ALL SELECT 'error', 'future_date', count_if(p > DATE '2000-01-01') FROM x UNION ALL SELECT 'info', 'older_than_two_years', count_if(p < DATE '1998-01-01') FROM x UNION ALL SELECT 'warning', 'empty_description', count_if(trim(coalesce(d, '')) = '') FROM x
UNION ALL SELECT 'info', 'short_description', count_if(trim(d) <> '' AND length(d) < 50) FROM x))"""


@query(_ISSUES + " SELECT * FROM iss", ("records", "faulty"))
def dq_01_record_issues(spark, sf):
    return D.record_issues(P.faulty(spark, sf), "2000-01-01")


@query("SELECT 'exploited' AS feed, s AS severity, i AS issue, n FROM (SELECT 'warning' AS s, 'repeated' AS i, count(*) - count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'error', 'missing', 0 UNION ALL SELECT 'error', 'format', 0 UNION ALL SELECT 'info', 'distinct', count(DISTINCT l_orderkey) FROM lineitem)", views=())
def dq_02_list_issues(spark, sf):
    return D.list_issues(spark.read.parquet(f"{sf}/lineitem.parquet"), "exploited", "l_orderkey", r"^\d+$")


@query("""SELECT r AS rule, n AS broken, round(n / (SELECT count(*) FROM faulty), 6) AS share FROM (SELECT 'score_without_date' AS r, count_if(epss_score > 0 AND epss_date IS NULL) AS n FROM faulty
UNION ALL SELECT 'score_range', count_if(epss_score NOT BETWEEN 0 AND 1 OR epss_percentile NOT BETWEEN 0 AND 1) FROM faulty UNION ALL SELECT 'missing_healthcare_score', count_if(healthcare_score IS NULL) FROM faulty
UNION ALL SELECT 'flag_against_score', count_if((is_healthcare = 1) <> (healthcare_score > 0.3)) FROM faulty UNION ALL SELECT 'curated_without_severity', count_if(is_curated = 1 AND curated_severity IS NULL) FROM faulty
UNION ALL SELECT 'technique_without_flag', count_if((attack_technique_count > 0) <> (attack_flag = 1)) FROM faulty)""", ("records", "faulty"))
def dq_05_consistency(spark, sf):
    return D.consistency(P.faulty(spark, sf))


@query("SELECT count(*) AS records, sum(kev_flag)::BIGINT AS exploited, sum(is_healthcare)::BIGINT AS healthcare, max(published)::DATE::VARCHAR AS last_day, 'healthy' AS status FROM records")
def dq_06_health(spark, sf):
    return D.health(P.records(spark, sf), 10).withColumn("last_day", F.col("last_day").cast("string"))


@query("SELECT 'cvss' AS \"column\", count_if(cvss <> 0) AS nonzero, round(sum(cvss), 4) AS total FROM records UNION ALL SELECT 'epss_score', count_if(epss_score <> 0), round(sum(epss_score), 4) FROM records")
def dq_07_column_audit(spark, sf):
    return D.column_audit(P.records(spark, sf), ["cvss", "epss_score"])


@query(f"{_SCORED}, w AS (SELECT *, round({_weights_sql(S.WEIGHTED)}, 9) AS score FROM s) SELECT cve_id, round(score, 6) AS score, cvss FROM w WHERE cve_id IN (SELECT cve_id FROM records WHERE cvss >= 6.0 AND is_healthcare = 1) ORDER BY w.score DESC, cve_id LIMIT 25".replace("FROM w WHERE", "FROM w WHERE"))
def qry_02_top_records(spark, sf):
    out = N.top_records(P.records(spark, sf).where("cvss IS NOT NULL").unionByName(P.records(spark, sf).where("cvss IS NULL")), REFERENCE, 25, min_cvss=6.0, healthcare_only=True)
    return out.select("cve_id", F.round("score", 6).alias("score"), "cvss")


@query("SELECT cve_id, n AS signals, CASE WHEN n >= 3 THEN 'P1' WHEN n = 2 THEN 'P2' ELSE 'P3' END AS priority, cvss FROM (SELECT *, kev_flag + chpl_flag + attack_flag AS n FROM records) WHERE n >= 1 ORDER BY n DESC, cvss DESC NULLS LAST, cve_id LIMIT 25")
def qry_07_multi_signal(spark, sf):
    return N.multi_signal(P.records(spark, sf), 25)


@query("SELECT cve_id, cvss FROM records WHERE is_healthcare = 1 AND kev_flag = 1 ORDER BY cvss DESC NULLS LAST, cve_id LIMIT 20")
def qry_04_06_lists(spark, sf):
    return R.top(P.records(spark, sf).where("is_healthcare = 1 AND kev_flag = 1"), [F.desc_nulls_last("cvss"), F.asc("cve_id")], 20).select("cve_id", "cvss")


def _recommended_sql(k, where, age="age"):
    features = _FEATURES.replace("FROM records", "FROM records WHERE cvss IS NOT NULL", 1)
    scored = f"s AS (SELECT *, {'c / 10.0'} AS cvss_norm, e AS epss FROM g), w AS (SELECT cve_id, round({_weights_sql(S.WEIGHTED).replace('epss_score', 'epss')}, 9) AS score, cvss, kev_flag, is_healthcare, published, substr(coalesce(description, ''), 1, 200) AS summary FROM s)"
    return f"WITH {features}, {scored}, b AS (SELECT * FROM w WHERE {where} ORDER BY score DESC, cve_id LIMIT {k}), rec AS (SELECT row_number() OVER (ORDER BY score DESC, cve_id)::INTEGER AS place, cve_id, score, cvss, kev_flag, is_healthcare, summary FROM b)"


def _six(df):
    return df.withColumn("score", F.round("score", 6))


@query(_recommended_sql(50, "cvss >= 5.0") + " SELECT place, cve_id, round(score, 6) AS score, cvss, kev_flag, is_healthcare, summary FROM rec")
def qry_01_recommendations(spark, sf):
    return _six(N.recommendations(P.records(spark, sf), REFERENCE, 50, min_cvss=5.0))


_AUDIT_WORD = "regexp_matches(lower(summary), 'patient|hospital|medical|health|clinical')"


@query(_recommended_sql(50, "true") + f""", a AS (SELECT *, {_AUDIT_WORD} AS word, CASE WHEN kev_flag = 1 OR cvss >= 9 THEN 'HIGH' WHEN cvss >= 7 OR {_AUDIT_WORD} THEN 'MEDIUM' ELSE 'LOW' END AS r FROM rec)
SELECT sum(kev_flag)::BIGINT AS exploited, count_if(cvss >= 9) AS critical, count_if(word) AS health_words, count_if(r = 'HIGH') AS review_high, count_if(r = 'MEDIUM') AS review_medium, count_if(r = 'LOW') AS review_low FROM a""")
def top_06_audit(spark, sf):
    return N.audit(N.recommendations(P.records(spark, sf), REFERENCE, 50))


@query("""SELECT cve_id, published::DATE::VARCHAR AS published, cvss, epss_score, healthcare_score, chpl_flag, kev_flag, substr(description, 1, 80) AS summary FROM records WHERE is_healthcare = 1
ORDER BY cvss DESC NULLS LAST, healthcare_score DESC NULLS LAST, cve_id LIMIT 20""")
def qry_05_healthcare(spark, sf):
    return N.healthcare_by_severity(P.records(spark, sf)).withColumn("published", F.to_date("published").cast("string"))


@query("""SELECT cve_id, published::DATE::VARCHAR AS published, cvss, epss_score, healthcare_score, kev_flag, substr(description, 1, 80) AS summary FROM records WHERE chpl_flag = 1
ORDER BY cvss DESC NULLS LAST, epss_score DESC NULLS LAST, cve_id LIMIT 20""")
def qry_06_certified(spark, sf):
    return N.certified_products(P.records(spark, sf)).withColumn("published", F.to_date("published").cast("string"))


_NOW = "2001-07-01"
_RECENT_FEATURES = _recommended_sql(20, "cvss >= 4.0").replace("DATE '2002-01-01'", f"DATE '{_NOW}'").replace("WHERE cvss IS NOT NULL", f"WHERE cvss IS NOT NULL AND published BETWEEN TIMESTAMP '{_NOW}' - INTERVAL 90 DAY AND TIMESTAMP '{_NOW}'")


@query(_RECENT_FEATURES + " SELECT place, cve_id, round(score, 6) AS score, cvss, kev_flag, is_healthcare, summary FROM rec")
def qry_03_recent(spark, sf):
    return _six(N.recent(P.records(spark, sf), _NOW, 90, 20, 4.0))


@query("""WITH a AS (SELECT key, '<li>Advisory ' || lower(cve_id) || ', see CVE-1999-' || lpad((key % 5000)::VARCHAR, 4, '0') || '</li>' AS html FROM records)
SELECT id, count(*) AS n FROM (SELECT DISTINCT key, upper(unnest(regexp_extract_all(html, '(?i)(CVE-[0-9]{4}-[0-9]{4,})', 1))) AS id FROM a) GROUP BY 1""")
def src_10_advisory_ids(spark, sf):
    r = P.records(spark, sf)
    older = F.concat(F.lit("CVE-1999-"), F.lpad((F.col("key") % 5000).cast("string"), 4, "0"))
    return feeds.advisory_ids(r.select(F.concat(F.lit("<li>Advisory "), F.lower("cve_id"), F.lit(", see "), older, F.lit("</li>")).alias("html")), "html")


@query("SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2", views=())
def str_02_over_budget(spark, sf):
    out = jobs.over_budget(spark.read.parquet(f"{sf}/events.parquet"), 2, "60 minutes")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1", views=())
def str_03_progress(spark, sf):
    return jobs.progress(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value").select("event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INTEGER AS new FROM events), s AS (SELECT user_id, ts, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1, 2""", views=())
def str_sessions(spark, sf):
    out = jobs.sessions(spark.read.parquet(f"{sf}/events.parquet"))
    return out.groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))


@query("SELECT r.cve_id, h.epss_date::VARCHAR AS at FROM records r JOIN history h ON h.cve_id = r.cve_id AND h.epss_date BETWEEN r.published::DATE AND r.published::DATE + 30", ("records", "history"))
def str_06_within_horizon(spark, sf):
    signals = P.signal_history(spark, sf).select("cve_id", F.col("epss_date").cast("timestamp").alias("at"))
    return jobs.within_horizon(P.records(spark, sf), signals, 30).select("cve_id", F.to_date("at").cast("string").alias("at"))


@query("SELECT event_type AS stage, arg_max(value, ts) AS status, count(*) AS n FROM events GROUP BY 1", views=())
def str_07_latest_status(spark, sf):
    return jobs.latest_status(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value").select(F.col("event_type").alias("stage"), "status", "n")


_FEATURE_LIST = ["kev_flag", "epss_score", "cvss_norm", "is_healthcare", "recency", "has_attack"]


def _training(spark, sf):
    f = B.record_features(P.records(spark, sf), REFERENCE).withColumn("grade", F.least(F.col("label"), F.lit(3)))
    return M.training_rows(f.withColumn("week", F.col("published_week")), _FEATURE_LIST, "grade")


@query()
def mod_02_pairwise_ranker(spark, sf):
    rows = stage(_training(spark, sf), "training-rows")
    scored = M.linear_scores(rows, M.fit_pairwise(rows, _FEATURE_LIST, per_row=4, rounds=10))
    return scored.select("cve_id", F.round("score", 6).alias("score"))


_SIDE = "CASE WHEN ('0x' || substr(md5(a.cve_id || '#' || b.cve_id), 1, 8))::BIGINT % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE"


@query(f"""{_SCORED}, x AS (SELECT s.cve_id, f.week AS "group", least(f.label, 3)::DOUBLE AS label, {", ".join(f"s.{c}::DOUBLE AS {c}" for c in ["kev_flag", "epss_score", "cvss_norm", "is_healthcare", "recency", "has_attack"])} FROM s JOIN f USING (cve_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY md5(cve_id), cve_id) AS n FROM x)
SELECT a."group", {_SIDE} AS first, abs(pow(2, a.label) - pow(2, b.label)) AS pair_weight, {", ".join(f"round((a.{c} - b.{c}) * CASE WHEN (a.label > b.label) = ({_SIDE} = 1) THEN 1 ELSE -1 END, 6) + 0.0 AS {c}" for c in ["kev_flag", "epss_score", "cvss_norm", "is_healthcare", "recency", "has_attack"])}
FROM p a JOIN p b ON a."group" = b."group" AND b.n BETWEEN a.n + 1 AND a.n + 4 AND a.label <> b.label""")
def mod_03_preference_pairs(spark, sf):
    pairs = M.preference_pairs(_training(spark, sf), _FEATURE_LIST, 4)
    return pairs.select("group", "first", "pair_weight", *[(F.round(c, 6) + 0.0).alias(c) for c in _FEATURE_LIST])


@query(f"SELECT {_WEEK} AS \"group\", count(*) AS n FROM records GROUP BY 1")
def mod_01_groups(spark, sf):
    return M.group_sizes(_training(spark, sf))


@query(f"""WITH v(term, technique) AS (VALUES {_TERM_VALUES}) SELECT term, count(*) AS n FROM records JOIN v ON contains(' ' || lower(coalesce(description, '')) || ' ', ' ' || term || ' ') GROUP BY 1""")
def txt_09_term_counts(spark, sf):
    return matches(P.records(spark, sf), "cve_id", F.col("description"), _term_table(spark)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
