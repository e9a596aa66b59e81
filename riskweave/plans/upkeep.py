"""Upserts, logs, snapshots, walks and lists over risk records."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import evaluate as E
from riskweave.operators import features as B
from riskweave.operators import filters as L
from riskweave.operators import fusion as U
from riskweave.operators import graph as G
from riskweave.operators import joins as J
from riskweave.operators import models as M
from riskweave.operators import quality as D
from riskweave.operators import ranking as R
from riskweave.operators import sinks as K
from riskweave.operators import splits as SP
from riskweave.operators import stats as T
from riskweave.operators import text_match as TM
from riskweave.functions import expressions as X
from riskweave.functions.expressions import contains_any, contains_words, flag, sunday_week
from riskweave.plans.analytics import _EDGES, _FEATURE_LIST, _HEALTH, _ISSUES, _KEV_WALK, _PAIRS, _PLACED, _base_sql, _edges, _metric, _pairs, _rounded, _seeds, _training, _vendor_sql, _walk_sql
from riskweave.plans.base import REFERENCE, query
from riskweave.session import stage
from riskweave.sources import feeds
from riskweave.sources import projection as P


def _changed(spark, sf):
    """New versions of every seventh record and some records that are not there yet."""
    r = P.records(spark, sf).where("key % 7 = 0")
    new = r.select(F.when(F.col("key") % 14 == 0, F.col("cve_id")).otherwise(F.concat(F.lit("NEW-"), F.col("key").cast("string"))).alias("cve_id"), F.lit("2001-01-01").alias("published"), F.lit(9.9).alias("cvss"))
    return P.records(spark, sf).select("cve_id", F.to_date("published").cast("string").alias("published"), "cvss", "label"), new


@query("""WITH o AS (SELECT cve_id, published::DATE::VARCHAR AS published, cvss, label FROM records), n AS (SELECT CASE WHEN key % 14 = 0 THEN cve_id ELSE 'NEW-' || key END AS cve_id, '2001-01-01' AS published, 9.9::DOUBLE AS cvss FROM records WHERE key % 7 = 0)
SELECT coalesce(n.cve_id, o.cve_id) AS cve_id, coalesce(o.published, n.published) AS published, coalesce(n.cvss, o.cvss) AS cvss, label FROM o FULL JOIN n ON o.cve_id = n.cve_id""")
def snk_01_03_upsert(spark, sf):
    return K.upserted(*_changed(spark, sf))


@query("""WITH o AS (SELECT cve_id, published::DATE::VARCHAR AS published, cvss, label FROM records), n AS (SELECT CASE WHEN key % 14 = 0 THEN cve_id ELSE 'NEW-' || key END AS cve_id, '2001-01-01' AS published, 9.9::DOUBLE AS cvss, NULL::BIGINT AS label FROM records WHERE key % 7 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE cve_id NOT IN (SELECT cve_id FROM n)""")
def src_16_merge_forward(spark, sf):
    return feeds.merged_forward(*_changed(spark, sf))


@query("SELECT event_type AS fetch_type, max_by(event_id, ts) AS end_date FROM events WHERE user_id % 2 = 0 GROUP BY 1", views=())
def snk_04_last_fetch(spark, sf):
    log = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("fetch_type"), F.col("event_id").alias("end_date"), F.col("ts").alias("fetch_date"), F.when(F.col("user_id") % 2 == 0, "success").otherwise("error").alias("status"))
    return K.last_fetches(log)


@query("SELECT cve_id, cvss, o_totalprice AS price FROM records LEFT JOIN orders ON o_orderkey = key AND key % 3 = 0")
def snk_07_enriched_export(spark, sf):
    r = P.records(spark, sf).select("cve_id", "key", "cvss")
    side = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    return K.enriched_export(r, side, ["price"], "key").select("cve_id", "cvss", "price")


@query("SELECT count(*) AS wanted, count(e.cve_id) AS known, count(e.cve_id) >= 0.95 * count(*) AS skip FROM records r LEFT JOIN exploited e USING (cve_id)", ("records", "exploited"))
def src_07_cache_hits(spark, sf):
    return feeds.hit_share(P.records(spark, sf), P.exploited(spark, sf))


@query("SELECT cve_id, cvss FROM records WHERE cve_id IN (SELECT cve_id FROM exploited)", ("records", "exploited"))
def joi_06_semi(spark, sf):
    return L.by_ids(P.records(spark, sf), P.exploited(spark, sf).select(F.lower("cve_id").alias("cve_id"))).select("cve_id", "cvss")


@query(r"""SELECT cve_id, (contains(lower(coalesce(description, '')), 'pump') OR contains(lower(coalesce(description, '')), 'sql'))::BIGINT AS anywhere, regexp_matches(lower(coalesce(description, '')), '\b(ris|in)\b')::BIGINT AS words,
length(coalesce(description, '')) AS size, list_sort(list_distinct(string_split(coalesce(cwe, ''), ',')))[1] AS first_cwe FROM records""")
def fn_01_03_text(spark, sf):
    text = F.lower(F.coalesce("description", F.lit("")))
    first = F.get(F.array_sort(F.array_distinct(F.split(F.coalesce("cwe", F.lit("")), ","))), F.lit(0))
    return P.records(spark, sf).select("cve_id", flag(contains_any(text, ["pump", "sql"])).cast("bigint").alias("anywhere"), flag(contains_words(text, ["ris", "in"])).cast("bigint").alias("words"), F.length(text).cast("bigint").alias("size"), first.alias("first_cwe"))


@query("SELECT cve_id, signals, cvss FROM (SELECT cve_id, kev_flag + chpl_flag + attack_flag AS signals, cvss FROM records) ORDER BY signals DESC, cvss DESC NULLS LAST, cve_id LIMIT 25")
def top_03_by_expression(spark, sf):
    r = P.records(spark, sf).withColumn("signals", F.col("kev_flag") + F.col("chpl_flag") + F.col("attack_flag"))
    return R.top(r, [F.desc("signals"), F.desc_nulls_last("cvss"), F.asc("cve_id")], 25).select("cve_id", "signals", "cvss")


@query("""SELECT cve_id, coalesce(cvss, 5.0) AS cvss, round(coalesce(cvss, 5.0) / 10, 6) AS cvss_norm, round(1 - age / (max(age) OVER ()), 6) AS recency_score, attack_flag AS has_attack, dense_rank() OVER (ORDER BY coalesce(curated_severity, 'nan')) - 1 AS curated_severity,
0::BIGINT AS soft_label, round(coalesce(healthcare_score, 0.2), 6) AS label_confidence FROM (SELECT *, greatest(0, date_diff('day', published::DATE, DATE '2002-01-01')) AS age FROM records)""")
def fea_15_common(spark, sf):
    r = P.records(spark, sf).withColumn("label_confidence", F.col("healthcare_score"))
    out = B.common_columns(r, REFERENCE)
    return _rounded(out.select("cve_id", "cvss", "cvss_norm", "recency_score", "has_attack", "curated_severity", "soft_label", "label_confidence"), "cve_id")


@query("SELECT cve_id, round(coalesce(cvss, 5.0) / 10 * coalesce(epss_score, 0.0), 6) AS cvss_epss_product, kev_flag * is_healthcare AS kev_healthcare_interaction FROM records")
def fea_16_interactions(spark, sf):
    return _rounded(B.interactions(B.record_features(P.records(spark, sf), REFERENCE)).select("cve_id", "cvss_epss_product", "kev_healthcare_interaction"), "cve_id")


_TOPS = f"""{_KEV_WALK}, {_walk_sql(10, 0.4)}, t AS (SELECT id, score FROM r10 ORDER BY round(score, 9) DESC, id LIMIT 100)"""


@query(f"{_TOPS} SELECT avg((coalesce(label, 0) >= 3)::INTEGER) AS precision, round(avg(label), 6) AS mean_label, avg((label IS NOT NULL)::INTEGER) AS coverage FROM t LEFT JOIN records ON cve_id = id")
def gra_07_walk_quality(spark, sf):
    ranks = G.diffusion(_edges(spark, sf), _seeds(spark, sf, "kev_flag"), restart=0.4, rounds=10, tolerance=0.0).withColumn("score", F.round("score", 9))
    return G.walk_quality(ranks, P.records(spark, sf).select(F.col("cve_id").alias("id"), "label"), 100)


@query(f"""{_EDGES}, {_base_sql('ba', 'kev_flag')}, {_base_sql('bb', 'chpl_flag')}, {_walk_sql(10, 0.4, 'ba', 'ra')}, {_walk_sql(10, 0.4, 'bb', 'rb')}, w AS (SELECT 'chpl' AS walk, * FROM rb10 UNION ALL SELECT 'kev', * FROM ra10)
SELECT cve_id, round(coalesce(nullif(k.score, 0), 0.5), 9) AS kev, round(coalesce(nullif(c.score, 0), 0.5), 9) AS chpl FROM records LEFT JOIN w k ON k.id = cve_id AND k.walk = 'kev' LEFT JOIN w c ON c.id = cve_id AND c.walk = 'chpl'""")
def gra_06_08_filled(spark, sf):
    seeds = _seeds(spark, sf, "kev_flag").withColumn("walk", F.lit("kev")).unionByName(_seeds(spark, sf, "chpl_flag").withColumn("walk", F.lit("chpl")))
    ranks = G.diffusion(_edges(spark, sf), seeds, restart=0.4, rounds=10, tolerance=0.0, batch="walk")
    out = P.records(spark, sf).select("cve_id")
    for walk in ("kev", "chpl"):
        out = G.filled(out, ranks.where(F.col("walk") == walk).select("id", "score"), "cve_id", 0.5).withColumnRenamed("score", walk)
    return out.select("cve_id", F.round("kev", 9).alias("kev"), F.round("chpl", 9).alias("chpl"))


_VENDOR_COLUMNS = ["cvss", "epss_score", "kev_flag"]
_VENDOR_MEANS = ", ".join(f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / stddev_pop(coalesce({c}, 0)) OVER () AS {c}" for c in _VENDOR_COLUMNS)


@query(f"SELECT vendor, count(*) AS n, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in _VENDOR_COLUMNS)} FROM (SELECT {_vendor_sql()} AS vendor, {_VENDOR_MEANS} FROM records) GROUP BY 1")
def gra_09_vendor_means(spark, sf):
    means = G.vendor_graph(P.records(spark, sf), _VENDOR_COLUMNS)[1]
    return means.select("vendor", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in _VENDOR_COLUMNS])


@query(f"""WITH v AS (SELECT cve_id, {_vendor_sql()} AS v, published FROM records) SELECT cve_id AS src, CASE WHEN v IN (SELECT v FROM v WHERE published < TIMESTAMP '1998-01-01') THEN v ELSE 'unknown_vendor' END AS dst FROM v WHERE published >= TIMESTAMP '1998-01-01'""")
def gra_09_vendor_edges(spark, sf):
    r = P.records(spark, sf)
    return G.vendor_graph(r.where("published >= TIMESTAMP '1998-01-01'"), _VENDOR_COLUMNS, r.where("published < TIMESTAMP '1998-01-01'"))[0]


@query(_ISSUES + """ SELECT * FROM iss UNION ALL SELECT 'exploited', s, i, n FROM (SELECT 'warning' AS s, 'repeated' AS i, 0::BIGINT AS n UNION ALL SELECT 'error', 'missing', 0 UNION ALL SELECT 'error', 'format', 0 UNION ALL SELECT 'info', 'distinct', count(DISTINCT cve_id) FROM exploited)
UNION ALL SELECT 'lines', s, i, n FROM (SELECT 'warning' AS s, 'repeated' AS i, count(*) - count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'error', 'missing', 0 UNION ALL SELECT 'error', 'format', count_if(NOT regexp_matches(l_orderkey::VARCHAR, '^[0-9]{1,4}$')) FROM lineitem
UNION ALL SELECT 'info', 'distinct', count(DISTINCT l_orderkey) FROM lineitem)""", ("records", "faulty", "exploited"))
def dq_03_combined(spark, sf):
    lines = D.list_issues(spark.read.parquet(f"{sf}/lineitem.parquet"), "lines", "l_orderkey", r"^\d{1,4}$")
    return D.combined(D.record_issues(P.faulty(spark, sf), "2000-01-01"), D.list_issues(P.exploited(spark, sf), "exploited", "cve_id"), lines)


@query()
def ens_03_stacking(spark, sf):
    wide = P.long_scores(spark, sf).groupBy("cve_id").pivot("model", ["a", "b", "c"]).agg(F.first("score")).join(P.records(spark, sf).select("cve_id", F.col("label").cast("double").alias("label")), "cve_id")
    return _rounded(M.stacking(wide, ["a", "b", "c"])[1], "model")


@query()
def ens_08_bootstrap(spark, sf):
    return _rounded(U.bootstrap_ensemble(P.long_scores(spark, sf), 10), "cve_id", digits=9)


# fixed values: columns that the variants add one after another, and those that the removals leave out
_ADDED = [
    ("severity", ["cvss", "cvss_high", "cvss_critical"]), ("exploited", ["kev_flag"]), ("exploit score", ["epss_score", "epss_percentile", "epss_high", "kev_x_epss"]),
    ("healthcare", ["is_healthcare", "healthcare_critical", "kev_healthcare", "healthcare_x_cvss"]), ("curated", ["is_curated"]),
    ("techniques", ["attack_flag", "attack_technique_count", "attack_healthcare", "attack_multi", "attack_count_x_healthcare"]), ("products", ["chpl_flag", "chpl_healthcare", "chpl_x_attack", "days_since_2018", "is_recent"]),
]
_REMOVED = [("no exploited", "kev"), ("no exploit score", "epss"), ("no healthcare", "healthcare"), ("no techniques", "attack"), ("no severity", "cvss")]


def _variants():
    cumulative = {name: [c for _, columns in _ADDED[: i + 1] for c in columns] for i, (name, _) in enumerate(_ADDED)}
    whole = cumulative[_ADDED[-1][0]]
    return cumulative | {name: [c for c in whole if part not in c] for name, part in _REMOVED}


def _legacy_rows(spark, sf):
    r = P.records(spark, sf).withColumns({"week": sunday_week(F.col("published")), "grade": F.least(F.col("label"), F.lit(3))})
    return M.training_rows(B.legacy_features(r, ("week", "grade")), [c for _, columns in _ADDED for c in columns], "grade")


def _halves(rows):
    parts = SP.random_split(rows, 0.3, "group")
    return parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split")


@query()
def mod_06_ablation(spark, sf):
    out = M.ablation(*_halves(_legacy_rows(spark, sf)), _variants(), rounds=10)
    return E.drops(E.increments(out, "place", "ndcg"), "variant", "ndcg", _ADDED[-1][0])


@query()
def mod_05_confidence_scale(spark, sf):
    return M.confidence_scales(*_halves(_training(spark, sf)), _FEATURE_LIST, rounds=10)


@query()
def mod_05_grid(spark, sf):
    return M.grid_search(_training(spark, sf), _FEATURE_LIST, {"depth": [2, 3], "rounds": [3], "step": [0.1]}, folds=2)


@query()
def mod_04_batch_scores(spark, sf):
    rows = stage(_training(spark, sf), "training-rows")
    weights = M.fit_pairwise(rows, _FEATURE_LIST, per_row=4, rounds=10)
    return _rounded(M.batch_scores(rows.drop("has_attack"), weights, 100, P.exploited(spark, sf)), "cve_id")


@query()
def mod_07_ensemble(spark, sf):
    return _rounded(M.ensemble(*_halves(_training(spark, sf)), _FEATURE_LIST, 3), "cve_id")


@query()
def mod_08_importance(spark, sf):
    rows = stage(_training(spark, sf), "training-rows")
    model = M.fit_trees(rows, _FEATURE_LIST, depth=3, rounds=3)
    return _rounded(M.importance_table(M.importances(model, _FEATURE_LIST), 5), "feature")


@query()
def mod_10_stability(spark, sf):
    runs = M.importance_runs(_training(spark, sf), _FEATURE_LIST, (0.3, 0.6), ("one", "two"), rounds=10)
    return T.stability(runs, "run", "feature", "importance", 3)


_LONG = ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in (5, 10) for m in ("ndcg", "precision", "recall", "ap"))
_LONG_NAMES = ", ".join(f"{m}_{k}" for k in (5, 10) for m in ("ndcg", "precision", "recall", "ap"))


def _long_sql(by):
    placed = _PLACED.replace("PARTITION BY model, week", f"PARTITION BY model, {by}")
    return f"({placed}, e AS (SELECT model, {by}, count(*) AS n, {', '.join(_metric(k) for k in (5, 10))} FROM q GROUP BY 1, 2) SELECT model, count(*)::DOUBLE AS groups, {_LONG} FROM e WHERE n >= 2 GROUP BY 1)"


@query(f"SELECT strategy, model, metric, value FROM (UNPIVOT (SELECT 'week' AS strategy, * FROM {_long_sql('week')} UNION ALL SELECT 'month', * FROM {_long_sql('month')}) ON groups, {_LONG_NAMES} INTO NAME metric VALUE value)".replace("FROM scores)", "FROM (SELECT *, left(week, 4) AS month FROM scores))"), ("records", "scores"))
def eva_16_long_table(spark, sf):
    s = P.long_scores(spark, sf).withColumn("month", F.substring("week", 1, 4))
    return E.long_table({by: E.macro(s, by, [5, 10]) for by in ("week", "month")}, ["model"])


@query("""WITH s AS (SELECT s.model, s.cve_id, s.score, r.kev_flag AS label, r.is_healthcare FROM scores s JOIN records r USING (cve_id)), x AS (SELECT *, 'overall' AS slice FROM s UNION ALL SELECT *, 'healthcare' FROM s WHERE is_healthcare = 1 UNION ALL SELECT *, 'other' FROM s WHERE is_healthcare = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY model, slice ORDER BY score DESC, cve_id) AS p, row_number() OVER (PARTITION BY model, slice ORDER BY label DESC, cve_id) AS i FROM x)
SELECT model, slice, count(*) AS n, count_if(label = 1) AS relevant, round(sum(CASE WHEN p <= 10 THEN label / log2(p + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN label / log2(i + 1) ELSE 0 END), 6) AS ndcg_10, round(sum(CASE WHEN p <= 20 THEN label / log2(p + 1) ELSE 0 END) / sum(CASE WHEN i <= 20 THEN label / log2(i + 1) ELSE 0 END), 6) AS ndcg_20,
round(sum(CASE WHEN p <= 10 THEN label ELSE 0 END) / 10, 6) AS precision_10, round(sum(CASE WHEN p <= 20 THEN label ELSE 0 END) / 20, 6) AS precision_20 FROM p GROUP BY 1, 2""", ("records", "scores"))
def eva_12_slices(spark, sf):
    r = P.records(spark, sf).select("cve_id", F.col("kev_flag").alias("label"), "is_healthcare")
    s = P.long_scores(spark, sf).drop("label").join(r, "cve_id")
    return E.slice_metrics(s, {"overall": F.lit(True), "healthcare": F.col("is_healthcare") == 1, "other": F.col("is_healthcare") == 0}, [10, 20])


@query("SELECT model, label, count(*) AS n, round(count(*) / 100, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, cve_id) AS p FROM scores) WHERE p <= 100 GROUP BY 1, 2", ("records", "scores"))
def eva_14_top_mix(spark, sf):
    return E.top_mix(P.long_scores(spark, sf), 100)


@query("""SELECT model, k::INTEGER AS k, count_if(label >= 3) AS found, round(count_if(label >= 3) / k, 6) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, cve_id) AS p FROM scores), (SELECT unnest([10, 20, 50, 100]) AS k)
WHERE p <= k GROUP BY model, k""", ("records", "scores"))
def eva_14_precision(spark, sf):
    return E.precision_at(P.long_scores(spark, sf), [10, 20, 50, 100], 3)


@query(f"{_PLACED.replace('label >= 2', 'label > 0')}, e AS (SELECT model, week, count(*) AS n, {_metric(10)} FROM q GROUP BY 1, 2) SELECT model, count(*) AS groups, {', '.join(f'round(avg({m}_10), 6) AS {m}_10' for m in ('ndcg', 'precision', 'recall', 'ap'))} FROM e WHERE n >= 2 GROUP BY 1", ("records", "scores"))
def eva_10_prototype(spark, sf):
    return E.macro(P.long_scores(spark, sf), "week", [10], relevant=1.0)


@query("""WITH m AS (SELECT model, round(avg(score), 6) AS v FROM scores GROUP BY 1) SELECT model, v, round((SELECT v FROM m WHERE model = 'a') - v, 6) AS "drop", round(100 * ((SELECT v FROM m WHERE model = 'a') - v) / (SELECT v FROM m WHERE model = 'a'), 4) AS drop_pct FROM m""", ("records", "scores"))
def eva_15_drops(spark, sf):
    return E.drops(P.long_scores(spark, sf).groupBy("model").agg(F.round(F.avg("score"), 6).alias("v")), "model", "v", "a")


# the complementary error function by a rational approximation that is right to 1.5e-7
_ERFC = "((((1.061405429 * q - 1.453152027) * q + 1.421413741) * q - 0.284496736) * q + 0.254829592) * q * exp(-z * z / 2)"
_TESTS = _PAIRS + f""", d AS (SELECT model_a, model_b, round(a - b, 12) AS d FROM pr WHERE round(a - b, 12) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2 AS r FROM d),
ti AS (SELECT model_a, model_b, sum(c * c * c - c) AS ties FROM (SELECT model_a, model_b, count(*)::DOUBLE AS c FROM d GROUP BY 1, 2, abs(d)) GROUP BY 1, 2),
wt AS (SELECT model_a, model_b, count(*)::DOUBLE AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS w FROM r GROUP BY 1, 2),
zt AS (SELECT model_a, model_b, n, w, abs((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)) AS z FROM wt JOIN ti USING (model_a, model_b)),
pt AS (SELECT *, {_ERFC} AS p FROM (SELECT *, 1 / (1 + 0.3275911 * z / sqrt(2)) AS q FROM zt)), c AS (SELECT *, least(1.0, p * count(*) OVER ()) AS pb, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, model_a || '#' || model_b) + 1)) AS raw FROM pt)"""


@query(_TESTS + " SELECT model_a, model_b, n::BIGINT AS n, w, round(p, 4) AS p, round(pb, 4) AS p_bonferroni, round(max(raw) OVER (ORDER BY p, model_a || '#' || model_b ROWS UNBOUNDED PRECEDING), 4) AS p_holm FROM c", ("records", "scores"))
def sig_04_all_pairs(spark, sf):
    out = T.all_pairs(_pairs(spark, sf), ["model_a", "model_b"])
    return out.select("model_a", "model_b", "n", "w", *[F.round(c, 4).alias(c) for c in ("p", "p_bonferroni", "p_holm")])


@query("WITH t AS (SELECT model, cve_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, cve_id) AS n FROM scores) WHERE n <= 500) SELECT a.model AS model_a, b.model AS model_b, count(*) AS common, 1000 - count(*) AS every FROM t a JOIN t b ON a.cve_id = b.cve_id AND a.model < b.model GROUP BY 1, 2", ("records", "scores"))
def set_03_common_tops(spark, sf):
    return U.common_tops(P.long_scores(spark, sf), 500)


@query("SELECT cve_id, CASE WHEN cvss IS NOT NULL THEN least(9.0, greatest(2.0, cvss)) END AS clipped, round(log2(key + 1), 6) AS logarithm, round(pow(coalesce(cvss, 0), 2), 6) AS square, abs(label - 3) AS distance FROM records")
def fn_07_numeric(spark, sf):
    return P.records(spark, sf).select("cve_id", X.clipped("cvss", 2, 9).alias("clipped"), F.round(F.log2(F.col("key") + 1), 6).alias("logarithm"), F.round(F.pow(X.number("cvss"), F.lit(2.0)), 6).alias("square"), F.abs(F.col("label") - 3).alias("distance"))


@query("""WITH a AS (SELECT cve_id, string_split(cwe, ',') AS x FROM records) SELECT cve_id, coalesce(list_has_any(x, ['CWE-79', 'CWE-89']), false)::BIGINT AS listed, array_to_string(list_sort(list_distinct(x))[1:1], ',') AS first_one, coalesce(len(x), 0) AS n FROM a""")
def fn_09_arrays(spark, sf):
    items = F.split("cwe", ",")
    return P.records(spark, sf).select("cve_id", X.any_of(items, ["CWE-79", "CWE-89"]).cast("bigint").alias("listed"), F.array_join(X.first_items(items, 1), ",").alias("first_one"), F.coalesce(F.size(items), F.lit(0)).cast("bigint").alias("n"))


@query("SELECT cve_id, CASE curated_severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 ELSE 1 END::BIGINT AS level FROM records")
def fn_10_map(spark, sf):
    return P.records(spark, sf).select("cve_id", X.looked_up(F.col("curated_severity"), {"critical": 5, "high": 4}, 1).cast("bigint").alias("level"))


@query("SELECT p_partkey, p_name || '|' || p_type AS names FROM part", views=())
def fn_11_printed_names(spark, sf):
    printed = F.concat(F.lit("[{'brand_name': '"), F.col("p_name"), F.lit("', 'maker': 'x', 'device_name' : '"), F.col("p_type"), F.lit("'}]"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array_join(X.named_values(printed, ["brand_name", "generic_name", "device_name"]), "|").alias("names"))


@query("""SELECT 'labels' AS "table", 'confidence' AS "column" FROM (SELECT count(*) AS n FROM labels) WHERE n >= 0 UNION ALL SELECT 'nowhere', '' FROM (SELECT count(*) AS n FROM documents) WHERE n >= 0""", views=())
def dq_04_contract(spark, sf):
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")}
    missing = D.contract(tables, {"documents": ["doc_id", "text"], "labels": ["doc_id", "confidence"], "nowhere": []})
    return spark.createDataFrame(missing, "table string, column string")


@query("""WITH c AS (SELECT curated_severity, row_number() OVER (ORDER BY curated_severity) AS code FROM (SELECT DISTINCT curated_severity FROM records WHERE curated_severity IS NOT NULL AND published < TIMESTAMP '1998-01-01'))
SELECT cve_id, coalesce(code, 0) AS code FROM records LEFT JOIN c USING (curated_severity) WHERE published >= TIMESTAMP '1998-01-01'""")
def fea_17_fitted_codes(spark, sf):
    r = P.records(spark, sf)
    codes = R.dense_codes(r.where("published < TIMESTAMP '1998-01-01'"), "curated_severity")
    return J.coded(r.where("published >= TIMESTAMP '1998-01-01'"), codes, "curated_severity", 0).select("cve_id", "code")


@query(_HEALTH + " SELECT coalesce(matched_vendor, 'none') AS vendor, count(*) AS n, sum((health_score > 0.3)::BIGINT)::BIGINT AS flagged, round(avg(health_score), 6) AS mean_score FROM z GROUP BY 1")
def txt_05_coverage(spark, sf):
    return TM.health_coverage(TM.health_score(P.records(spark, sf)))
