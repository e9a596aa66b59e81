"""Filters, joins, aggregates, windows, limits and set operations over risk records."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import expressions as X
from riskweave.operators import aggregates as A
from riskweave.operators import filters as L
from riskweave.operators import joins as J
from riskweave.operators import quantiles as Q
from riskweave.operators import ranking as R
from riskweave.plans.base import query
from riskweave.sources import projection as P

NUMERIC = ["cvss", "epss_score", "epss_percentile", "healthcare_score", "attack_technique_count"]


@query("""SELECT cve_id, published::DATE::VARCHAR AS day, coalesce(cvss, (SELECT median(cvss) FROM records)) AS cvss, coalesce(epss_score, 0.0) AS epss_score
FROM records WHERE published IS NOT NULL""")
def fil_01_clean(spark, sf):
    return L.clean(P.records(spark, sf)).select("cve_id", F.to_date("published").cast("string").alias("day"), "cvss", "epss_score")


@query("SELECT cve_id, cvss FROM records WHERE cvss >= 5.0 AND cvss <= 9.0 AND published >= '1996-01-01' AND published <= '1999-12-31' AND is_healthcare = 1")
def fil_02_select(spark, sf):
    return L.select_records(P.records(spark, sf), 5.0, 9.0, "1996-01-01", "1999-12-31", healthcare_only=True).select("cve_id", "cvss")


@query("SELECT cve_id, published::DATE::VARCHAR AS day, cvss FROM records WHERE key % 3 = 0 AND cvss >= 7 AND published >= '1995-01-01' ORDER BY published DESC, cve_id LIMIT 100")
def fil_03_query(spark, sf):
    r = P.records(spark, sf)
    ids = r.where("key % 3 = 0").select(F.lower("cve_id").alias("cve_id"))
    found = L.select_records(L.by_ids(r, ids), 7.0, start="1995-01-01")
    return R.top(found, [F.desc("published"), F.asc("cve_id")], 100).select("cve_id", F.to_date("published").cast("string").alias("day"), "cvss")


@query("SELECT cve_id, published::DATE::VARCHAR AS day, kev_flag FROM records WHERE published BETWEEN '1997-03-01' AND '1997-09-30'")
def fil_04_date_range(spark, sf):
    return L.select_records(P.records(spark, sf), start="1997-03-01", end="1997-09-30").select("cve_id", F.to_date("published").cast("string").alias("day"), "kev_flag")


@query("SELECT cve_id, cvss, kev_flag FROM records WHERE cve_id IN (SELECT upper('cve-' || year(published) || '-' || lpad(key::VARCHAR, 7, '0')) FROM records WHERE key % 1000 = 7)")
def fil_05_point_lookup(spark, sf):
    r = P.records(spark, sf)
    return L.by_ids(r, r.where("key % 1000 = 7").select(F.lower("cve_id").alias("cve_id"))).select("cve_id", "cvss", "kev_flag")


@query("SELECT cve_id, curated_severity FROM records WHERE is_curated = 1 AND lower(curated_severity) = 'critical' AND lower(description) LIKE '%microsoft%'")
def fil_06_curated_selection(spark, sf):
    r = P.records(spark, sf).where("is_curated = 1").withColumn("vendors", F.split(F.lower("description"), " "))
    return r.where((F.lower("curated_severity") == "critical") & F.exists("vendors", lambda v: v.contains("microsoft"))).select("cve_id", "curated_severity")


@query("SELECT cve_id, epss_score FROM records WHERE epss_score >= 0.5")
def fil_07_high_risk(spark, sf):
    return P.records(spark, sf).where("epss_score >= 0.5").select("cve_id", "epss_score")


@query("""SELECT v AS rule, count(*) AS n FROM (SELECT unnest(list_filter([
  CASE WHEN NOT regexp_matches(id, '^CVE-[0-9]{4}-[0-9]{4,}$') THEN 'bad_id' END, CASE WHEN c IS NOT NULL AND NOT c BETWEEN 0 AND 10 THEN 'cvss_range' END,
  CASE WHEN e IS NOT NULL AND NOT e BETWEEN 0 AND 1 THEN 'epss_range' END, CASE WHEN label NOT BETWEEN 0 AND 5 THEN 'label_range' END,
  CASE WHEN length(trim(coalesce(d, ''))) < 10 THEN 'short_description' END, CASE WHEN starts_with(upper(trim(coalesce(d, ''))), '** REJECT **') THEN 'placeholder' END], lambda x: x IS NOT NULL)) AS v
  FROM (SELECT CASE WHEN key % 97 = 0 THEN 'X-' || cve_id ELSE cve_id END AS id, CASE WHEN key % 89 = 0 THEN 11.0 ELSE cvss END AS c, CASE WHEN key % 83 = 0 THEN 1.5 ELSE epss_score END AS e, label,
    CASE WHEN key % 79 = 0 THEN '** REJECT ** do not use' ELSE description END AS d FROM records)) GROUP BY v""")
def fil_08_validation(spark, sf):
    r = P.records(spark, sf).withColumns(
        {
            "cve_id": F.when(F.col("key") % 97 == 0, F.concat(F.lit("X-"), "cve_id")).otherwise(F.col("cve_id")),
            "cvss": F.when(F.col("key") % 89 == 0, 11.0).otherwise(F.col("cvss")),
            "epss_score": F.when(F.col("key") % 83 == 0, 1.5).otherwise(F.col("epss_score")),
            "description": F.when(F.col("key") % 79 == 0, "** REJECT ** do not use").otherwise(F.col("description")),
        }
    )
    return L.violations(r).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cve_id, coalesce(cvss, 0.0) AS cvss, coalesce(epss_score, 0.0) AS epss_score, 0.0 AS unknown_column, label::DOUBLE AS label FROM records")
def fil_09_fit_columns(spark, sf):
    return L.fit_columns(P.records(spark, sf), ["cvss", "epss_score", "unknown_column", "label"])


@query("SELECT 'all' AS variant, 5::BIGINT AS features, round(sum(coalesce(cvss, 0) + coalesce(epss_score, 0) + coalesce(epss_percentile, 0) + healthcare_score + attack_technique_count), 4) AS total FROM records UNION ALL SELECT 'scores', 2, round(sum(coalesce(cvss, 0) + coalesce(epss_score, 0)), 4) FROM records")
def fil_10_feature_subsets(spark, sf):
    out = None
    for name, columns in {"all": NUMERIC, "scores": NUMERIC[:2]}.items():
        part = L.fit_columns(P.records(spark, sf), columns).agg(F.round(F.sum(sum((F.col(c) for c in columns), F.lit(0.0))), 4).alias("total"))
        part = part.select(F.lit(name).alias("variant"), F.lit(len(columns)).cast("bigint").alias("features"), "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'cvss' AS \"column\", 1.0 AS share UNION ALL SELECT 'cwe', 0.0 UNION ALL SELECT 'label', 1.0", views=())
def fil_11_coercible(spark, sf):
    return L.coercible(P.records(spark, sf), ["cvss", "cwe", "label"])


@query("SELECT cve_id, cvss, o_totalprice AS price, o_orderpriority AS priority FROM records LEFT JOIN orders ON o_orderkey = key AND o_orderpriority <> '5-LOW'")
def joi_01_left(spark, sf):
    side = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    return P.records(spark, sf).select("key", "cve_id", "cvss").join(side, "key", "left").select("cve_id", "cvss", "price", "priority")


@query("SELECT cve_id, l_linenumber AS line, cvss FROM lineitem LEFT JOIN records ON l_orderkey = key WHERE cvss IS NOT NULL AND kev_flag = 1")
def joi_02_inner_by_predicate(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"))
    return lines.join(P.records(spark, sf), "key", "left").where("cvss IS NOT NULL AND kev_flag = 1").select("cve_id", "line", "cvss")


@query("SELECT cve_id, cvss, c_mktsegment AS segment FROM records JOIN orders ON o_orderkey = key JOIN customer ON c_custkey = o_custkey WHERE kev_flag = 1 AND is_healthcare = 1")
def joi_03_inner_flags(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("c_custkey"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return P.records(spark, sf).where("kev_flag = 1 AND is_healthcare = 1").join(o, "key").join(c, "c_custkey").select("cve_id", "cvss", "segment")


@query("SELECT cve_id, (cve_id IN (SELECT cve_id FROM exploited))::BIGINT AS exploited FROM records", ("records", "exploited"))
def joi_04_membership(spark, sf):
    return J.membership(P.records(spark, sf), P.exploited(spark, sf), "exploited").select("cve_id", F.col("exploited").cast("bigint").alias("exploited"))


@query("SELECT cve_id, coalesce(r_name, 'none') AS region FROM records LEFT JOIN (SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3) ON r_regionkey = key % 5")
def joi_05_lookup(spark, sf):
    side = spark.read.parquet(f"{sf}/region.parquet").where("r_regionkey < 3").select(F.col("r_regionkey").cast("bigint").alias("region_key"), F.col("r_name").alias("region"))
    return J.lookup(P.records(spark, sf).withColumn("region_key", F.col("key") % 5), side, "region_key", {"region": "none"}).select("cve_id", "region")


@query("SELECT cve_id FROM records WHERE cve_id NOT IN (SELECT cve_id FROM exploited)", ("records", "exploited"))
def joi_07_anti(spark, sf):
    return J.missing(P.records(spark, sf).select("cve_id"), P.exploited(spark, sf))


@query("SELECT r.cve_id, round(max(h.epss_score), 6) AS best FROM records r JOIN history h ON h.cve_id = r.cve_id AND h.epss_date BETWEEN r.published::DATE AND r.published::DATE + 60 GROUP BY r.cve_id", ("records", "history"))
def joi_08_interval(spark, sf):
    return J.best_in_window(P.records(spark, sf), P.signal_history(spark, sf), 60).select("cve_id", F.round("best", 6).alias("best"))


@query("""SELECT r.cve_id, coalesce(date_added BETWEEN published::DATE AND published::DATE + 60, false)::BIGINT AS within, coalesce(date_added < published::DATE, false)::BIGINT AS prior,
coalesce(date_added > published::DATE + 60, false)::BIGINT AS later FROM records r LEFT JOIN exploited e USING (cve_id)""", ("records", "exploited"))
def joi_09_dated_hits(spark, sf):
    out = J.dated_hit(P.records(spark, sf), P.exploited(spark, sf), 60)
    return out.select("cve_id", *[F.col(c).cast("bigint").alias(c) for c in ("within", "prior", "later")])


@query("""SELECT DISTINCT a.cwe AS cwe_a, b.cwe AS cwe_b, count(*) OVER (PARTITION BY a.cwe, b.cwe) AS n FROM
(SELECT DISTINCT cwe, cve_id, week FROM g) a JOIN (SELECT DISTINCT cwe, cve_id, week FROM g) b ON a.week = b.week AND a.cve_id < b.cve_id""".replace("SELECT DISTINCT a.cwe", "WITH g AS (SELECT cwe, cve_id, published::DATE AS week FROM records WHERE cwe IS NOT NULL AND published::DATE IN (SELECT published::DATE FROM records WHERE cwe IS NOT NULL GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100)) SELECT DISTINCT a.cwe"))
def joi_13_group_pairs(spark, sf):
    r = P.records(spark, sf).where("cwe IS NOT NULL").select("cve_id", "cwe", F.to_date("published").alias("week"))
    pairs = J.within_group_pairs(r, "week", "cve_id", 100)
    named = pairs.join(r.select(F.col("cve_id").alias("src"), F.col("cwe").alias("cwe_a")), "src").join(r.select(F.col("cve_id").alias("dst"), F.col("cwe").alias("cwe_b")), "dst")
    return named.groupBy("cwe_a", "cwe_b").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT model, week, round(avg(score), 9) AS v FROM scores GROUP BY 1, 2)
SELECT a.week, a.model AS model_a, b.model AS model_b, a.v AS a, b.v AS b FROM m a JOIN m b ON a.week = b.week AND a.model < b.model""", ("records", "scores"))
def joi_14_paired(spark, sf):
    m = P.long_scores(spark, sf).groupBy("model", "week").agg(F.round(F.avg("score"), 9).alias("v"))
    return J.paired(m, ["week"], "model", "v")


@query("""WITH c AS (SELECT cwe, row_number() OVER (ORDER BY cwe) AS code FROM (SELECT DISTINCT cwe FROM records WHERE cwe IS NOT NULL AND key % 12 < 8))
SELECT r.cve_id, coalesce(c.code, 0)::BIGINT AS code FROM records r LEFT JOIN c USING (cwe)""")
def joi_17_codes(spark, sf):
    r = P.records(spark, sf)
    return J.coded(r, R.dense_codes(r.where("key % 12 < 8"), "cwe"), "cwe", 0).select("cve_id", "code")


@query("""SELECT count(*) AS total, min(published)::DATE::VARCHAR AS first_day, max(published)::DATE::VARCHAR AS last_day, count(cvss) AS with_cvss, round(avg(cvss), 2) AS avg_cvss,
sum(kev_flag)::BIGINT AS n_kev_flag, sum(is_healthcare)::BIGINT AS n_is_healthcare, sum(is_curated)::BIGINT AS n_is_curated, sum(attack_flag)::BIGINT AS n_attack_flag, sum(chpl_flag)::BIGINT AS n_chpl_flag FROM records""")
def agg_01_statistics(spark, sf):
    return A.table_statistics(P.records(spark, sf)).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("SELECT l AS label, count(label) AS n, round(100.0 * count(label) / sum(count(label)) OVER (), 4) AS pct FROM (SELECT unnest(range(0, 8)) AS l) LEFT JOIN records ON label = l GROUP BY l")
def agg_02_label_distribution(spark, sf):
    return A.distribution(P.records(spark, sf), "label", list(range(8)))


@query("SELECT year(published)::BIGINT AS year, count(*) AS total, count(cvss) AS with_cvss, round(avg(cvss), 2) AS avg_cvss, min(cvss) AS min_cvss, max(cvss) AS max_cvss FROM records GROUP BY 1")
def agg_03_by_year(spark, sf):
    return A.by_year(P.records(spark, sf))


@query("SELECT CASE WHEN cvss IS NULL THEN 'unknown' WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, min(cvss) AS least FROM records GROUP BY 1")
def agg_04_severity_bands(spark, sf):
    return A.severity_bands(P.records(spark, sf))


@query("""SELECT count(*) AS total, round(avg((epss_score IS NOT NULL)::DOUBLE) * 100, 4) AS pct_epss, round(avg(coalesce(epss_score > 0, false)::DOUBLE) * 100, 4) AS pct_epss_positive,
round(avg((epss_date IS NOT NULL)::DOUBLE) * 100, 4) AS pct_epss_dated, round(avg(kev_flag) * 100, 4) AS pct_kev_flag, round(avg(is_healthcare) * 100, 4) AS pct_is_healthcare, round(avg(is_curated) * 100, 4) AS pct_is_curated,
round(avg(attack_flag) * 100, 4) AS pct_attack_flag, round(avg(chpl_flag) * 100, 4) AS pct_chpl_flag, round(avg((kev_flag = 1 AND is_healthcare = 1)::DOUBLE) * 100, 4) AS pct_kev_healthcare,
round(avg((kev_flag + is_healthcare + is_curated + attack_flag + chpl_flag >= 2)::DOUBLE) * 100, 4) AS pct_two_signals, round(avg((kev_flag + is_healthcare + is_curated + attack_flag + chpl_flag >= 3)::DOUBLE) * 100, 4) AS pct_three_signals FROM records""")
def agg_05_coverage(spark, sf):
    return A.coverage(P.records(spark, sf))


@query("SELECT count(*) AS total, count(epss_date) AS dated, count_if(epss_score > 0) AS positive FROM records")
def agg_06_epss_coverage(spark, sf):
    return P.records(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count("epss_date").alias("dated"), F.count_if(F.col("epss_score") > 0).alias("positive"))


@query("""WITH k AS (SELECT CASE WHEN key % 101 = 0 THEN '' WHEN key % 103 = 0 THEN NULL WHEN key % 97 = 0 THEN 'CVE-1999-1' ELSE cve_id END AS id FROM records)
SELECT 'repeated' AS problem, count(*) AS n FROM (SELECT id FROM k WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) UNION ALL
SELECT 'blank', count_if(coalesce(trim(id) = '', true)) FROM k UNION ALL SELECT 'format', count_if(NOT regexp_matches(id, '^CVE-[0-9]{4}-[0-9]{4,}$')) FROM k""")
def agg_07_key_problems(spark, sf):
    k = F.col("key")
    return A.key_problems(P.records(spark, sf).withColumn("cve_id", F.when(k % 101 == 0, "").when(k % 103 == 0, None).when(k % 97 == 0, "CVE-1999-1").otherwise(F.col("cve_id"))))


@query("SELECT cwe, count(*) AS n, sum(kev_flag)::BIGINT AS hits, round(sum(kev_flag) / count(*), 6) AS rate FROM records WHERE cwe IS NOT NULL GROUP BY cwe HAVING count(*) >= 10")
def agg_08_exploitation_rate(spark, sf):
    return A.rate_by(P.records(spark, sf), "cwe", 10).withColumn("rate", F.round("rate", 6))


@query("SELECT CASE WHEN grouping(label) = 1 THEN 'all' ELSE label::VARCHAR END AS a, CASE WHEN grouping(kev_flag) = 1 THEN 'all' ELSE kev_flag::VARCHAR END AS b, count(*) AS n FROM records GROUP BY CUBE (label, kev_flag)")
def agg_09_crosstab(spark, sf):
    return A.crosstab(P.records(spark, sf), "label", "kev_flag")


@query("SELECT least(9, floor(healthcare_score * 10))::BIGINT AS bin, count(*) AS n FROM records GROUP BY 1")
def agg_10_histogram(spark, sf):
    return A.confidence_histogram(P.records(spark, sf), "healthcare_score")


@query("SELECT cwe, count(*) AS n FROM records WHERE cwe IS NOT NULL GROUP BY cwe ORDER BY n DESC, cwe LIMIT 5")
def agg_11_top_categories(spark, sf):
    counts = P.records(spark, sf).where("cwe IS NOT NULL").groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))
    return R.top(counts, [F.desc("n"), F.asc("cwe")], 5)


def _each(columns, select):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {select.replace('$', c)} FROM records" for c in columns)


@query(_each(NUMERIC, """count($) AS n, round(avg($), 6) AS mean, round(stddev_samp($), 6) AS std, min($)::DOUBLE AS min, round(quantile_cont($::DOUBLE, 0.05), 6) AS q05, round(quantile_cont($::DOUBLE, 0.25), 6) AS q25,
round(quantile_cont($::DOUBLE, 0.5), 6) AS q50, round(quantile_cont($::DOUBLE, 0.75), 6) AS q75, round(quantile_cont($::DOUBLE, 0.95), 6) AS q95, max($)::DOUBLE AS max, round(avg(($ IS NULL)::DOUBLE) * 100, 4) AS missing_pct, round(avg(coalesce($ = 0, false)::DOUBLE) * 100, 4) AS zero_pct"""))
def agg_12_describe(spark, sf):
    return A.describe(P.records(spark, sf), NUMERIC)


@query(_each(["cvss", "cwe", "description", "epss_score", "label"], "count(*) - count($) AS missing, round(100.0 * (count(*) - count($)) / count(*), 2) AS pct"))
def agg_13_missingness(spark, sf):
    return A.missingness(P.records(spark, sf).select("cvss", "cwe", "description", "epss_score", "label"))


@query(_each(["cvss", "epss_score"], "round(100.0 * (count(*) - count($)) / count(*), 2) AS before, 0.0 AS after, round(0 - round(100.0 * (count(*) - count($)) / count(*), 2), 2) AS change"))
def joi_16_missingness_change(spark, sf):
    r = P.records(spark, sf).select("published", "cvss", "epss_score")
    return A.missingness_change(r.select("cvss", "epss_score"), L.clean(r).select("cvss", "epss_score"))


@query(_each(["cvss", "kev_flag", "attack_technique_count"], "count(DISTINCT $) + max(($ IS NULL)::INTEGER) AS n_values, round(avg(coalesce($ <> 0, false)::DOUBLE), 6) AS nonzero_share, false AS constant, avg(coalesce($ <> 0, false)::DOUBLE) < 0.01 AS mostly_zero"))
def agg_14_weak_features(spark, sf):
    return A.weak_features(P.records(spark, sf), ["cvss", "kev_flag", "attack_technique_count"])


@query(_each(NUMERIC, "round(corr($, label), 6) + 0.0 AS r"))
def agg_15_correlation(spark, sf):
    return A.correlations(P.records(spark, sf), NUMERIC, "label")


@query("SELECT strftime(published, '%Y-%m') AS month, count(*) AS n FROM records GROUP BY 1 HAVING strftime(published, '%Y-%m') > (SELECT strftime(max(published)::DATE - INTERVAL 12 MONTH, '%Y-%m') FROM records)".replace("HAVING strftime(published, '%Y-%m')", "HAVING month"))
def agg_16_monthly(spark, sf):
    return A.monthly(P.records(spark, sf), 12)


@query("""SELECT round(a, 6) AS mean_kev, round(b, 6) AS mean_other, round(c, 6) AS median_kev, round(d, 6) AS median_other, round(a - b, 6) AS mean_difference, round(c - d, 6) AS median_difference FROM
(SELECT avg(cvss) FILTER (kev_flag = 1) AS a, avg(cvss) FILTER (kev_flag <> 1) AS b, median(cvss) FILTER (kev_flag = 1) AS c, median(cvss) FILTER (kev_flag <> 1) AS d FROM records)""")
def agg_17_kev_comparison(spark, sf):
    return A.kev_comparison(P.records(spark, sf))


@query("SELECT label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM records GROUP BY label")
def agg_18_class_weights(spark, sf):
    return A.class_weights(P.records(spark, sf), "label")


@query("SELECT cve_id, round((cvss - avg(cvss) OVER ()) / stddev_pop(cvss) OVER (), 6) AS cvss, round((attack_technique_count - avg(attack_technique_count) OVER ()) / stddev_pop(attack_technique_count) OVER (), 6) AS attack_technique_count FROM records")
def agg_19_scaling(spark, sf):
    r = P.records(spark, sf).select("cve_id", "cvss", "attack_technique_count")
    columns = ["cvss", "attack_technique_count"]
    return A.scaled(r, A.scaling(r, columns), columns).select("cve_id", *[F.round(c, 6).alias(c) for c in columns])


@query("SELECT 'severity' AS facet, curated_severity AS value, count(*) AS n FROM records WHERE is_curated = 1 GROUP BY 2 UNION ALL SELECT 'exploited', '1', sum(kev_flag)::BIGINT FROM records WHERE is_curated = 1")
def agg_20_curated(spark, sf):
    return A.curated_statistics(P.records(spark, sf))


@query("SELECT cwe, round(avg(cvss), 6) AS mean_cvss, round(avg(epss_score), 6) AS mean_epss_score FROM records GROUP BY cwe")
def agg_21_means(spark, sf):
    return A.means_by(P.records(spark, sf), "cwe", ["cvss", "epss_score"])


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN m = 0 THEN 'full' WHEN 100 - p >= 90 THEN '90-99' ELSE '<90' END AS bucket FROM (" + _each(["cve_id", "cvss", "cwe", "description", "epss_score", "curated_severity"], "count(*) - count($) AS m, round(100.0 * (count(*) - count($)) / count(*), 2) AS p") + ")) GROUP BY 1")
def agg_25_completeness(spark, sf):
    return A.completeness(P.records(spark, sf).select("cve_id", "cvss", "cwe", "description", "epss_score", "curated_severity"))


@query("WITH m AS (SELECT model, week, avg(score) AS v FROM scores GROUP BY 1, 2), s AS (SELECT model, avg(v) AS mean, stddev_samp(v) AS std FROM m GROUP BY 1) SELECT model, round(mean, 6) AS mean, round(std, 6) AS std, round(100 * (mean - (SELECT mean FROM s WHERE model = 'a')) / (SELECT mean FROM s WHERE model = 'a'), 4) AS change_pct FROM s", ("records", "scores"))
def agg_23_fold_summary(spark, sf):
    return A.fold_summary(P.long_scores(spark, sf).groupBy("model", "week").agg(F.avg("score").alias("v")), "model", "v", "a")


@query("SELECT t AS threshold, count_if(s >= t) AS n, round(count_if(s >= t) / count(*), 6) AS rate, round(count_if(s >= t AND kev_flag = 1) / sum(kev_flag), 6) AS kev_capture FROM (SELECT cvss AS s, kev_flag FROM records), (SELECT unnest([4.0, 7.0, 9.0]::DOUBLE[]) AS t) GROUP BY t")
def agg_24_threshold_sensitivity(spark, sf):
    return A.threshold_sensitivity(P.records(spark, sf), "cvss", [4.0, 7.0, 9.0])


@query("SELECT median(cvss) AS middle, round(avg(length(description)), 6) AS mean_length FROM records")
def agg_26_imputation(spark, sf):
    r = P.records(spark, sf)
    middle = Q.medians(r, {"cvss": F.col("cvss")})["cvss"]
    return r.agg(F.lit(middle).cast("double").alias("middle"), F.round(F.avg(F.length("description")), 6).alias("mean_length"))


@query("SELECT cve_id, model, row_number() OVER (PARTITION BY model, week ORDER BY score DESC, cve_id)::BIGINT AS position, row_number() OVER (PARTITION BY model, week ORDER BY label DESC, cve_id)::BIGINT AS ideal FROM scores", ("records", "scores"))
def win_01_positions(spark, sf):
    by_score = R.in_group(P.long_scores(spark, sf), ["model", "week"], [F.desc("score"), F.asc("cve_id")])
    return R.in_group(by_score, ["model", "week"], [F.desc("label"), F.asc("cve_id")], "ideal").select("cve_id", "model", F.col("position").cast("bigint").alias("position"), F.col("ideal").cast("bigint").alias("ideal"))


@query("SELECT cve_id, model, sum((label >= 2)::BIGINT) OVER (PARTITION BY model, week ORDER BY score DESC, cve_id ROWS UNBOUNDED PRECEDING)::BIGINT AS hits FROM scores", ("records", "scores"))
def win_03_running_hits(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("model", "week").orderBy(F.desc("score"), F.asc("cve_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return P.long_scores(spark, sf).select("cve_id", "model", F.sum((F.col("label") >= 2).cast("bigint")).over(w).alias("hits"))


@query("SELECT cve_id, row_number() OVER (ORDER BY epss_score DESC NULLS LAST, cve_id)::BIGINT AS rank FROM records")
def win_04_global_rank(spark, sf):
    return R.global_rank(P.records(spark, sf).select("cve_id", "epss_score"), [F.desc_nulls_last("epss_score"), F.asc("cve_id")]).select("cve_id", "rank")


@query("SELECT cve_id, model, rank() OVER (PARTITION BY model, week ORDER BY score DESC) + (count(*) OVER (PARTITION BY model, week, score) - 1) / 2 AS avg_rank FROM scores", ("records", "scores"))
def win_05_average_rank(spark, sf):
    return R.average_rank(P.long_scores(spark, sf), ["model", "week"], F.col("score")).select("cve_id", "model", "avg_rank")


@query("SELECT week, count(*) AS n FROM scores WHERE model = 'a' GROUP BY week", ("records", "scores"))
def win_06_group_sizes(spark, sf):
    return P.long_scores(spark, sf).where("model = 'a'").groupBy("week").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cve_id, epss_date::VARCHAR AS day, round(s, 6) AS score FROM (SELECT cve_id, epss_date, epss_score AS s, row_number() OVER (PARTITION BY cve_id ORDER BY epss_date DESC, epss_score DESC) AS n FROM history) WHERE n = 1", ("records", "history"))
def win_08_latest(spark, sf):
    return R.latest(P.signal_history(spark, sf), ["cve_id"], [F.desc("epss_date"), F.desc("epss_score")]).select("cve_id", F.col("epss_date").cast("string").alias("day"), F.round("epss_score", 6).alias("score"))


@query("SELECT cve_id, label FROM (SELECT cve_id, label, epss_score, row_number() OVER (PARTITION BY label ORDER BY epss_score DESC NULLS LAST, cve_id) AS n FROM records) ORDER BY (n = 1) DESC, epss_score DESC NULLS LAST, cve_id LIMIT 20")
def win_09_best_then_fill(spark, sf):
    return R.best_then_fill(P.records(spark, sf), "label", "epss_score", "cve_id", 20).select("cve_id", "label")


@query("SELECT cve_id, cvss FROM records ORDER BY cvss DESC NULLS LAST, cve_id LIMIT 50")
def top_01_first_rows(spark, sf):
    return R.top(P.records(spark, sf), [F.desc_nulls_last("cvss"), F.asc("cve_id")], 50).select("cve_id", "cvss")


@query("SELECT cve_id, label, year(published)::BIGINT AS year FROM records ORDER BY year(published), label DESC, cve_id LIMIT 40")
def top_02_multi_key(spark, sf):
    return R.top(P.records(spark, sf), [F.year("published").asc(), F.desc("label"), F.asc("cve_id")], 40).select("cve_id", "label", F.year("published").cast("bigint").alias("year"))


@query("""SELECT model, count_if(label >= 2) AS relevant, round(avg(cvss), 6) AS mean_cvss, sum(kev_flag)::BIGINT AS exploited FROM (SELECT s.model, s.label, r.cvss, r.kev_flag,
row_number() OVER (PARTITION BY s.model ORDER BY s.score DESC, s.cve_id) AS n FROM scores s JOIN records r USING (cve_id)) WHERE n <= 20 GROUP BY model""", ("records", "scores"))
def top_05_profile(spark, sf):
    r = P.records(spark, sf).select("cve_id", "cvss", "kev_flag")
    tops = R.in_group(P.long_scores(spark, sf), ["model"], [F.desc("score"), F.asc("cve_id")]).where("position <= 20")
    return tops.join(r, "cve_id").groupBy("model").agg(F.count_if(F.col("label") >= 2).alias("relevant"), F.round(F.avg("cvss"), 6).alias("mean_cvss"), F.sum("kev_flag").alias("exploited"))


@query("SELECT cve_id, cvss, NULL::VARCHAR AS source FROM records WHERE kev_flag = 1 UNION ALL SELECT cve_id, NULL, 'exploited' FROM exploited", ("records", "exploited"))
def set_01_union(spark, sf):
    return P.records(spark, sf).where("kev_flag = 1").select("cve_id", "cvss").unionByName(P.exploited(spark, sf).select("cve_id", F.lit("exploited").alias("source")), allowMissingColumns=True)


@query("SELECT lower(description) AS pattern FROM records WHERE description IS NOT NULL UNION SELECT lower(p_brand) FROM part")
def set_02_union_distinct(spark, sf):
    a = P.records(spark, sf).where("description IS NOT NULL").select(F.lower("description").alias("pattern"))
    return a.union(spark.read.parquet(f"{sf}/part.parquet").select(F.lower("p_brand"))).distinct()


@query("SELECT cve_id FROM records WHERE kev_flag = 1 EXCEPT SELECT cve_id FROM exploited", ("records", "exploited"))
def set_04_difference(spark, sf):
    return P.records(spark, sf).where("kev_flag = 1").select("cve_id").exceptAll(P.exploited(spark, sf).select("cve_id"))


@query("""SELECT cve_id, year(published) || '-' || lpad(((dayofyear(published) + 6 - dayofweek(published)) // 7)::VARCHAR, 2, '0') AS sunday_week,
date_trunc('week', published)::DATE || '/' || (date_trunc('week', published)::DATE + 6) AS monday_week, strftime(published, '%Y-%m') AS month, date_diff('day', published::DATE, DATE '2002-01-01')::BIGINT AS age,
(('0x' || substr(md5(cve_id), 1, 8))::BIGINT % 10)::INTEGER AS bucket FROM records""")
def fn_06_dates(spark, sf):
    p = F.col("published")
    return P.records(spark, sf).select("cve_id", X.sunday_week(p).alias("sunday_week"), X.monday_week(p).alias("monday_week"), X.month_key(p).alias("month"), X.days_between(F.lit("2002-01-01").cast("timestamp"), p).cast("bigint").alias("age"), X.hash_bucket("cve_id", 10).alias("bucket"))


@query("""WITH w AS (SELECT doc_id, lower(text) AS t, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{3,}'), lambda x: x NOT IN ('that', 'this', 'with', 'from')) AS w FROM documents),
p AS (SELECT doc_id, unnest(list_filter(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), lambda x: length(x) >= 8)) AS p FROM w UNION SELECT doc_id, trim(t) FROM w WHERE length(trim(t)) BETWEEN 1 AND 80)
SELECT p AS phrase, count(DISTINCT doc_id) AS n FROM p GROUP BY p HAVING count(DISTINCT doc_id) >= 20""", views=())
def fn_04_phrases(spark, sf):
    docs = X.dealt_by_size(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    found = docs.select(F.explode(X.phrases(F.col("text"), ["that", "this", "with", "from"])).alias("phrase"))
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("""SELECT event_id, try_cast(props->>'k' AS BIGINT) AS k, props->>'k' AS text FROM events""", views=())
def fn_11_json(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.get_json_object("props", "$.k").alias("text"))
