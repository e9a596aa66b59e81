"""Approximate similarity, listwise ranking, exact tails, several relations, sliding budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import graph as G
from riskweave.operators import listwise
from riskweave.operators import models as M
from riskweave.operators import searches, similarity
from riskweave.operators import sinks as K
from riskweave.operators import stats as T
from riskweave.operators import text_match as TM
from riskweave.plans.analytics import _FEATURE_LIST, _FUZZY, _KEV_WALK, _PAIRS, _edges, _fuzzy_terms, _pairs, _rounded, _seeds, _training, _walk_sql
from riskweave.plans.base import query
from riskweave.plans.landing import _folder, _stream
from riskweave.session import stage
from riskweave.sources import projection as P
from riskweave.streaming import jobs

_VECTOR = ["cvss", "epss_score", "epss_percentile", "healthcare_score", "attack_technique_count", "kev_flag", "chpl_flag", "is_curated"]


@query()
def gra_02_approximate(spark, sf):
    """Records by their standardised signals."""
    r = P.records(spark, sf)
    moments = r.agg(*[f(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{n}_{c}") for c in _VECTOR for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in _VECTOR]
    vectors = r.join(F.broadcast(moments)).select("key", F.array(*[F.round(x, 9) for x in scaled]).alias("v"))
    return similarity.approximate(vectors, "key", "v")


@query()
def mod_02_listwise_ranker(spark, sf):
    rows = stage(_training(spark, sf), "training-rows")
    scored = M.linear_scores(rows, listwise.fit(rows, _FEATURE_LIST, rounds=6, near=5))
    return scored.select("cve_id", F.round("score", 6).alias("score"))


_YEARS = _PAIRS.replace("b.ndcg AS b FROM", "b.ndcg AS b, a.week AS week FROM") + ", dy AS (SELECT model_a, model_b, left(week, 4) AS year, a - b AS x, round(a - b, 12) AS d FROM pr)"


@query(
    _YEARS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, dist(n, s, c) AS (SELECT 0, 0, 1::HUGEINT UNION ALL SELECT n + 1, s + g * (n + 1), sum(c)::HUGEINT FROM dist, (SELECT unnest([0, 1]) AS g) WHERE n < 50 GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b, year ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model_a, model_b, year, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY model_a, model_b, year, abs(d)) AS same FROM dy WHERE d <> 0),
t AS (SELECT model_a, model_b, year, count(*) AS n, max(same) AS same, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS w FROM r GROUP BY 1, 2, 3)
SELECT model_a, model_b, year, t.n, w, round(CASE WHEN t.n < 5 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(c)::DOUBLE FROM dist WHERE dist.n = t.n AND s <= w) / power(2.0, t.n)) END, 8) AS p FROM t WHERE t.n <= 50 AND same = 1""",
    ("records", "scores"),
)
def sig_01_exact(spark, sf):
    """Signed ranks within years, where no two differences are of one size: their own distribution, not the normal one."""
    pairs = stage(_pairs(spark, sf).withColumn("year", F.substring("week", 1, 4)), "year-pairs")
    by = ["model_a", "model_b", "year"]
    size = F.abs(F.round(F.col("a") - F.col("b"), 12))
    distinct = pairs.where(size != 0).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(size).alias("_d")).where("_n = _d AND _n <= 50").select(*by)
    return T.wilcoxon(pairs.join(distinct, by), by).select(*by, "n", "w", F.round("p", 8).alias("p"))


@query(
    _YEARS
    + """, t AS (SELECT model_a, model_b, year, count(*) AS n, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM dy GROUP BY 1, 2, 3)
SELECT model_a, model_b, year, n, round(t, 6) AS t, round(CASE WHEN n < 5 THEN 1.0 ELSE 1 - 2 * exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) * (abs(t) / 6000) *
list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(1 + power(t * i / 2000, 2) / (n - 1), -n / 2))) END, 6) AS p FROM t WHERE t IS NOT NULL AND isfinite(t)""",
    ("records", "scores"),
)
def sig_02_exact(spark, sf):
    """Student's t within years; the SQL integrates its density by Simpson's rule."""
    by = ["model_a", "model_b", "year"]
    out = T.paired_t(_pairs(spark, sf).withColumn("year", F.substring("week", 1, 4)), by)
    return out.where("t IS NOT NULL").select(*by, "n", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"))


@query("""WITH r AS (SELECT cve_id, coalesce(cvss, 0) AS x, coalesce(cwe, 'none') AS cwe, 's-' || coalesce(curated_severity, 'none') AS sev FROM records), s AS (SELECT sev, length(sev)::DOUBLE AS y, avg(x) AS x FROM r GROUP BY 1)
SELECT cwe, round(avg(r.x), 6) AS hop_1, round(avg(s.y), 6) AS across, round(avg(s.x), 6) AS hop_3 FROM r JOIN s USING (sev) GROUP BY 1""")
def gra_10_relations(spark, sf):
    """Weaknesses: the mean of their records, of their records' severities, and of what those severities' records have."""
    r = P.records(spark, sf).select(F.col("cve_id").alias("id"), F.coalesce("cvss", F.lit(0.0)).alias("x"), F.coalesce("cwe", F.lit("none")).alias("cwe"), F.concat(F.lit("s-"), F.coalesce("curated_severity", F.lit("none"))).alias("sev"))
    edges = r.select(F.col("id").alias("src"), F.col("cwe").alias("dst"), F.lit("weakness").alias("relation")).unionByName(r.select(F.col("id").alias("src"), F.col("sev").alias("dst"), F.lit("severity").alias("relation")))
    nodes = r.select("id", "x").unionByName(r.select(F.col("cwe").alias("id"), F.lit(0.0).alias("x")).distinct()).unionByName(r.select(F.col("sev").alias("id"), F.length("sev").cast("double").alias("x")).distinct())
    out = G.neighbour_means(edges, nodes, ["x"], hops=3)
    named = out.join(r.select(F.col("cwe").alias("id")).distinct(), "id", "left_semi")
    return named.select(F.col("id").alias("cwe"), F.round("weakness_1_x", 6).alias("hop_1"), F.round("weakness_2_severity_1_x", 6).alias("across"), F.round("weakness_3_severity_2_severity_1_x", 6).alias("hop_3"))


_SLIDING = "SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 4 HOURS PRECEDING AND CURRENT ROW) AS n FROM events"


@query(f"SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, n FROM ({_SLIDING}) WHERE n > 2", views=())
def str_02_sliding(spark, sf):
    out = jobs.sliding_counts(spark.read.parquet(f"{sf}/events.parquet"), 4 * 3600).where("n > 2")
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "n")


@query(f"SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, least(n, 3) AS n FROM ({_SLIDING}) WHERE n > 2 AND ts <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTES", views=())
def str_02_sliding_stream(spark, sf):
    """Events over the budget that the watermark has passed when all that has landed is read."""
    root = _folder(spark, "sliding")
    out = jobs.drained(jobs.sliding_budget(_stream(spark, sf), 2, 4 * 3600), "sliding", f"{root}/checkpoint", sink=f"{root}/out")
    return out.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "n")


@query(f"{_KEV_WALK}, {_walk_sql(60, 0.4)} SELECT id, round(score, 9) AS score FROM r60")
def gra_04_converged(spark, sf):
    """The walk goes on until a stretch of rounds moves less than the tolerance in all."""
    return _rounded(G.diffusion(_edges(spark, sf), _seeds(spark, sf, "kev_flag"), restart=0.4, tolerance=1e-12), "id", digits=9)


@query("SELECT cve_id, CASE WHEN key % 700 = 0 THEN 9.9 ELSE cvss END AS cvss, published::DATE::VARCHAR AS published FROM records")
def str_01_bucketed(spark, sf):
    """Two landings, drained into a table in buckets: the second rewrites only the buckets of its few keys."""
    root = _folder(spark, "bucketed")
    r = P.records(spark, sf).select("cve_id", F.to_date("published").cast("string").alias("published"), "cvss", "key")
    table = K.BucketedTable(spark, f"{root}/table", buckets=32)
    stream = lambda: jobs.events(spark, f"{root}/landing", "cve_id string, published string, cvss double", "json")
    r.drop("key").write.json(f"{root}/landing")
    jobs.ingest_buckets(stream(), table, f"{root}/checkpoint").awaitTermination()
    r.where("key % 700 = 0").select("cve_id", "published", F.lit(9.9).alias("cvss")).write.mode("append").json(f"{root}/landing")
    jobs.ingest_buckets(stream(), table, f"{root}/checkpoint").awaitTermination()
    return table.read()


@query(_FUZZY + " SELECT cve_id, term, round(cosine, 6) AS cosine FROM (SELECT dv.k AS cve_id, tw.k AS term, sum(v * w) / any_value(l) AS cosine FROM dv JOIN tw USING (g) JOIN dl ON dl.k = dv.k GROUP BY 1, 2) WHERE round(cosine, 9) >= 0.3")
def txt_07_matches(spark, sf):
    """The similarity join by prefixes."""
    return _rounded(TM.fuzzy_matches(P.records(spark, sf).select("cve_id", "description"), "cve_id", "description", _fuzzy_terms(spark), 0.3), "cve_id", "term")


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE cve_id IS NULL) AS differing, count(*) AS n_train, 'cvss_norm,epss_score,has_attack,is_healthcare,kev_flag,recency' AS features FROM records")
def snk_10_saved_model(spark, sf):
    """A model and its card, saved, loaded and scored again: rows, rows whose score differs, and what the card says."""
    rows = stage(_training(spark, sf), "training-rows")
    model, root = M.fit_trees(rows, _FEATURE_LIST, depth=2, rounds=2), _folder(spark, "model")
    M.save(model, root, _FEATURE_LIST, {"ndcg_10": M.quality(M.scored(model, rows))}, rows.count())
    first, again = (M.scored(m, rows).select("cve_id", F.col("score").alias(n)) for m, n in ((model, "a"), (M.load(root), "b")))
    card = spark.read.schema("features array<string>, metrics map<string,double>, n_train bigint").json(f"{root}/card").first()
    out = first.join(again, "cve_id", "full_outer").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))
    return out.select("rows", "differing", F.lit(card["n_train"]).cast("bigint").alias("n_train"), F.lit(",".join(sorted(card["features"]))).alias("features"))


# fixed values: three values for each of three options, three folds and the first 20 rows; ten replicas; four sizes
_OPTIONS = {"step": [0.1, 0.3, 1.0], "regular": [0.001, 0.01, 0.1], "decay": [1.0, 0.9, 0.7]}


@query()
def mod_05_grid_27(spark, sf):
    """All 27 combinations on three folds, fitted together."""
    return searches.grid(_training(spark, sf), _FEATURE_LIST, _OPTIONS)


@query()
def mod_07_replicas(spark, sf):
    """Every record under ten rankers, fitted together on draws of whole weeks."""
    rows = stage(_training(spark, sf), "training-rows")
    return _rounded(searches.ensemble(rows, rows, _FEATURE_LIST, 10), "cve_id")


@query()
def mod_10_runs(spark, sf):
    """Four sizes by five seeds."""
    runs = searches.importance_runs(_training(spark, sf), _FEATURE_LIST, (0.1, 0.3, 0.5, 1.0), ("one", "two", "three", "four", "five"))
    return T.stability(runs, "run", "feature", "importance", 3)
