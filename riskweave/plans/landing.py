"""Feeds, sinks and streams over files that are landed from the test tables first: what is read back must equal what SQL says of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import sinks as K
from riskweave.operators import text_match as TM
from riskweave.plans.base import query
from riskweave.session import shared_dir, swept
from riskweave.sources import feeds
from riskweave.sources import projection as P
from riskweave.streaming import jobs

#: Entries of a landed document; documents are as many as the table needs.
PAGE = 500


def _folder(spark: SparkSession, name: str) -> str:
    return swept(spark, f"{shared_dir(spark)}/riskweave/landed-{name}-{uuid.uuid4().hex}")


def _documents(rows: DataFrame, entry, name: str, **others) -> str:
    """Lands JSON documents whose field ``name`` lists up to about PAGE entries each."""
    spark = rows.sparkSession
    path = _folder(spark, name)
    paged = rows.groupBy(F.floor(F.col("key") / PAGE).alias("_page")).agg(F.collect_list(entry).alias(name))
    paged.select(*[v.alias(k) for k, v in others.items()], name).write.option("maxRecordsPerFile", 1).json(path)  # a document is a file
    return path


def _record_pages(spark, sf) -> str:
    r = P.records(spark, sf)
    data = F.struct(F.col("cvss").alias("baseScore"), F.col("cvss_vector").alias("vectorString"))
    newer, older = F.when(F.col("key") % 2 == 0, F.array(F.struct(data.alias("cvssData")))), F.when(F.col("key") % 2 == 1, F.array(F.struct(data.alias("cvssData"))))
    text = lambda c: F.array(F.struct(F.col(c).alias("value")))
    cve = F.struct(
        F.col("cve_id").alias("id"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("published"), F.lit("no date").alias("lastModified"), text("description").alias("descriptions"),
        F.struct(newer.alias("cvssMetricV31"), older.alias("cvssMetricV30")).alias("metrics"), F.array(F.struct(text("cwe").alias("description"))).alias("weaknesses"),
    )
    return _documents(r, F.struct(cve.alias("cve")), "vulnerabilities", totalResults=F.lit(1))


@query("SELECT cve_id, published::DATE::VARCHAR AS published, NULL::VARCHAR AS modified, description, cvss, cvss_vector, cwe FROM records")
def src_01_record_pages(spark, sf):
    out = feeds.records(spark, _record_pages(spark, sf))
    return out.select("cve_id", F.to_date("published").cast("string").alias("published"), F.col("modified").cast("string").alias("modified"), "description", "cvss", "cvss_vector", "cwe")


@query("SELECT cve_id, cvss FROM records WHERE published >= TIMESTAMP '2001-07-01' - INTERVAL 120 DAY")
def src_02_recent_pages(spark, sf):
    return feeds.recent_records(spark, _record_pages(spark, sf), 120, "2001-07-01").select("cve_id", "cvss")


@query("SELECT cve_id, date_added::VARCHAR AS date_added FROM exploited", ("records", "exploited"))
def src_03_exploited_csv(spark, sf):
    path = _folder(spark, "exploited-csv")
    P.exploited(spark, sf).select(F.col("cve_id").alias(" CVE ID "), F.col("date_added").alias("Date Added")).write.option("header", True).csv(path)
    return feeds.exploited_csv(spark, path).select("cve_id", "date_added")


@query("SELECT cve_id, date_added::VARCHAR AS date_added FROM exploited", ("records", "exploited"))
def src_04_exploited_json(spark, sf):
    e = P.exploited(spark, sf).join(P.records(spark, sf).select("cve_id", "key"), "cve_id")
    path = _documents(e, F.struct(F.col("cve_id").alias("cveID"), F.col("date_added").cast("string").alias("dateAdded")), "vulnerabilities")
    return feeds.exploited_json(spark, path).withColumn("date_added", F.col("date_added").cast("string"))


@query("SELECT 'T' || p_partkey AS technique, p_name AS name, p_type AS description, p_brand AS alias, (p_size > 25)::BIGINT AS n_capec FROM part", views=())
def src_05_techniques(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("key", F.col("p_partkey"))
    reference = lambda source, value: F.struct(F.lit(source).alias("source_name"), value.alias("external_id"))
    name = F.concat(F.lit("T"), F.col("p_partkey").cast("string"))
    links = F.when(F.col("p_size") > 25, F.array(reference("capec", F.lit("CAPEC-1")), reference("mitre-attack", name))).otherwise(F.array(reference("mitre-attack", name)))
    entry = F.struct(F.lit("attack-pattern").alias("type"), name.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("aliases"), links.alias("external_references"))
    other = F.struct(F.lit("tool").alias("type"), name.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("aliases"), links.alias("external_references"))
    path = _documents(p.select("*", F.explode(F.array(entry, other)).alias("entry")), F.col("entry"), "objects")
    return feeds.techniques(spark, path).select("technique", "name", "description", F.col("aliases")[0].alias("alias"), F.size("capec").cast("bigint").alias("n_capec"))


@query("SELECT DISTINCT p_name AS product, p_brand AS developer FROM part", views=())
def src_06_products(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("key", F.col("p_partkey"))
    nested = F.struct(F.struct(F.col("p_name").alias("name")).alias("product"), F.struct(F.col("p_brand").alias("name")).alias("developer"))
    return feeds.products(spark, _documents(p, nested, "results", recordCount=F.lit(1)))


@query("SELECT cve_id, epss_score, epss_percentile, epss_date::VARCHAR AS epss_date FROM records")
def src_07_exploit_scores(spark, sf):
    text = [F.col(c).cast("string").alias(n) for c, n in (("cve_id", "cve"), ("epss_score", "epss"), ("epss_percentile", "percentile"), ("epss_date", "date"))]
    out = feeds.exploit_scores(spark, _documents(P.records(spark, sf), F.struct(*text), "data"))
    return out.withColumn("epss_date", F.col("epss_date").cast("string"))


@query("SELECT cve_id, epss_score, CASE WHEN key % 2 = 0 THEN epss_date END::VARCHAR AS epss_date FROM records WHERE epss_score IS NOT NULL")
def src_08_snapshots(spark, sf):
    """Half of the snapshots list entries, half map ids to numbers."""
    r = P.records(spark, sf).where("epss_score IS NOT NULL")
    paged = lambda rest: r.where(f"key % 2 = {rest}").groupBy(F.floor(F.col("key") / PAGE).alias("_page"))
    entry = F.struct(F.col("cve_id").alias("cve"), F.col("epss_score").cast("string").alias("epss"), F.col("epss_date").cast("string").alias("date"))
    listed = paged(0).agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("value")).select("value")
    mapped = paged(1).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("cve_id", "epss_score")))).alias("value")).select("value")
    path = _folder(spark, "snapshots")
    every = listed.unionByName(mapped)
    every.write.option("maxRecordsPerFile", 1).text(path)  # a snapshot is a file
    return feeds.exploit_score_snapshots(spark, path).withColumn("epss_date", F.col("epss_date").cast("string"))


@query("SELECT p_brand AS recalling_firm, p_name AS product_description, p_type AS \"openfda.device_name\", p_size::BIGINT AS \"openfda.class.level\" FROM part", views=())
def src_09_recalls(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("key", F.col("p_partkey"))
    entry = F.struct(F.col("p_brand").alias("recalling_firm"), F.col("p_name").alias("product_description"), F.struct(F.col("p_type").alias("device_name"), F.struct(F.col("p_size").alias("level")).alias("class")).alias("openfda"))
    out = feeds.recalls(spark, _documents(p, entry, "results"))
    return out.select("recalling_firm", "product_description", "`openfda.device_name`", "`openfda.class.level`")


@query("SELECT cve_id, curated_severity AS severity, kev_flag = 1 AS exploited_in_wild FROM records WHERE is_curated = 1")
def src_11_incidents(spark, sf):
    r = P.records(spark, sf).where("is_curated = 1")
    entry = F.struct("cve_id", F.col("curated_severity").alias("severity"), (F.col("kev_flag") == 1).alias("exploited_in_wild"), F.array("description").alias("affected_vendors"))
    return feeds.incidents(spark, _documents(r, entry, "breaches", metadata=F.lit("landed"))).select("cve_id", "severity", "exploited_in_wild")


@query("SELECT lower(trim(p_name)) AS pattern, min(p_brand) AS key FROM part WHERE p_size > 25 GROUP BY 1", views=())
def src_12_patterns(spark, sf):
    path = _folder(spark, "patterns")
    p = spark.read.parquet(f"{sf}/part.parquet")
    p.select(F.lit("product").alias("type"), F.col("p_brand").alias("key"), F.col("p_name").alias("pattern"), F.when(F.col("p_size") > 25, "Yes").otherwise("no").alias("active")).write.option("header", True).csv(path)
    built_in = TM.vocabulary_rows(spark)
    both = feeds.patterns(spark, path, built_in)
    return both.join(built_in.select("pattern").distinct(), "pattern", "left_anti").select("pattern", "key")


@query("SELECT cve_id, published::DATE::VARCHAR AS published, cvss, epss_score, kev_flag FROM records WHERE cvss >= 5.0 AND kev_flag = 1 AND published >= TIMESTAMP '1996-01-01'")
def src_13_base_scan(spark, sf):
    r = P.records(spark, sf)
    base = r.select("cve_id", F.col("published").cast("string").alias("published"), "cvss")
    out = feeds.base_scan(base, r.select("cve_id", "epss_score", "kev_flag"), min_cvss=5.0, kev_only=True, start="1996-01-01")
    return out.select("cve_id", F.to_date("published").cast("string").alias("published"), "cvss", "epss_score", "kev_flag")


@query("SELECT cve_id, published::DATE::VARCHAR AS published, cvss FROM records WHERE key % 3 > 0")
def src_14_newest_file(spark, sf):
    """Two landed versions; the later holds other rows, a third of them with dates that can't be read."""
    root = _folder(spark, "features")
    r = P.records(spark, sf)
    text = F.when(F.col("key") % 3 == 0, F.lit("never")).otherwise(F.col("published").cast("string"))
    r.select("cve_id", "published", F.lit(0.0).alias("cvss")).write.option("header", True).csv(f"{root}/features_20250101")
    r.select("cve_id", text.alias("published"), "cvss").write.option("header", True).csv(f"{root}/features_20250301")
    out = feeds.newest_snapshot(spark, root, "features_*")
    return out.select("cve_id", F.to_date("published").cast("string").alias("published"), F.col("cvss").try_cast("double").alias("cvss"))


@query("SELECT 'exploits' AS source, true AS fresh, false AS stale FROM (SELECT count(*) AS n FROM records) WHERE n > 0 UNION ALL SELECT 'lists', true, false FROM (SELECT count(*) AS n FROM records) WHERE n > 0")
def src_15_freshness(spark, sf):
    root = _folder(spark, "sources")
    P.records(spark, sf).select("cve_id", "epss_score").write.parquet(f"{root}/exploits")
    P.records(spark, sf).where("kev_flag = 1").select("cve_id").write.parquet(f"{root}/lists")
    return feeds.freshness(spark, root, 7).select("source", (F.col("files") > 0).alias("fresh"), "stale")


@query("SELECT CASE WHEN key % 7 = 0 THEN 0.5::DOUBLE ELSE epss_score END AS epss_score, epss_percentile, cve_id, CASE WHEN key % 7 = 0 THEN 'later' ELSE 'first' END AS updated_at FROM records")
def snk_02_partial_upsert(spark, sf):
    """Only the columns that the new rows bring change, and the time of the change."""
    r = P.records(spark, sf)
    old = r.select("cve_id", "epss_score", "epss_percentile", F.lit("first").alias("updated_at"))
    new = r.where("key % 7 = 0").select("cve_id", F.lit(0.5).alias("epss_score"), F.lit("later").alias("updated_at"))
    return K.upserted(old, new)


@query("SELECT cve_id, place::INTEGER AS place FROM (SELECT cve_id, row_number() OVER (ORDER BY healthcare_score DESC, cve_id) AS place FROM records) WHERE place <= 25")
def snk_05_scored_output(spark, sf):
    root = _folder(spark, "scored")
    K.scored_output(P.records(spark, sf).select("cve_id", "healthcare_score"), root, "healthcare_score", "cve_id", 25)
    tops = spark.read.option("header", True).schema("cve_id string, healthcare_score double").csv(f"{root}/top")
    return tops.selectExpr("cve_id", "row_number() OVER (ORDER BY healthcare_score DESC, cve_id) AS place")


@query("SELECT year(published)::INTEGER AS year, count(*) FILTER (kev_flag = 0) AS \"0_n\", round(avg(cvss) FILTER (kev_flag = 0), 6) AS \"0_avg_cvss\", count(*) FILTER (kev_flag = 1) AS \"1_n\", round(avg(cvss) FILTER (kev_flag = 1), 6) AS \"1_avg_cvss\" FROM records GROUP BY 1")
def snk_06_export(spark, sf):
    path = _folder(spark, "export")
    wide = P.records(spark, sf).groupBy(F.year("published").alias("year")).pivot("kev_flag", [0, 1]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cvss"), 6).alias("avg(cvss)"))
    K.export(wide, path)
    return spark.read.parquet(path)


@query("SELECT c_mktsegment AS kind, max(c_name) AS pattern, count(*) AS n FROM customer GROUP BY 1", views=())
def snk_08_vocabulary_rows(spark, sf):
    """Rows of a vocabulary, written as CSV under plain names and read back."""
    path = _folder(spark, "vocabulary")
    rows = spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.col("c_mktsegment").alias("kind")).agg(F.max("c_name").alias("pattern"), F.count(F.lit(1)).alias("(n)"))
    K.export(rows, path, "csv")
    return spark.read.option("header", True).schema("kind string, pattern string, n bigint").csv(path)


def _stream(spark, sf) -> DataFrame:
    """The events as a stream of landed files."""
    landing = _folder(spark, "events")
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(landing)
    return jobs.events(spark, landing, rows.schema)


@query("SELECT cve_id, CASE WHEN key % 7 = 0 THEN 9.9 ELSE cvss END AS cvss, published::DATE::VARCHAR AS published FROM records")
def str_01_04_ingest(spark, sf):
    """Two landings, each drained to its end: the second goes on from the checkpoint and upserts into the first's snapshot."""
    root = _folder(spark, "ingest")
    r = P.records(spark, sf).select("cve_id", F.to_date("published").cast("string").alias("published"), "cvss", "key")
    stream = lambda: jobs.events(spark, f"{root}/landing", "cve_id string, published string, cvss double", "json")
    r.drop("key").write.json(f"{root}/landing")
    jobs.ingest(stream(), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    r.where("key % 7 = 0").select("cve_id", "published", F.lit(9.9).alias("cvss")).write.mode("append").json(f"{root}/landing")
    jobs.ingest(stream(), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return jobs.latest_snapshot(spark, f"{root}/table")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events) SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, user_id, n FROM (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2), m
WHERE n > 2 AND start + INTERVAL 60 MINUTE <= mark""", views=())
def str_02_budget_stream(spark, sf):
    """The windows that the watermark has closed when all that has landed is read."""
    root = _folder(spark, "budget")
    out = jobs.drained(jobs.over_budget(_stream(spark, sf), 2, "60 minutes"), "budget", f"{root}/checkpoint", sink=f"{root}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1", views=())
def str_03_progress_stream(spark, sf):
    root = _folder(spark, "progress")
    out = jobs.drained(jobs.progress(_stream(spark, sf), "event_type", "value"), "progress_" + uuid.uuid4().hex, f"{root}/checkpoint", mode="complete")  # a row for each kind
    return out.select("event_type", "n", "total")


@query("SELECT event_id, event_type, c_mktsegment AS segment FROM events LEFT JOIN customer ON c_custkey = user_id", views=())
def str_05_enriched_stream(spark, sf):
    root = _folder(spark, "enriched")
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return jobs.drained(jobs.enriched(_stream(spark, sf), (c, "user_id")).select("event_id", "event_type", "segment"), "enriched", f"{root}/checkpoint", sink=f"{root}/out")


@query("SELECT r.cve_id, h.epss_date::VARCHAR AS at FROM records r JOIN history h ON h.cve_id = r.cve_id AND h.epss_date BETWEEN r.published::DATE AND r.published::DATE + 30", ("records", "history"))
def str_06_horizon_stream(spark, sf):
    """Both sides as streams of landed files; all of a landing is one batch, so that no row is late."""
    root = _folder(spark, "horizon")
    P.records(spark, sf).select("cve_id", F.to_date("published").cast("timestamp").alias("published")).write.parquet(f"{root}/published")
    P.signal_history(spark, sf).select("cve_id", F.col("epss_date").cast("timestamp").alias("at")).write.parquet(f"{root}/signals")
    p, s = (jobs.events(spark, f"{root}/{n}", f"cve_id string, {c} timestamp") for n, c in (("published", "published"), ("signals", "at")))
    out = jobs.drained(jobs.within_horizon(p, s, 30), "horizon", f"{root}/checkpoint", sink=f"{root}/out")
    return out.select("cve_id", F.to_date("at").cast("string").alias("at"))


@query("SELECT event_type AS stage, arg_max(value, ts) AS status, count(*) AS n FROM events GROUP BY 1", views=())
def str_07_trace_stream(spark, sf):
    """Landed trace records as a stream; a row for each stage."""
    root = _folder(spark, "trace")
    out = jobs.drained(jobs.latest_status(_stream(spark, sf), "event_type", "value"), "trace_" + uuid.uuid4().hex, f"{root}/checkpoint", mode="complete")
    return out.select(F.col("event_type").alias("stage"), "status", "n")
