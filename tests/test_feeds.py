"""Landed files, snapshots and streams in temporary folders."""

import json

from pyspark.sql import functions as F

from riskweave.operators import sinks
from riskweave.sources import feeds
from riskweave.streaming import jobs

PAGE = {
    "totalResults": 2,
    "vulnerabilities": [
        {"cve": {"id": "CVE-2024-0001", "published": "2024-01-15T10:00:00.000", "lastModified": "2024-01-16T10:00:00.000", "descriptions": [{"value": "first"}, {"value": "second"}], "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 7.5, "vectorString": "v30"}}]}, "weaknesses": [{"description": [{"value": "CWE-79"}]}]}},
        {"cve": {"id": "CVE-2024-0002", "published": "bad", "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.8, "vectorString": "v31"}}], "cvssMetricV30": [{"cvssData": {"baseScore": 1.0, "vectorString": "old"}}]}}},
    ],
}


def put(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(folder)


def test_pages(spark, tmp_path):
    got = {r["cve_id"]: r for r in feeds.records(spark, put(tmp_path / "nvd", "p1.json", PAGE)).collect()}
    assert (got["CVE-2024-0001"]["description"], got["CVE-2024-0001"]["cvss"], got["CVE-2024-0001"]["cwe"]) == ("first", 7.5, "CWE-79")
    assert got["CVE-2024-0002"]["cvss"] == 9.8 and got["CVE-2024-0002"]["published"] is None
    assert [r["cve_id"] for r in feeds.recent_records(spark, str(tmp_path / "nvd"), 30, "2024-02-01").collect()] == ["CVE-2024-0001"]


def test_side_feeds(spark, tmp_path):
    csv = put(tmp_path / "kev", "k.csv", " CVE ID ,Date\nCVE-1,2024-01-01\n")
    assert [r["cve_id"] for r in feeds.exploited_csv(spark, csv).collect()] == ["CVE-1"]
    js = put(tmp_path / "kevj", "k.json", {"vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2024-01-02"}]})
    put(tmp_path / "kevj", "l.json", [{"cve_id": "CVE-2", "date_added": "2024-01-03"}])
    assert sorted(r["cve_id"] for r in feeds.exploited_json(spark, js).collect()) == ["CVE-1", "CVE-2"]
    epss = put(tmp_path / "epss", "e.json", {"data": [{"cve": "CVE-1", "epss": "0.1", "percentile": "x", "date": "2024-01-01"}]})
    row = feeds.exploit_scores(spark, epss).first()
    assert row["epss_score"] == 0.1 and row["epss_percentile"] is None
    put(tmp_path / "epss", "f.json", {"CVE-2": {"epss_score": 0.3, "date": "2024-02-01"}, "CVE-3": 0.4})
    assert {r["cve_id"]: r["epss_score"] for r in feeds.exploit_score_snapshots(spark, epss).collect()} == {"CVE-1": 0.1, "CVE-2": 0.3, "CVE-3": 0.4}
    bundle = put(tmp_path / "att", "a.json", {"objects": [{"type": "attack-pattern", "name": "Phish", "external_references": [{"source_name": "mitre-attack", "external_id": "T1"}, {"source_name": "capec", "external_id": "C9"}]}, {"type": "tool", "name": "x"}]})
    t = feeds.techniques(spark, bundle).collect()
    assert [(r["technique"], r["capec"]) for r in t] == [("T1", ["C9"])]
    pages = put(tmp_path / "chpl", "c.json", {"results": [{"product": {"name": "EHR"}, "developer": {"name": "Acme"}}, {"productName": "Lab", "developerName": "Beta"}]})
    assert sorted(r["product"] for r in feeds.products(spark, pages).collect()) == ["EHR", "Lab"]
    fda = put(tmp_path / "fda", "r.json", {"results": [{"firm": "A", "openfda": {"code": {"x": 1}}}]})
    assert feeds.recalls(spark, fda).columns == ["firm", "openfda.code.x"]
    own = put(tmp_path / "pat", "p.csv", "type,key,pattern,active\nvendor,x,Foo,yes\nvendor,y,bar,0\n")
    built = spark.createDataFrame([("vendor", "z", "foo"), ("keyword", "k", "icu")], "type string, key string, pattern string")
    assert {r["pattern"]: r["key"] for r in feeds.patterns(spark, own, built).collect()} == {"foo": "x", "icu": "k"}
    fresh = {r["source"]: r["files"] for r in feeds.freshness(spark, str(tmp_path), 30).collect()}
    assert fresh["epss"] == 2


def test_upsert_keeps_and_merges(spark):
    old = spark.createDataFrame([("a", "2020", "old", 1), ("b", "2021", "keep", 2)], "cve_id string, published string, description string, kev_flag int")
    new = spark.createDataFrame([("a", "2024", "new"), ("c", "2024", "add"), ("a", "2024", "new")], "cve_id string, published string, description string")
    got = {r["cve_id"]: tuple(r)[1:] for r in sinks.upserted(old, new).collect()}
    assert got == {"a": ("2020", "new", 1), "b": ("2021", "keep", 2), "c": ("2024", "add", None)}
    assert feeds.merged_forward(old, new.dropDuplicates()).count() == 3
    log = spark.createDataFrame([("recent", "2024-01-01", "2024-01-31", "success"), ("recent", "2024-02-01", "2024-02-28", "error")], "fetch_type string, fetch_date string, end_date string, status string")
    assert sinks.last_fetch(log, "recent").first()["end_date"] == "2024-01-31"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "cve_id string, score double")
    sinks.scored_output(df, str(tmp_path), "score", "cve_id", 2)
    assert [r["cve_id"] for r in spark.read.option("header", True).csv(f"{tmp_path}/top").collect()] == ["b", "c"]
    pivot = df.groupBy("cve_id").pivot("score", [1.0, 3.0]).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("m"))
    assert all(c.replace("_", "").isalnum() for c in sinks.flat_names(pivot).columns)


def test_stream_ingest_goes_on_and_equals_batch(spark, tmp_path):
    landing, root, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    schema = "cve_id string, published string, description string"

    def run():
        stream = spark.readStream.schema(schema).json(str(landing))
        jobs.ingest(stream, root, mark).awaitTermination()
        return {r["cve_id"]: r["description"] for r in jobs.latest_snapshot(spark, root).collect()}

    put(landing, "1.json", '{"cve_id":"a","published":"1","description":"x"}\n{"cve_id":"b","published":"1","description":"y"}')
    assert run() == {"a": "x", "b": "y"}
    put(landing, "2.json", '{"cve_id":"a","published":"2","description":"z"}')
    assert run() == {"a": "z", "b": "y"}
    assert jobs.latest_snapshot(spark, root).where("cve_id = 'a'").first()["published"] == "1"


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(300).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("t").alias("event_type"), F.lit(1.0).alias("value"))
    path = str(tmp_path / "events")
    rows.write.parquet(path)
    stream = jobs.events(spark, path, rows.schema)
    got = jobs.drained(jobs.progress(stream, "event_type", "value"), "progress_table", str(tmp_path / "c1"), "complete")
    assert got.first()["n"] == 300
    budget = jobs.drained(jobs.over_budget(jobs.events(spark, path, rows.schema), 2, "60 seconds"), "budget", str(tmp_path / "c2"), "update")
    assert {tuple(r) for r in budget.collect()} == {tuple(r) for r in jobs.over_budget(rows, 2, "60 seconds").collect()}
    p = rows.select(F.col("user_id").cast("string").alias("cve_id"), F.col("ts").alias("published")).limit(3)
    p.write.parquet(str(tmp_path / "p"))
    s = rows.select(F.col("user_id").cast("string").alias("cve_id"), F.col("ts").alias("at"))
    s.write.parquet(str(tmp_path / "s"))
    joined = jobs.within_horizon(jobs.events(spark, str(tmp_path / "p"), p.schema), jobs.events(spark, str(tmp_path / "s"), s.schema))
    out = jobs.drained(joined, "horizon", str(tmp_path / "c3"), sink=str(tmp_path / "out"))
    assert out.count() == jobs.within_horizon(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "s"))).count()


def test_records_of_one_printed_id_stay_one_row_each(spark, tmp_path):
    """Keys of eight digits are cut to seven in the id; their training rows don't meet each other's labels."""
    from riskweave.plans.upkeep import _legacy_rows

    spark.sql("SELECT 10000000L + id AS o_orderkey, TIMESTAMP '1995-03-01' AS o_orderdate FROM range(10)").write.parquet(f"{tmp_path}/orders.parquet")
    assert _legacy_rows(spark, str(tmp_path)).count() == 10


def test_snapshots_are_opened_once(spark, tmp_path):
    texts = ['{"data": [{"cve": "CVE-1-1", "epss": "0.5", "date": "2001-02-03"}, {"cve": "CVE-1-2", "epss": "x"}]}', '{"CVE-2-1": 0.25, "other": 1, "CVE-2-2": {"epss_score": 0.75, "date": "2002-01-01"}}', "no json", "{}"]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
    out = feeds.exploit_score_snapshots(spark, str(tmp_path))
    got = sorted((r["cve_id"], r["epss_score"], str(r["epss_date"])) for r in out.collect())
    assert got == [("CVE-1-1", 0.5, "2001-02-03"), ("CVE-1-2", None, "None"), ("CVE-2-1", 0.25, "None"), ("CVE-2-2", 0.75, "2002-01-01")]
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
