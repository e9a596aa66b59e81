"""Risk records and their side feeds as views over the star-schema test tables, by arithmetic on keys.

Each view has a twin in DuckDB SQL, so that every operator can be compared on the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEAKNESSES = ["CWE-79", "CWE-89", "CWE-787,CWE-79", "CWE-416", "CWE-20", "CWE-287", "CWE-327", "CWE-22", "CWE-999", "CWE-362,CWE-190", None, "CWE-119"]
DESCRIPTIONS = [
    "Microsoft Exchange remote code execution in the wild",
    "Cisco router denial of service through crafted packets",
    "Philips infusion pump buffer overflow allows elevated privileges",
    "WordPress plugin cross-site scripting in comments",
    "Epic EHR authentication bypass exposes patient data",
    "Oracle database sql injection through the search form",
    "GE Healthcare PACS path traversal in the dicom viewer",
    "Linux kernel use after free",
    "Apache server 2.4 improper access control",
    "Medtronic insulin pump missing validation of commands",
    "Jenkins csrf in the job page, exploit available",
    "library xml external entity flaw with information disclosure",
    None,
    "Cerner hospital portal privilege escalation",
    "Siemens MRI scanner weak encryption",
    "in fooviewer version 3 a crash on malformed files",
]


def _pick(values: list, k: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record: key, times, severity, weakness, text, signals, label."""
    k = F.col("o_orderkey").cast("bigint")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")

    def letter(letters: str, x: F.Column) -> F.Column:
        return F.substring(F.lit(letters), (x % len(letters) + 1).cast("int"), F.lit(1))

    def part(n: int) -> F.Column:
        return F.floor(k / n)

    vector = F.concat(
        F.lit("CVSS:3.1/AV:"), letter("NALP", k), F.lit("/AC:"), letter("LH", k), F.lit("/PR:"), letter("NLH", k), F.lit("/UI:"), letter("NR", part(2)),
        F.lit("/S:"), letter("UC", part(3)), F.lit("/C:"), letter("HLN", part(5)), F.lit("/I:"), letter("HLN", part(7)), F.lit("/A:"), letter("HLN", part(11)),
    )
    return orders.select(
        F.concat(F.lit("CVE-"), F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad(k.cast("string"), 7, "0")).alias("cve_id"),
        k.alias("key"),
        F.col("o_orderdate").cast("timestamp").alias("published"),
        F.when(k % 17 == 0, None).otherwise((k * 7919 % 101) / F.lit(10.0)).alias("cvss"),
        vector.alias("cvss_vector"),
        _pick(WEAKNESSES, k).alias("cwe"),
        _pick(DESCRIPTIONS, k).alias("description"),
        F.when(k % 13 == 0, None).otherwise((k * 104729 % 1000) / F.lit(1000.0)).alias("epss_score"),
        F.when(k % 13 == 0, None).otherwise((k * 7877 % 1000) / F.lit(1000.0)).alias("epss_percentile"),
        F.when(k % 13 == 0, None).otherwise(F.date_add(F.to_date("o_orderdate"), (k * 31 % 60).cast("int"))).alias("epss_date"),
        (k % 50 == 0).cast("bigint").alias("kev_flag"),
        (k % 3 == 0).cast("bigint").alias("is_healthcare"),
        (k % 11 == 0).cast("bigint").alias("is_curated"),
        F.when(k % 11 == 0, _pick(["critical", "high", "medium"], k)).alias("curated_severity"),
        ((k * 37 % 100) / F.lit(100.0)).alias("healthcare_score"),
        (k % 5 > 0).cast("bigint").alias("attack_flag"),
        (k % 5).alias("attack_technique_count"),
        (k % 7 == 0).cast("bigint").alias("chpl_flag"),
        (k * 13 % 6).alias("label"),
    )


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


RECORDS_SQL = f"""
records AS (SELECT 'CVE-' || year(o_orderdate) || '-' || lpad(k::VARCHAR, 7, '0') AS cve_id, k AS key, o_orderdate::TIMESTAMP AS published,
  CASE WHEN k % 17 = 0 THEN NULL ELSE (k * 7919 % 101) / 10.0::DOUBLE END AS cvss,
  'CVSS:3.1/AV:' || substr('NALP', k % 4 + 1, 1) || '/AC:' || substr('LH', k % 2 + 1, 1) || '/PR:' || substr('NLH', k % 3 + 1, 1) || '/UI:' || substr('NR', k // 2 % 2 + 1, 1)
  || '/S:' || substr('UC', k // 3 % 2 + 1, 1) || '/C:' || substr('HLN', k // 5 % 3 + 1, 1) || '/I:' || substr('HLN', k // 7 % 3 + 1, 1) || '/A:' || substr('HLN', k // 11 % 3 + 1, 1) AS cvss_vector,
  ({_list(WEAKNESSES)})[k % 12 + 1] AS cwe, ({_list(DESCRIPTIONS)})[k % 16 + 1] AS description,
  CASE WHEN k % 13 = 0 THEN NULL ELSE (k * 104729 % 1000) / 1000.0::DOUBLE END AS epss_score,
  CASE WHEN k % 13 = 0 THEN NULL ELSE (k * 7877 % 1000) / 1000.0::DOUBLE END AS epss_percentile,
  CASE WHEN k % 13 = 0 THEN NULL ELSE (o_orderdate::DATE + (k * 31 % 60)::INTEGER)::DATE END AS epss_date,
  (k % 50 = 0)::BIGINT AS kev_flag, (k % 3 = 0)::BIGINT AS is_healthcare, (k % 11 = 0)::BIGINT AS is_curated,
  CASE WHEN k % 11 = 0 THEN (['critical', 'high', 'medium'])[k % 3 + 1] END AS curated_severity, (k * 37 % 100) / 100.0::DOUBLE AS healthcare_score,
  (k % 5 > 0)::BIGINT AS attack_flag, k % 5 AS attack_technique_count, (k % 7 = 0)::BIGINT AS chpl_flag, k * 13 % 6 AS label
  FROM (SELECT o_orderkey::BIGINT AS k, o_orderdate FROM orders))"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, description): whole documents, of which most have a description before, after or within their text."""
    k = F.col("doc_id").cast("bigint")
    said = _pick(DESCRIPTIONS, k * 7)
    within = F.concat(F.substring("text", 1, 200), F.lit(", "), said, F.lit(". "), F.expr("substring(text, 201)"))
    text = F.when(k % 5 == 4, F.col("text")).when(k % 3 == 0, F.concat(said, F.lit(" "), F.col("text"))).when(k % 3 == 1, F.concat(F.col("text"), F.lit(" "), said)).otherwise(within)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("description"))


REPORTS_SQL = f"""reports AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN text WHEN doc_id % 3 = 0 THEN said || ' ' || text WHEN doc_id % 3 = 1 THEN text || ' ' || said
  ELSE substr(text, 1, 200) || ', ' || said || '. ' || substr(text, 201) END AS description FROM (SELECT doc_id, text, ({_list(DESCRIPTIONS)})[doc_id * 7 % 16 + 1] AS said FROM documents))"""


def signal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated scores of records: cve_id, epss_date, epss_score; one row for each line item."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("bigint").alias("key"), "l_shipdate", "l_discount")
    keys = records(spark, sf_dir).select("key", "cve_id")
    return lines.join(keys, "key").select("cve_id", F.to_date("l_shipdate").alias("epss_date"), (F.col("l_discount") * 10).alias("epss_score"))


HISTORY_SQL = "history AS (SELECT cve_id, l_shipdate::DATE AS epss_date, l_discount * 10 AS epss_score FROM lineitem JOIN records ON l_orderkey = key)"


def exploited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cve_id and date_added of exploited records: those with a returned line item."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("bigint").alias("key"), "l_shipdate")
    first = lines.groupBy("key").agg(F.min(F.to_date("l_shipdate")).alias("date_added"))
    return first.join(records(spark, sf_dir).select("key", "cve_id"), "key").select("cve_id", "date_added")


EXPLOITED_SQL = "exploited AS (SELECT cve_id, min(l_shipdate::DATE) AS date_added FROM lineitem JOIN records ON l_orderkey = key WHERE l_returnflag = 'R' GROUP BY cve_id)"


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cve_id, week, label, model, score): three models' scores of each record with a score."""
    from riskweave.functions.expressions import sunday_week

    r = records(spark, sf_dir)
    k = F.col("key")
    scored = r.select("cve_id", sunday_week(F.col("published")).alias("week"), F.least(F.col("label"), F.lit(3)).alias("label"),
                      F.explode(F.create_map(F.lit("a"), (k * 7919 % 1009) / F.lit(1009.0), F.lit("b"), (k * 104729 % 997) / F.lit(997.0), F.lit("c"), (k * 31 % 50) / F.lit(50.0))).alias("model", "score"))
    return scored


SCORES_SQL = """scores AS (SELECT cve_id, year(published) || '-' || lpad(((dayofyear(published) + 6 - dayofweek(published)) // 7)::VARCHAR, 2, '0') AS week, least(label, 3) AS label, model, score
  FROM records, LATERAL (VALUES ('a', (key * 7919 % 1009) / 1009.0::DOUBLE), ('b', (key * 104729 % 997) / 997.0::DOUBLE), ('c', (key * 31 % 50) / 50.0::DOUBLE)) m(model, score))"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with planted faults: repeated and badly formed ids, severities and scores out of range, missing dates and values, blank and empty texts."""
    r, k = records(spark, sf_dir), F.col("key")
    broken = r.withColumns(
        {
            "cve_id": F.when(k % 41 == 0, F.concat(F.lit("BAD-"), k.cast("string"))).otherwise(F.col("cve_id")),
            "cvss": F.when(k % 29 == 0, F.lit(11.0)).when(k % 37 == 0, F.lit(-1.0)).otherwise(F.col("cvss")),
            "published": F.when(k % 31 == 0, None).otherwise(F.col("published")),
            "description": F.when(k % 43 == 0, F.lit("   ")).otherwise(F.col("description")),
            "epss_date": F.when(k % 19 == 0, None).otherwise(F.col("epss_date")),
            "epss_score": F.when(k % 23 == 0, F.lit(1.5)).otherwise(F.col("epss_score")),
            "healthcare_score": F.when(k % 47 == 0, None).otherwise(F.col("healthcare_score")),
            "curated_severity": F.when(k % 2 == 0, None).otherwise(F.col("curated_severity")),
            "attack_flag": F.when(k % 53 == 0, F.lit(0).cast("bigint")).otherwise(F.col("attack_flag")),
        }
    )
    return broken.unionByName(broken.where(k % 97 == 0))


FAULTY_SQL = """faulty AS (WITH b AS (SELECT key, CASE WHEN key % 41 = 0 THEN 'BAD-' || key ELSE cve_id END AS cve_id, CASE WHEN key % 29 = 0 THEN 11.0 WHEN key % 37 = 0 THEN -1.0 ELSE cvss END AS cvss,
  CASE WHEN key % 31 = 0 THEN NULL ELSE published END AS published, CASE WHEN key % 43 = 0 THEN '   ' ELSE description END AS description, CASE WHEN key % 19 = 0 THEN NULL ELSE epss_date END AS epss_date,
  CASE WHEN key % 23 = 0 THEN 1.5 ELSE epss_score END AS epss_score, epss_percentile, CASE WHEN key % 47 = 0 THEN NULL ELSE healthcare_score END AS healthcare_score, is_healthcare, is_curated,
  CASE WHEN key % 2 = 0 THEN NULL ELSE curated_severity END AS curated_severity, CASE WHEN key % 53 = 0 THEN 0 ELSE attack_flag END AS attack_flag, attack_technique_count FROM records)
  SELECT * FROM b UNION ALL SELECT * FROM b WHERE key % 97 = 0)"""
