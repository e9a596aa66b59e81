"""Landed feeds: JSON, CSV, HTML and text files read with declared schemas into flat tables. Bad values become null, never errors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.filters import select_records
from riskweave.operators.ranking import latest

_DATA = "struct<baseScore:double,vectorString:string>"
RECORD_PAGE = (
    "totalResults bigint, vulnerabilities array<struct<cve:struct<id:string,published:string,lastModified:string,descriptions:array<struct<value:string>>,"
    f"metrics:struct<cvssMetricV31:array<struct<cvssData:{_DATA}>>,cvssMetricV30:array<struct<cvssData:{_DATA}>>>,weaknesses:array<struct<description:array<struct<value:string>>>>>>>"
)


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each vulnerability of the landed pages: first description, first score of version 3.1 or else 3.0, first weakness."""
    pages = spark.read.schema(RECORD_PAGE).json(path, multiLine=True)
    cve = pages.select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")
    data = F.coalesce(F.get("metrics.cvssMetricV31", F.lit(0))["cvssData"], F.get("metrics.cvssMetricV30", F.lit(0))["cvssData"])
    return cve.select(
        F.col("id").alias("cve_id"),
        F.try_to_timestamp("published").alias("published"),
        F.try_to_timestamp("lastModified").alias("modified"),
        F.get("descriptions", F.lit(0))["value"].alias("description"),
        data["baseScore"].alias("cvss"),
        data["vectorString"].alias("cvss_vector"),
        F.get(F.get("weaknesses", F.lit(0))["description"], F.lit(0))["value"].alias("cwe"),
        F.to_json(F.struct("*")).alias("raw_json"),
    )


def recent_records(spark: SparkSession, path: str, days_back: int, now: str | None = None) -> DataFrame:
    today = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return records(spark, path).where(F.col("published") >= today - F.make_dt_interval(F.lit(days_back))).select("cve_id", "published", "description", "cvss")


def exploited_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV list of ids: header names are trimmed, lower-cased and joined by ``_``; the id column is one of the usual names, or any that holds ``cve``; else null."""
    raw = spark.read.option("header", True).csv(path)
    names = [re.sub(r"\s+", "_", c.strip().lower()) for c in raw.columns]
    table = raw.toDF(*names)
    usual = [c for c in ("cve_id", "cveid", "cve", "cve_number", "cve-id", "vulnerability_id") if c in names]
    found = usual[0] if usual else next((c for c in names if "cve" in c), None)
    return table.withColumn("cve_id", F.col(f"`{found}`") if found else F.lit(None).cast("string"))


def exploited_json(spark: SparkSession, path: str) -> DataFrame:
    """(cve_id, date_added) of a dict with ``vulnerabilities`` or a list of entries, in any of three spellings."""
    entry = "cveID:string,cve_id:string,cve:string,dateAdded:string,date_added:string"
    raw = spark.read.schema(f"vulnerabilities array<struct<{entry}>>, {entry.replace(':', ' ')}").json(path, multiLine=True)
    own = F.struct("cveID", "cve_id", "cve", "dateAdded", "date_added")
    rows = raw.select(F.explode(F.coalesce("vulnerabilities", F.array(own))).alias("v"))
    return rows.select(F.coalesce("v.cveID", "v.cve_id", "v.cve").alias("cve_id"), F.to_date(F.coalesce("v.dateAdded", "v.date_added").try_cast("timestamp")).alias("date_added")).where("cve_id IS NOT NULL")


def techniques(spark: SparkSession, path: str) -> DataFrame:
    """(technique, name, description, aliases, capec) of a bundle's attack patterns."""
    schema = "objects array<struct<type:string,id:string,name:string,description:string,aliases:array<string>,external_references:array<struct<source_name:string,external_id:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*").where("type = 'attack-pattern'")
    of = lambda source: F.transform(F.filter("external_references", lambda r: r["source_name"] == source), lambda r: r["external_id"])
    return rows.select(F.get(of("mitre-attack"), F.lit(0)).alias("technique"), "name", "description", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), of("capec").alias("capec"))


def products(spark: SparkSession, path: str) -> DataFrame:
    """(product, developer) of catalogue pages, nested or flat."""
    schema = "recordCount bigint, results array<struct<product:struct<name:string>,developer:struct<name:string>,productName:string,developerName:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("r"))
    return rows.select(F.coalesce("r.product.name", "r.productName").alias("product"), F.coalesce("r.developer.name", "r.developerName").alias("developer")).distinct()


def exploit_scores(spark: SparkSession, path: str) -> DataFrame:
    """(cve_id, epss_score, epss_percentile, epss_date) of ``data`` lists; numbers come as text."""
    schema = "data array<struct<cve:string,epss:string,percentile:string,date:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data").alias("d"))
    return rows.select(F.col("d.cve").alias("cve_id"), F.col("d.epss").try_cast("double").alias("epss_score"), F.col("d.percentile").try_cast("double").alias("epss_percentile"), F.col("d.date").try_cast("date").alias("epss_date"))


def exploit_score_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The same of a folder of snapshots in two shapes: a ``data`` list, or a map of id to number or to (epss_score, date)."""
    text = spark.read.text(path, wholetext=True).select("value", F.get_json_object("value", "$.data").alias("_data"))
    entry = lambda k, score, date: F.struct(k.alias("cve_id"), score.alias("epss_score"), date.try_cast("date").alias("epss_date"))
    listed = F.transform(F.from_json("_data", "array<struct<cve:string,epss:string,date:string>>"), lambda d: entry(d["cve"], d["epss"].try_cast("double"), d["date"]))
    pairs = F.filter(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: e["key"].like("CVE-%"))
    score = lambda v: F.coalesce(v.try_cast("double"), F.get_json_object(v, "$.epss_score").try_cast("double"))
    mapped = F.transform(pairs, lambda e: entry(e["key"], score(e["value"]), F.get_json_object(e["value"], "$.date")))
    # both shapes in one pass: each file is opened once
    return text.select(F.inline(F.when(F.col("_data").isNotNull(), listed).otherwise(mapped)))


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """All struct fields as columns of their dotted names; arrays stay."""

    def walk(fields: list[T.StructField], path: list[str]):
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, [*path, f.name])
            else:
                yield F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias(separator.join([*path, f.name]))

    return df.select(*walk(df.schema.fields, []))


def recalls(spark: SparkSession, path: str) -> DataFrame:
    """Entries of ``results`` with all nested fields as columns."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")
    return flattened(rows)


def advisory_ids(pages: DataFrame, column: str = "html", pattern: str = r"(?i)(CVE-\d{4}-\d{4,})") -> DataFrame:
    """(id, n) of the distinct ids that the texts name, upper case, with the number of texts."""
    ids = pages.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(column, F.lit(pattern), 1), lambda x: F.upper(x)))).alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def incidents(spark: SparkSession, path: str) -> DataFrame:
    schema = "breaches array<struct<cve_id:string,severity:string,confidence:string,healthcare_impact:string,affected_vendors:array<string>,breach_type:string,exploited_in_wild:boolean,source:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("breaches").alias("b")).select("b.*")


def patterns(spark: SparkSession, path: str, built_in: DataFrame) -> DataFrame:
    """(type, key, pattern) of a CSV's active rows and of the built-in vocabulary, each pattern once, the CSV's first."""
    own = spark.read.option("header", True).csv(path)
    active = own.where(F.lower(F.trim("active")).isin("1", "true", "yes", "y")).select("type", "key", F.lower(F.trim("pattern")).alias("pattern"), F.lit(0).alias("_o"))
    every = active.unionByName(built_in.select("type", "key", "pattern", F.lit(1).alias("_o")))
    return latest(every.where("pattern <> ''"), ["pattern"], [F.asc("_o"), F.asc("type"), F.asc("key")]).drop("_o")


def base_scan(records: DataFrame, enrichments: DataFrame | None = None, key: str = "cve_id", **conditions) -> DataFrame:
    """Records with readable dates, or null, left-joined with enrichments if given, that meet the conditions of :func:`select_records`; those on records reach their scan."""
    dated = records.withColumn("published", F.col("published").try_cast("timestamp"))
    return select_records(dated if enrichments is None else dated.join(enrichments, key, "left"), **conditions)


def newest_snapshot(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Rows of the CSV file or folder below the path whose name matches the pattern and comes last; rows without a readable date go. Only names are listed, and only the newest is read."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern))
    names = sorted(s.getPath().toString() for s in found or [])
    if not names:
        raise FileNotFoundError(f"nothing in {path} matches {pattern}")
    rows = spark.read.option("header", True).csv(names[-1])
    return rows.withColumn("published", F.col("published").try_cast("timestamp")).where("published IS NOT NULL")


def freshness(spark: SparkSession, path: str, stale_days: int, now: str | None = None) -> DataFrame:
    """(source, files, bytes, newest, age_days, stale) of the folders below the path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    source = F.element_at(F.split("path", "/"), -2)
    out = files.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))
    age = F.datediff(F.lit(now).cast("date") if now else F.current_date(), F.to_date("newest"))
    return out.withColumn("age_days", age.cast("bigint")).withColumn("stale", F.col("age_days") > stale_days)


def merged_forward(old: DataFrame, new: DataFrame, key: str = "cve_id") -> DataFrame:
    """New rows replace old ones of their key; nothing is deleted."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n")))
    return both.withColumn("_p", place).where("_p = 1").drop("_p", "_n")


def hit_share(wanted: DataFrame, known: DataFrame, key: str = "cve_id") -> DataFrame:
    """One row: wanted keys, those known, and whether a refresh can be left out (95 % or more)."""
    w = wanted.select(key).distinct()
    hits = w.join(known.select(key).distinct().withColumn("_k", F.lit(1)), key, "left")
    return hits.agg(F.count(F.lit(1)).alias("wanted"), F.count("_k").alias("known")).withColumn("skip", F.col("known") >= 0.95 * F.col("wanted"))
