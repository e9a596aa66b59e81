"""Text operators over whole documents: each document's text with a record's description before, after or within it."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import expressions as X
from riskweave.functions import vocabulary as V
from riskweave.operators import features as B
from riskweave.operators import text_match as TM
from riskweave.plans.analytics import _PRODUCT_NAMES, _TERMS, _VENDORS, _fuzzy_terms, _rounded, _term_table
from riskweave.plans.base import SQL, query
from riskweave.sources import projection as P

_WORDS = "array_to_string(regexp_extract_all({}, '[a-z0-9_-]+'), ' ')"
_PASSAGES = "p AS (SELECT DISTINCT item_id::VARCHAR AS item_id, array_to_string(string_split(lower(trim(unnest(string_split(text, '.')))), ' ')[1:3], ' ') AS term FROM benchmark)"


def _over_reports(name: str) -> str:
    """The SQL of a query over records, over reports; whole words by runs of word characters."""
    sql = SQL[name].replace(P.RECORDS_SQL.strip(), P.REPORTS_SQL.replace("reports AS", "records AS", 1)).replace("cve_id", "doc_id")
    return sql.replace("contains(' ' || t || ' ',", f"contains(' ' || {_WORDS.format('t')} || ' ',")


@query(_over_reports("fea_05_description"), views=())
def fea_05_reports(spark, sf):
    return B.description_features(P.reports(spark, sf)).drop("description")


@query(_over_reports("fea_06_vendor"), views=())
def fea_06_reports(spark, sf):
    return _rounded(B.vendor_features(P.reports(spark, sf)).drop("description"), "doc_id")


@query(_over_reports("txt_01_04_health"), views=())
def txt_01_04_reports(spark, sf):
    return _rounded(TM.health_score(P.reports(spark, sf)).drop("description"), "doc_id")


@query(_over_reports("txt_11_listed_vendor"), views=())
def txt_11_reports(spark, sf):
    return P.reports(spark, sf).select("doc_id", B.listed_vendor(F.col("description")).alias("vendor"))


@query(_over_reports("fn_05_vendor"), views=())
def fn_05_reports(spark, sf):
    return P.reports(spark, sf).select("doc_id", X.vendor_of(F.col("description")).alias("vendor"))


@query(_over_reports("joi_12_two_stages"), views=())
def joi_12_reports(spark, sf):
    named = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "name string, priority int")
    out = TM.catalogue_match(P.reports(spark, sf), "doc_id", "description", named(_VENDORS), named(_PRODUCT_NAMES))
    return out.select("doc_id", F.col("flag").cast("bigint").alias("flag"), F.array_join("matched", ",").alias("matched"))


@query(_over_reports("txt_07_flag"), views=())
def txt_07_reports(spark, sf):
    return _rounded(TM.fuzzy_flag(P.reports(spark, sf), "doc_id", "description", _fuzzy_terms(spark), V.ANCHORS), "doc_id")


@query(
    f"WITH {P.REPORTS_SQL}, v(term, technique) AS (VALUES {', '.join(str(t) for t in _TERMS)}), t AS (SELECT doc_id, ' ' || {_WORDS.format('lower(description)')} || ' ' AS t FROM reports) "
    "SELECT doc_id, array_to_string(list_sort(list(DISTINCT technique)), ',') AS ids, count(DISTINCT technique) AS n FROM t JOIN v ON contains(t, ' ' || term || ' ') GROUP BY 1",
    views=(),
)
def joi_11_reports(spark, sf):
    out = TM.techniques(P.reports(spark, sf), "doc_id", "description", _term_table(spark))
    return out.select("doc_id", F.array_join("ids", ",").alias("ids"), F.col("n").cast("bigint").alias("n"))


@query(
    f"WITH {_PASSAGES}, t AS (SELECT doc_id, ' ' || {_WORDS.format('lower(text)')} || ' ' AS t FROM documents), q AS (SELECT item_id, {_WORDS.format('term')} AS term FROM p) "
    "SELECT doc_id, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids, count(DISTINCT item_id) AS n FROM t JOIN q ON term <> '' AND contains(t, ' ' || term || ' ') GROUP BY 1",
    views=(),
)
def joi_11_passages(spark, sf):
    """Documents that hold the first three words of a benchmark sentence, by item: a vocabulary that the tables give."""
    sentences = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.explode(F.split("text", r"\.")).alias("s"))
    start = F.array_join(F.slice(F.split(F.lower(F.trim("s")), " "), 1, 3), " ")
    vocabulary = sentences.select(start.alias("term"), F.col("item_id").cast("string").alias("technique")).distinct()
    out = TM.techniques(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", vocabulary)
    return out.select("doc_id", F.array_join("ids", ",").alias("ids"), F.col("n").cast("bigint").alias("n"))
