"""The queries of this subpackage and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import ann, bpe, dialogue, langid, licenses, lm, mixing, neardup, phrases, pii, rules, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5, 256.0)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("found")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.by_position(mixed, ["doc_id", "size", "source_size", "target", "taken"])


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.RULES, urls.canonical_on_hosts(pages, urls.LABELS)).select("page_id", "host", "path", "rule", "verdict", "listed")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.STATISTICS, "base_failed", "kept")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.report(_table(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_nearest": op4_nearest,
    "op5_language_id": op5_language_id,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_lm_scores": op8_lm_scores,
    "op9_pii": op9_pii,
    "op10_url_filter": op10_url_filter,
    "op11_quality_rules": op11_quality_rules,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_phrases": op13_phrases,
}

SQL: dict[str, str] = {
    "op2_exact_top_k": topk.SQL,
    "op6_license_scan": licenses.SQL,
    "op7_mixing": mixing.SQL,
    "op10_url_filter": urls.SQL,
    "op11_quality_rules": rules.SQL,
    "op12_conversation_repair": dialogue.SQL,
    "op13_phrases": phrases.SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
