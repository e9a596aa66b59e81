"""From documents to packed training tokens: language, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents; further columns, of any name, also those of an operator's own results, stay as they are.

Defined results of every stage: an empty table gives an empty one; repeated rows and ids each count (near-duplicates keep one of equal texts, tokens give a row for each row);
texts of any length are read whole; null texts go with the first stage, and count as empty where a later one is used by itself; a table without n_chars gets none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, langid, mixing, neardup, pii
from riskweave.llm._columns import guarded
from riskweave.session import stage

#: Predictions that are less sure than this are rejected; a text of one of the learned languages is far above.
LEAST_SCORE = 0.2


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; texts that are null, without letters, or unlike all learned languages go."""
    work, restore = guarded(docs, {"doc_id": "doc_id", "text": "text", "lang": "lang"})
    found = langid.identify(work)
    return restore(found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)), [])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced; n_chars follows the text."""
    clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: each document once for each pass of its source that begins before the source's target, by position."""
    work, restore = guarded(docs, {"doc_id": "doc_id", "text": "text", "source": "source"})
    mixed = mixing.mix(work)
    return restore(mixing.training_order(mixed, ["doc_id", "text", "source", "_rest"]), [])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for each row of the sequence."""
    coded = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(coded)


STAGES = [("language ID", languages), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: SQL expresses neither the classifier nor the samples.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
