"""Enrichment joins: by key, by interval, by membership, by phrase."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskweave.functions.expressions import flag
from riskweave.session import stage


def membership(df: DataFrame, keys: DataFrame, name: str, key: str = "cve_id") -> DataFrame:
    """df with 1 where the key is in the other table, else 0; rows are neither lost nor doubled."""
    there = keys.select(key).distinct().withColumn("_there", F.lit(1))
    return df.join(there, key, "left").withColumn(name, F.coalesce("_there", F.lit(0))).drop("_there")


def lookup(df: DataFrame, dimension: DataFrame, key: str, defaults: dict) -> DataFrame:
    """df with the dimension's columns, or their defaults where the key is not in it."""
    out = df.join(dimension.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if v is not None else F.col(c) for c, v in defaults.items()})


def missing(df: DataFrame, known: DataFrame, key: str = "cve_id") -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_anti")


def best_in_window(df: DataFrame, history: DataFrame, days: int, key: str = "cve_id", start: str = "published", when: str = "epss_date", value: str = "epss_score") -> DataFrame:
    """(key, best): the largest dated value of a key from its start to ``days`` later.

    The range test rides on the equi join by key, and the maximum is partly taken before rows meet.
    """
    spans = df.select(key, F.to_date(start).alias("_from"), F.date_add(F.to_date(start), days).alias("_to"))
    daily = history.groupBy(key, when).agg(F.max(value).alias(value))
    return daily.join(spans, key).where(F.col(when).between(F.col("_from"), F.col("_to"))).groupBy(key).agg(F.max(value).alias("best"))


def dated_hit(df: DataFrame, events: DataFrame, days: int, key: str = "cve_id", start: str = "published", when: str = "date_added") -> DataFrame:
    """df with within (the event falls in the window), prior (before it) and later, from the first event of each key."""
    first = events.groupBy(key).agg(F.min(when).alias("_at"))
    at, begin = F.col("_at"), F.to_date(start)
    return df.join(first, key, "left").withColumns({"within": flag(at.between(begin, F.date_add(begin, days))), "prior": flag(at < begin), "later": flag(at > F.date_add(begin, days))}).drop("_at")


def within_group_pairs(df: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """(src, dst), src < dst, of the keys that share a group of at most ``most`` keys: larger groups say nothing and are left out by definition."""
    members = df.where(F.col(group).isNotNull()).select(group, key).distinct()
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(2, most))
    small = members.join(sizes, group).select(group, key)
    return small.select(group, F.col(key).alias("src")).join(small.select(group, F.col(key).alias("dst")), group).where("src < dst").select("src", "dst").distinct()


def paired(scores: DataFrame, group: list[str], model: str, value: str) -> DataFrame:
    """(group, model_a, model_b, a, b) of each two models, once."""
    a = scores.select(*group, F.col(model).alias("model_a"), F.col(value).alias("a"))
    b = scores.select(*group, F.col(model).alias("model_b"), F.col(value).alias("b"))
    return a.join(b, group).where("model_a < model_b")


def coded(df: DataFrame, codes: DataFrame, column: str, unknown: int) -> DataFrame:
    """df with the code of the column's value, ``unknown`` where the value has none."""
    return df.join(codes, column, "left").withColumn("code", F.coalesce(F.col("code").cast("bigint"), F.lit(unknown)))


_OUTSIDE = r"[^a-z0-9_-]+"


def _word_runs(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _OUTSIDE), lambda w: w != "")


def fits(kept: DataFrame, most_rows: int = 200_000, most_bytes: int = 32 << 20) -> bool:
    """Whether the staged rows and their bytes as JSON stay within the bounds."""
    n, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= most_rows and size <= most_bytes


def checked(small: DataFrame, most_rows: int = 200_000, most_bytes: int = 32 << 20) -> DataFrame:
    """small, staged, to be broadcast where its rows and their bytes as JSON stay within the bounds; beyond, a join with it shuffles."""
    kept = stage(small, "small-side")
    return F.broadcast(kept) if fits(kept, most_rows, most_bytes) else kept


def dealt_hits(texts: DataFrame, key: str, text: Column, found: Callable[[str], Iterable[str]], name: str) -> DataFrame:
    """(key, name): what ``found`` gives for each text, as rows, where the texts are read; missing texts are left out."""
    kind = texts.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                each = [list(found(t)) if t is not None else [] for t in part.column(1).to_pylist()]
                at = np.repeat(np.arange(len(each)), [len(x) for x in each])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array([h for x in each for h in x], pa.string())], names=[key, name])

    return texts.select(key, text.alias("_x")).mapInArrow(run, StructType([StructField(key, kind), StructField(name, StringType())]))


def _runs_of(known: list[str]) -> Callable[[str], set[str]]:
    """The known runs of words in a lower-case text: of each place only the lengths of the runs that begin with its word are tried."""
    runs, lengths = set(known), {}
    for run in known:
        words = run.split(" ")
        lengths.setdefault(words[0], set()).add(len(words))

    def found(text: str) -> set[str]:
        words = re.findall("[a-z0-9_-]+", text)
        return {run for i, w in enumerate(words) if w in lengths for n in lengths[w] if i + n <= len(words) and (run := " ".join(words[i : i + n])) in runs}

    return found


def matches(texts: DataFrame, key: str, text: Column, vocabulary: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(key, term, ...) of the vocabulary terms that stand in a text as whole words, whatever signs and blanks stand between these.

    Runs of words, of the lengths that the vocabulary has, are met with the vocabulary by equality: no test of every term on every text, and time in proportion to a text's length. A vocabulary of a checked
    size goes to the tasks, which look runs up where they read the texts; a larger one stays a table, and a text's runs are dealt out as rows.
    """
    words = _word_runs(F.col("term"))
    known = stage(vocabulary.withColumn("_run", F.array_join(words, " ")).where(F.col("_run") != ""), "small-side")
    if fits(known, broadcast_rows):
        runs = [r[0] for r in known.select("_run").distinct().collect()]  # of checked size
        return dealt_hits(texts, key, F.lower(text), _runs_of(runs), "_run").join(F.broadcast(known), "_run").drop("_run")
    lengths = [r[0] for r in known.select(F.size(F.split("_run", " ")).alias("n")).distinct().orderBy("n").collect()]  # one row for each length of a term
    if not lengths:
        return texts.select(key).join(vocabulary.limit(0))
    # the words as one string: no function of an array is evaluated again for each of its elements, wherever the optimizer puts it
    joined = texts.select(key, F.array_join(_word_runs(text), " ").alias("_x"))
    runs = F.concat(*[F.regexp_extract_all("_x", F.lit(rf"(?<![^ ])(?=((?:[^ ]+ ){{{n - 1}}}[^ ]+))"), 1) for n in lengths])
    # the outer form, as the other one repeats its argument in a filter before
    return joined.select(key, F.explode_outer(F.array_distinct(runs)).alias("_run")).join(known, "_run").drop("_run")
