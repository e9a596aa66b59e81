"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: ``1 + g * (2t - 1)``, whose integral
``t + g * (t^2 - t)`` is the share of its target words that are due by t. Documents of a source stand in the
order of a hash of their id (of their text where they have none); the words before a document are the cumulative demand at which it is
due, so inverting the integral gives its training position. A source whose target exceeds its size is passed through again.

Defined results: null texts have size 0; the null source is one source, last in order; empty documents are
taken 0 words and have no position; documents with equal ids stand together, by size, then text (so a bucket holds all rows of an id: ids are taken to be near unique, null ones apart); texts of any length are read whole; repeated rows each count; an empty table gives an empty result; further columns stay, but a result replaces a column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm._columns import guarded
from riskweave.session import stage

#: Rows up to which a summary is broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def _bounded(df: DataFrame, name: str) -> DataFrame:
    """The staged summary, marked for broadcasting only if it is small."""
    kept = stage(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _cycled(values: list[float], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(place - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: list[float], share: float, most: float, growths: list[float]) -> DataFrame:
    """One row for each source of (_source, size): source_size, target, _growth, _buckets.

    Sources share ``share`` of all words by weight; none gets over ``most`` times its size, the excess
    is shared again by weight. With sources by the ratio of limit and weight, that level is where
    the rest of the words over the rest of the weights first meets the ratio. The windows span the sources only.
    """
    per_source = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    place = F.row_number().over(Window.orderBy("_source"))
    listed = per_source.withColumn("_weight", _cycled(weights, place)).withColumn("_growth", _cycled(growths, place))
    listed = listed.withColumn("_limit", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    by_ratio = Window.orderBy("_ratio", "_source")
    all_rows = Window.partitionBy()
    leveled = (
        listed.withColumn("_before", F.coalesce(F.sum("_limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.col("_before")) / F.col("_rest"))
        .withColumn("_chosen", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_source", "_level"))).over(all_rows)["_level"])
    )
    target = F.least(F.col("_limit"), F.coalesce(F.col("_chosen") * F.col("_weight"), F.col("_limit")))
    # about as many rows in a bucket as a source has buckets: neither grows faster than the root of its rows
    per_bucket = F.greatest(F.lit(128.0), F.sqrt(F.col("_rows")))
    return leveled.select("_source", "source_size", target.alias("target"), "_growth", F.ceil(F.col("_rows") / per_bucket).alias("_buckets"))


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, growths: list[float] = (-0.5, 0.0, 0.5), id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with size, source_size, target, taken (words that the mix takes, repeats counted) and starts.

    ``starts`` holds a position in [0, 1] for each pass that takes words of the document. A source's order is
    cut into buckets by hash range; sums of buckets give each bucket's offset, and running sums stay within buckets, so no source meets in one task.
    """
    if not -1 <= min(growths) <= max(growths) <= 1 or min(weights) <= 0 or most < share:
        raise ValueError("growths must be in [-1, 1], weights positive, most at least share")
    work, restore = guarded(docs, {"doc_id": id_col, "text": text, "_from": source})
    sized = (
        work.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint"))
        # the null source sorts last: every other key starts with a smaller character
        .withColumn("_source", F.coalesce(F.concat(F.lit("0"), F.col("_from")), F.lit("1")))
        .withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.md5("text")), F.lit(""))))
    )
    narrow = sized.select("_source", "size", "_key")
    sources = _bounded(targets(narrow, list(weights), share, most, list(growths)), "mix-sources")
    fraction = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    bucket = F.floor(fraction * F.col("_buckets"))
    sums = narrow.join(sources, "_source").groupBy("_source", bucket.alias("_bucket")).agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _bounded(sums.select("_source", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset")), "mix-offsets")

    placed = sized.join(sources, "_source").withColumn("_bucket", bucket).withColumn("_tie", F.xxhash64("text"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size", "_tie")
    running = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("_first", running).join(offsets, ["_source", "_bucket"]).withColumn("_first", F.col("_first") + F.col("_offset"))
    due = F.round("target").cast("bigint")
    passes = range(int(-(-most // 1)))
    start = [F.col("_first") + p * F.col("source_size") for p in passes]
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), due - x)) for x in start), F.lit(0)).cast("bigint")
    starts = F.filter(F.array(*[F.when((x < due) & (F.col("size") > 0), inverted(x / F.col("target"), F.col("_growth"))) for x in start]), lambda t: t.isNotNull())
    return restore(placed.withColumn("taken", taken).withColumn("starts", starts), ["size", "source_size", "target", "taken", "starts"])


def inverted(part: Column, growth: Column) -> Column:
    """The time t with ``t + g * (t^2 - t) = part``."""
    slope = 1 - growth
    return F.when(growth == 0, part).otherwise((F.sqrt(slope * slope + 4 * growth * part) - slope) / (2 * growth))


def by_position(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each document, range-sorted by its first position: passes, position and last_position, to six places; null without a pass."""
    at = lambda i: F.round(F.get("starts", i), 6)
    out = mixed.select(*columns, F.size("starts").cast("bigint").alias("passes"), at(F.lit(0)).alias("position"), at(F.size("starts") - 1).alias("last_position"))
    return out.repartitionByRange("position", columns[0]).sortWithinPartitions("position", columns[0])


def training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each pass over each document, with its position, range-sorted by position."""
    rows = mixed.select(*columns, F.posexplode("starts").alias("pass", "position"))
    tie = "doc_id" if "doc_id" in columns else columns[0]
    return rows.repartitionByRange(F.col("position"), F.col(tie)).sortWithinPartitions("position", tie)


SQL = r"""
WITH d AS (
  SELECT doc_id, text, coalesce('0' || source, '1') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) AS place FROM d GROUP BY src),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CASE (place - 1) % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS g,
             source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
c AS (SELECT arg_min(level, (ratio, src)) AS level FROM l WHERE level <= ratio),
t AS (SELECT src, source_size, g, least(cap, coalesce(c.level * weight, cap)) AS target FROM l LEFT JOIN c ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.g, round(t.target)::BIGINT AS due,
             coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY md5(coalesce(d.doc_id::VARCHAR, ':' || md5(d.text), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x
      FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, due - x)) + greatest(0, least(size, due - x - source_size)))::BIGINT AS taken,
       CASE WHEN size = 0 THEN 0 ELSE (x < due)::BIGINT + (x + source_size < due)::BIGINT END::BIGINT AS passes,
       CASE WHEN x < due AND size > 0 THEN at1 END AS position,
       CASE WHEN x + source_size < due AND size > 0 THEN at2 WHEN x < due AND size > 0 THEN at1 END AS last_position
FROM (SELECT *, 0.0::DOUBLE + round(CASE WHEN g = 0 THEN x / target ELSE (sqrt((1 - g) * (1 - g) + 4 * g * (x / target)) - (1 - g)) / (2 * g) END, 6) AS at1,
             0.0::DOUBLE + round(CASE WHEN g = 0 THEN (x + source_size) / target ELSE (sqrt(greatest(0.0, (1 - g) * (1 - g) + 4 * g * ((x + source_size) / target))) - (1 - g)) / (2 * g) END, 6) AS at2 FROM p)
"""
