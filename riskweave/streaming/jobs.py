"""Streaming jobs: landed files to upserted snapshots, rate windows, progress, enrichment, signals within a horizon."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from riskweave.operators.sinks import BucketedTable, upserted, write_snapshot


def events(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def ingest(landing: DataFrame, root: str, checkpoint: str, key: str = "cve_id") -> StreamingQuery:
    """Upserts each batch of landed records into a new snapshot below the root; the checkpoint is where a restart goes on.

    A version is named after its batch, so a batch that runs again writes the same version; it is written aside and moved by the writer's commit.
    """

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        versions = _versions(spark, root)
        if number in versions:
            return
        earlier = [v for v in versions if v < number]
        old = spark.read.parquet(f"{root}/v={max(earlier)}") if earlier else None
        write_snapshot(upserted(old, new, key) if old is not None else new.dropDuplicates([key]), root, number)

    return landing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_buckets(landing: DataFrame, table: BucketedTable, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Upserts each batch of landed records into the buckets that its keys fall in; versions are named after batches, so one that runs again changes nothing, and old ones go."""

    def batch(new: DataFrame, number: int) -> None:
        table.upsert(new, number)
        table.expire(keep)

    return landing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions below the root."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")))


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v={max(_versions(spark, root))}")


def over_budget(stream: DataFrame, most: int = 80, window: str = "60 seconds", slide: str | None = None, late: str = "10 minutes", user: str = "user_id", when: str = "ts") -> DataFrame:
    """(window start, user, n) of users with more than ``most`` events in a window. Works on streams and tables."""
    span = F.window(F.col(when), window, slide) if slide else F.window(F.col(when), window)
    rows = stream.withWatermark(when, late) if stream.isStreaming else stream
    return rows.groupBy(span.alias("w"), user).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("w.start").alias("start"), user, "n")


def sliding_counts(events: DataFrame, seconds: int = 60, user: str = "user_id", when: str = "ts") -> DataFrame:
    """A table's (user, when, n): events of the user in the ``seconds`` up to each event, both ends, itself and others of its time included; refused events count too."""
    span = Window.partitionBy(user).orderBy(F.unix_micros(F.col(when).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.select(user, when, F.count(F.lit(1)).over(span).alias("n"))


def sliding_budget(stream: DataFrame, most: int = 80, seconds: int = 60, late: str = "10 minutes", user: str = "user_id", when: str = "ts", key: str = "event_id") -> DataFrame:
    """(user, key, when, n) of events of a stream that exceed a budget of ``most`` in the ``seconds`` up to them, counted as :func:`sliding_counts` does, but up to ``most`` + 1 only.

    The state of a user holds the events that the watermark has not passed, since earlier ones may still come, and a ring of the last ``most`` times before it; a timer wakes users whose waiting
    events the watermark has passed. An event that comes again within the watermark, by key, counts once; one later than the watermark is dropped by Spark.
    """
    span = seconds * 1_000_000

    def step(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, ring = (list(zip(state.get[0], state.get[1])), list(state.get[2])) if state.exists else ([], [])
        known = {k for _, k in waiting}
        for frame in frames:
            for at, k in zip(frame["_at"].tolist(), frame[key].tolist()):
                if k not in known:
                    known.add(k)
                    waiting.append((at, k))
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted(x for x in waiting if x[0] <= passed)
        waiting = [x for x in waiting if x[0] > passed]
        out = []
        times = [at for at, _ in ready]
        for i, (at, k) in enumerate(ready):
            ring.append(at)
            del ring[: -(most + 1)]
            together = bisect.bisect_right(times, at) - i - 1  # later ones of the same time count too
            n = sum(x >= at - span for x in ring) + together
            if n > most:
                out.append((group[0], k, at, min(n, most + 1)))
        if waiting:
            state.update(([a for a, _ in waiting], [k for _, k in waiting], ring[-most:]))
            state.setTimeoutTimestamp(max(min(a for a, _ in waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif ring and ring[-1] >= passed - span:
            state.update(([], [], ring[-most:]))
            state.setTimeoutTimestamp(max((ring[-1] + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[user, key, "_at", "n"])

    rows = stream.withWatermark(when, late).select(user, key, when, F.unix_micros(when).alias("_at"))
    found = rows.groupBy(user).applyInPandasWithState(step, f"{user} bigint, {key} bigint, _at bigint, n bigint", "times array<bigint>, keys array<bigint>, ring array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(user, key, F.timestamp_micros("_at").alias(when), "n")


def progress(stream: DataFrame, by: str, value: str) -> DataFrame:
    """Running count, sum and latest time by kind, for a complete-mode sink."""
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"), F.max("ts").alias("latest"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", user: str = "user_id", when: str = "ts") -> DataFrame:
    rows = stream.withWatermark(when, late) if stream.isStreaming else stream
    return rows.groupBy(F.session_window(when, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), user, "n")


def enriched(stream: DataFrame, *feeds: tuple[DataFrame, str]) -> DataFrame:
    """The stream left-joined with static feeds by key."""
    for feed, key in feeds:
        stream = stream.join(feed, key, "left")
    return stream


def within_horizon(published: DataFrame, signals: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """(cve_id, published, at) of signals within ``days`` after publication: an interval join whose state the watermarks of both sides bound."""
    p, s = published.select("cve_id", "published"), signals.select(F.col("cve_id").alias("_id"), "at")
    if published.isStreaming:
        p, s = p.withWatermark("published", late), s.withWatermark("at", late)
    return p.join(s, (F.col("cve_id") == F.col("_id")) & (F.col("at") >= F.col("published")) & (F.col("at") <= F.col("published") + F.expr(f"INTERVAL {int(days)} DAYS"))).select("cve_id", "published", "at")


def latest_status(trace: DataFrame, stage: str = "stage", status: str = "status", when: str = "ts") -> DataFrame:
    return trace.groupBy(stage).agg(F.max_by(status, when).alias("status"), F.max(when).alias("at"), F.count(F.lit(1)).alias("n"))


def drained(df: DataFrame, name: str, checkpoint: str, mode: str = "append", then: Callable[[DataFrame], DataFrame] | None = None, sink: str | None = None) -> DataFrame:
    """Runs a stream over all that has landed into Parquet (append) or a memory table, and returns the result."""
    spark = df.sparkSession
    if mode == "append" and sink:
        df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        out = spark.read.schema(df.schema).parquet(sink)
    else:
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        out = spark.table(name)
    return then(out) if then else out
