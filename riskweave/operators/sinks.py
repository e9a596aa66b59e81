"""Upserts as new snapshots, logs and exports. A snapshot is written beside the one that is read, never over it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEPT = ["published", "created_at"]


def upserted(old: DataFrame, new: DataFrame, key: str = "cve_id", kept: list[str] = KEPT) -> DataFrame:
    """Old and new rows by key: new values win where they are there, but those of ``kept`` columns stay; columns that new lacks stay; of repeated new keys one row counts."""
    once = new.dropDuplicates([key])
    o, n = (df.select(F.col(key).alias("_k" + s), F.struct(*df.columns).alias(s)) for df, s in ((old, "o"), (once, "n")))
    both = o.join(n, F.col("_ko") == F.col("_kn"), "full_outer")
    have, more = set(old.columns), [c for c in new.columns if c not in old.columns]

    def value(c: str):
        if c == key:
            return F.coalesce("_kn", "_ko")
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c not in have:
            return F.col(f"n.{c}")
        return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in kept else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))

    return both.select(*[value(c).alias(c) for c in [*old.columns, *more]])


def write_snapshot(df: DataFrame, root: str, version: int, partition: str | None = None) -> str:
    """Writes the table as a new version below the root and returns its path."""
    path = f"{root.rstrip('/')}/v={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return path


def last_fetch(log: DataFrame, kind: str | None = None) -> DataFrame:
    """One row: end_date of the latest successful fetch, of one kind if given."""
    good = log.where("status = 'success'")
    if kind is not None:
        good = good.where(F.col("fetch_type") == kind)
    return good.agg(F.max_by("end_date", "fetch_date").alias("end_date"))


def last_fetches(log: DataFrame) -> DataFrame:
    """(fetch_type, end_date) of the latest successful fetch of every kind, in one pass."""
    return log.where("status = 'success'").groupBy("fetch_type").agg(F.max_by("end_date", "fetch_date").alias("end_date"))


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def scored_output(df: DataFrame, root: str, score: str, key: str, k: int) -> None:
    """The whole table by falling score, dealt out by range, and its first k rows as one CSV each."""
    df.repartitionByRange(F.desc(score), F.asc(key)).sortWithinPartitions(F.desc(score), F.asc(key)).write.mode("overwrite").option("header", True).csv(f"{root}/all")
    df.orderBy(F.desc(score), F.asc(key)).limit(k).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/top")


def flat_names(df: DataFrame) -> DataFrame:
    """Column names of a pivot as plain words joined by ``_``."""
    import re

    return df.toDF(*[re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]+", "_", c)).strip("_") for c in df.columns])


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = flat_names(df).write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def enriched_export(records: DataFrame, enrichments: DataFrame, columns: list[str], key: str = "cve_id") -> DataFrame:
    return records.join(enrichments.select(key, *columns), key, "left")


def rank_over_time(log: DataFrame, key: list[str], when: str) -> DataFrame:
    return log.withColumn("version", F.row_number().over(Window.partitionBy(*key).orderBy(when)))


class BucketedTable:
    """A table by key below a root, kept in buckets of a hash of the key. A change reads and rewrites only the buckets that its keys fall in; a manifest lists each bucket's files, and a new manifest, named by its
    version and written aside before it is moved to its name, is the commit: readers see the one before or the one after, and a writer that dies leaves the table as it was.

    ``root/data/v=<version>/bucket=<n>`` holds files, ``root/manifest/<version>.json`` the version of each bucket. A version that is there already is not written again, so a batch that is
    replayed changes nothing. One writer at a time. Columns of new rows that the table lacks are added; old files lack them and read as null.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "cve_id", buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        if not self._files.exists(self._path("manifest")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path("manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, version: int) -> dict:
        """{"buckets": version of each bucket's files, "schema": DDL}: a line for each bucket, so its size is that of their number."""
        stream = self._files.open(self._path(f"manifest/{version}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, version: int, buckets: dict[str, int], schema: str) -> None:
        aside = self._path(f"manifest/_{version}-{uuid.uuid4().hex}.json")
        stream = self._files.create(aside, True)
        stream.write(bytearray(json.dumps({"buckets": buckets, "schema": schema}).encode()))
        stream.close()
        if not self._files.rename(aside, self._path(f"manifest/{version}.json")):
            raise RuntimeError(f"version {version} was committed by another writer")

    def _paths(self, buckets: dict[str, int]) -> list[str]:
        return [f"{self.root}/data/v={v}/bucket={b}" for b, v in buckets.items()]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table of a version, the last if none is given; None before the first."""
        found = self.versions()
        if not found:
            return None
        known = self.manifest(found[-1] if version is None else version)
        if not known["buckets"]:
            return self.spark.createDataFrame([], known["schema"])
        return self.spark.read.schema(known["schema"]).parquet(*self._paths(known["buckets"]))

    def upsert(self, new: DataFrame, version: int) -> list[int]:
        """Applies :func:`upserted` to the buckets of the new rows' keys; their numbers. Nothing happens if the version is there."""
        found = self.versions()
        if version in found:
            return []
        if found and version < found[-1]:
            raise ValueError(f"version {version} comes before the committed {found[-1]}")
        known = self.manifest(found[-1]) if found else {"buckets": {}, "schema": ""}
        number = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in new.select(number.alias("b")).distinct().collect())  # not above the number of buckets
        old = {b: known["buckets"][str(b)] for b in touched if str(b) in known["buckets"]}
        rows = new.dropDuplicates([self.key])
        if known["schema"]:
            before = self.spark.read.schema(known["schema"]).parquet(*self._paths(old)) if old else self.spark.createDataFrame([], known["schema"])
            rows = upserted(before, rows, self.key)
        path = f"{self.root}/data/v={version}"
        rows.withColumn("bucket", number).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self._commit(version, known["buckets"] | {str(b): version for b in touched}, schema)
        return touched

    def expire(self, keep: int = 2) -> list[str]:
        """Deletes manifests but the last ``keep``, and files that none of these names; what it deleted."""
        found = self.versions()
        kept, gone = found[-keep:], found[:-keep]
        named = {p for v in kept for p in self._paths(self.manifest(v)["buckets"])}
        out = []
        for v in gone:
            self._files.delete(self._path(f"manifest/{v}.json"), False)
        if kept and self._files.exists(self._path("data")):
            for folder in self._files.listStatus(self._path("data")):
                version = int(folder.getPath().getName()[2:])
                if version > kept[-1]:
                    continue  # a writer may be at work there
                for part in self._files.listStatus(folder.getPath()):
                    name = part.getPath().getName()
                    path = f"{self.root}/data/v={version}/{name}"
                    if name.startswith("bucket=") and path not in named:
                        self._files.delete(part.getPath(), True)
                        out.append(path)
        return out
