"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions that name no spark.checkpoint.dir, by application id.
_OWN_DIRS: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


def build_session(app: str = "riskweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive plans; conf overrides (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder of its own; any other
    master raises ValueError, since a machine's own folder is not visible to other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN_DIRS:
        _OWN_DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIRS[sc.applicationId]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage so that neither
    lost executors nor a second use compute it again. The files go when the session's process ends, or by
    :func:`unstage`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riskweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._riskweave_path = path
    return out


def swept(spark: SparkSession, path: str) -> str:
    """The path, whose files go when the session's process ends."""
    _STAGED.append((spark, path))
    return path


def unstage(df: DataFrame) -> None:
    """Deletes what :func:`stage` wrote for this frame; nothing may read it afterwards."""
    path = getattr(df, "_riskweave_path", None)
    if path:
        _delete(df.sparkSession, path)
        _STAGED[:] = [x for x in _STAGED if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            return


atexit.register(_sweep)
