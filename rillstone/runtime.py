"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_written: list[str] = []


def session(app: str = "rillstone", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on; cluster settings win where they exist."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or an own one where that is unset and the session is a local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="rillstone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_own_dir[app])
    return "file://" + _own_dir[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/rillstone/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete through Hadoop's file system layer."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The written files outlive lost executors, unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may already be gone
            return
