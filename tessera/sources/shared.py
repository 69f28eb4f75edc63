"""The folder that driver and executors share, and small results that are written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder, but only if executors run in the driver's machine."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own = _own or "file://" + tempfile.mkdtemp(prefix="tessera-")
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"


_roots: list[str] = []


def _tidy() -> None:
    """At the end of the driver's process, if Spark still runs: the tables that results were read from go."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for root in _roots:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001  the session may end first
        return


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, read by all that use it by columns, and found again when executors are lost."""
    path = folder(df.sparkSession, "written")
    if not _roots:
        atexit.register(_tidy)
    _roots.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
