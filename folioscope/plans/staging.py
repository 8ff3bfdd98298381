"""Lineage cuts that survive the loss of an executor.

Tables are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; driver and executors all see it. Only where that
setting is missing and Spark runs in local mode (tests) a temporary folder is
used instead.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables; raises on a cluster that names none."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (conf.get("spark.master", "") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="folioscope-")
    return "file://" + _own[app]


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table; with ``by``, a folder for each value of that column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _left.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame | None) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_staged_path", None)
    if path is None:
        return
    spark = df.sparkSession
    _delete(spark, path)
    _left[:] = [x for x in _left if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
