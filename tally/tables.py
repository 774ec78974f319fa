"""Tables and folders that driver and executors share while a query runs."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is missing, a local master gets a folder of its own; a
    cluster gets an error, since a machine-local folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        folder = tempfile.TemporaryDirectory(prefix="tally-")
        atexit.register(folder.cleanup)
        _local[sc.applicationId] = folder.name
    return "file://" + _local[sc.applicationId]


_paths: list[tuple[SparkSession, str]] = []
_names: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a table that this process needs until it ends."""
    path = f"{shared_dir(spark)}/tally/{label}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    """Tables of this process go with it, as far as its Spark still runs."""
    for spark, name in _names:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # as below
            break
    for spark, path in _paths:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # a stopped session cannot delete; its folder is the user's to clear
            return


@contextmanager
def shuffles_go(spark: SparkSession):
    """Shuffle files of what is executed inside go at its end, not when the driver's memory is next cleaned."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def goes_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a written path when the driver's JVM ends, also where the session was stopped before."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts its lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    with shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    goes_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
