"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: str | None = None
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset on one machine, as in tests, a temporary one.

    On a cluster a folder of the driver's machine would not be seen by executors, so there it is an error.
    """
    global _own
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"{SETTING} must name a folder that all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="tidepool-")
        atexit.register(_forget, _own)
    return _own


def _forget(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/tidepool-{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of df written as a table and read again, and its path; the new plan has no lineage.

    The table survives the loss of executors, and what reads it knows its real size, so joins are
    planned by it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables made by cut()."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in _made:
            _made.remove(path)


def release(spark: SparkSession) -> None:
    """Remove all tables that this process has left in the shared folder, once no result of theirs is needed."""
    drop(spark, *list(_made))
