"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only where that is unset and driver
    and executors are one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="fieldwright-")
        atexit.register(remove, spark, _own[app])
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, removed at exit."""
    path = f"{shared_folder(spark)}/fieldwright/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what is built on it starts from files, so nothing
    before is computed twice and a lost executor costs one task."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped before
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
