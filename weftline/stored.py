"""Tables and files in the folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder takes its place if driver and executors are one process, as in tests; on a
    cluster that is an error, as no local folder is seen by all.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="weftline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_folders: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, within the innermost ``temporary`` folder if there is one."""
    return f"{_folders[-1] if _folders else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can write one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for all tables that are written meanwhile, deleted at the end.

    Results that are read from these tables must be written elsewhere before.
    """
    path = scratch(spark, name)
    _folders.append(path)
    try:
        yield path
    finally:
        _folders.remove(path)
        removed(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back as Parquet."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
