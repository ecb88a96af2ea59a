"""Cutting lineage in iterative plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame

_LOCAL: dict[str, str] = {}


def _folder(spark) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="claimloom-"))


def _delete(spark, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is temporary
        pass


def scratch(spark, name: str) -> str:
    """A new path in the shared folder, deleted when the program ends."""
    path = f"{_folder(spark)}/claimloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back, so that later steps neither repeat
    nor lose it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, n: int) -> bool:
    """Whether df has less than n rows; reads no more than that."""
    return len(df.limit(n).take(n)) < n
