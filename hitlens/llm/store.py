"""Intermediate tables in the folder that driver and executors share.

A staged table cuts the lineage: a lost executor costs the tasks that read it, not the work that made it.
The folder is the cluster's ``spark.checkpoint.dir``. Only a local session, where nothing is set, gets a
folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hitlens-llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders staged within the open scopes, innermost last.
_SCOPES: list[list[str]] = []


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written as Parquet to the shared folder and read again with the same schema."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unstage(staged: DataFrame) -> None:
    """Removes a staged table that nothing will read again."""
    _remove(staged.sparkSession, staged.staged_at)


@contextmanager
def scope(spark: SparkSession):
    """Tables staged within are removed at the end, also after an error: what is to last is staged by `outlast`."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def outlast(df: DataFrame, name: str) -> DataFrame:
    """Like stage(), but kept by the innermost scope (the one around it, if any, removes it)."""
    inner = _SCOPES.pop()
    try:
        return stage(df, name)
    finally:
        _SCOPES.append(inner)


def join_small(left: DataFrame, right: DataFrame, on, how: str, parts: Column | None = None, most: int = 100_000) -> DataFrame:
    """left joined with a staged table: broadcast while its rows (with arrays: their elements, `parts`) are at most
    `most` (some 10 MB of narrow values), otherwise by a shuffle, whose hot keys adaptive execution splits. Both give
    the same rows."""
    n = right.agg(F.sum(F.lit(1) if parts is None else 1 + parts)).first()[0] or 0
    return left.join(F.broadcast(right) if n <= most else right, on, how)
