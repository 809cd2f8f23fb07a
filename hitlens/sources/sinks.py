"""Writers. Window outputs replace their own partitions (dynamic overwrite),
so writing a window twice leaves one copy; whole tables are switched
atomically by a small version file; the ledger row of a window is written only
after its statistics."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_PARTITIONS = ("stat_type", "stat_date", "stat_time")
DAY_PARTITIONS = ("stat_type", "stat_date")


def overwrite_partitions(df: DataFrame, path: str, partition_cols=WINDOW_PARTITIONS,
                         fmt: str = "parquet") -> None:
    """Replace exactly the partitions present in ``df``; others stay.

    Rows are rebalanced by the partition columns first (the ``rebalance``
    hint): each task writes few files, and AQE splits a partition that holds
    a hot window over several tasks instead of one."""
    (df.hint("rebalance", *partition_cols)
       .write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols)
       .format(fmt)
       .save(path))


def overwrite_folder(df: DataFrame, path: str, partition_cols=(), fmt: str = "parquet") -> None:
    """Replace everything under ``path``, also when ``df`` has no rows."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "static")
       .partitionBy(*partition_cols).format(fmt).save(path))


def read_or_none(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame | None:
    """The table, or None when it was never written (asked of Spark, so any
    file system the cluster mounts works)."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder this package wrote, on whatever file system it is."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What the folders below ``path`` are named after a prefix."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return []
    names = (unquote(x.getPath().getName()) for x in fs.listStatus(target))
    return sorted(x.removeprefix(prefix) for x in names if x.startswith(prefix))


def read_days(spark: SparkSession, path: str, schema, stat_type: str, days) -> DataFrame | None:
    """The day partitions of one stat type. Only their folders are listed, so
    a tick's read does not grow with the history."""
    folders = [f"{path}/stat_type={stat_type}/stat_date={d.isoformat()}" for d in days]
    folders = [f for f in folders if exists(spark, f)]
    if not folders:
        return None
    return spark.read.option("basePath", path).schema(schema).parquet(*folders)


def with_file(stored: DataFrame, *columns: str) -> DataFrame:
    """Columns of a stored table, and the file each row lies in."""
    return stored.select(*columns, F.col("_metadata.file_path").alias("file_path"))


def folder_of(file_path: str) -> str:
    """The partition folder of a file (the column holds a URI, the folder a name with its own %3A)."""
    return unquote(file_path.rsplit("/", 1)[0])


def remove_folders(spark: SparkSession, folders) -> None:
    for folder in folders:
        remove(spark, folder)


# ---------------------------------------------------------------- versions

class VersionConflict(Exception):
    """Another writer published the version that this one was about to."""


@dataclass(frozen=True)
class Manifest:
    """A version of a table: the folder of each of its parts, and a mark."""
    seq: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    mark: str = ""


def read_manifest(spark: SparkSession, root: str, table: str, seq: int | None = None) -> Manifest:
    """The version in force (or of a number); number 0 before the first one.
    Only the newest small file is read, whatever the number of versions."""
    fs, folder = _file_system(spark, f"{root}/_versions/{table}")
    if seq is None:
        seqs = _versions(fs, folder)
        if not seqs:
            return Manifest()
        seq = seqs[-1]
    stream = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{seq:012d}"))
    try:
        stored = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Manifest(seq, stored["parts"], stored["mark"])


def _versions(fs, folder) -> list[int]:
    if not fs.exists(folder):
        return []
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit())


def commit_version(spark: SparkSession, root: str, table: str, before: Manifest, parts: dict[str, str], mark: str = "", keep: int = 2) -> Manifest:
    """Publish the version after ``before``, or raise ``VersionConflict`` when
    it exists already: its file is created by a rename that never replaces,
    so of several writers one succeeds and the others start again from its
    version. Folders that only versions older than the last ``keep`` name are removed."""
    jvm = spark.sparkContext._jvm
    fs, folder = _file_system(spark, f"{root}/_versions/{table}")
    after = Manifest(before.seq + 1, parts, mark)
    path = jvm.org.apache.hadoop.fs.Path
    target, made = path(folder, f"{after.seq:012d}"), path(folder, f"_{uuid.uuid4().hex}")
    stream = fs.create(made, False)
    stream.write(json.dumps({"mark": mark, "parts": parts}).encode())
    stream.close()
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(made).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(made), fs.makeQualified(target), never)
    except Py4JJavaError as e:
        fs.delete(made, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise VersionConflict(f"{table} {after.seq}") from None
        raise
    seqs = _versions(fs, folder)
    old = [x for x in seqs if x <= after.seq - keep]
    if old:
        kept = {f for x in seqs if x > after.seq - keep for f in read_manifest(spark, root, table, x).parts.values()}
        for x in old:
            for stale in set(read_manifest(spark, root, table, x).parts.values()) - kept:
                remove(spark, stale)
            fs.delete(path(folder, f"{x:012d}"), False)
    return after


def publish_version(df: DataFrame, root: str, table: str, mark: str = "", keep: int = 2) -> None:
    """Write a new version of a whole table, then switch readers to it: a
    crash before leaves the old version in force."""
    spark = df.sparkSession
    before = read_manifest(spark, root, table)
    folder = f"{root}/{table}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    try:
        commit_version(spark, root, table, before, {"all": folder}, mark, keep)
    except VersionConflict:
        remove(spark, folder)
        raise


def read_version(spark: SparkSession, root: str, table: str, schema) -> tuple[DataFrame | None, str]:
    """The version in force and its mark; (None, "") before the first one."""
    at = read_manifest(spark, root, table)
    if not at.parts:
        return None, at.mark
    return spark.read.schema(schema).parquet(*at.parts.values()), at.mark
