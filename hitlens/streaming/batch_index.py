"""Small tables with a folder per ingest batch, folded now and then.

A batch writes its rows to its own folder, replaced as a whole on a replay.
Once more than ``FOLD`` batches lie there, all but each query's newest (the
only one that can be replayed) are merged into one version, named by a small
version file that also says up to which batch each query is folded. So a
read takes the version and at most ``FOLD`` small folders, however many
batches there were, and a crash while folding changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import sinks

FOLD = 64


@dataclass(frozen=True)
class BatchIndex:
    """``merge`` sums up rows of several batches to fewer rows of the same columns."""
    root: str
    name: str
    schema: str
    merge: Callable[[DataFrame], DataFrame]

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    def folder(self, run: str, batch: int) -> str:
        return f"{self.path}/ingest_run={run}/ingest_batch={batch}"

    def write(self, rows: DataFrame, run: str, batch: int) -> None:
        sinks.overwrite_folder(rows.coalesce(1), self.folder(run, batch))

    def _batches(self, spark: SparkSession, folded: dict[str, int]) -> list[tuple[str, int]]:
        return [(run, int(b)) for run in sinks.children(spark, self.path, "ingest_run=")
                for b in sinks.children(spark, f"{self.path}/ingest_run={run}", "ingest_batch=") if int(b) > folded.get(run, -1)]

    def has(self, spark: SparkSession, run: str, batch: int) -> bool:
        at = sinks.read_manifest(spark, self.root.rstrip("/"), self.name)
        folded = json.loads(at.mark) if at.mark else {}
        return batch <= folded.get(run, -1) or sinks.exists(spark, f"{self.folder(run, batch)}/_SUCCESS")

    def read(self, spark: SparkSession, without: tuple[str, int] | None = None) -> DataFrame:
        """All rows, but for those of one batch that is not folded yet."""
        at = sinks.read_manifest(spark, self.root.rstrip("/"), self.name)
        batches = [x for x in self._batches(spark, json.loads(at.mark) if at.mark else {}) if x != without]
        folders = [*at.parts.values(), *(self.folder(*x) for x in batches)]
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)

    def fold(self, spark: SparkSession, above: int = FOLD) -> None:
        at = sinks.read_manifest(spark, self.root.rstrip("/"), self.name)
        folded = json.loads(at.mark) if at.mark else {}
        batches = self._batches(spark, folded)
        if len(batches) <= above:
            return
        newest: dict[str, int] = {}
        for run, b in batches:
            newest[run] = max(b, newest.get(run, -1))
        old = [(run, b) for run, b in batches if b < newest[run]]
        if not old:
            return
        rows = spark.read.schema(self.schema).parquet(*at.parts.values(), *(self.folder(*x) for x in old))
        folder = f"{self.root.rstrip('/')}/{self.name}_folded/{uuid.uuid4().hex}"
        self.merge(rows).write.parquet(folder)
        mark = folded | {run: newest[run] - 1 for run, _ in old}
        try:
            sinks.commit_version(spark, self.root.rstrip("/"), self.name, at, {"all": folder}, json.dumps(mark))
        except sinks.VersionConflict:  # another query folded
            sinks.remove(spark, folder)
            return
        sinks.remove_folders(spark, [self.folder(*x) for x in old])


def merge_ranges(rows: DataFrame) -> DataFrame:
    """Offset ranges (partition, first, last) of a topic partition joined
    where they touch or overlap: as many rows as there are gaps."""
    order = Window.partitionBy("partition").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("_new", (F.coalesce(F.col("first") > reach + 1, F.lit(True))).cast("int"))
    numbered = starts.withColumn("_range", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (numbered.groupBy("partition", "_range").agg(F.min("first").alias("first"), F.max("last").alias("last"))
            .drop("_range"))
