"""Parquet readers. Column pruning and filter pushdown are left to Catalyst:
callers select and filter, the scan only reads what the plan needs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str, schema=None) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)
