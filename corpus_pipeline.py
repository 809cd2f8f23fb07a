"""Documents to training sequences: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents. run() writes each stage's rows to the shared folder and reads them again, so a lost executor never
costs more than the stage at hand. What a stage has staged for itself, and the rows it has read, are removed behind it.

Nulls: a null or blank text fails the quality rules and goes there; a null source is a host of its own; a null id
sorts last. An empty table gives an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlens.llm import credentials, host_quality, packing, simhash_dedup, suffix_dedup
from hitlens.llm.store import outlast, scope, unstage

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all rules, at the limits of their hosts."""
    return host_quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near copies."""
    return simhash_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later places of passages that repeat across them."""
    return suffix_dedup.remove_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mask in place of each secret."""
    return credentials.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence."""
    found = packing.pack(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return found.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packed),
]
#: The fingerprints, heads and tokens are no SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with scope(spark):
            kept = outlast(step(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            unstage(docs)  # what this stage has read
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
