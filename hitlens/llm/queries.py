"""The registered queries of this package: name -> fn(spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, credentials, decontaminate, hard_negatives, host_quality, language_id, license_scan, packing, periodic_runs, scaled_sketch, simhash_dedup, suffix_dedup, toxicity
from .store import stage


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.encode(documents(spark, sf_dir), path, pattern)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir), license_scan.default_templates(spark))
    return found.select(F.col("id").alias("doc_id"), "license", "containment", "word")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", language_id.held_out(F.col("doc_id")).alias("held_out"))
    model = language_id.fit(docs)
    scored = stage(language_id.predict(docs, model).drop("text"), "scored")
    model = language_id.calibrate(scored, "lang", ~F.col("held_out"), model)
    p = F.col("language")
    accepted = F.coalesce(p["entropy"].isNotNull() & language_id.accepted(p["lang"], p["entropy"], model), F.lit(False))
    return scored.select("doc_id", "held_out", p["lang"].alias("lang_pred"), p["score"].alias("score"), accepted.alias("accepted"))


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return host_quality.judge(docs, drop_text=True).select("doc_id", *(F.col(f"quality.{x}").alias(x) for x in fields))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per later place of a repeated passage, with the document that holds the first one."""
    found = suffix_dedup.passages(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "start", "end", "n_words", F.col("first_doc").alias("first_doc_id"), "first_word")


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.compare_successors(documents(spark, sf_dir))


def op10_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.col("secrets.base")

    def number(kind: str):
        k = credentials.KINDS.index(kind)
        return F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind, *_ in credentials.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(credentials.spans_text(base), 256).alias("base_sha256"), credentials.spans_text(F.col("secrets.all")).alias("spans")
    )


def _planted(text: pa.Array, doc_id: pa.Array) -> pa.Array:
    """The contract's texts: those of every tenth crc32 of the id are periodic from one word on."""
    out = []
    for raw, doc in zip(text.cast(pa.binary()).to_pylist(), doc_id.to_pylist()):
        g, turn = divmod(zlib.crc32(str(doc).encode()), 10)
        words = raw.split() if raw and doc is not None and turn == 0 else []
        if words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            raw = b" ".join(words[:a] + [words[a + i % p] for i in range(len(words) - a)])
        out.append(raw)
    return pa.array(out, pa.binary()).cast(pa.string())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.arrow_udf(_planted, "string")(F.col("text"), F.col("doc_id"))
    found = periodic_runs.scan(documents(spark, sf_dir).select("doc_id", edited.alias("text")))
    runs = F.col("periodic.runs")
    # by the exact length / period; ties: the earlier run, as runs are ordered by start, then period
    best = F.reduce(runs, F.get(runs, 0), lambda best, x: F.when(x.length * best.period > best.length * x.period, x).otherwise(best))
    listed = F.transform(runs, lambda x: F.concat(x.start.cast("string"), F.lit(","), x.length.cast("string"), F.lit(","), x.period.cast("string"), F.lit("\n")))
    found = found.select("doc_id", runs.alias("runs"), best.alias("best"), F.array_join(listed, "").alias("listed"), F.col("periodic.collapsed").alias("collapsed"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit, items = F.col("leaks.n_hit"), F.col("leaks.items")
    return found.select(
        "doc_id", F.col("leaks.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    id, label = F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(vectors, id, F.col("embedding"), moved, id % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_toxicity, op3_simhash_dedup, op4_license_scan, op5_language_id, op6_host_quality, op7_packing, op8_suffix_dedup, op9_scaled_sketch, op10_credentials, op11_periodic_runs, op12_decontaminate, op13_hard_negatives)}
ORACLE: dict[str, str] = {"op6_host_quality": host_quality.oracle(), "op10_credentials": credentials.oracle(), "op12_decontaminate": decontaminate.oracle(), "op13_hard_negatives": hard_negatives.oracle()}
