"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

A text's fingerprint holds a 1 where over half of its shingle hashes do. Distinct fingerprints are sorted into
tiles by their population counts, one count for each 16-bit section. The sum of the sections' count differences
is a lower bound of the bit distance, so two tiles further apart than the radius are never compared; each
other pair of tiles meets in one row of a join and is compared in full with exclusive-or and bit counts in
numpy. A tile holds at most `TILE` fingerprints; more of the same counts make more tiles. From a pair of
tiles comes a spanning forest of its links, at most one link per fingerprint, so a group of copies costs rows in
proportion to its size. Copies of a text share one fingerprint and are compared once.

Edge cases: a null, empty or blank text has fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle; repeated rows and ties share a class; an empty table gives an empty result; only the id
and text columns are read, and `keep_one` returns every column of its input, whatever its name. A null id counts as
the largest id; of very long texts all shingles count.
"""

from __future__ import annotations

from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .store import stage
from .text import shingles, texts

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
SECTIONS, TILE = 4, 4096


def simhash(text: str, k: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of a text; A-Z are lower-cased."""
    runs = shingles(text.encode().lower().split(), k)
    if not runs:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs))
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(runs), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""

    def batch(column: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(x, k) for x in texts(column)], np.uint64).view(np.int64))

    return F.arrow_udf(batch, T.LongType())(text)


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius, one of each pair d, -d, and zero."""
    each = product(range(-radius, radius + 1), repeat=SECTIONS)
    return [d for d in each if sum(map(abs, d)) <= radius and d >= (0,) * SECTIONS]


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius between left and right, without those that join what earlier ones have joined."""
    nodes = np.unique(np.concatenate([left, right]))
    label = np.arange(len(nodes))
    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    found = []
    rows = max(1, (1 << 20) // len(right))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at : at + rows, None] ^ right[None, :]) <= radius
        for i in np.nonzero(near.any(axis=1))[0].tolist():
            own, others = at_left[at + i], at_right[near[i]]
            others = others[label[others] != label[own]]
            while len(others):
                found.append((int(nodes[own].view(np.int64)), int(nodes[others[0]].view(np.int64))))
                label[label == label[others[0]]] = label[own]
                others = others[label[others] != label[own]]
    return found


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that span the same components as all links within the radius."""
    bits = 64 // SECTIONS
    counts = [F.bit_count(F.shiftrightunsigned("fp", bits * s).bitwiseAND(F.lit((1 << bits) - 1))).cast("long") for s in range(SECTIONS)]
    base = 2 * bits  # room for a count of 0..16 and for sums with an offset of either sign
    key = sum(((c + radius) * base**s for s, c in enumerate(counts)), F.lit(0).cast("long"))
    keyed = prints.select("fp", key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    tiles = (
        keyed.join(sizes, "key")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile)))
        .groupBy("key", "block")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )
    tiles = stage(tiles, "tiles")
    steps = F.array(*(F.lit(sum(d * base**s for s, d in enumerate(o))).cast("long") for o in _offsets(radius)))
    left = tiles.select(F.explode(F.transform(steps, lambda x: x + F.col("key"))).alias("key"), F.col("block").alias("block_a"), F.col("key").alias("key_a"), F.col("fps").alias("fps_a"))
    pairs = left.join(tiles, "key").filter("key <> key_a or block >= block_a").select("fps_a", "fps")

    def compare(batches):
        for batch in batches:
            found = []
            for a, b in zip(batch.column(0), batch.column(1)):
                found += _forest(*(x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b)), radius)
            flat = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Staged (id, fp) to (fp, component): the smallest id over all fingerprints that links reach from fp."""
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    roots = stage(components(links(distinct.select("fp"), radius)), "roots")
    rooted = distinct.join(roots, distinct.fp == roots.id, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return rooted.join(lowest, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fp (signed long), component (the smallest id of its class)."""
    prints = stage(docs.select(F.col(id).alias("id"), fingerprints(F.col(text), k).alias("fp")), "simhash")
    return prints.join(classes(prints, radius).withColumnRenamed("fp", "fp_"), F.col("fp") == F.col("fp_")).drop("fp_")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The row of smallest id of each class (of rows that share that id, the first by a hash of the row; of equal
    rows, one), with all its columns."""
    columns = docs.columns
    # A row's key: its id (null as the least long) and a hash of the row, which tells null from that id.
    own = ["own_id", "own_tie"]
    while {c.lower() for c in columns} & set(own):
        own = [c + "_" for c in own]
    tied = docs.withColumn(own[0], F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63)))).withColumn(
        own[1], F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in columns))
    )
    prints = stage(tied.select(F.col(id).alias("id"), *own, fingerprints(F.col(text), k).alias("fp")), "simhash")
    known = classes(prints.select("id", "fp"), radius).withColumnRenamed("fp", "fp_")
    first = (
        prints.join(known, F.col("fp") == F.col("fp_"))
        .groupBy("component")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), *own)).alias("first"))
        .select(*(F.col(f"first.{c}").alias(c) for c in own))
    )
    # The rows are shuffled once: both steps need them by the same key.
    return tied.join(first, own, "left_semi").dropDuplicates(own).select(*(f"`{c}`" for c in columns))
