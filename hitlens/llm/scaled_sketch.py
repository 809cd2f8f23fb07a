"""Document fingerprints by a threshold-scaled sketch.

A sketch keeps every distinct shingle hash below a fixed share (`1 / SCALE`) of the hash space, and the smallest
hash always, so a text with words never has an empty sketch. The share is the same for every text, so
sketches of very unequal texts compare without bias and the sketch of a union is the union (with the smallest hash).
Likeness is the containment of the smaller sketch in the larger one.

Each text is also compared with its successor and with an edited form, whose second half is the successor's start. The
order (descending id) is that of ranges of ids: boundaries come from a bounded quantile sketch, each range goes to one task
with its rows sorted there, and the row after a range's last one is sent along as a copy, so texts are shuffled once.

Edge cases: a null or empty text has the empty fingerprint; two empty fingerprints are alike (1), an empty and another one
are not (0); rows of one id come by the hash of their text; a null id comes last; the row after the last is the
first, also of a single row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import shingles, texts

SHINGLE_WORDS, SCALE, SEED = 5, 8, 9
_LIMIT = np.uint64((1 << 64) // SCALE)
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def sketch(text: str, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The kept hashes, ascending."""
    runs = shingles(text.encode().split(), k)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs))
    kept = np.unique(hashes[hashes < _LIMIT])
    return kept if len(kept) or not len(hashes) else hashes.min(keepdims=True)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    return both[(both < _LIMIT) | (np.arange(len(both)) == 0)]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller one's shingles that the other has."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def fingerprint(a: np.ndarray) -> str:
    """The sketch as text: 16 hexadecimal digits for each hash."""
    return a.astype(">u8").tobytes().hex()


def read_fingerprint(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def edited(text: str, after: str) -> str:
    """text with its last half (rounded down) replaced by as many code points, or all, from the start of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(batches):
    """Rows of one range in order, then the row that follows it."""

    def out(rows):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    held, rows = None, []
    every = chain.from_iterable(zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()) for b in batches)
    for doc, text, range_, copy in every:
        mine = sketch(text)
        if held is not None and held[3] == range_:
            was, before, theirs, _ = held
            change = edited(before, text)
            new = sketch(change)
            rows.append(
                (was, len(before), hashlib.sha256(change.encode()).hexdigest(), fingerprint(theirs), fingerprint(new), containment(theirs, new), containment(theirs, mine))
            )
            if len(rows) == 500:
                yield out(rows)
                rows = []
        held = None if copy else (doc, text, mine, range_)
    yield out(rows)


def _ranges(key: Column, cuts: list[int], copies: dict[int, int]) -> Column:
    """The ranges that a row goes to, as 2 * range, and 2 * range + 1 for a copy. Range 0 has the largest keys."""
    bounds = np.array(cuts, np.int64)

    def batch(column: pa.Array) -> pa.Array:
        keys = column.to_numpy(zero_copy_only=False)
        own = 2 * (len(bounds) - np.searchsorted(bounds, keys, "left"))
        return pa.array([[o] if k not in copies else [o, 2 * copies[k] + 1] for k, o in zip(keys.tolist(), own.tolist())], pa.list_(pa.int64()))

    return F.arrow_udf(batch, T.ArrayType(T.LongType()))(key)


def compare_successors(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document in SCHEMA: fingerprints of its text and of its edited text, and their likeness."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63)))  # a null id comes last
    rows = docs.select(key.alias("key"), F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    # Four ranges for each shuffle partition. What the driver gets is a few numbers a range.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / (4 * parts) for i in range(1, 4 * parts)]
    cuts = sorted(set(rows.agg(F.percentile_approx("key", shares, 10_000)).first()[0] or []))
    own = F.explode(_ranges(F.col("key"), cuts, {})).alias("to")
    first = {r.to: r.key for r in rows.select("key", own).groupBy("to").agg(F.max("key").alias("key")).collect()}
    filled = sorted(first)
    # The first rows of a range are copied behind the range before it, those of the first one behind the last.
    copies = {first[r]: filled[i - 1] // 2 for i, r in enumerate(filled)}
    sent = rows.select("key", "doc", "text", F.explode(_ranges(F.col("key"), cuts, copies)).alias("to"))
    sent = sent.select("key", "doc", "text", F.shiftright("to", 1).alias("range"), F.col("to").bitwiseAND(F.lit(1)).alias("copy"))
    spread = sent.repartition(parts, "range").sortWithinPartitions("range", "copy", F.col("key").desc(), F.xxhash64("text"))
    return spread.select("doc", "text", "range", "copy").mapInArrow(_compare, SCHEMA)
