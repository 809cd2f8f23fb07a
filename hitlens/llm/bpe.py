"""Byte-level BPE: encoding in overlapping chunks, decoding by raw bytes.

A text longer than `chunk` code points becomes chunks that overlap; each is pre-tokenised on its own, in a task
of its own. A pre-token depends only on the text from its start on, so two neighbouring chunks agree from the first
boundary that both have: there they are stitched, and the pieces between stitches are encoded in parallel. Where no
boundary of the overlap agrees (one pre-token longer than it) the rest of the text stays together as one piece. A stitch never
follows white space, as the pattern looks ahead over white space. Short texts are one chunk and are encoded where
they are read.

Edge cases: a null or empty text has no ids; repeated rows are encoded each, and rows that share an id are rows of their own; a null
id stays null; an empty table gives an empty result; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stage
from .text import texts, worker_cache

CHUNK, OVERLAP = 16_384, 512
def tiktoken_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def codec(path: str, pattern: str):
    """The tiktoken encoding of a rank file, once per Python worker."""
    cache, key = worker_cache(), ("tiktoken", path, pattern)
    if key not in cache:
        import tiktoken

        cache[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=tiktoken_ranks(path), special_tokens={})
    return cache[key]


def ids_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int32), *rows])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encoded(text: Column, path: str, pattern: str) -> Column:
    def batch(column: pa.Array) -> pa.Array:
        encode = codec(path, pattern).encode_ordinary
        return ids_array([np.array(encode(x), np.int32) for x in texts(column)])

    return F.arrow_udf(batch, T.ArrayType(T.IntegerType()))(text)


def _boundaries(column_text: Column, length: Column, pattern: str, chunk: int, overlap: int) -> Column:
    """Starts of pre-tokens of a chunk, relative to it, that do not follow white space: those in its first `overlap`
    points (head) and those in the last (tail). A pre-token that touches the end of a chunk is left out, as the text goes on."""

    def batch(column: pa.Array, full: pa.Array) -> pa.Array:
        cut = regex.compile(pattern)
        heads, tails = [], []
        for text, more in zip(texts(column), full.to_pylist()):
            at = [m.start() for m in cut.finditer(text)]
            if more and at:
                at.pop()
                while at and text[at[-1] :].isspace():
                    at.pop()
            at = [x for x in at if x and not text[x - 1].isspace()]
            heads.append([x for x in at if x <= overlap])
            tails.append([x - chunk for x in at if x >= chunk])
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(heads, kind), pa.array(tails, kind)], ["head", "tail"])

    kind = T.StructType([T.StructField("head", T.ArrayType(T.IntegerType())), T.StructField("tail", T.ArrayType(T.IntegerType()))])
    return F.arrow_udf(batch, kind)(column_text, length)


def pieces(long: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, text) of long texts, staged, to (row, piece, text): parts that can be encoded each on its own."""
    last = F.ceil((F.length("text") - 1) / chunk).cast("int") - 1
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("text", i * chunk + 1, F.lit(chunk + overlap)))
    chunks = long.select("row", last.alias("last"), F.posexplode(parts).alias("piece", "text"))
    spread = chunks.repartition("row", "piece")  # chunks of one text go to many tasks
    cut = spread.select("row", "piece", _boundaries(F.col("text"), F.col("piece") < F.col("last"), pattern, chunk, overlap).alias("at"))
    cut = stage(cut, "boundaries")
    after = cut.select("row", (F.col("piece") - 1).alias("piece"), F.col("at.head").alias("head"))
    agreed = F.array_min(F.array_intersect("at.tail", "head"))
    found = (
        cut.join(after, ["row", "piece"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("piece", ((F.col("piece") + 1).cast("long") * chunk + agreed).alias("at")))).alias("found"))
    )
    # A chunk's tail is only known to be right where its own head agreed: behind the first that did not, no more cuts.
    missing = F.array_position(F.transform("found", lambda x: x["at"].isNull()), True)
    sure = F.when(missing > 0, F.slice("found", F.lit(1), (missing - 1).cast("int"))).otherwise(F.col("found"))
    stitches = found.select("row", F.transform(sure, lambda x: x["at"]).alias("stitches"))
    starts = F.concat(F.array(F.lit(0).cast("long")), "stitches")
    ends = F.concat("stitches", F.array(F.length("text").cast("long")))
    part = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    return long.join(stitches, "row").select("row", F.posexplode(part).alias("piece", "text"))


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: id, ids (array of token ids)."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= chunk + 1).select("id", _encoded(F.col("text"), path, pattern).alias("ids"))
    long = stage(rows.filter(F.length("text") > chunk + 1).withColumn("row", F.monotonically_increasing_id()), "long")
    parts = pieces(long.select("row", "text"), pattern, chunk, overlap).repartition("row", "piece")
    ids = parts.select("row", "piece", _encoded(F.col("text"), path, pattern).alias("ids"))
    whole = ids.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.union(whole.join(long.select("row", "id"), "row").select("id", "ids"))


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids: those of its tokens, one after the other."""

    def batch(column: pa.Array) -> pa.Array:
        cache, key = worker_cache(), ("bytes", path)
        if key not in cache:
            cache[key] = {i: token for token, i in tiktoken_ranks(path).items()}
        token, out = cache[key].__getitem__, []
        for row in column:  # without a Python list of the whole batch
            values = row.values
            out.append(b"" if values is None else b"".join(map(token, values.to_numpy(zero_copy_only=False).tolist())))
        return pa.array(out, pa.binary())

    return F.arrow_udf(batch, T.BinaryType())(ids)
