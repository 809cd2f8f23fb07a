"""Benchmark decontamination: a broadcast hash set of normalised test n-grams over the training text's token windows.

Words are the runs of a-z, 0-9 and code points from 128 on, A-Z lower-cased. A window is `N` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. Every training text's windows of these lengths are
hashed by prefix sums and looked up in a bitmap, then in the sorted hashes; each hit is verified word for word
against the item's own words, so a hash collision is never reported. Verified windows mark their words as hit:
`remove` cuts these spans out or drops the documents.

Scale: training rows are never shuffled. The benchmark is dealt by hash into blocks of about `BLOCK_BYTES` of words (a worker holds some
six times that), each collected and broadcast apart, so what a worker holds doesn't grow with the benchmark; further blocks
scan the rows once more, from a staged copy. An item longer than `PIECE_WORDS` is cut into pieces that overlap by N - 1 words.
A passage that any number of documents share costs each of them its own look-up and nothing else.

Edge cases: a null, empty or wordless text has no words and no hits; null, empty and wordless items have no windows; repeated
items and rows of one item id count once; items with a null id mark words, but are not listed; repeated rows
of documents are judged each; windows that many items share list all of them, in order; empty tables of either kind
give no hits; other columns of documents are untouched, whatever their names (one named as the result is replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stage
from .text import texts, word_bounds

N, BLOCK_BYTES, PIECE_WORDS = 10, 16 << 20, 10_000
#: Fixed normalisation: a-z, 0-9 and bytes of code points from 128 on stay, A-Z goes to a-z, the rest separates words.
_TABLE = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_MULTIPLIER = 0x9E3779B97F4A7C15
RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Powers:
    """Powers of the rolling hash's multiplier and of its inverse, as many as the longest input so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            steps = np.full((2, 2 * n), np.array([[_MULTIPLIER], [pow(_MULTIPLIER, -1, 1 << 64)]], np.uint64))
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.up[:n], self.down[:n]


class Windows:
    """Hashes of all windows of a sequence of word hashes, by prefix sums."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        up, self.down = powers.of(len(hashes))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])

    def of(self, n: int) -> np.ndarray:
        h = (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def pieces(benchmark: DataFrame, id: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """Distinct (item, words) of the benchmark: normalised words joined by spaces, in pieces of bounded length."""

    def cut(column: pa.Array) -> pa.Array:
        out = []
        for x in texts(column):
            words = words_of(x.encode())
            steps = range(0, max(1, len(words) - n + 1), PIECE_WORDS)
            out.append([b" ".join(words[i : i + PIECE_WORDS + n - 1]) for i in steps] if words else [])
        return pa.array(out, pa.list_(pa.binary()))

    cuts = F.arrow_udf(cut, "array<binary>")(F.col(text).cast("string"))
    return benchmark.select(F.col(id).cast("string").alias("item"), F.explode(cuts).alias("words")).distinct()


class Block:
    """The hash set of a block of pieces, by window length: sorted hashes of distinct windows, where each stands in the
    pieces' words, and the items that hold it."""

    def __init__(self, rows: list[tuple[str | None, bytes]], n: int = N):
        powers = Powers()
        self.items = sorted({item for item, _ in rows if item is not None})
        number = {item: i for i, item in enumerate(self.items)}
        self.text = b"".join(words for _, words in rows)
        found: dict[int, list] = {}
        base = 0
        for item, joined in rows:
            words = joined.split(b" ")
            starts, ends = word_bounds(words)
            size = min(n, len(words))
            hashes = Windows(word_hashes(words), powers).of(size)
            owner = np.full(len(hashes), number.get(item, -1), np.int32)
            found.setdefault(size, []).append((hashes, base + starts[: len(hashes)], base + ends[size - 1 :], owner))
            base += len(joined)
        self.sets = {size: self._set(*(np.concatenate(x) for x in zip(*parts))) for size, parts in found.items()}

    def _set(self, keys, starts, ends, owners):
        order = np.argsort(keys, kind="stable")
        keys, starts, ends, owners = keys[order], starts[order], ends[order], owners[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        for e in np.nonzero(~new)[0].tolist():  # equal hashes of unequal words are distinct windows
            new[e] = self.text[starts[e] : ends[e]] != self.text[starts[e - 1] : ends[e - 1]]
        first = np.nonzero(new)[0]
        bits = max(12, len(first).bit_length() + 4)
        marks = np.zeros(1 << bits, bool)
        marks[keys >> np.uint64(64 - bits)] = True
        return bits, marks, keys[first], starts[first], ends[first], np.append(first, len(keys)), owners

    def look_up(self, words: list[bytes], powers: Powers) -> tuple[np.ndarray | None, list[str]]:
        """(which words are hit, or None; the items) of a text's words."""
        hit, found = None, set()
        windows = Windows(word_hashes(words), powers) if words else None
        for size, (bits, marks, keys, starts, ends, owned, owners) in self.sets.items():
            if size > len(words):
                continue
            hashes = windows.of(size)
            likely = np.nonzero(marks[hashes >> np.uint64(64 - bits)])[0]
            if not len(likely):
                continue
            first, last = (np.searchsorted(keys, hashes[likely], side) for side in ("left", "right"))
            for i, a, b in zip(*(x[first < last].tolist() for x in (likely, first, last))):
                gram = b" ".join(words[i : i + size])
                for e in range(a, b):
                    if self.text[starts[e] : ends[e]] == gram:  # verified word for word
                        hit = np.zeros(len(words), bool) if hit is None else hit
                        hit[i : i + size] = True
                        found.update(owners[owned[e] : owned[e + 1]].tolist())
        return hit, [self.items[i] for i in found if i >= 0]


def char_spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point offsets (start, end exclusive) of the runs of hit words."""
    data = np.frombuffer(raw.translate(_TABLE), np.uint8)
    turns = np.diff(np.concatenate([[False], data != 32, [False]]).astype(np.int8))
    starts, ends = np.nonzero(turns == 1)[0], np.nonzero(turns == -1)[0]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    runs = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return list(zip(points[starts[runs[:-1] == 1]].tolist(), points[ends[runs[1:] == -1]].tolist()))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scanner(block, later: bool):
    """The Arrow function that gives a broadcast block's hits, joined to those of the blocks before."""
    powers = Powers()

    def hits(text: pa.Array, earlier: list) -> pa.Array:
        out = []
        for raw, before in zip(text.cast(pa.binary()).to_pylist(), earlier):
            raw = raw or b""
            words = words_of(raw)
            hit, items = block.value.look_up(words, powers)
            spans = [] if hit is None else char_spans(raw, hit)
            n_hit = 0 if hit is None else int(hit.sum())
            if before is not None and before["spans"]:
                spans = _merged(spans + [(s["start"], s["end"]) for s in before["spans"]])
                items, chars = {*items, *before["items"]}, raw.decode()
                n_hit = sum(len(words_of(chars[a:b].encode())) for a, b in spans)
            out.append({"n_words": len(words), "n_hit": n_hit, "items": sorted(items), "spans": [{"start": a, "end": b} for a, b in spans]})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS)]))

    def first(text: pa.Array) -> pa.Array:
        return hits(text, [None] * len(text))

    def next_(text: pa.Array, before: pa.Array) -> pa.Array:
        return hits(text, before.to_pylist())

    return next_ if later else first


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", result: str = "leaks", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a column `result`: n_words, n_hit (words in benchmark windows), items (ids as text, sorted), spans (runs of
    hit words, code points, end exclusive)."""
    spark = docs.sparkSession
    cut = stage(pieces(benchmark, item_id, item_text, n), "benchmark")
    n_blocks = max(1, -(-(cut.agg(F.sum(F.length("words"))).first()[0] or 0) // block_bytes))
    where = F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks))
    for k in range(n_blocks):
        rows = [(r.item, bytes(r.words)) for r in cut.filter(where == k).collect()]
        block = spark.sparkContext.broadcast(Block(rows, n))
        found = F.arrow_udf(_scanner(block, k > 0), RESULT).asNondeterministic()  # evaluated once
        docs = docs.withColumn(result, found(F.col(text), F.col(result)) if k else found(F.col(text)))
        if k + 1 < n_blocks:
            docs = stage(docs, "leaks")
    return docs


def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for x, cuts in zip(text.to_pylist(), spans.to_pylist()):
        if x is not None and cuts:
            edges = [0, *(e for s in cuts for e in (s["start"], s["end"])), len(x)]
            x = "".join(x[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append(x)
    return pa.array(out, pa.string())


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", whole_documents: bool = False, **options) -> DataFrame:
    """docs without the spans of benchmark windows, or without the documents that hold any."""
    column = "leaks"
    while column in docs.columns:
        column += "_"
    found = scan(docs, benchmark, text, result=column, **options)
    if whole_documents:
        return found.filter(F.col(f"{column}.n_hit") == 0).drop(column)
    cut = F.arrow_udf(_without, "string").asNondeterministic()(F.col(text), F.col(f"{column}.spans"))
    return found.withColumn(text, F.when(F.col(f"{column}.n_hit") > 0, cut).otherwise(F.col(text))).drop(column)


def oracle(n: int = N) -> str:
    """The query's rows as DuckDB SQL."""

    def words(column: str) -> str:
        plain = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"CASE WHEN {column} IS NULL THEN [] ELSE regexp_extract_all({plain}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') END"

    return f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {words('text')} AS w FROM benchmark),
gram AS (
  SELECT DISTINCT item, least(len(w), {n}) AS size, array_to_string(w[i:i + least(len(w), {n}) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
place AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM gram) WHERE len(w) >= size)),
hit AS (SELECT r, item, i, p.size FROM place p JOIN gram g ON p.gram = g.gram AND p.size = g.size),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN held USING (r)"""
