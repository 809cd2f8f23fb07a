"""Hard negatives by residue-number-system products.

Vectors become integers, floor(scale * component). Scores are exact integer inner products: the residues of both matrices modulo
several small primes are multiplied in float32, where no sum leaves the 2**24 integers that float32 holds exactly (dimensions are taken in
chunks of `CHUNK` for that), and the score is rebuilt from its residues by Chinese remaindering with balanced digits. As many primes are
taken as the largest squared length needs, since it bounds every score.

An anchor's positives are its first rows of the same label, by score, then id. Each positive bounds a window of scores; its
hard negatives are the first rows of other labels inside it. Two passes over the rows: the first selects positives, the second
negatives, each keeping per task and anchor only the best rows, which a window over (anchor, positive) then merges.

Scale: anchors, a stated query set, meet all rows in blocks of about `BLOCK` components, each collected and broadcast apart (some
8 MB a prime); rows are never shuffled. What is merged is at most (positives x negatives) rows a task and anchor. Work
grows with anchors x rows, as exact search does. The integer rows and each block's result are staged.

Edge cases: rows with a null label or vector, or a null or non-finite component, take no part; neither does a row with a component beyond
sqrt(2**62 / dimensions), whose scores have no exact 64-bit form. Vectors are compared with those of their own dimension; empty ones
score 0. A null id is no anchor and comes last among ties; rows that repeat an id are rows of their own (an anchor's own row alone is left
out), and ties beyond the id go by the row's place in the staged table. Without rows, anchors, positives or fitting negatives the result has no rows.
Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stage

POSITIVES, NEGATIVES, SCALE = 5, 3, 256.0
#: Hundredths of the positive's score between which a hard negative's lies.
WINDOW = (50, 95)
#: Components of a block of anchors, rows of a tile, anchors that meet a tile at once, dimensions of a float32 product.
BLOCK, TILE, SLAB, CHUNK = 1 << 21, 4096, 256, 256
_LAST = (1 << 63) - 1


def primes_for(dimensions: int, bound: int) -> list[int]:
    """Primes for products of up to CHUNK dimensions in float32 whose product exceeds four times the bound: a balanced
    top digit then stays away from the edge, where rounding could turn it."""
    half = min(2047, math.isqrt(((1 << 24) - 1) // max(1, min(dimensions, CHUNK))))  # two residues' product fits as well
    p, out, product = 2 * half + 1, [], 1
    while product <= 4 * bound + 4:
        if all(p % k for k in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return out


class Residues:
    """An integer matrix (rows x dimensions) modulo each prime, balanced around 0, in float32."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = []
        for p in primes:
            r = matrix % p
            self.parts.append((r - p * (r > p // 2)).astype(np.float32))


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, near 0; x holds integers within 2**24."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def scores(left: Residues, right: Residues, kind) -> np.ndarray:
    """left @ right.T, exact: residues by float32 products, then balanced mixed-radix digits."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(left.primes):
        a, b = left.parts[k], right.parts[k]
        r = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, a.shape[1], CHUNK):
            r = _balanced(r + _balanced(a[:, at : at + CHUNK] @ b[:, at : at + CHUNK].T, p), p)
        for digit, before in zip(digits, left.primes):
            inverse = pow(before, -1, p)
            r = _balanced((r - digit) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
        digits.append(r)
    out = digits[-1].astype(kind)
    for digit, p in zip(digits[-2::-1], left.primes[-2::-1]):
        out = out * kind(p) + digit.astype(kind)
    return out


def score_kind(bound: int):
    """The type that holds every score exactly: the smallest, for speed."""
    return np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else np.int64


def _least(kind):
    return np.iinfo(np.int64).min if kind is np.int64 else -np.inf


class Best:
    """The best k rows so far of several groups: by score, then id (null last), then row."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.found = [np.zeros((groups, 0), np.int64) for _ in range(4)]  # score, null id, id, row
        self.held = np.zeros((groups, 0), bool)

    def add(self, at, held, score, null, id_, row) -> None:
        """More rows (groups x any) of the groups `at`."""
        wide = [np.concatenate([old[at], new], axis=1) for old, new in zip(self.found, (score, null, id_, row))]
        held = np.concatenate([self.held[at], held], axis=1)
        order = np.lexsort((wide[3], wide[2], wide[1], -wide[0], ~held), axis=-1)[:, : self.k]
        if self.held.shape[1] < self.k:
            grow = self.k - self.held.shape[1]
            self.found = [np.pad(x, ((0, 0), (0, grow))) for x in self.found]
            self.held = np.pad(self.held, ((0, 0), (0, grow)))
        n = order.shape[1]
        for old, new in zip(self.found, wide):
            old[at, :n] = np.take_along_axis(new, order, axis=1)
        self.held[at, :n] = np.take_along_axis(held, order, axis=1)


class Anchors:
    """A block of anchors, by label: their rows, residues and, for the second pass, the windows of their positives."""

    def __init__(self, rows: list, dimensions: int, bound: int, positives: dict | None = None, n_positives: int = POSITIVES, window=WINDOW):
        rows = sorted(rows, key=lambda r: (r.label, r.row))
        self.row = np.array([r.row for r in rows], np.int64)
        self.label = np.array([r.label for r in rows], np.int64)
        self.residues = Residues(np.array([r.q for r in rows], np.int64).reshape(len(rows), dimensions), primes_for(dimensions, bound))
        self.dimensions, self.kind = dimensions, score_kind(bound)
        if positives is not None:
            self.low = np.full((len(rows), n_positives), 1, np.int64)  # an empty window where there is no positive
            self.high = np.full((len(rows), n_positives), 0, np.int64)
            self.has = np.zeros((len(rows), n_positives), bool)
            for i, r in enumerate(self.row.tolist()):
                for number, score in positives.get(r, ()):
                    self.low[i, number - 1] = -(-window[0] * score // 100)
                    self.high[i, number - 1] = window[1] * score // 100
                    self.has[i, number - 1] = True

    def slab(self, at: np.ndarray) -> Residues:
        out = object.__new__(Residues)
        out.primes, out.parts = self.residues.primes, [x[at] for x in self.residues.parts]
        return out


def _tiles(batches, anchors: Anchors):
    """Rows in tiles, sorted by id (null last), then row: (row, id, null, label, residues)."""
    waiting, n = [], 0

    def tile():
        row, id_, null, label, q = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((row, id_, null))
        return row[order], id_[order], null[order], label[order], Residues(q[order], anchors.residues.primes)

    for batch in batches:
        for at in range(0, len(batch), TILE):
            part = batch.slice(at, TILE)
            ids = part.column(1)
            q = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(part), anchors.dimensions)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            waiting.append((part.column(0).to_numpy(), ids.fill_null(_LAST).to_numpy(), null.astype(np.int64), part.column(2).to_numpy(), q))
            n += len(part)
            if n >= TILE:
                yield tile()
                waiting, n = [], 0
    if n:
        yield tile()


def _take_best(s: np.ndarray, k: int, least) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of the k greatest of each line, the first of equal ones first; s is left as it was."""
    lines = np.arange(len(s))
    columns, values = [], []
    for _ in range(min(k, s.shape[1])):
        columns.append(s.argmax(axis=1))
        values.append(s[lines, columns[-1]])
        s[lines, columns[-1]] = least
    for column, value in zip(columns, values):
        s[lines, column] = np.where(value == least, s[lines, column], value)
    return np.stack(columns, axis=1), np.stack(values, axis=1)


def _batches(best: Best, anchors: Anchors, numbers: int):
    """What a task found, as Arrow batches: anchor row, number of the positive, score, id, row."""
    group, place = np.nonzero(best.held)
    score, null, id_, row = (x[group, place] for x in best.found)
    columns = [anchors.row[group // numbers], (group % numbers + 1).astype(np.int32), score, row]
    for at in range(0, max(1, len(group)), 50_000):
        cut = slice(at, at + 50_000)
        arrays = [pa.array(x[cut]) for x in columns]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(id_[cut], mask=null[cut] == 1)], ["anchor", "number", "score", "row", "id"])


_FOUND = "anchor long, number int, score long, row long, id long"


def _positives(block, k: int):
    def run(batches):
        anchors: Anchors = block.value
        best, least = Best(len(anchors.row), k), _least(anchors.kind)
        for row, id_, null, label, residues in _tiles(batches, anchors):
            for own in np.unique(label):
                mine = np.nonzero(label == own)[0]
                theirs = np.arange(np.searchsorted(anchors.label, own, "left"), np.searchsorted(anchors.label, own, "right"))
                right = object.__new__(Residues)
                right.primes, right.parts = residues.primes, [x[mine] for x in residues.parts]
                for at in range(0, len(theirs), SLAB):
                    some = theirs[at : at + SLAB]
                    s = scores(anchors.slab(some), right, anchors.kind)
                    s[anchors.row[some][:, None] == row[mine][None, :]] = least
                    column, value = _take_best(s, k, least)
                    held, column = value > least, mine[column]
                    value = np.where(held, value, 0).astype(np.int64)
                    best.add(some, held, value, null[column], id_[column], row[column])
        yield from _batches(best, anchors, 1)

    return run


def _negatives(block, k: int):
    def run(batches):
        anchors: Anchors = block.value
        numbers = anchors.has.shape[1]
        best, least = Best(len(anchors.row) * numbers, k), _least(anchors.kind)
        for row, id_, null, label, residues in _tiles(batches, anchors):
            for at in range(0, len(anchors.row), SLAB):
                some = np.arange(at, min(at + SLAB, len(anchors.row)))
                s = scores(anchors.slab(some), residues, anchors.kind)
                s[anchors.label[some][:, None] == label[None, :]] = least
                for number in range(numbers):  # positives come by falling score, and so do their windows
                    has, high, low = (x[some, number] for x in (anchors.has, anchors.high, anchors.low))
                    if not has.any():
                        break
                    np.putmask(s, has[:, None] & (s > high.astype(anchors.kind)[:, None]), least)
                    column, value = _take_best(s, k, least)
                    held = has[:, None] & (value > least)
                    value = np.where(held, value, 0).astype(np.int64)
                    held &= value >= low[:, None]
                    if held.any():
                        best.add(some * numbers + number, held, value, null[column], id_[column], row[column])
        yield from _batches(best, anchors, numbers)

    return run


def integer_rows(rows: DataFrame, id: Column, vector: Column, label: Column, anchor: Column, scale: float = SCALE) -> DataFrame:
    """The rows that take part: row (its place), id, label, q (integers), squared, is_anchor."""
    x = vector.cast("array<double>")
    # Squares of such components sum to 2**62 at most.
    most = F.sqrt(F.pow(F.lit(2.0), F.lit(62.0)) / F.greatest(F.size(x), F.lit(1)))
    plain = rows.select(id.cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), most.alias("most"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    # Rounding down may add one. A comparison with null is null, and one with NaN, the greatest double, is false.
    fits = F.forall("x", lambda v: F.coalesce(F.abs(v * F.lit(scale)) + F.lit(1.0) <= F.col("most"), F.lit(False)))
    plain = plain.filter(F.col("label").isNotNull() & F.col("x").isNotNull()).filter(fits)
    q = F.transform("x", lambda v: F.floor(v * F.lit(scale)).cast("long"))
    plain = plain.select(F.monotonically_increasing_id().alias("row"), "id", "label", q.alias("q"), F.col("is_anchor") & F.col("id").isNotNull())
    plain = plain.toDF("row", "id", "label", "q", "is_anchor")
    return plain.withColumn("squared", F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + v * v))


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each anchor and positive, with their rank, out of what tasks found."""
    order = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, id: Column, vector: Column, label: Column, anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor and each of its first
    positives the first negatives whose score lies within the window (hundredths of the positive's score)."""
    spark = rows.sparkSession
    table = stage(integer_rows(rows, id, vector, label, anchor, scale), "vectors")
    sizes = table.groupBy(F.size("q").alias("d")).agg(F.max("squared").alias("bound"), F.sum(F.col("is_anchor").cast("long")).alias("n"))
    found = []
    for kind in sizes.filter("n > 0").orderBy("d").collect():  # one row per dimension of the vectors
        same = table.filter(F.size("q") == kind.d)
        n_blocks = -(-kind.n * max(1, kind.d) // block)
        for k in range(n_blocks):
            asked = same.filter(F.col("is_anchor") & (F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == k))
            some = asked.select("row", "id", "label", "q").collect()
            if some:
                found.append(_mine_block(spark, same.select("row", "id", "label", "q"), some, kind.d, kind.bound, n_positives, n_negatives, window))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    result = spark.createDataFrame([], out)
    for x in found:
        result = result.unionByName(x)
    return result


def _mine_block(spark, same: DataFrame, some: list, d: int, bound: int, n_positives: int, n_negatives: int, window) -> DataFrame:
    first = spark.sparkContext.broadcast(Anchors(some, d, bound))
    chosen = stage(_first(same.mapInArrow(_positives(first, n_positives), _FOUND), n_positives), "positives")
    windows: dict[int, list] = {}
    for r in chosen.select("anchor", "rank", "score").collect():  # n_positives rows an anchor of the block
        windows.setdefault(r.anchor, []).append((r.rank, r.score))
    second = spark.sparkContext.broadcast(Anchors(some, d, bound, windows, n_positives, window))
    negatives = _first(same.mapInArrow(_negatives(second, n_negatives), _FOUND), n_negatives)
    ids = spark.createDataFrame([(r.row, r.id) for r in some], "anchor long, anchor_id long")
    positives = chosen.select("anchor", F.col("rank").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = negatives.join(F.broadcast(positives.join(F.broadcast(ids), "anchor")), ["anchor", "number"])  # at most n_positives rows an anchor of the block
    return stage(both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


def oracle() -> str:
    """The query's rows as DuckDB SQL."""
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS r, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (
  SELECT anchor, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, r) AS number
  FROM s WHERE same QUALIFY number <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, number ORDER BY score DESC, id NULLS LAST, s.r) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND {WINDOW[0]} * positive_score <= 100 * score AND 100 * score <= {WINDOW[1]} * positive_score
QUALIFY rank <= {NEGATIVES}"""
