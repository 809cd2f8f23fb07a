"""Toxicity by compression distance.

Two zstandard dictionaries are trained. The ordinary one is trained on windows of ordinary texts. The toxic one is trained on
*residual* windows of toxic texts: those that a dictionary trained on the toxic texts of the other folds shortens by `RESIDUAL` bytes more
than one trained, alike and at the same size, on as many windows of ordinary texts. So what both kinds of text share, and what a single
text says, stays out. Between words stands a mark of three bytes instead of white space, so that a match that begins or ends with a word
is worth more than one inside words.

A text is scored in overlapping windows: the bytes a window needs with the ordinary dictionary alone, less those it needs
when the toxic one is there too. A logistic curve over the windows' largest savings, their mean and the share of large
ones gives the score; its coefficients and the threshold that becomes 0.5 (best F1) come from labelled texts, each measured
with dictionaries that it did not train (cross-fitting).

The model is fitted from a bounded sample of labelled rows: of each label the `SAMPLE` documents with the smallest hash of
their id. Dictionaries are trained on the driver, from stretches spread over a text of more than `SAMPLE_CHARS` code points;
the sampled texts are measured whole, in tasks. The labels of all training rows are counted, and each sampled row weighs
in the curve and the threshold as many rows of its label as it stands for, so that neither depends on the sample's mix. Scoring
reads whole texts, in tasks.

Edge cases: a null or empty text is one empty window and scores by the curve like any other; without two labels in the
sample every score is 0; repeated rows score alike; rows without an id are never learned from; an
empty table gives an empty result; ties of an id are learned from with its one label; a score is a column expression, so other
columns and their names don't matter; labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import texts, worker_cache

SAMPLE, SAMPLE_CHARS, FOLDS = 2_000, 20_000, 3
#: A longer text trains dictionaries by so many stretches of SAMPLE_CHARS together.
STRETCHES = 10
WINDOW, STRIDE, LEVEL = 56, 28, 9
MARK = b"   "
#: Bytes of the dictionaries: ordinary, of the two that are compared for residual windows, toxic (its best segments, at its end).
ORDINARY_BYTES, COMPARED_BYTES, TOXIC_BYTES = 65_536, 16_384, 2_048
#: Bytes of a training window, at least, from each word on, and bytes more that make it residual.
TRAINED, RESIDUAL = 28, 4


def held_out(id: Column) -> Column:
    """Whether a row is kept out of training: crc32 of the id as text, modulo 5, is 0 (or there is no id)."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def marked(text: str) -> bytes:
    """The text's words in lower case, a mark before, after and between them."""
    return MARK + MARK.join(text.encode().lower().split()) + MARK


def windows(raw: bytes) -> list[bytes]:
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - WINDOW + STRIDE), STRIDE)]


def word_windows(raw: bytes) -> list[bytes]:
    """From each word on, words until TRAINED bytes are reached, marks included; of a last long word its beginning."""
    words, out = raw.split(), []
    for i in range(len(words)):
        window, j = MARK + words[i], i + 1
        while len(window) < TRAINED and j < len(words):
            window, j = window + MARK + words[j], j + 1
        out.append(window[: TRAINED + 12] + MARK)
    return out


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """The content of a dictionary trained on samples; of too few for training, the samples themselves."""
    import zstandard

    try:
        trained = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
        return trained[max(0, len(trained) - size * 15 // 16) :]  # without the header and its entropy tables
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _compressor(content: bytes):
    import zstandard

    dictionary = zstandard.ZstdCompressionDict(b"\0" * 8 + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)  # it needs eight bytes
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


def residual(toxic: list[bytes], plain: list[bytes], ordinary: bytes) -> list[bytes]:
    """The distinct windows of toxic texts that those of other folds explain better than ordinary texts do."""
    sides = [[sorted({w for i, raw in enumerate(many) if i % FOLDS == k for w in word_windows(raw)}) for k in range(FOLDS)] for many in (toxic, plain)]
    out = []
    for k in range(FOLDS):
        others = [w for j in range(FOLDS) if j != k for w in sides[0][j]]
        against = sorted((w for j in range(FOLDS) if j != k for w in sides[1][j]), key=zlib.crc32)[: len(others)]
        with_toxic, with_plain = (_compressor(_trained(x, COMPARED_BYTES, 16, 8) + ordinary).compress for x in (others, against))
        out += [w for w in sides[0][k] if len(with_plain(w)) - len(with_toxic(w)) >= RESIDUAL]
    return out


class Distance:
    """The two dictionaries, ready to compress windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.both = _compressor(ordinary), _compressor(toxic + ordinary)

    def savings(self, raw: bytes) -> np.ndarray:
        parts = windows(raw)
        own, other = self.ordinary.compress, self.both.compress
        return np.array([len(own(x)) - len(other(x)) for x in parts], float)

    def features(self, text: str) -> list[float]:
        saved = np.sort(self.savings(marked(text)))[::-1]
        return [1.0, saved[0], saved[:3].mean(), saved.mean(), (saved >= 3).mean(), math.log(len(saved))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge, of rows that count `weight` times."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _best_threshold(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The value, midway between two, from which on predicting 1 has the best F1, of rows that count `weight` times."""
    order = np.argsort(-value, kind="stable")
    value, hits, flagged = value[order], np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (flagged + hits[-1])
    last = np.append(value[1:] != value[:-1], True)  # ties go together
    best = int(np.argmax(np.where(last, f1, -1)))
    return float((value[best] + value[best + 1]) / 2) if best + 1 < len(value) else float(value[best]) - 1.0


def _weights(y: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """For each sampled row the rows of its label that it stands for, scaled to a mean of 1."""
    each = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    return each / each.mean()


def _stretches(text: Column) -> Column:
    """The text, or of a long one STRETCHES parts at even distances, by lines."""
    n, size = F.length(text), SAMPLE_CHARS // STRETCHES
    start = lambda i: (F.floor(i * (n - size) / (STRETCHES - 1)) + 1).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substring(text, start(i), F.lit(size)))
    return F.when(n > SAMPLE_CHARS, F.array_join(parts, "\n")).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> dict:
    """The model: ordinary and toxic dictionary contents, coefficients. Learns only from rows that are not held out."""
    known = labels.select(F.col(id).alias("id"), F.col(toxic).cast("int").alias("y")).filter("id is not null and y in (0, 1)").dropDuplicates(["id"])
    own = docs.filter(~held_out(F.col(id))).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = own.select("id").join(known, "id").distinct()
    totals = {0: 0, 1: 0} | {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    first, second = (rows.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1))
    # Twice `sample` ids at most; the texts themselves are not shuffled.
    chosen = first.union(second).collect()
    chosen = docs.sparkSession.createDataFrame([(r.id, r.y) for r in chosen], T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("y", T.IntegerType())]))
    # Copies of a text go to one fold, and count once.
    drawn = own.join(F.broadcast(chosen), "id").select("y", "text", F.crc32(F.col("text").cast("binary")).alias("fold"), F.xxhash64("text").alias("mark"))
    got = {(r.y, r.mark): r for r in drawn.select("y", _stretches(F.col("text")).alias("text"), "fold", "mark").collect()}
    many = {y: sorted(((r.fold, r.text) for (k, _), r in got.items() if k == y)) for y in (0, 1)}
    if min(map(len, many.values())) < FOLDS:
        return {"ordinary": b"", "toxic": b"", "weights": None}
    # Each sampled text is measured with dictionaries that it did not train.
    folds = [_dictionaries(*([t for f, t in many[k] if f % FOLDS != fold] for k in (0, 1))) for fold in range(FOLDS)]
    measured = drawn.select("y", "mark", _features(F.col("text"), F.col("fold") % FOLDS, folds).alias("x")).collect()
    measured = sorted({(r.y, r.mark): r.x for r in measured}.items())
    x, y = np.array([x for _, x in measured]), np.array([float(k) for (k, _), _ in measured])
    weight = _weights(y, totals)
    weights = _logistic(x, y, weight)
    weights[0] -= _best_threshold(x @ weights, y, weight)
    ordinary, strong = _dictionaries(*([t for _, t in many[k]] for k in (0, 1)))
    return {"ordinary": ordinary, "toxic": strong, "weights": weights.tolist()}


def _distance(ordinary: bytes, toxic: bytes) -> Distance:
    cache, key = worker_cache(), ("toxicity", hash((ordinary, toxic)))
    if key not in cache:
        cache[key] = Distance(ordinary, toxic)
    return cache[key]


def _features(text: Column, fold: Column, folds: list[tuple[bytes, bytes]]) -> Column:
    """The features of a text by the dictionaries of its fold."""

    def batch(column: pa.Array, fold: pa.Array) -> pa.Array:
        return pa.array([_distance(*folds[f]).features(x) for x, f in zip(texts(column), fold.to_pylist())], pa.list_(pa.float64()))

    return F.arrow_udf(batch, T.ArrayType(T.DoubleType()))(text, fold)


def _dictionaries(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes]:
    """Contents of the dictionaries trained on ordinary windows and on residual toxic ones."""
    plain, strong = ([marked(t) for t in x] for x in (ordinary, toxic))
    own = _trained([x for raw in plain for x in windows(raw)[::2]], ORDINARY_BYTES, 48, 8)  # every second window: they overlap by half
    return own, _trained(residual(strong, plain, own), 2 * TOXIC_BYTES, 8, 8)[-TOXIC_BYTES:]


def score(text: Column, model: dict) -> Column:
    """The score of a text, from 0 to 1; 0.5 and more is toxic."""

    def batch(column: pa.Array) -> pa.Array:
        if model["weights"] is None:
            return pa.array(np.zeros(len(column)))
        own = _distance(model["ordinary"], model["toxic"])
        value = np.array([own.features(x) for x in texts(column)]).reshape(-1, len(model["weights"])) @ np.array(model["weights"])
        return pa.array(1 / (1 + np.exp(-np.clip(value, -500, 500))))

    return F.arrow_udf(batch, T.DoubleType())(text)
