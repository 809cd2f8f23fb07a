"""Language identification by interpolated Kneser-Ney character models.

Characters are real code points, in lower case: letters and marks stay, every run of others counts as one space. Per language an n-gram
model of order 4 with absolute discounting and interpolation is made from the counts of all training texts; it grows with them and with
the alphabet, and nothing is folded together.

Counting and estimation are Spark work: tasks add up their 4-grams, shuffles add up the tasks, and each order's probabilities come
from joins of the n-grams with their contexts and with the order below. What scoring needs of an n-gram is two numbers a language: by how much
having seen it raises the log probability of its last character over the lower order (`rise`), and the log weight that the lower order
gets behind it (`weight`). A text's log probability is the sum of these over its n-grams of every order, 0 for those never
seen. So the model is a set of sorted arrays of 64-bit n-gram hashes with their numbers beside; it can be cut anywhere, and is
broadcast in blocks of at most `BLOCK_VALUES` numbers, whatever the corpus, the alphabet or the number of languages: each
block adds its share to the texts' sums. The language of the lowest cross-entropy per character wins.

Rejection: `accepted` is false where a text's cross-entropy in its best language is above the level that 99% of that
language's training texts stay under. Texts are scored once; the levels come from the scored rows. The score is the best
language's share of the languages' likelihoods, tempered by the text's length.

Edge cases: a null text or one without a letter is `und` with score 0; without training texts every text is `und`; ties go
to the first language by name; repeated rows count and score each; an empty table gives an empty result; language, source and
id are no inputs of a prediction; other columns are untouched, whatever their names (one named as the result is replaced).
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stage
from .text import worker_cache

ORDER, DISCOUNT, SPACE = 4, 0.75, 32
#: Numbers of a broadcast block, and n-grams that a counting task holds before it hands them on.
BLOCK_VALUES, HELD = 1 << 23, 1 << 20
#: Cross-entropies are counted in steps of this many nats for the rejection level.
STEP, ACCEPT = 0.01, 0.99
NONE = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    """By code point: 1 for letters, 2 for marks, 0 for others."""
    cache = worker_cache()
    if "letters" not in cache:
        kinds = {"L": 1, "M": 2}
        cache["letters"] = np.fromiter((kinds.get(unicodedata.category(chr(p))[0], 0) for p in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    return cache["letters"]


def fold(text: str) -> np.ndarray | None:
    """A text's characters between spaces, as code points; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    if not (kinds == 1).any():
        return None
    out = np.concatenate([[SPACE], np.where(kinds > 0, points, SPACE), [SPACE]]).astype(np.uint64)
    return out[np.concatenate([[True], (out[1:] != SPACE) | (out[:-1] != SPACE)])]


def _mixed(h: np.ndarray, order: int) -> np.ndarray:
    h = (h + np.uint64(order)) * _ODD
    return (h ^ (h >> np.uint64(32))) * _ODD


def hashes(points: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of all n-grams of orders 1 to ORDER, each by its first character's place."""
    out, h = [], np.zeros(len(points), np.uint64)
    for order in range(1, ORDER + 1):
        if order > len(points):
            out.append(np.empty(0, np.uint64))
            continue
        h = h[: len(points) - order + 1] * np.uint64(0x100000001B3) + points[order - 1 :] + np.uint64(1)
        out.append(_mixed(h, order))
    return out


def _hash_grams(grams: pa.Array) -> pa.Array:
    """The hash of each n-gram, as `hashes` gives it."""
    rows = [hashes(np.frombuffer(g.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))[len(g) - 1][0] for g in grams.to_pylist()]
    return pa.array(np.array(rows, np.uint64).view(np.int64))


def _count(batches):
    """(lang, text) rows to the task's 4-gram counts (lang, gram, n), handed on whenever many are held."""
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def batch_of(lang: str):
        points, marks, n = (np.concatenate(x) for x in zip(*held.pop(lang)))
        _, first, same = np.unique(marks, return_index=True, return_inverse=True)
        n = np.bincount(same, n)
        spelled = np.ascontiguousarray(points[first].astype(np.uint32)).tobytes().decode("utf-32-le", "surrogatepass")
        grams = [spelled[i : i + ORDER] for i in range(0, len(spelled), ORDER)]
        sizes[lang] = 0
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(grams, pa.string()), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            points = fold(text)
            if points is not None and len(points) >= ORDER:
                marks, first, n = np.unique(hashes(points)[-1], return_index=True, return_counts=True)
                held.setdefault(lang, []).append((np.lib.stride_tricks.sliding_window_view(points.astype(np.uint32), ORDER)[first], marks, n))
                sizes[lang] = sizes.get(lang, 0) + len(marks)
                if sizes[lang] > HELD:
                    yield batch_of(lang)
    for lang in list(held):
        yield batch_of(lang)


def counts(rows: DataFrame) -> DataFrame:
    """(lang, text) to (lang, gram, n) over all rows."""
    return rows.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """`grams`: a staged table (hash, values: lang number, rise, weight) of all orders; per language the log
    probability that every character starts from (uniform, behind the empty context); rejection levels."""

    langs: list[str]
    grams: DataFrame | None
    start: list[float]
    n_grams: int = 0
    levels: dict[str, float] = field(default_factory=dict)


def estimate(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, rise, weight) of all n-grams and contexts, and (lang, start), from (lang, gram, n) of order ORDER."""
    tables = {ORDER: stage(counted, "grams")}
    for order in range(ORDER - 1, 0, -1):  # in how many ways a shorter n-gram is continued to the left
        longer = tables[order + 1].select("lang", F.substring("gram", 2, order).alias("gram"))
        tables[order] = stage(longer.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    # One more for characters never seen.
    uniform = 1 / (tables[1].agg(F.countDistinct("gram")).first()[0] + 1)
    lower, parts = None, []
    for order in range(1, ORDER + 1):
        rows = tables[order].select("lang", "gram", "n", F.substring("gram", 1, order - 1).alias("context"), F.substring("gram", 2, order - 1).alias("shorter"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (DISCOUNT * F.count(F.lit(1)) / F.sum("n")).alias("weight"))
        contexts = stage(contexts, "contexts")
        rows = rows.join(contexts, ["lang", "context"])
        if order == 1:
            rows = rows.withColumn("below", F.lit(uniform))
        else:
            rows = rows.join(lower, ["lang", "shorter"])
        backed = F.col("weight") * F.col("below")
        share = (F.col("n") - DISCOUNT) / F.col("total") + backed
        known = stage(rows.select("lang", "gram", share.alias("p"), F.log(share / backed).alias("rise")), "known")
        lower = known.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below"))
        parts.append(known.select("lang", "gram", "rise", F.lit(0.0).alias("weight")))
        if order == 1:
            start = contexts.select("lang", F.log(F.col("weight") * uniform).alias("start"))
        else:
            parts.append(contexts.select("lang", F.col("context").alias("gram"), F.lit(0.0).alias("rise"), F.log("weight").alias("weight")))
    grams = parts[0]
    for more in parts[1:]:
        grams = grams.unionByName(more)
    return grams.groupBy("lang", "gram").agg(F.sum("rise").alias("rise"), F.sum("weight").alias("weight")), start


def held_out(id: Column) -> Column:
    """Whether a row is kept out of training: crc32 of the id as text, modulo 5, is 0 (or there is no id)."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of all training texts, without rejection levels."""
    rows = docs.filter(~held_out(docs[id]) & docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
    grams, start = estimate(counts(rows))
    start = {r.lang: r.start for r in start.collect()}  # a row a language
    langs = sorted(start)
    if not langs:
        return Model([], None, [])
    number = F.create_map(*(x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))))
    value = F.struct(F.element_at(number, F.col("lang")).alias("lang"), F.col("rise").cast("float").alias("rise"), F.col("weight").cast("float").alias("weight"))
    # The values of a hash are at most one a language.
    table = grams.select(F.arrow_udf(_hash_grams, "bigint")("gram").alias("hash"), value.alias("value")).groupBy("hash").agg(F.collect_list("value").alias("values"))
    table = stage(table, "model")
    return Model(langs, table, [start[x] for x in langs], table.count())


class Block:
    """A share of the model: hashes sorted, found by their leading bits, with each language's numbers."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, lang: np.ndarray, rise: np.ndarray, weight: np.ndarray, n_langs: int):
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        # One row more, of zeros, for what isn't there.
        self.rise, self.weight = (np.zeros((len(keys) + 1, n_langs), np.float32) for _ in range(2))
        self.rise[place[at], lang] = rise
        self.weight[place[at], lang] = weight
        self.both = self.rise + self.weight
        self.keys = np.append(keys[order], np.uint64((1 << 64) - 1))
        self.bits = np.uint64(64 - max(4, int(len(keys)).bit_length()))
        self.first = np.searchsorted(self.keys[:-1] >> self.bits, np.arange((1 << int(64 - self.bits)) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's row, or the row of zeros."""
        lead = (h >> self.bits).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        on = np.nonzero((at < end) & (self.keys[at] < h))[0]
        while len(on):
            at[on] += 1
            on = on[(at[on] < end[on]) & (self.keys[at[on]] < h[on])]
        return np.where((at < end) & (self.keys[at] == h), at, len(self.keys) - 1)

    def sums(self, points: np.ndarray) -> np.ndarray:
        """The block's share of a text's log probability in each language."""
        total = np.zeros(self.both.shape[1])
        for order, h in enumerate(hashes(points), 1):
            if not len(h):
                break
            kinds, n = np.unique(h, return_counts=True)  # a text repeats most of its n-grams
            total += n.astype(float) @ self.both[self.find(kinds)].astype(float)
            last, first = self.find(h[[-1, 0]])
            if order < ORDER:
                total -= self.weight[last]  # nothing follows the last character
            if order == 1:
                total -= self.rise[first]  # and the first one is given
        return total


def _block(rows: list, n_langs: int) -> Block:
    keys = np.array([r.hash for r in rows], np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r["values"]) for r in rows])
    lang, rise, weight = (np.array([v[i] for r in rows for v in r["values"]]) for i in range(3))
    return Block(keys, at, lang.astype(np.int64), rise, weight, n_langs)


def _adder(block, start: list[float], later: bool):
    """The Arrow function that adds a block's sums to those of the blocks before; null where a text has no letter."""

    def added(text: pa.Array, before: list) -> pa.Array:
        out = []
        for raw, so_far in zip(text.to_pylist(), before):
            points = fold(raw) if raw else None
            if points is None:
                out.append(None)
                continue
            begun = np.array(start) * (len(points) - 1) if so_far is None else np.array(so_far["sums"])
            out.append({"n": len(points) - 1, "sums": begun + block.value.sums(points)})
        return pa.array(out, pa.struct([("n", pa.int64()), ("sums", pa.list_(pa.float64()))]))

    def first(text: pa.Array) -> pa.Array:
        return added(text, [None] * len(text))

    def next_(text: pa.Array, before: pa.Array) -> pa.Array:
        return added(text, before.to_pylist())

    return next_ if later else first


_SUMS = "struct<n:bigint,sums:array<double>>"


def predict(docs: DataFrame, model: Model, text: str = "text", result: str = "language", block_values: int = BLOCK_VALUES) -> DataFrame:
    """docs with a struct column `result`: lang, score (0 to 1), entropy (nats per character), accepted (by the model's levels)."""
    none = F.struct(F.lit(NONE).alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("accepted"))
    if not model.langs:
        return docs.withColumn(result, none)
    spark, size = docs.sparkSession, len(model.langs)
    n_blocks = max(1, -(-model.n_grams * size // block_values))
    for k in range(n_blocks):
        rows = model.grams.filter(F.pmod("hash", F.lit(n_blocks)) == k).collect()
        block = spark.sparkContext.broadcast(_block(rows, size))
        add = F.arrow_udf(_adder(block, model.start, k > 0), _SUMS).asNondeterministic()  # evaluated once
        docs = docs.withColumn(result, add(F.col(text), F.col(result)) if k else add(F.col(text)))
        if k + 1 < n_blocks:
            docs = stage(docs, "language")
    return _judged(docs, model, result, none)


def _judged(docs: DataFrame, model: Model, result: str, none: Column) -> DataFrame:
    """The sums as a prediction."""

    def judged(sums: Column) -> Column:
        entropy = F.transform(sums["sums"], lambda x: -x / sums["n"])
        best = F.array_min(entropy)
        # Neighbouring characters say much the same: likelihoods grow with the root of the length.
        odds = F.aggregate(entropy, F.lit(0.0), lambda a, x: a + F.exp((best - x) * 4 * F.sqrt(sums["n"])))
        lang = F.get(F.array(*map(F.lit, model.langs)), (F.array_position(entropy, best) - 1).cast("int"))
        known = F.struct(lang.alias("lang"), (1 / odds).alias("score"), best.alias("entropy"), accepted(lang, best, model).alias("accepted"))
        return F.when(sums.isNull(), none).otherwise(known)

    return docs.withColumn(result, F.transform(F.array(F.col(result)), judged)[0])


def accepted(lang: Column, entropy: Column, model: Model) -> Column:
    """Whether an entropy is within the level of its language; without a level everything is."""
    out = F.lit(True)
    for name, level in model.levels.items():
        out = F.when(lang == name, entropy <= level).otherwise(out)
    return F.coalesce(out, F.lit(False))


def calibrate(scored: DataFrame, lang: str, training: Column, model: Model, result: str = "language") -> Model:
    """The model with its rejection levels, from all scored training rows that were predicted right: counts in steps, a few
    hundred rows a language."""
    p = F.col(result)
    spread = scored.filter(training & (p["lang"] == F.col(lang))).groupBy(p["lang"].alias("lang"), F.floor(p["entropy"] / STEP).alias("step")).count().collect()
    levels = {}
    for name in model.langs:
        own = sorted((r["step"], r["count"]) for r in spread if r["lang"] == name)
        if own:
            share = np.cumsum([n for _, n in own]) / sum(n for _, n in own)
            levels[name] = float((own[int(np.searchsorted(share, ACCEPT))][0] + 1) * STEP)
    return Model(model.langs, model.grams, model.start, model.n_grams, levels)
