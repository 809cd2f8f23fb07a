"""Repeated passages by a sparse suffix array over words.

Suffixes are kept only where a minimiser of the words' content selects their start, so two copies of a passage keep
the same suffixes. The kept suffixes are sorted by the hash of their first `HEAD` words (then document and place)
over range partitions, and neighbours are compared: a run of equal heads is a repeat, and its first row, of the
smallest document id, is the place that stays. Aligned neighbours of a document join into one match, which is then
extended left and right word by word against the text of the first place. Before a match is reported, a second hash of all its
words, independent of the one that sorted them, must agree with the first place's: a collision is never reported.

Guarantee: of every passage of `MIN_WORDS` words or more that occurs twice, the later places are found, up to
WINDOW - 1 words at either edge where the first place itself ends earlier. Whatever is reported equals the first place word for
word over HEAD words at least (43). Shorter repeats are left alone. A run of a hot passage may span many partitions: each
partition scans its share, and a table of at most two rows a partition settles runs that cross an edge.

Edge cases: null, empty and short texts have no suffix and are kept as they are; rows equal in id and text count as
one document; rows of one id with other texts are documents of their own (told apart by 31 bits of their CRC where they sort, by 64
bits of hash where they are cut); rows without an id are documents by their text, and come after ids below 2**62; a passage that
repeats within its own document is found where the two places do not overlap; empty tables give empty results;
other columns are kept untouched, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stage, unstage

MIN_WORDS, WINDOW, GRAM = 50, 8, 8
#: Words that an anchor in the first WINDOW words of a passage of MIN_WORDS still has to its right.
HEAD = MIN_WORDS - WINDOW + 1
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Documents that a worker takes at once.
BLOCK = 256


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def word_hashes(raw: bytes) -> np.ndarray:
    words = raw.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` word hashes (polynomial modulo 2**64, by prefix sums)."""
    powers = np.multiply.accumulate(np.full(len(words) + 1, _BASE, np.uint64))
    inverse = np.multiply.accumulate(np.full(len(words) + 1, pow(_BASE, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1], dtype=np.uint64)])
    return _mix((sums[size:] - sums[:-size]) * inverse[: len(words) - size + 1])


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM, head: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the kept suffixes, ascending, and the hashes of their heads."""
    if len(words) < head:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = runs(words, gram)
    least = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1)
    at = least + np.arange(len(least))
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    at = at[at + head <= len(words)]
    return at, runs(words, head)[at]


def _tie(text: Column) -> Column:
    """31 bits that tell texts of one id apart."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF))


def _doc(id: Column, text: Column) -> Column:
    """The number that orders documents: the id, or above 2**62 a hash of the text where it is null."""
    by_text = F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(id.cast("long"), by_text)


def _blocks(batches):
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            yield batch.slice(at, BLOCK)


def _suffixes(batches):
    for batch in _blocks(batches):
        docs, places, keys = [], [], []
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            raw = raw or b""
            at, key = anchors(word_hashes(raw))
            docs.append(np.full(len(at), doc, np.int64))
            places.append(((zlib.crc32(raw) & 0x7FFFFFFF) << 32) + at)
            keys.append(key.view(np.int64))
        columns = [np.concatenate([np.empty(0, np.int64), *x]) for x in (keys, docs, places)]
        for i in range(0, max(1, len(columns[0])), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in columns], ["key", "doc", "place"])


#: Kinds of rows that a scanned partition gives.
_REPEAT, _ALONE, _EDGE = 0, 1, 2
_SCANNED = "kind int, key long, doc long, place long, first_doc long, first_place long, n int"


def _neighbours(batches):
    """Compares neighbours of a sorted partition of the suffix array. Gives the rows whose head a neighbour shares,
    each with the first row of its run; the partition's first and last run as _EDGE rows, and their lone rows."""
    names = [x.split()[0] for x in _SCANNED.split(", ")]

    def rows(kind, key, doc, place, first_doc, first_place, n):
        whole = [np.full(len(key), kind, np.int32), key, doc, place, first_doc, first_place, np.full(len(key), n, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in whole], names)

    def row(kind, key, doc, place, n):
        one = [np.array([x], np.int64) for x in (key, doc, place, doc, place)]
        return rows(kind, *one, n)

    run = None  # of the last row: its key, first row, rows so far (2: or more), and whether it opened the partition
    for batch in batches:
        key, doc, place = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        if run is not None and run["n"] == 1:  # its only row is still held back
            key, doc, place = (np.concatenate([[run[c]], x]) for c, x in (("key", key), ("doc", doc), ("place", place)))
            opening, carried = run["opening"], None
        else:
            opening, carried = run is None, run
        new = np.concatenate([[carried is None or key[0] != carried["key"]], key[1:] != key[:-1]])
        if carried is not None and new.any() and carried["opening"]:  # the partition's first run ended here, or right before
            yield row(_EDGE, carried["key"], carried["doc"], carried["place"], carried["n"])
        begins = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first_doc, first_place = (np.where(begins < 0, 0 if carried is None else carried[c], x[begins]) for c, x in (("doc", doc), ("place", place)))
        shared = ~new | np.concatenate([~new[1:], [False]])
        held = bool(new[-1])
        emit = shared.copy()
        if emit.any():
            yield rows(_REPEAT, *(x[emit] for x in (key, doc, place, first_doc, first_place)), 0)
        if opening and int(new.sum()) > 1:  # the partition's first run ended in this batch
            n = int(np.nonzero(new)[0][1])
            yield row(_EDGE, key[0], doc[0], place[0], min(2, n))
            if n == 1:
                yield row(_ALONE, key[0], doc[0], place[0], 1)
        last_opening = (opening and int(new.sum()) == 1) or (carried is not None and not new.any() and carried["opening"])
        run = {"key": int(key[-1]), "doc": int(first_doc[-1]), "place": int(first_place[-1]), "n": 1 if held else 2, "opening": last_opening}
    if run is not None:
        yield row(_EDGE, run["key"], run["doc"], run["place"], run["n"])
        if run["n"] == 1:
            yield row(_ALONE, run["key"], run["doc"], run["place"], 1)


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Kept suffixes that repeat an earlier one: doc, tie, pos, first_doc, first_tie, first_pos."""
    suffixes = stage(docs.select(_doc(docs[id], docs[text]), text).mapInArrow(_suffixes, "key long, doc long, place long"), "suffixes")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = suffixes.repartitionByRange(parts, "key", "doc", "place").sortWithinPartitions("key", "doc", "place")
    scanned = stage(ordered.mapInArrow(_neighbours, _SCANNED), "neighbours")
    unstage(suffixes)
    # At most two rows a partition of the scan.
    edges = (
        scanned.filter(F.col("kind") == _EDGE)
        .groupBy(F.col("key").alias("edge"))
        .agg(F.min(F.struct("first_doc", "first_place")).alias("first"), F.sum("n").alias("all"))
        .filter("`all` > 1")
    )
    found = (
        scanned.filter(F.col("kind") != _EDGE)
        .join(F.broadcast(edges), F.col("key") == F.col("edge"), "left")
        .filter((F.col("kind") == _REPEAT) | F.col("edge").isNotNull())
        .withColumn("first_doc", F.coalesce("first.first_doc", "first_doc"))
        .withColumn("first_place", F.coalesce("first.first_place", "first_place"))
    )
    tie, pos = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    found = found.select("doc", tie("place").alias("tie"), pos("place").alias("pos"), "first_doc", tie("first_place").alias("first_tie"), pos("first_place").alias("first_pos"))
    same = (F.col("doc") == F.col("first_doc")) & (F.col("tie") == F.col("first_tie"))
    return found.filter(~same | (F.col("pos") - F.col("first_pos") >= HEAD))


_MATCH = ("doc", "tie", "start", "end", "first_doc", "first_tie", "first_start")


def _matches(batches):
    """Joins aligned suffixes (same document, first document and distance, no gap) of rows sorted by them and by place."""
    last = None  # the open match: its (doc, tie, first_doc, first_tie, distance), start, and last place

    def rows(keys, start, last_pos):
        columns = [*keys[:2], start, last_pos + HEAD, *keys[2:4], start - keys[4]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], list(_MATCH))

    for batch in batches:
        if not len(batch):
            continue
        *keys, pos = (batch.column(i).to_numpy() for i in range(6))
        before = [np.concatenate([[x[0] if last is None else last[0][i]], x[:-1]]) for i, x in enumerate(keys)]
        gap = pos > np.concatenate([[pos[0] if last is None else last[2]], pos[:-1]]) + HEAD
        new = gap | np.logical_or.reduce([x != y for x, y in zip(keys, before)])
        if last is None:
            new[0] = True
        begins = np.nonzero(new)[0]
        if last is not None:  # the open match goes on up to the first new one
            end = begins[0] if len(begins) else len(pos)
            last = (last[0], last[1], pos[end - 1] if end else last[2])
        if len(begins):
            if last is not None:
                yield rows([np.array([x]) for x in last[0]], np.array([last[1]]), np.array([last[2]]))
            ends = np.append(begins[1:], len(pos)) - 1
            if len(begins) > 1:
                yield rows([x[begins[:-1]] for x in keys], pos[begins[:-1]], pos[ends[:-1]])
            last = (tuple(x[begins[-1]] for x in keys), pos[begins[-1]], pos[-1])
    if last is not None:
        yield rows([np.array([x]) for x in last[0]], np.array([last[1]]), np.array([last[2]]))


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code point offsets of the words' starts and ends."""
    data = np.frombuffer(raw, np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    turn = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return point[np.nonzero(turn == 1)[0]], point[np.nonzero(turn == -1)[0]]


def spelling(words: np.ndarray) -> np.ndarray:
    """Prefix sums of a second hash of the words, by other powers and of other mixed words than `runs`: for every start and
    end, `spelled` gives the hash of the words between."""
    powers = np.multiply.accumulate(np.full(len(words) + 1, _BASE2, np.uint64))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words ^ np.uint64(_BASE2)) * powers[:-1], dtype=np.uint64)])


def spelled(sums: np.ndarray, start: int, end: int) -> int:
    """64 bits, signed."""
    x = (int(sums[end]) - int(sums[start])) * pow(_BASE2, -start, 1 << 64) % (1 << 64)
    return x - (1 << 64) if x >> 63 else x


_AROUND = "doc long, tie long, start long, end long, id long, text_hash long, check long, before array<long>, after array<long>, starts array<int>, ends array<int>"


def _around(batches):
    """For each wanted place of a document: a hash of its words, the words before and after it, nearest first, and the
    character offsets that the place has when it grows by 0, 1, ... of them."""
    names = [x.split()[0] for x in _AROUND.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 2
    for batch in _blocks(batches):
        out = []
        for doc, tie, id_, text_hash, raw, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4).cast(pa.binary()).to_pylist(), batch.column(5)):
            words = word_hashes(raw)
            sums, plain = spelling(words), words.view(np.int64)
            first, last = word_places(raw)
            for s, e in zip(*(wanted.values.field(c).to_pylist() for c in ("start", "end"))):
                if e > len(words):
                    continue  # a place in another text of this id and tie
                low = max(0, s - WINDOW)
                out.append((doc, tie, s, e, id_, text_hash, spelled(sums, s, e), plain[low:s][::-1].copy(), plain[e : e + WINDOW].copy(), first[low : s + 1][::-1].copy(), last[e - 1 : e + WINDOW].copy()))
        for at in range(0, len(out), 20_000):
            part = list(zip(*out[at : at + 20_000]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(part, kinds)], names)


def _equal(a: str, b: str) -> Column:
    """How many leading elements of two arrays agree."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a))


def _found(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Later places of repeated passages, with the id and the text's hash of their documents."""
    found = repeats(docs, id, text).withColumn("distance", F.col("pos") - F.col("first_pos"))
    order = ["doc", "tie", "first_doc", "first_tie", "distance", "pos"]
    aligned = found.select(*order).repartition("doc", "tie").sortWithinPartitions(*order)
    matches = stage(aligned.mapInArrow(_matches, ", ".join(f"{c} long" for c in _MATCH)), "matches")
    first_end = F.col("first_start") + F.col("end") - F.col("start")
    first = matches.select(F.col("first_doc").alias("doc"), F.col("first_tie").alias("tie"), F.col("first_start").alias("start"), first_end.alias("end"))
    wanted = matches.select("doc", "tie", "start", "end").union(first).distinct().groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("wanted"))
    keyed = docs.select(_doc(docs[id], docs[text]).alias("doc"), _tie(docs[text]).alias("tie"), docs[id].cast("long").alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    # Places have no proven bound: the same shuffled join at every size.
    meeting = keyed.join(wanted.hint("merge"), ["doc", "tie"]).select("doc", "tie", "id", "text_hash", "text", "wanted")
    around = stage(meeting.mapInArrow(_around, _AROUND).dropDuplicates(["doc", "tie", "start", "end", "text_hash"]), "around")
    theirs = around.select(
        F.col("doc").alias("first_doc"), F.col("tie").alias("first_tie"), F.col("start").alias("first_start"), F.col("end").alias("first_end"), F.col("id").alias("first_id"),
        F.col("check").alias("first_check"), F.col("before").alias("first_before"), F.col("after").alias("first_after"),
    )
    both = matches.withColumn("first_end", first_end).join(around, ["doc", "tie", "start", "end"]).join(theirs, ["first_doc", "first_tie", "first_start", "first_end"])
    left, right = _equal("before", "first_before"), _equal("after", "first_after")
    return both.filter(F.col("check") == F.col("first_check")).select(
        "id", "tie", "text_hash", F.get("starts", left).cast("long").alias("start"), F.get("ends", right).cast("long").alias("end"),
        (F.col("end") - F.col("start") + left + right).alias("n_words"), "first_id", (F.col("first_start") - left).alias("first_word"),
    )


def passages(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Later places of repeated passages: doc, tie, start, end (code points, end exclusive), n_words, first_doc, first_word."""
    return _found(docs, id, text).select(F.col("id").alias("doc"), "tie", "start", "end", "n_words", F.col("first_id").alias("first_doc"), "first_word")


def _cut(column: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(column.to_pylist(), spans.to_pylist()):
        if text is not None and cuts:
            parts, at = [], 0
            for x in cuts:  # by start; they may overlap
                if x["start"] > at:
                    parts.append(text[at : x["start"]])
                at = max(at, x["end"])
            parts.append(text[at:])
            text = "".join(parts)
        out.append(text)
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs without the later places of repeated passages. Documents of which no word is left go; n_chars, where
    the table has it, is that of the text that is left of changed documents."""
    columns = docs.columns
    taken = {c.lower() for c in columns}
    names = ["suffix_id", "suffix_hash", "suffix_cuts", "own_id", "own_hash"]
    while taken & set(names):
        names = [x + "_" for x in names]
    cut_id, cut_hash, cuts, own_id, own_hash = names
    found = (
        _found(docs, id, text)
        .groupBy(F.col("id").alias(cut_id), F.col("text_hash").alias(cut_hash))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
    )
    found = stage(found, "cuts")
    keyed = docs.withColumn(own_id, F.col(id).cast("long")).withColumn(own_hash, F.xxhash64(text))
    joined = keyed.join(found.hint("merge"), (F.col(own_hash) == F.col(cut_hash)) & F.col(own_id).eqNullSafe(F.col(cut_id)), "left")
    changed = F.col(cuts).isNotNull()
    left = joined.withColumn(text, F.when(changed, F.arrow_udf(_cut, T.StringType()).asNondeterministic()(F.col(text), F.col(cuts))).otherwise(F.col(text)))
    left = left.filter(~changed | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if n_chars in columns:
        left = left.withColumn(n_chars, F.when(changed, F.length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return left.select(*(f"`{c}`" for c in columns))
