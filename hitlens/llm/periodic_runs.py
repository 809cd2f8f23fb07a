"""Periodic runs of words by recompression.

A run is a stretch of words whose smallest period is q (words q apart are equal), of `LEAST_WORDS` words and `EXPONENT` periods
or more, that no neighbouring word extends keeping period q.

Candidates: a run of four periods holds four words on the grid of multiples of q, q apart and equal, so for every q the places
of the grid where four words in a row agree are candidates (n / q places for q: the harmonic grid, n ln n
in all). The texts that have any are written as one run-length grammar: blocks of equal symbols become one symbol with a count,
then, by a bit of each symbol's hash, pairs become one symbol, and so on in turns until texts are single symbols. Names are
exact: equal names have equal expansions. How far the words from i and from i + q agree (to the right, and to the left by the
mirrored levels) is answered by climbing the levels while whole symbols agree and descending where they differ, for all
candidates at once. Of the candidates of one period, one per stretch of agreeing words is asked. Equal stretches
keep their smallest period: the others are its multiples.

Everything is exact and within a row, so tasks need no shuffle. A worker takes texts of `BLOCK_WORDS` words at a time; a longer text
is a block of its own, and its memory is some 100 bytes a word.

Edge cases: null, empty and blank texts have no words and no run, and collapse to the empty text; texts of fewer than LEAST_WORDS words
have no run; runs are ordered by start, then period; overlapping runs are all reported; repeated rows and rows of one id are judged each;
an empty table gives an empty result; other columns are untouched, whatever their names (one named as the result is replaced).
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, EXPONENT = 6, 4
#: Words of texts that a worker takes at once, and the longest text whose grid is looked up in a table.
BLOCK_WORDS, GRID_WORDS = 200_000, 1 << 16
RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
_ODD = 0x9E3779B97F4A7C15


class Level:
    """Symbols of one level, and how the next level merges them: the symbol above each, whether it is the first there,
    and, where blocks were merged, how many symbols of its block are left from it on."""

    def __init__(self, sym: np.ndarray, start: np.ndarray | None):
        self.sym, self.start = sym, start  # start: the first symbol of each one on the level below, and that level's length
        self.up = self.first = self.rest = None

    def merged(self, first: np.ndarray, blocks: bool) -> np.ndarray:
        """Sets what the merge at the marked first symbols gives; returns the next level's start."""
        start = np.append(np.nonzero(first)[0], len(first)).astype(np.int32)
        self.first, self.up = first, (np.cumsum(first) - 1).astype(np.int32)
        if blocks:
            self.rest = start[self.up + 1] - np.arange(len(first), dtype=np.int32)
        return start

    def mirrored(self, below: int) -> "Level":
        """The level read from right to left; below: symbols of the level below."""
        out = Level(self.sym[::-1], None if self.start is None else (below - self.start)[::-1])
        if self.up is not None:
            out.up, out.first = (self.up[-1] - self.up)[::-1], np.append(self.first[1:], True)[::-1]
            if self.rest is not None:
                ahead = np.arange(len(self.sym), dtype=np.int32)
                out.rest = (ahead - np.maximum.accumulate(np.where(self.first, ahead, 0)) + 1)[::-1]
        return out


class Grammar:
    """Run-length grammar of a sequence of symbols >= 0; negative symbols are separators, each unique, that are never merged.
    The sequence starts and ends with one."""

    def __init__(self, sym: np.ndarray):
        self.levels, names, texts_, turn = [Level(sym.astype(np.int64), None)], int(sym.max(initial=0)) + 1, int((sym < 0).sum()), 0
        while len(self.levels[-1].sym) > 2 * texts_:
            names = self._blocks(names)
            names = self._pairs(names, turn)
            turn += 1
        self.length = len(sym)
        sizes = [0, *(len(x.sym) for x in self.levels)]
        self.mirror = [x.mirrored(below) for x, below in zip(self.levels, sizes)]

    def _add(self, first: np.ndarray, code: np.ndarray, made: np.ndarray, names: int, blocks: bool) -> int:
        """Appends the level whose symbols begin where `first` marks; those of `made` are named by their code."""
        last = self.levels[-1]
        start = last.merged(first, blocks)
        sym = last.sym[start[:-1]]
        known, which = np.unique(code, return_inverse=True)
        sym[made] = names + which
        self.levels.append(Level(sym, start))
        return names + len(known)

    def _blocks(self, names: int) -> int:
        sym = self.levels[-1].sym
        first = np.concatenate([[True], sym[1:] != sym[:-1]])
        if first.all():
            return names
        at = np.nonzero(first)[0]
        size = np.diff(np.append(at, len(sym)))
        made = np.nonzero(size > 1)[0]
        return self._add(first, sym[at[made]] * (len(sym) + 1) + size[made], made, names, True)

    def _pairs(self, names: int, turn: int) -> int:
        sym = self.levels[-1].sym
        mixed = (sym.astype(np.uint64) + np.uint64(turn * 0x51ED27)) * np.uint64(_ODD)
        right = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(_ODD)) >> np.uint64(63) == 1
        word = sym >= 0
        pair = ~right[:-1] & right[1:] & word[:-1] & word[1:]
        if not pair.any():
            return names
        first = np.concatenate([[True], ~pair])
        left = np.nonzero(pair)[0]
        made = (np.cumsum(first) - 1)[left]
        return self._add(first, sym[left] * names + sym[left + 1], made, names, False)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on agree (i < j)."""
        return self._agree(self.levels, i, j)

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i and up to j agree."""
        return self._agree(self.mirror, self.length - 1 - i, self.length - 1 - j)

    @staticmethod
    def _agree(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differ: list[list] = []
        q, a, b = np.arange(len(i)), i, j
        for level in levels:  # up, as long as symbols agree
            differ.append([])
            above = []
            while len(q):
                same = level.sym[a] == level.sym[b]
                differ[-1].append((q[~same], a[~same], b[~same]))
                q, a, b = q[same], a[same], b[same]
                if level.up is not None:
                    whole = level.first[a] & level.first[b]
                    above.append((q[whole], level.up[a[whole]], level.up[b[whole]]))
                    q, a, b = q[~whole], a[~whole], b[~whole]
                step = 1 if level.rest is None else np.minimum(level.rest[a], level.rest[b])
                a, b = a + step, b + step
            q, a, b = (np.concatenate(x) for x in zip(*above)) if above else (q, a, b)
            if not len(q):
                break
        q, a, b = q[:0], a[:0], b[:0]
        for level, met in zip(levels[len(differ) - 1 :: -1], differ[::-1]):  # down, to the words that differ
            q, a, b = (np.concatenate(x) for x in zip((q, a, b), *met))
            on = np.arange(len(q))
            while len(on := on[level.sym[a[on]] == level.sym[b[on]]]):
                step = 1 if level.rest is None else np.minimum(level.rest[a[on]], level.rest[b[on]])
                a[on] += step
                b[on] += step
            if level.start is not None:
                a, b = level.start[a], level.start[b]
        out = np.empty(len(i), np.int64)
        out[q] = a - i[q]
        return out


class Grid:
    """Candidates (place, period) of a text: four equal words in a row on the grid of multiples of the period."""

    def __init__(self):
        self.size, self.table = 0, ()

    def _grow(self, n: int) -> None:
        self.size = min(GRID_WORDS, 2 * n)
        periods = np.arange(1, (self.size - 1) // (EXPONENT - 1) + 1)
        places = -(-(self.size - (EXPONENT - 1) * periods) // periods)
        q = np.repeat(periods, places)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(places) - places, places)) * q
        last = i + (EXPONENT - 1) * q
        order = np.argsort(last, kind="stable")
        self.table = tuple(x[order].astype(np.int32) for x in (i, i + q, q, last))

    def candidates(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(w)
        if n > GRID_WORDS:
            found = []
            for q in range(1, n // EXPONENT + 1):
                x = w[::q]
                same = x[1:] == x[:-1]
                at = np.nonzero(same[:-2] & same[1:-1] & same[2:])[0]
                if len(at):
                    found.append((at * q, np.full(len(at), q)))
            return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        if n > self.size:
            self._grow(n)
        i, j, q, last = (x[: np.searchsorted(self.table[3], n)] for x in self.table)
        at = np.nonzero(w[i] == w[j])[0]
        at = at[(w[j[at] + q[at]] == w[j[at]])]
        at = at[(w[last[at]] == w[j[at]])]
        return i[at].astype(np.int64), q[at].astype(np.int64)


def find_runs(docs: list[np.ndarray], grid: Grid) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of several texts' word numbers (one vocabulary), in this order."""
    asked = []
    for d, w in enumerate(docs):
        if len(w) >= LEAST_WORDS:
            place, q = grid.candidates(w)
            if len(place):
                asked.append((d, place, q))
    if not asked:
        return (np.empty(0, np.int64),) * 4
    parts, base, at = [np.array([-1])], [], 1
    for k, (d, _, _) in enumerate(asked):
        base.append(at)
        parts += [docs[d], np.array([-2 - k])]
        at += len(docs[d]) + 1
    grammar = Grammar(np.concatenate(parts))
    text = np.concatenate([np.full(len(p), k) for k, (_, p, _) in enumerate(asked)])
    q = np.concatenate([x for _, _, x in asked])
    place = np.concatenate([p + base[k] for k, (_, p, _) in enumerate(asked)])
    order = np.lexsort((place, q, text))
    text, q, place = text[order], q[order], place[order]
    found = []
    while len(place):  # the first candidate of each text and period that no stretch found so far holds
        first = np.concatenate([[True], (text[1:] != text[:-1]) | (q[1:] != q[:-1])])
        i, p = place[first], q[first]
        ahead, behind = grammar.right(i, i + p), grammar.left(i - 1, i - 1 + p)
        length = behind + ahead + p
        run = length >= np.maximum(LEAST_WORDS, EXPONENT * p)
        found.append((text[first][run], (i - behind)[run], length[run], p[run]))
        left = place >= (i + ahead)[np.cumsum(first) - 1]
        text, q, place = text[left], q[left], place[left]
    text, start, length, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    least = np.ones(len(text), bool)
    least[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, q = text[least], start[least], length[least], q[least]
    order = np.lexsort((q, start, text))
    number = np.array([d for d, _, _ in asked])
    return number[text][order], (start - np.array(base)[text])[order], length[order], q[order]


def _scan(column: pa.Array) -> pa.Array:
    grid, rows, block, size = Grid(), [], [], 0
    columns: list[list] = [[], [], [], []]  # n_words, runs, their values, collapsed

    def settle():
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        docs = [np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)) for words in block]
        text, start, length, period = find_runs(docs, grid)
        per_text = np.bincount(text, minlength=len(block))
        columns[0] += map(len, block)
        columns[1] += per_text.tolist()
        columns[2].append((start, length, period))
        ends = np.cumsum(per_text)
        for words, n, end in zip(block, per_text.tolist(), ends.tolist()):
            if n:
                goes = np.zeros(len(words) + 1, np.int64)
                np.add.at(goes, (start + period)[end - n : end], 1)
                np.add.at(goes, (start + length)[end - n : end], -1)
                words = [words[i] for i in np.nonzero(np.cumsum(goes)[:-1] == 0)[0].tolist()]
            columns[3].append(b" ".join(words))

    for raw in column.cast(pa.binary()).to_pylist():
        block.append((raw or b"").split())
        size += len(block[-1])
        if size >= BLOCK_WORDS:
            settle()
            block, size = [], 0
    settle()
    values = [np.concatenate(x) for x in zip(*columns[2])]
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in values], ["start", "length", "period"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(columns[1])]).astype(np.int32))
    collapsed = pa.array(columns[3], pa.binary()).cast(pa.string())
    return pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.ListArray.from_arrays(offsets, runs), collapsed], ["n_words", "runs", "collapsed"])


def scan(docs: DataFrame, text: str = "text", result: str = "periodic") -> DataFrame:
    """docs with a column `result`: n_words, runs (start, length, period, in words), and the text without what any run
    repeats (the words of a run after its first period), its words joined by single spaces."""
    return docs.withColumn(result, F.arrow_udf(_scan, RESULT).asNondeterministic()(F.col(text)))  # evaluated once


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the repeated periods of runs cut out of the texts; texts without a run stay as they are."""
    column = "periodic"
    while column in docs.columns:
        column += "_"
    found = scan(docs, text, column)
    return found.withColumn(text, F.when(F.size(f"{column}.runs") > 0, F.col(f"{column}.collapsed")).otherwise(F.col(text))).drop(column)
