"""Hierarchical packing of documents into training sequences of several lengths.

A document is its token ids and an end id. Whole multiples of the context become sequences of their own; what is left is
routed to the shortest tier (256, 512, 1024 or 2048 tokens) that holds it. Tiers are packed from long to
short: a sequence starts with the longest document of its tier, its gap is filled with the longest documents of the
shorter tiers that fit, and what still gapes with a part cut from a short one. So each sequence is full
at a power of two and needs no padding. Sequences of a tier make step groups of equal tokens, dealt
out in turns by attention cost (sum of squared piece lengths).

Each task packs what it reads, from pools of bounded size, without a shuffle; only a task's last tokens (fewer than
fit a tier) go to sequences of smaller powers of two. Sequence and group ids start with the partition's number and a
retried task makes the same ones, as long as its input comes in the same order, as from a table.

Edge cases: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives an empty result;
a null id stays null; other columns are not read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .text import texts, worker_cache

CONTEXT, TIERS, END_ID = 2048, (2048, 1024, 512, 256), 1
#: Tokens of documents that a task holds at once, and of a step group.
POOL_TOKENS, GROUP_TOKENS = 1 << 20, 1 << 16
#: Words and pre-tokens whose ids a worker remembers (words twice: the current and the last generation), and texts
#: that it encodes at once.
REMEMBERED, BLOCK = 300_000, 128
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Words:
    """Encodes whole texts by a pattern's pre-tokens and `merge` (a pre-token's ids), remembering the ids of words.

    A space after a point other than white space starts a pre-token of the byte-level patterns, so a text is the words
    between such spaces, each with the space before it, and a word's ids do not depend on its neighbours. Texts in
    which a space meets other white space are encoded pre-token by pre-token.
    """

    def __init__(self, pattern: str, merge, added: dict[str, int] | None = None, letters=None):
        """added: strings that are one token wherever they stand, and their ids. Texts are cut at them first. letters: as
        `merge` of a space and a word of letters."""
        self.split, self.merge, self.added = regex.compile(pattern).findall, merge, added or {}
        self.letters = letters or (lambda word: merge(" " + word))
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.added else None
        self.now: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            self.pieces[piece] = ids = array("I", self.merge(piece)).tobytes()
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._ids, self.split(text)))

    def _learn(self, words: set[str]) -> None:
        """Remembers the words' ids; b"" for a word next to which the pattern may cut elsewhere than at the space."""
        now, last, ids, letters = self.now, self.last, self._ids, self.letters
        several = []  # words of several pre-tokens
        for w in words:
            known = last.get(w)
            if known is not None:
                now[w] = known
            elif not w or w[-1].isspace():
                now[w] = b""
            elif w.isalpha():  # the pattern takes a space and letters whole
                now[w] = array("I", letters(w)).tobytes()
            else:
                several.append(w)
        # All at once: between two safe words the pattern cuts at the space.
        pieces = iter(self.split("".join([" " + w for w in several])))
        for w in several:
            left, parts = len(w) + 1, []
            while left > 0:
                piece = next(pieces)
                left -= len(piece)
                whole = now.get(piece[1:]) if piece[0] == " " else None
                parts.append(whole or ids(piece))
            now[w] = b"".join(parts)

    def encode(self, texts_: list[str]) -> list[np.ndarray]:
        holding = [i for i, x in enumerate(texts_) if any(token in x for token in self.added)]
        if not holding:
            return self._encode(texts_)
        parts = [self.cut(texts_[i]) for i in holding]  # odd places are added tokens
        rest = [x for i, x in enumerate(texts_) if i not in set(holding)]
        ids = iter(self._encode(rest + [x for p in parts for x in p[::2]]))
        out: list = [None] * len(texts_)
        for i in sorted(set(range(len(texts_))) - set(holding)):
            out[i] = next(ids)
        for i, p in zip(holding, parts):
            out[i] = np.concatenate([np.array([self.added[x]], np.uint32) if k % 2 else next(ids) for k, x in enumerate(p)])
        return out

    def _encode(self, texts_: list[str]) -> list[np.ndarray]:
        if len(self.now) >= REMEMBERED:
            self.now, self.last = {}, self.now
        firsts, cut = [], []
        for x in texts_:
            first, space, rest = x.partition(" ")
            firsts.append(first)
            cut.append(rest.split(" ") if space else [])
        self._learn(set().union(*cut).difference(self.now))
        out = []
        for text, first, words in zip(texts_, firsts, cut):
            ids = list(map(self.now.__getitem__, words))
            if not first or first[-1].isspace() or b"" in ids:
                out.append(np.frombuffer(self._plain(text), np.uint32))
            else:
                out.append(np.frombuffer(self._plain(first) + b"".join(ids), np.uint32))
        return out


def tokenizer_words(path: str, pattern: str) -> Words:
    """The Words of a byte-level BPE file of `tokenizers`, once per Python worker. Added tokens are cut out first, as the
    library's plain encode does; pre-tokens go to its merges as characters of the byte-level alphabet."""
    cache, key = worker_cache(), ("tokenizers", path)
    if key not in cache:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        merge, added = whole.model.tokenize, {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

        def ids(piece: str) -> list[int]:
            plain = piece.isascii() and piece.isprintable()
            return [t.id for t in merge(piece.replace(" ", chr(letters[32])) if plain else piece.encode().decode("latin-1").translate(letters))]

        shown_space = chr(letters[32])

        def word(w: str) -> list[int]:
            return [t.id for t in merge(shown_space + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)))]

        cache[key] = Words(pattern, ids, added, word)
    return cache[key]


class Packer:
    """Packs parts (length, serial, doc, start, ids, doc_tokens) into sequences: (tier, parts)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.parts, self.tokens, self.serial = tiers, [], 0, count()

    def add(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        insort(self.parts, (len(ids), next(self.serial), doc, start, ids, doc_tokens))
        self.tokens += len(ids)

    def _take(self, longest: int, shortest: int = 0):
        """The longest part within the bounds, or None."""
        at = bisect_right(self.parts, (longest, float("inf")))
        if at and self.parts[at - 1][0] > shortest:
            self.tokens -= self.parts[at - 1][0]
            return self.parts.pop(at - 1)
        return None

    def _cut(self, length: int):
        """The first ids of the shortest part that is longer; its rest goes back."""
        at = bisect_right(self.parts, (length, float("inf")))
        if at == len(self.parts):
            return None
        size, serial, doc, start, ids, all_ = self.parts.pop(at)
        self.tokens -= size
        self.add(doc, start + length, ids[length:], all_)
        return (length, serial, doc, start, ids[:length], all_)

    def fill(self, tier: int, first) -> list | None:
        """A full sequence that starts with `first`; None, and all parts put back, if the pool can't fill it."""
        taken, gap = [first], tier - first[0]
        if self.tokens < gap:
            self.add(*first[2:])
            return None
        while gap:
            part = self._take(gap) or self._cut(gap)
            taken.append(part)
            gap -= part[0]
        return taken

    def sequences(self):
        """Full sequences, tier by tier, as long as each tier has documents and the pool can fill their gaps."""
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while (first := self._take(tier, below)) is not None:
                if (taken := self.fill(tier, first)) is None:
                    break
                yield tier, taken

    def rest(self):
        """What is left, in sequences at powers of two, long ones first."""
        while self.tokens:
            size = min(self.tiers[0], 1 << (self.tokens.bit_length() - 1))
            first = self._take(size) or self._cut(size)
            yield size, self.fill(size, first)


def pack(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, context: int = CONTEXT, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: its document and place there, its ids (little-endian unsigned 32-bit), its sequence, offset
    there, the sequence's tier (tokens) and step group."""

    def batches_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def encoded(batch, words):
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            yield from zip(part.column(0).to_pylist(), words.encode(texts(part.column(1))))

    def run(batches):
        words = tokenizer_words(path, pattern)
        home = TaskContext.get().partitionId() << 36
        sequence, group, packer = count(home), count(home), Packer(tiers)
        waiting: dict[int, list] = {}  # by tier: full sequences that have no step group yet

        def deal(tier: int, last: bool = False):
            """Rows of the tier's waiting sequences, dealt to step groups in turns, costly ones first."""
            each = max(1, GROUP_TOKENS // tier)
            full = waiting[tier]
            if len(full) < 4 * each and not last:
                return []
            keep = [] if last else full[len(full) // each * each :]
            full = full[: len(full) - len(keep)]
            waiting[tier] = keep
            groups = [next(group) for _ in range(-(-len(full) // each))]
            rows = []
            for i, parts in enumerate(sorted(full, key=lambda s: -sum(p[0] ** 2 for p in s))):
                turn, k = divmod(i, len(groups))
                number, own, offset = next(sequence), groups[-1 - k if turn % 2 else k], 0
                for length, _, doc, start, ids, all_ in parts:
                    rows.append((doc, start, length, ids.tobytes(), all_, number, offset, tier, own))
                    offset += length
            return rows

        def put(tier: int, parts: list):
            waiting.setdefault(tier, []).append(parts)
            return deal(tier)

        rows: list = []
        for batch in batches:
            for doc, ids in encoded(batch, words):
                ids = np.append(ids, np.uint32(end_id))
                whole = len(ids) // context * context
                for start in range(0, whole, context):
                    rows += put(context, [(context, 0, doc, start, ids[start : start + context].copy(), len(ids))])
                if whole < len(ids):
                    packer.add(doc, whole, ids[whole:].copy(), len(ids))
                if packer.tokens >= POOL_TOKENS:
                    for tier, parts in packer.sequences():
                        rows += put(tier, parts)
                if len(rows) >= 5_000:
                    yield batches_of(rows)
                    rows = []
        for tier, parts in packer.sequences():
            rows += put(tier, parts)
        for tier, parts in packer.rest():
            rows += put(tier, parts)
        for tier in sorted(waiting, reverse=True):
            rows += deal(tier, True) if waiting[tier] else []
        for i in range(0, max(1, len(rows)), 5_000):
            yield batches_of(rows[i : i + 5_000])

    return docs.select(docs[id].cast("long").alias("doc_id"), text).mapInArrow(run, SCHEMA)
