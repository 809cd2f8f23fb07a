import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken

from hitlens.llm import bpe
from hitlens.llm.queries import QUERIES

from .helpers import SF001, empty, frame, odd_rows, rows_of

PATH = P.path("byte_bpe_50k.tiktoken")


def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.tiktoken_ranks(PATH), special_tokens={})


def hard_texts():
    rng = random.Random(9)
    parts = ["a", "word", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "12", "é", "漢字", "!!", "　", "\xa0", "x" * 70, " " * 40, "9" * 33, "<|endoftext|>"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 400))) for _ in range(60)] + ["a" * 900, " " * 900, "\n" * 500 + "b", "word " * 300, "ab" * 200 + " " + "cd" * 300]


def test_query_equals_tiktoken(spark):
    own = encoding()
    got = {r.doc_id: r for r in QUERIES["op1_byte_bpe"](spark, SF001).collect()}
    rows = rows_of()
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_stitched_chunks_equal_whole_texts(spark):
    own, many = encoding(), hard_texts()
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(many)])
    for chunk, overlap in ((64, 16), (100, 90), (50, 1)):
        got = {r.id: r.ids for r in bpe.encode(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: own.encode_ordinary(t) for i, t in enumerate(many)}


def test_long_texts_are_cut_at_true_boundaries(spark):
    many = [t for t in hard_texts() if len(t) > 200]
    long = bpe.stage(spark.createDataFrame(list(enumerate(many)), "row long, text string"))
    got = {}
    for r in bpe.pieces(long, P.PATTERN, 64, 32).collect():
        got.setdefault(r.row, []).append((r.piece, r.text))
    assert sum(len(x) > 1 for x in got.values()) > len(many) / 2
    for i, text in enumerate(many):
        assert "".join(t for _, t in sorted(got[i])) == text
        starts, at = {m.start() for m in regex.finditer(P.PATTERN, text)}, 0
        for _, t in sorted(got[i]):
            assert at in starts
            at += len(t)


def test_odd_rows_and_empty_table(spark):
    own = encoding()
    got = sorted((r.id is None, r.id or 0, r.ids) for r in bpe.encode(frame(spark), PATH, P.PATTERN).collect())
    assert got == sorted((r[0] is None, r[0] or 0, own.encode_ordinary(r[1] or "")) for r in odd_rows())
    assert bpe.encode(empty(spark), PATH, P.PATTERN).count() == 0
