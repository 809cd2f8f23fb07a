import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hitlens.llm import packing
from hitlens.llm.queries import QUERIES

from .helpers import SF001, empty, frame, odd_rows, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    own = Tokenizer.from_file(PATH)
    return [x.ids + [1] for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, rows, max_padding):
    want = {}
    for (i, *_), ids in zip(rows, ids_of([r[1] for r in rows])):
        want.setdefault(i, []).append(ids)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, all_ in want.items():
        got = sorted((p.start, bytes(p.ids)) for p in by_doc[i])
        if len(all_) == 1:
            assert b"".join(x for _, x in got) == np.array(all_[0], "<u4").tobytes()
            at = 0
            for start, x in got:
                assert start == at
                at += len(x) // 4
        assert sum(len(x) // 4 for _, x in got) == sum(map(len, all_))
        assert {p.doc_tokens for p in by_doc[i]} == set(map(len, all_))
    padding = tokens = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at <= 2048 and len({(p.tier, p.step_group) for p in ps}) == 1
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        tokens += at
    assert padding <= max_padding * tokens
    return by_sequence


def test_query(spark):
    rows = rows_of()
    pieces = packing.pack(frame(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    check(pieces, rows, 0.001)
    got = QUERIES["op7_packing"](spark, SF001).collect()
    assert len({r.doc_id for r in got}) == len(rows)
    ids = {r[0]: x for r, x in zip(rows, ids_of([r[1] for r in rows]))}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_step_groups_hold_equal_tokens(spark):
    rows = [(i, f"word{i} " * (i % 400 + 1), "en", "s") for i in range(2000)]
    groups = {}
    for ps in check(packing.pack(frame(spark, rows).coalesce(1), PATH, public_tokenizers.PATTERN).collect(), rows, 0.001).values():
        key = (ps[0].tier, ps[0].step_group)
        groups[key] = groups.get(key, 0) + ps[0].tier
    assert len({k[1] for k in groups}) == len(groups)
    full = [v for (tier, _), v in groups.items() if tier in packing.TIERS]
    assert max(full) == packing.GROUP_TOKENS and sum(v == packing.GROUP_TOKENS for v in full) >= len(full) - 2 * len(packing.TIERS)


def test_odd_rows_and_empty_table(spark):
    token = "<|endoftext|>"
    held = [f"x {token} y", token, f"{token}start", f"end {token}", f"{token}{token} twice {token}\n b", f"<|endoftext| >{token[:-1]}", "a  b \n c　 d e"]
    rows = odd_rows() + [(20 + i, t, "en", "s", None, "x", None, "y", 3) for i, t in enumerate(held)]
    docs = spark.createDataFrame(rows, frame(spark).schema)
    check(packing.pack(docs, PATH, public_tokenizers.PATTERN).collect(), [r[:4] for r in rows], 0.01)
    assert packing.pack(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_remembered_words_equal_whole_texts():
    from .test_bpe import hard_texts

    many = hard_texts() + ["x <|endoftext|> y", "a<|endoftext|>", "one two three", " one", "one ", "a \nb c", "a\n b", "a  b   c", ""]
    want = [x[:-1] for x in ids_of(many)]
    old = packing.REMEMBERED
    for packing.REMEMBERED in (3, 40, old):  # generations go by within a block, and do not
        words = packing.tokenizer_words(PATH, public_tokenizers.PATTERN)
        for block in (1, 7, len(many)):
            got = [x.tolist() for i in range(0, len(many), block) for x in words.encode(many[i : i + block])]
            assert got == want
    packing.REMEMBERED = old
