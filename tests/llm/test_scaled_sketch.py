import hashlib

import numpy as np
import pytest

from hitlens.llm import scaled_sketch as ss
from hitlens.llm.queries import QUERIES

from .helpers import SF01, empty, frame, odd_rows, rows_of


def true_containment(a, b):
    sets = []
    for t in (a, b):
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / min(map(len, sets)) if all(sets) else float(sets[0] == sets[1])


@pytest.mark.parametrize("parts", ["1", "7"])
def test_query_against_plain_python(spark, parts):
    rows = sorted(((i, t or "") for i, t, *_ in rows_of(SF01)), reverse=True)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in QUERIES["op9_scaled_sketch"](spark, SF01).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows)
    off = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        change = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(change.encode()).hexdigest())
        assert r.fingerprint == ss.fingerprint(ss.sketch(text)) and r.edited_fingerprint == ss.fingerprint(ss.sketch(change))
        if len(text) > 8000:
            off += [abs(r.near_edited - true_containment(text, change)), abs(r.near_next - true_containment(text, after))]
        if text == after:
            assert r.near_next == 1
    assert np.mean(off) < 0.03 and max(off) < 0.35


def test_sketches_merge_and_unequal_texts_compare():
    words = [f"w{i}" for i in range(40_000)]
    a, b = " ".join(words[:30_000]), " ".join(words[29_996:])
    whole = ss.sketch(" ".join(words))
    assert np.array_equal(ss.merge(ss.sketch(a), ss.sketch(b)), whole)
    assert ss.containment(ss.sketch(" ".join(words[500:900])), whole) == 1
    assert np.array_equal(ss.read_fingerprint(ss.fingerprint(whole)), whole)
    assert len(ss.sketch("few words")) == 1 and len(ss.sketch("")) == 0


def test_odd_rows_and_empty_table(spark):
    rows = odd_rows()
    got = ss.compare_successors(frame(spark)).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == "" and by[2].near_next == 1 and by[13].near_next == 1
    assert by[None].edited_sha256 == hashlib.sha256(("no id " + odd_rows()[-1][1][:6]).encode()).hexdigest()
    assert ss.compare_successors(empty(spark)).count() == 0
    single = ss.compare_successors(frame(spark, [(5, "only one here", "en", "s")])).collect()
    assert single[0].near_next == 1 and len(single) == 1
