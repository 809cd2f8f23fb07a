import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hitlens.llm import periodic_runs as pr
from hitlens.llm.queries import QUERIES

from .helpers import SF001, empty, frame, odd_rows, rows_of


def brute(w):
    """All runs (start, length, period) of a sequence, by the definition."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    goes = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(x for i, x in enumerate(words) if i not in goes)


def found(docs):
    out = [[] for _ in docs]
    for d, *run in zip(*(x.tolist() for x in pr.find_runs([np.array(x, np.int64) for x in docs], pr.Grid()))):
        out[d].append(tuple(run))
    return out


def hard_sequences():
    rng = random.Random(5)
    docs = [[], [1], [1] * 5, [1] * 6, [1] * 300, [1, 2] * 4, [1, 2] * 3 + [1], [1, 2, 3] * 4, [9] + [1, 2, 3] * 5 + [1, 2, 9], ([1] * 6 + [2]) * 5, ([1, 1, 2] * 4 + [3]) * 6,
            [1, 2] * 6 + [3] + [1, 2] * 6, list(range(500)), [*range(40)] * 9 + [*range(7)]]
    for size, kinds in ((30, 2), (200, 2), (400, 3), (60, 1), (1500, 30)):
        docs += [[rng.randrange(kinds) for _ in range(rng.randrange(size))] for _ in range(20)]
    for _ in range(60):  # periodic stretches, some broken by one word, within others
        w = [rng.randrange(50) for _ in range(rng.randrange(100))]
        for _ in range(rng.randrange(4)):
            p = rng.randrange(1, 40)
            w += ([rng.randrange(3) for _ in range(p)] * 12)[: rng.randrange(1, 12 * p + 1)]
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = 77
        docs.append(w)
    return docs


@pytest.mark.parametrize("grid_words", [1 << 16, 16])
def test_runs_against_the_definition(monkeypatch, grid_words):
    monkeypatch.setattr(pr, "GRID_WORDS", grid_words)
    docs = hard_sequences()
    want = [brute(w) for w in docs]
    assert found(docs) == want and sum(map(len, want)) > 150
    assert [found([w])[0] for w in docs[::7]] == want[::7]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_any_sequences(docs):
    assert found(docs) == [brute(w) for w in docs]


def test_grammar_agreement_and_exact_names():
    rng = random.Random(3)
    w = [-1] + [rng.randrange(2) for _ in range(400)] + [1, 0, 0] * 90 + [-2] + [1] * 200 + [-3]
    g = pr.Grammar(np.array(w))
    assert len(g.levels) > 8 and any(x.rest is not None for x in g.levels)

    def spell(level, k):
        while level:
            k = [x for s in k for x in range(g.levels[level].start[s], g.levels[level].start[s + 1])]
            level -= 1
        return tuple(w[x] for x in k)

    for level in range(len(g.levels)):
        texts = {}
        for k, name in enumerate(g.levels[level].sym.tolist()):
            assert texts.setdefault(name, spell(level, [k])) == spell(level, [k])
    i = np.array([rng.randrange(1, len(w) - 2) for _ in range(3000)])
    j = np.array([rng.randrange(x + 1, len(w) - 1) for x in i])
    right, left = g.right(i, j), g.left(i, j)
    for a, b, r, back in zip(i.tolist(), j.tolist(), right.tolist(), left.tolist()):
        n = 0
        while b + n < len(w) and w[a + n] == w[b + n]:
            n += 1
        m = 0
        while a - m >= 0 and w[a - m] == w[b - m]:
            m += 1
        assert (r, back) == (n, m)


def test_long_text_in_one_go():
    w = [*range(70_000)] + [1, 2, 3, 4, 5] * 6000 + [*range(100_000)] * 1
    assert found([w]) == [[(70_000, 30_000, 5)]]


def expected(rows):
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if doc is not None and h % 10 == 0 and words:
            n = len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        out.append((doc, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()))
    return out


def test_query_against_the_definition(spark):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    df = QUERIES["op11_periodic_runs"](spark, SF001)
    assert df.columns == names and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    # the definition takes the square of a text's words: compare those of up to 3,000
    rows = [(r[0], r[1]) for r in rows_of() if len((r[1] or "").split()) <= 3000]
    got = {r.doc_id: tuple(r) for r in df.collect()}
    assert len(got) == len(rows_of())
    want = expected(rows)
    assert [got[r[0]] for r in want] == want and sum(r[1] for r in want) > 10


def test_odd_rows_and_empty_table(spark):
    rows = odd_rows() + [(30, "a b " * 9 + "c", "en", "s", None, "x", None, "y", 3)]
    docs = spark.createDataFrame(rows, frame(spark).schema)
    got = sorted(((r.doc_id is None, r.doc_id, r.text or "", r.periodic.n_words, [tuple(x) for x in r.periodic.runs], r.periodic.collapsed) for r in pr.scan(docs).collect()), key=str)
    want = []
    for r in rows:
        words = (r[1] or "").encode().split()
        runs = [] if len(words) > 10_000 else brute(words)
        want.append((r[0] is None, r[0], r[1] or "", len(words), runs, collapsed(words, runs).decode()))
    assert got == sorted(want, key=str) and any(x[4] for x in want)
    assert pr.scan(empty(spark)).count() == 0
    named = docs.withColumn("periodic", docs.label)
    cut = {(r.doc_id, r.text) for r in pr.collapse(named).collect()}
    assert pr.collapse(named).columns == named.columns and (30, "a b c") in cut and (11, "\n \n  x   y\r\n\tz  ") in cut
