import random
import re

from hitlens.llm import license_scan as ls
from hitlens.llm.queries import QUERIES

from .helpers import SF01, empty, frame, rows_of


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def runs(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(text, templates=ls.TEMPLATES):
    """Licenses by comparing every window with every template."""
    words, out = tokens(text), {}
    for name, template in templates:
        t = tokens(template)
        want = runs(t)
        for at in range(0, max(1, len(words) - 1), ls.STRIDE):
            low = max(0, at - len(t))
            share = len(want & runs(words[low : at + ls.WINDOW + len(t)])) / len(want)
            if share >= ls.CONTAINED:
                out[name] = max(out.get(name, 0), share)
    return out


def test_query_equals_brute_force_and_is_native(spark):
    got = QUERIES["op4_license_scan"](spark, SF01)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    want = {(i, k): v for i, t, *_ in rows_of(SF01) if "icens" in (t or "") or "reely" in (t or "") for k, v in plain(t).items()}
    assert want and {(r.doc_id, r.license): r.containment for r in got.collect()} == want


def test_every_alignment_is_retrieved(spark):
    rng, rows, want = random.Random(4), [], {}
    for i in range(300):
        name, text = ls.TEMPLATES[i % len(ls.TEMPLATES)]
        pad = lambda n: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n))
        rows.append((i, f"{pad(rng.randrange(40))} {text.upper() if i % 2 else text}! {pad(rng.randrange(40))}", "en", "s"))
        want[i] = name
    got = ls.scan(frame(spark, rows), ls.default_templates(spark)).collect()
    assert {(r.id, r.license) for r in got} >= set(want.items()) and all(r.containment >= ls.CONTAINED for r in got)


def test_edited_and_partial_notices(spark):
    text = ls.TEMPLATES[7][1]
    cut = text.split()
    rows = [(1, " ".join(cut[:-1]), "en", "s"), (2, " ".join(cut[: len(cut) // 2]), "en", "s"), (3, "mit license released under the", "en", "s")]
    got = {r.id for r in ls.scan(frame(spark, rows), ls.default_templates(spark)).collect()}
    assert got == {1}


def test_recall_of_edited_copies(spark):
    """Copies of full texts with words replaced, left out and added, down to a containment of 0.8."""
    rng, rows, want = random.Random(7), [], {}
    full = [(k, t) for k, t in ls.TEMPLATES if len(t.split()) > 40]
    assert len(full) >= 10
    for i in range(240):
        name, text = full[i % len(full)]
        words = text.split()
        for _ in range(rng.randrange(1, max(2, len(words) // 25))):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [f"edit{rng.randrange(999)}"] * rng.randrange(2)
        pad = lambda n: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n))
        copy = f"{pad(rng.randrange(60))} {' '.join(words)} {pad(rng.randrange(60))}"
        share = len(runs(tokens(text)) & runs(tokens(copy))) / len(runs(tokens(text)))
        if share >= ls.CONTAINED:
            rows.append((i, copy, "en", "s"))
            want[i, name] = share
    got = {(r.id, r.license): r.containment for r in ls.scan(frame(spark, rows), ls.default_templates(spark)).collect()}
    found = [k for k in want if k in got]
    assert len(want) > 150 and len(found) >= 0.99 * len(want)


def test_miss_probability():
    assert ls.miss_probability(0.5) < 0.001 and ls.miss_probability(1.0) == 0


def test_odd_rows_and_empty_tables(spark):
    docs, templates = frame(spark), ls.default_templates(spark)
    assert ls.scan(docs, templates).count() == 0
    assert ls.scan(empty(spark), templates).count() == 0
    assert ls.scan(docs, templates.limit(0)).count() == 0
    twice = frame(spark, [(8, ls.TEMPLATES[0][1], "en", "s"), (8, ls.TEMPLATES[0][1], "en", "s"), (None, "x " + ls.TEMPLATES[0][1], None, None)])
    assert sorted((r.id or 0, r.license) for r in ls.scan(twice, templates).collect()) == [(0, "Apache-2.0"), (8, "Apache-2.0")]


def test_short_template_and_both_sides_of_the_switch(spark, monkeypatch):
    templates = spark.createDataFrame([(0, "short", "MIT License"), *((i + 1, k, t) for i, (k, t) in enumerate(ls.TEMPLATES))], "template int, license string, text string")
    rows = [(1, "MIT License", "en", "s"), (2, "mit, license!", "en", "s"), (3, "License MIT", "en", "s"), (4, "of the " + ls.TEMPLATES[7][1] + " of the", "en", "s")]
    rows += [(10 + i, t, "en", "s") for i, t, *_ in rows_of()[:200]]
    docs = frame(spark, rows)
    below = sorted(map(tuple, ls.scan(docs, templates).collect()))
    monkeypatch.setattr(ls, "MAX_PAIRS", 0)
    assert sorted(map(tuple, ls.scan(docs, templates).collect())) == below
    assert {r[0] for r in below if r[2] == "short"} == {1, 2} and (4, "MIT") in {(r[0], r[2]) for r in below}
