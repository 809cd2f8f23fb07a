import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlens.llm import hard_negatives as hn
from hitlens.llm.queries import ORACLE, QUERIES

from .helpers import SF01, SF001

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, row string, q int, x int"


def brute(rows, n_positives=5, n_negatives=3):
    """(anchor, positive, rank, negative, their scores) by sorting all scores of every anchor."""
    kept = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for k, (i, label, q) in enumerate(kept):
        if i is None or i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, other)), j is None, j or 0, n, j, own) for n, (j, own, other) in enumerate(kept) if n != k and len(other) == len(q)]
        scored.sort(key=lambda x: x[:4])
        for p in [x for x in scored if x[5] == label][:n_positives]:
            fits = [x for x in scored if x[5] != label and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]]
            out += [(i, p[4], rank, x[4], -p[0], -x[0]) for rank, x in enumerate(fits[:n_negatives], 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)


def mined(spark, rows, **options):
    df = table(spark, rows).repartition(3)
    id, label = F.col("vec_id"), F.col("label").cast("long")
    found = hn.mine(df, id, F.col("embedding"), F.when(id % 7 == 0, (label + 1) % 10).otherwise(label), id % 50 == 0, **options)
    assert found.columns == NAMES
    return sorted((tuple(r) for r in found.collect()), key=str)


def f32(x):
    return float(np.float32(x))


def random_rows(n, d, labels=4, seed=1, size=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(labels)]
    return [(i, [f32(size * (c + rng.gauss(0, 1.3))) for c in centres[i % labels]], i % labels) for i in range(n)]


def odd_rows():
    """Nulls of every kind, ties, repeated rows and ids, a null id, other dimensions, few positives."""
    nan, inf = float("nan"), float("inf")
    rows = random_rows(400, 8, 3)
    rows += [(1000 + i, [1.0, 2.0, 0.5, 1.0, 0.0, 0.0, 1.0, f32(0.1 * (i % 5))], i % 3) for i in range(120)]  # ties by the score
    rows += [(None, rows[3][1], 1), (501, None, 1), (503, [1.0] * 8, None), (505, [1.0] * 7 + [nan], 1), (506, [inf] + [1.0] * 7, 2), (507, [1.0, None] + [1.0] * 6, 0)]
    rows += [(550, [1.0, 2.0], 1), (551, [1.0, 2.5], 1), (552, [1.0, 1.5], 2), (600, [], 1), (601, [], 1), (602, [], 3), (650, [f32(3e5), 1.0, 2.0], 8), (651, [f32(2e5), 1.0, 2.0], 8), (652, [f32(1.5e5), 0.0, 2.0], 9)]
    return rows


@pytest.mark.parametrize("d,size", [(1, 1.0), (3, 900.0), (64, 0.2), (64, 4e4), (300, 1.0), (700, 60.0)])
def test_scores_are_exact(d, size):
    rng = np.random.default_rng(d)
    a, b = ((rng.normal(size=(n, d)) * 256 * size).astype(np.int64) for n in (40, 90))
    b[:40] = a  # the largest scores: equal vectors, and opposite ones
    b[40:50] = -a[:10]
    bound = int(max((a * a).sum(axis=1).max(), (b * b).sum(axis=1).max()))
    primes = hn.primes_for(d, bound)
    assert math.prod(primes) > 4 * bound and min(d, hn.CHUNK) * (max(primes) // 2) ** 2 < 1 << 24
    got = hn.scores(hn.Residues(a, primes), hn.Residues(b, primes), hn.score_kind(bound))
    assert (got.astype(np.int64) == a @ b.T).all() and got.dtype == hn.score_kind(bound)


@pytest.mark.parametrize("tile,slab,block", [(4096, 256, 1 << 21), (50, 3, 16)])
def test_against_brute_force(spark, monkeypatch, tile, slab, block):
    monkeypatch.setattr(hn, "TILE", tile)
    monkeypatch.setattr(hn, "SLAB", slab)
    for rows in (random_rows(600, 16), odd_rows()):
        want = sorted(brute(rows), key=str)
        assert mined(spark, rows, block=block) == want and len(want) > 20


def test_repeated_ids_and_rows(spark):
    rows = random_rows(120, 6, 2) + [(50, [f32(0.5)] * 6, 1)] * 3 + [(100, [f32(x / 7) for x in range(6)], 0)] * 2
    assert mined(spark, rows) == sorted(brute(rows), key=str)


def test_huge_components_take_no_part(spark):
    rows = random_rows(200, 8, 3)
    assert mined(spark, rows + [(700, [f32(3e38)] * 8, 1), (701, [f32(-1e12)] + [0.0] * 7, 2)]) == sorted(brute(rows), key=str)


def test_nothing_to_mine(spark):
    assert mined(spark, []) == [] == mined(spark, random_rows(1, 4)) == mined(spark, [r for r in random_rows(99, 4) if r[0] % 50])
    assert mined(spark, random_rows(200, 4, 1)) == sorted(brute(random_rows(200, 4, 1)), key=str)


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_against_sql_and_brute_force(spark, sf):
    got = sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cursor = con.execute(ORACLE["op13_hard_negatives"])
    order = [[x[0] for x in cursor.description].index(c) for c in NAMES]
    assert got == sorted(tuple(r[i] for i in order) for r in cursor.fetchall())
    rows = con.sql("select vec_id, embedding, label from embeddings").fetchall()
    assert got == sorted(brute(rows)) and len(got) > 50
