import random

import xxhash

from hitlens.llm import components, simhash_dedup
from hitlens.llm.queries import QUERIES

from .helpers import SF001, empty, frame, rows_of


def print_of(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints, radius=3):
    """{id: fp} to {id: smallest id reachable}, comparing all pairs."""
    left, out = set(prints), {}
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            seen.add(x)
            todo += [y for y in left - seen - set(todo) if (prints[x] ^ prints[y]).bit_count() <= radius]
        out |= dict.fromkeys(seen, min(seen))
        left -= seen
    return out


def test_query_equals_brute_force(spark):
    prints = {i: print_of(t) for i, t, *_ in rows_of()}
    want = classes_of(prints)
    got = QUERIES["op3_simhash_dedup"](spark, SF001).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", want[i]) for i, p in prints.items()}
    assert len(got) == len(prints)


def test_links_span_all_links_within_the_radius(spark):
    rng = random.Random(5)
    prints = {}
    for i in range(60):
        x = rng.getrandbits(64)
        for j in range(12):  # chains of near prints, and dense balls
            prints[len(prints)] = x
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) if i % 2 else 0
            if not i % 2:
                prints[len(prints)] = x ^ (1 << rng.randrange(64))
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "id long, fp long")
    for tile in (4096, 2):  # one tile for each population count, and many
        found = simhash_dedup.links(rows.select("fp").distinct(), tile=tile).collect()
        assert all((a ^ b if a ^ b >= 0 else (a ^ b) + (1 << 64)).bit_count() <= 3 for a, b in found)
        roots = {r.id: r.root for r in components.components(spark.createDataFrame(found, "a long, b long")).collect()}
        by_root = {}
        for i, p in prints.items():
            s = p - (1 << 64) if p >> 63 else p
            by_root.setdefault(roots.get(s, s), []).append(i)
        assert sorted(map(sorted, by_root.values())) == sorted(sorted(i for i, c in classes_of(prints).items() if c == k) for k in set(classes_of(prints).values()))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def test_odd_rows_and_empty_table(spark):
    docs = frame(spark)
    got = simhash_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    zero = [r for r in got if r.fp == 0]
    assert {r.id for r in zero} == {1, 2, 3} and {r.component for r in zero} == {1}
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 6, 7, 8, 9, 9, 10, 11, 12] or sorted(i for i in ids if i is not None) == [1, 4, 6, 7, 8, 9, 10, 11, 12]
    assert simhash_dedup.keep_one(empty(spark)).count() == 0
    clash = docs.withColumn("own_id", docs.id).withColumn("OWN_TIE", docs.label)
    assert simhash_dedup.keep_one(clash).columns == clash.columns and simhash_dedup.keep_one(clash).count() == len(ids)
