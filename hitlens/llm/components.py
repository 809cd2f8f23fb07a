"""Connected components of a graph of long ids, on Spark alone.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step is one shuffle of the edges and
their number never grows beyond that of the input; every vertex ends linked to the smallest id it reaches.
Rounds are staged in the shared folder. A vertex of very many neighbours is no group in one task: its smallest
neighbour comes from a partial aggregate and is joined back, and adaptive execution splits that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's larger (large star) or smaller (small star) neighbours to the smallest of them and itself."""
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.union(swapped) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = low.select("a", F.col("m").alias("b"))
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own)
    return out.filter("a <> b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b), longs, in any direction; returns (id, root): each vertex of an edge and its smallest reachable id."""
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # Count and checksum of the edge set; it no longer changes once all vertices hang on their roots.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = stage(_star(_star(now, True), False).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
