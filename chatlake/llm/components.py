"""Connected components by alternating large-star and small-star steps over DataFrames.

Every step is a grouped minimum and a join on the node, so no component and no list of neighbours is
ever gathered; the edges shrink to stars. Each round is written to the shared folder, and only its
count and sum come back to compare with the round before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import delete, gathered, joined_apart, materialise


def _to_least(rows: DataFrame, neighbours: DataFrame, most: int, edges: int) -> DataFrame:
    """rows (u, v) with m, the smallest of u and its neighbours; nodes with over ``most`` are broadcast."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select("u", F.least("u", "v").alias("m"), "n")
    least = gathered(least, edges)
    return gathered(joined_apart(rows, least.drop("n"), least.where(F.col("n") > most).drop("n"), "u"), edges)


def _large_star(edges: DataFrame, most: int, n: int) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    larger = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return _to_least(larger, both, most, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))


def _small_star(edges: DataFrame, most: int, n: int) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _to_least(down, down, most, n).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(gathered(down.groupBy("u").agg(F.min("v").alias("v")), n)).distinct()


def components(edges: DataFrame, name: str = "edges", rounds: int = 60, share: int = 1000) -> DataFrame:
    """u, v (bigint) -> node, component: the smallest node reachable, for every node with an edge.

    Nodes with more than one part in ``share`` of the edges, so twice ``share`` at most, are hot.
    """
    state = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct(), name)
    before = (state.count(), None)
    for _ in range(rounds):
        most = max(before[0] // share, share)
        last, state = state, materialise(gathered(_small_star(_large_star(state, most, before[0]), most, before[0]), before[0]), name)
        delete(state.sparkSession, last)
        # stars in which nothing moves any more have one edge a node and the same hash sum
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
