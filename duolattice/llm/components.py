"""Connected components by alternating large-star and small-star steps over an edge table.

Each round, every node hands its larger neighbours to its smallest one, then its smaller neighbours to the smallest of them;
after O(log^2 n) rounds each component is a star around its smallest node. Minima and edges are written to the shared folder
before they are joined: the joins are then plain joins of two shuffles, whose hot nodes adaptive execution can split. They are
deleted when the round has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialized


def _large_star(edges: DataFrame, made: list[str]) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialized(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least", made)
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, made: list[str]) -> DataFrame:
    least = materialized(edges.groupBy("a").agg(F.min("b").alias("m")), "least", made)
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long, in any order) to (a, b) with b the smallest node of a's component, for every a but the smallest itself."""
    edges = materialized(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", kept := [])
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or (state.n, state.h) == seen:
            return edges
        seen = (state.n, state.h)
        # What a round has read goes once its result is written.
        made = kept
        large = materialized(_large_star(edges, made), "edges", made)
        edges = materialized(_small_star(large, made), "edges", kept := [])
        discard(edges.sparkSession, made)
    raise RuntimeError(f"components are not found after {max_rounds} rounds")
