"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import checkpoint


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
    return tuple(row)


def _star(directed: DataFrame, keep: str) -> DataFrame:
    """Links each u's chosen neighbours v to the least of u and its neighbours. directed: u, v."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = directed.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))) if keep == "v < u" else linked


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Of edges (a, b) over longs: node, root, root being the least node that a node can reach.

    Nodes without an edge are left out, as are loops. Each round's edges are no more than the last one's, and each
    round is checkpointed. Degrees are reduced by partial aggregation; the joins on a hot node can be split.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, "v > u").where("a <> b").distinct()
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "v < u").where("a <> b").distinct()
        now = checkpoint(small)
        if (after := _state(now)) == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
