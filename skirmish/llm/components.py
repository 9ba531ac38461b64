"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import discard, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id`` and ``label``, the smallest id reachable, for every id that is an end of an edge to another id.

    edges: ``a``, ``b`` of any ordered type, in any direction, repeated or not. A round hangs each node's larger
    neighbours, then its smaller ones, under its smallest neighbour; the number of rounds grows with the logarithm of the
    longest path. Only sums by node and joins: a node of many edges is split like any skewed join, nothing is collected.
    Rounds are written to the shared folder, which cuts the lineage. No edges: an empty table.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = stored(ends)
    state = _state(now)
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # the large star keeps edges with the larger end first
        large = stored(large.where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        new = _state(after)
        done = new == state
        for old in (now, large):
            discard(old)
        now, state = after, new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).union(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
