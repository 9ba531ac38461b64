"""Ratings from line-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.stages import discard, stored


def ridge(games: DataFrame, alpha: float, prior: DataFrame | None = None, rounds: int = 300, precision: float = 1e-26) -> DataFrame:
    """``player`` and ``strength``: the least squares of the score differences over both line-ups, with alpha times the sum of
    squares added; no intercept.

    games: side_a, side_b (arrays of players), diff; each row is a game, repeated ones too. prior: player, strength; what is added is then the distance from these,
    and from 0 for all others. A player on both sides of a game cancels out. Nulls in sides or diff leave the game out.

    The normal equations are sparse sums over pairs of players that have met, and are solved by conjugate gradients: a round is
    a join of the pairs with one row per player, and two sums, so neither players nor games pass through the driver. Rounds
    end when the residual's square is precision times the first, or after so many.
    """
    sign = lambda side, x: F.transform(side, lambda p: F.struct(p.alias("player"), F.lit(x).alias("x")))
    known = games.where("side_a IS NOT NULL AND side_b IS NOT NULL AND diff IS NOT NULL")
    # written, so that the numbers don't change
    known = stored(known.select(F.monotonically_increasing_id().alias("id"), "side_a", "side_b", "diff"))
    cells = known.select("id", F.col("diff").cast("double").alias("diff"), F.explode(F.concat(sign("side_a", 1.0), sign("side_b", -1.0))).alias("s")).select("id", "diff", "s.*")
    cells = stored(cells.where("player IS NOT NULL").groupBy("id", "diff", "player").agg(F.sum("x").alias("x")).where("x <> 0"))
    other = cells.select("id", F.col("player").alias("other"), F.col("x").alias("y"))
    pairs = stored(cells.join(other, "id").groupBy("player", "other").agg(F.sum(F.col("x") * F.col("y")).alias("v")))
    start = F.lit(0.0) if prior is None else F.coalesce("strength", F.lit(0.0))
    sums = cells.groupBy("player").agg(F.sum(F.col("x") * F.col("diff")).alias("b"))
    sums = sums.withColumn("w", start) if prior is None else sums.join(prior.select("player", "strength"), "player", "left").withColumn("w", start).drop("strength")

    def times(state: DataFrame, column: str) -> DataFrame:
        """state with ``q``, the pairs' matrix times a column."""
        held = state.select(F.col("player").alias("other"), F.col(column).alias("_c"))
        return state.join(pairs.join(held, "other").groupBy("player").agg(F.sum(F.col("v") * F.col("_c")).alias("q")), "player")

    # alpha pulls towards the prior, where the search begins, so that it has no part in the first residual
    state = stored(times(sums, "w").select("player", "w", (F.col("b") - F.col("q")).alias("r"), F.lit(0.0).alias("p")))
    size = lambda df: df.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    first = left = size(state)
    share = 0.0
    for _ in range(rounds):
        if left <= precision * first:
            break
        turned = state.withColumn("p", F.col("r") + share * F.col("p"))
        moved = stored(times(turned, "p").withColumn("q", F.col("q") + alpha * F.col("p")))
        step = left / moved.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        new = stored(moved.select("player", (F.col("w") + step * F.col("p")).alias("w"), (F.col("r") - step * F.col("q")).alias("r"), "p"))
        # summed over the new residual: what follows from the old one's sums is lost in their rounding
        after = size(new)
        for old in (state, moved):
            discard(old)
        state, left, share = new, after, after / left
    return state.select("player", F.col("w").alias("strength"))
