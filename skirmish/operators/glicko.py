"""Glicko-2 ratings, period by period, of players in teams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.stages import discard, stored

# Fixed values of the published method: a new player's rating, deviation and volatility, and the scale. Volatilities are narrowed further than its 1e-6.
RATING, DEVIATION, VOLATILITY = 1500.0, 350.0, 0.06
SCALE, PRECISION = 173.7178, 1e-10
#: How fast volatilities may change.
TAU = 0.5


def volatility(phi: np.ndarray, sigma: np.ndarray, v: np.ndarray, delta: np.ndarray, tau: float = TAU) -> np.ndarray:
    """The volatilities after a period: the root of the likelihood's slope, bracketed and narrowed by secants (Illinois)."""
    a = np.log(sigma**2)
    start, d2, base = a, delta**2, phi**2 + v

    def slope(x: np.ndarray) -> np.ndarray:
        e = np.exp(x)
        return e * (d2 - base - e) / (2 * (base + e) ** 2) - (x - start) / tau**2

    b = np.where(d2 > base, np.log(np.maximum(d2 - base, 1e-300)), a - tau)
    low = (d2 <= base) & (slope(b) < 0)
    while low.any():
        b = np.where(low, b - tau, b)
        low &= slope(b) < 0
    fa, fb = slope(a), slope(b)
    open_ = np.abs(b - a) > PRECISION
    while open_.any():
        c = np.where(open_, a + (a - b) * fa / np.where(open_, fb - fa, 1.0), b)
        fc = slope(c)
        crossed = fc * fb <= 0
        a, fa = np.where(open_ & crossed, b, a), np.where(open_, np.where(crossed, fb, fa / 2), fa)
        b, fb = np.where(open_, c, b), np.where(open_, fc, fb)
        open_ &= np.abs(b - a) > PRECISION
    return np.exp(a / 2)


def damping(phi):
    """How much an opponent of this deviation counts."""
    return 1 / np.sqrt(1 + 3 * phi**2 / np.pi**2)


def rated(mu: np.ndarray, phi: np.ndarray, sigma: np.ndarray, certainty: np.ndarray, gain: np.ndarray, tau: float = TAU) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mu, phi and sigma after a period. certainty: the sum of g^2 E (1 - E) over a player's games, gain: of g (score - E)."""
    v = 1 / certainty
    after = volatility(phi, sigma, v, v * gain, tau)
    new = 1 / np.sqrt(1 / (phi**2 + after**2) + certainty)
    return mu + new**2 * gain, new, after


_STATE = "player string, mu double, phi double, sigma double, period long"


def _rated(period: int, tau: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            played = rows["certainty"].notna().to_numpy()
            mu, phi, sigma, last = (rows[c].to_numpy(copy=True) for c in ("mu", "phi", "sigma", "period"))
            now = (rows[c].to_numpy()[played] for c in ("mu", "now", "sigma", "certainty", "gain"))
            mu[played], phi[played], sigma[played] = rated(*now, tau)
            last[played] = period
            yield pd.DataFrame({"player": rows["player"], "mu": mu, "phi": phi, "sigma": sigma, "period": last})

    return run


def period_ratings(state: DataFrame, results: DataFrame, period: int, tau: float = TAU) -> DataFrame:
    """The state after a period: new values of those who play in it, and all others as they were.

    state: player, mu, phi, sigma, period; results: those of this period. Each plays the other side's composite: its mean
    rating, and the root of its squared deviations' sum over its number. A player's deviation grows by the volatility for
    every period since the last one played. Results are dealt once by player, if the state is too large to be broadcast, and
    once by game, where both sides meet; back to the players go sums only.
    """
    idle = F.greatest(F.lit(period) - F.col("period") - 1, F.lit(0))
    new = (0.0, DEVIATION / SCALE)
    before = state.withColumn("now", F.sqrt(F.col("phi") * F.col("phi") + idle * F.col("sigma") * F.col("sigma")))
    own = results.join(before.select("player", "mu", "now"), "player", "left").select("game", "side", "player", "score", F.coalesce("mu", F.lit(new[0])).alias("mu"), F.coalesce("now", F.lit(new[1])).alias("phi"))
    own = own.repartition("game").dropDuplicates(["game", "side", "player"])
    game = Window.partitionBy("game")
    theirs = [[F.when(F.col("side") == 1 - k, x) for x in (F.lit(1), F.col("mu"), F.col("phi") * F.col("phi"))] for k in (0, 1)]
    sums = [F.struct(F.count(n).over(game).alias("n"), F.sum(mu).over(game).alias("mu"), F.sum(square).over(game).alias("square")) for n, mu, square in theirs]
    met = own.withColumn("_t", F.when(F.col("side") == 0, sums[0]).otherwise(sums[1])).where("_t.n > 0")
    met = met.select("player", "score", "mu", (F.col("_t.mu") / F.col("_t.n")).alias("their_mu"), (1 / F.sqrt(1 + 3 * F.col("_t.square") / (F.col("_t.n") * F.col("_t.n")) / np.pi**2)).alias("g"))
    met = met.withColumn("expected", 1 / (1 + F.exp(-F.col("g") * (F.col("mu") - F.col("their_mu")))))
    gained = met.groupBy("player").agg(F.sum(F.expr("g * g * expected * (1 - expected)")).alias("certainty"), F.sum(F.expr("g * (score - expected)")).alias("gain"))
    values = [F.coalesce(c, F.lit(x)).alias(c) for c, x in (("mu", new[0]), ("phi", new[1]), ("now", new[1]), ("sigma", VOLATILITY), ("period", period))]
    return before.join(gained, "player", "full").select("player", *values, "certainty", "gain").mapInPandas(_rated(period, tau), _STATE)


def shown(state: DataFrame, period: int | None = None) -> DataFrame:
    """player, rating, deviation, volatility and the last period played; the deviation as of the end of the period given."""
    idle = F.lit(0) if period is None else F.lit(period) - F.col("period")
    phi = F.sqrt(F.pow("phi", F.lit(2)) + idle * F.pow("sigma", F.lit(2)))
    return state.select("player", (F.col("mu") * SCALE + RATING).alias("rating"), (phi * SCALE).alias("deviation"), F.col("sigma").alias("volatility"), "period")


def glicko2(results: DataFrame, tau: float = TAU) -> DataFrame:
    """player, rating, deviation, volatility and period, the last one played, of everybody after the last period.

    results: period (long), game, side (0 or 1), player, score (1 won, 0.5 drawn, 0 lost). A game needs both sides; a player
    counts once on a side. Rows with a null in any of these are left out. An empty table gives an empty table.

    Ratings go from period to period, so periods follow one another: each is a join of its own results with the state, by
    player, and two sums. The results are written by period as they come, and the state, one row per player, after every
    period: a lost executor costs its tasks only. Periods without games cost nothing.
    """
    rows = results.select(F.col("period").cast("long").alias("period"), "game", F.col("side").cast("int").alias("side"), F.col("player").cast("string").alias("player"), F.col("score").cast("double").alias("score"))
    rows = stored(rows.dropna().where("side IN (0, 1)"), by="period")
    periods = [r["period"] for r in rows.select("period").distinct().orderBy("period").collect()]
    state = results.sparkSession.createDataFrame([], _STATE)
    for k, period in enumerate(periods):
        after = stored(period_ratings(state, rows.where(F.col("period") == period), period, tau))
        if k:
            discard(state)
        state = after
    return shown(state, state.agg(F.max("period")).first()[0])
