"""Glicko-2 ratings of a stream of games: the update of operators.glicko, held in state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from skirmish.operators import glicko

RATED = "league string, player string, rating double, deviation double, volatility double, period long"
_PLAYER = "mu double, phi double, sigma double, period long"
_RESULT = "game string, side int, player string, score double"


def after_period(known: dict[str, tuple[float, float, float, int]], results: pd.DataFrame, period: int, tau: float = glicko.TAU) -> dict[str, tuple[float, float, float, int]]:
    """The new mu, phi, sigma and period of those who play in a period. known: of everybody before it."""
    rows = results.drop_duplicates(["game", "side", "player"])
    rows = rows[rows.groupby("game")["side"].transform("nunique") == 2]
    if rows.empty:
        return {}
    new = (0.0, glicko.DEVIATION / glicko.SCALE, glicko.VOLATILITY, period)
    own = np.array([known.get(p, new) for p in rows["player"]])
    idle = np.maximum(period - own[:, 3] - 1, 0)
    rows = rows.assign(mu=own[:, 0], phi=np.sqrt(own[:, 1] ** 2 + idle * own[:, 2] ** 2), sigma=own[:, 2])
    rows["square"] = rows["phi"] ** 2
    sides = rows.groupby(["game", "side"]).agg(their_mu=("mu", "mean"), square=("square", "sum"), n=("mu", "size")).reset_index()
    sides["their_phi"], sides["side"] = np.sqrt(sides["square"]) / sides["n"], 1 - sides["side"]
    met = rows.merge(sides[["game", "side", "their_mu", "their_phi"]], on=["game", "side"])
    g = glicko.damping(met["their_phi"])
    expected = 1 / (1 + np.exp(-g * (met["mu"] - met["their_mu"])))
    met = met.assign(certainty=g * g * expected * (1 - expected), gain=g * (met["score"] - expected))
    sums = met.groupby("player").agg(mu=("mu", "first"), phi=("phi", "first"), sigma=("sigma", "first"), certainty=("certainty", "sum"), gain=("gain", "sum"))
    found = glicko.rated(*(sums[c].to_numpy() for c in ("mu", "phi", "sigma", "certainty", "gain")), tau)
    return {p: (float(mu), float(phi), float(sigma), period) for p, mu, phi, sigma in zip(sums.index, *found, strict=True)}


class Ratings(StatefulProcessor):
    """A league's players, and the results of its open periods. A period is rated when a timer at its end fires."""

    def __init__(self, seconds: int, tau: float):
        self.seconds, self.tau = seconds, tau

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.players = handle.getMapState("players", "player string", _PLAYER)
        self.open = handle.getMapState("open", "period long, n long", _RESULT)
        self.next = handle.getValueState("next", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n = self.next.get()[0] if self.next.exists() else 0
        due = set()
        for batch in rows:
            for ts, *result in zip(batch["ts"], batch["game"], batch["side"], batch["player"], batch["score"], strict=True):
                period = int(pd.Timestamp(ts).timestamp() // self.seconds)
                end = (period + 1) * self.seconds * 1000
                if end <= timerValues.getCurrentWatermarkInMs():
                    continue  # too late: its period has been rated
                self.open.updateValue((period, n), (str(result[0]), int(result[1]), str(result[2]), float(result[3])))
                n += 1
                due.add(end)
        self.next.update((n,))
        for end in due - set(self.handle.listTimers()):
            self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        period = expiredTimerInfo.getExpiryTimeInMs() // (self.seconds * 1000) - 1
        mine = [(k, v) for k, v in self.open.iterator() if k[0] == period]
        results = pd.DataFrame([tuple(v) for _, v in mine], columns=["game", "side", "player", "score"])
        known = {k[0]: tuple(v) for k, v in self.players.iterator()}
        new = after_period(known, results, period, self.tau)
        for player, state in new.items():
            self.players.updateValue((player,), state)
        for k, _ in mine:
            self.open.removeKey(tuple(k))
        out = [(key[0], p, mu * glicko.SCALE + glicko.RATING, phi * glicko.SCALE, sigma, period) for p, (mu, phi, sigma, _) in new.items()]
        yield pd.DataFrame(out, columns=["league", "player", "rating", "deviation", "volatility", "period"])

    def close(self) -> None:
        pass


def live_ratings(stream: DataFrame, period: str = "7 days", late: str = "1 hour", tau: float = glicko.TAU) -> DataFrame:
    """league, player, rating, deviation, volatility and period of everybody who has played, once a period has ended.

    stream: league, ts, game, side (0 or 1), player, score. Periods are counted from 1970. Results that come after the
    watermark has passed the end of their period are left out; rows with nulls too. Leagues are rated apart, each by
    one task, as its players' ratings hang together; state is its players and the results of its open periods. Needs the
    RocksDB state store.
    """
    seconds = int(pd.Timedelta(period).total_seconds())
    columns = ["league", "ts", "game", "side", "player", "score"]
    rows = stream.select(F.col("league").cast("string").alias("league"), *columns[1:]).dropna().withWatermark("ts", late)
    return rows.groupBy("league").transformWithStateInPandas(Ratings(seconds, tau), RATED, "Append", "EventTime")
