"""Glicko-2: the published example, batch against stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from skirmish.operators import glicko
from skirmish.streaming import ratings as live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_the_published_example():
    """1500 (200) beats 1400 (30), and loses to 1550 (100) and 1700 (300)."""
    mu, phi, score = (np.array([1400, 1550, 1700]) - 1500) / glicko.SCALE, np.array([30, 100, 300]) / glicko.SCALE, np.array([1, 0, 0])
    g = glicko.damping(phi)
    e = 1 / (1 + np.exp(g * mu))
    found = glicko.rated(np.zeros(1), np.array([200 / glicko.SCALE]), np.array([0.06]), np.array([(g * g * e * (1 - e)).sum()]), np.array([(g * (score - e)).sum()]))
    assert found[0][0] * glicko.SCALE + 1500 == pytest.approx(1464.06, abs=0.02)
    assert found[1][0] * glicko.SCALE == pytest.approx(151.52, abs=0.01) and found[2][0] == pytest.approx(0.05999, abs=1e-5)


def test_volatility_of_upsets():
    """A series of upsets raises it; the slope is zero there."""
    phi, sigma, v, delta = np.array([1.1, 0.3, 2.0]), np.array([0.06, 0.06, 0.08]), np.array([1.8, 0.01, 0.5]), np.array([0.5, 3.0, -9.0])
    after = glicko.volatility(phi, sigma, v, delta)
    x = np.log(after**2)
    slope = np.exp(x) * (delta**2 - phi**2 - v - np.exp(x)) / (2 * (phi**2 + v + np.exp(x)) ** 2) - (x - np.log(sigma**2)) / glicko.TAU**2
    assert np.abs(slope).max() < 1e-5 and after[1] > 0.06 and after[2] > 0.08


def season():
    """(ts, game, side, player, score) of two weeks with games and an empty one between, in order."""
    rng, rows, start = random.Random(1), [], datetime(2024, 1, 4)  # weeks from 1970 begin on Thursdays
    strength = {f"p{k}": k for k in range(12)}
    for game in range(60):
        at = start + timedelta(days=(0 if game < 30 else 14), hours=2 * (game % 30))
        players = rng.sample(sorted(strength)[: 12 if game < 30 else 10], 8)
        sums = [sum(strength[p] for p in players[4 * s : 4 * s + 4]) + rng.randrange(-4, 5) for s in (0, 1)]
        for s in (0, 1):
            score = 1.0 if sums[s] > sums[1 - s] else 0.5 if sums[s] == sums[1 - s] else 0.0
            rows += [(at, f"g{game}", s, p, score) for p in players[4 * s : 4 * s + 4]]
    return rows


def batch(spark, rows):
    results = [(int((ts - datetime(1970, 1, 1)).total_seconds() // (7 * 86400)), *r) for ts, *r in rows]
    return spark.createDataFrame(results, "period long, game string, side int, player string, score double")


def test_batch_ratings(spark):
    rows = season()
    got = {r["player"]: r for r in glicko.glicko2(batch(spark, rows)).collect()}
    assert len(got) == 12 and got["p9"]["rating"] > 1560 > 1440 > got["p0"]["rating"]
    # two did not play in the last week: their deviation has grown over two weeks
    before = {r["player"]: r for r in glicko.glicko2(batch(spark, [r for r in rows if r[0] < datetime(2024, 1, 11)])).collect()}
    idle = next(p for p in got if got[p]["period"] != max(r["period"] for r in got.values()))
    assert got[idle]["rating"] == before[idle]["rating"]
    assert got[idle]["deviation"] ** 2 == pytest.approx(before[idle]["deviation"] ** 2 + 2 * (before[idle]["volatility"] * glicko.SCALE) ** 2)


def test_odd_results(spark):
    rows = batch(spark, season()[:16])
    odd = spark.createDataFrame([(2818, "alone", 0, "p0", 1.0), (2818, "g0", None, "x", 1.0), (None, "g0", 0, "x", 1.0)], rows.schema)
    same = lambda df: sorted(tuple(r) for r in glicko.glicko2(df).collect())
    want = same(rows)
    got = same(rows.union(rows).union(odd))
    assert [r[0] for r in got] == [r[0] for r in want] and np.allclose([r[1] for r in got], [r[1] for r in want])
    assert glicko.glicko2(rows.limit(0)).count() == 0


def test_the_stream_rates_like_the_batch(spark, tmp_path):
    rows = season()
    schema = "league string, ts timestamp, game string, side int, player string, score double"
    source = tmp_path / "in"
    source.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = live.live_ratings(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = out.writeStream.format("memory").queryName("rated").outputMode("append").start()
    try:
        late = [("a", datetime(2024, 1, 5), "late", s, f"p{s}", float(s)) for s in (0, 1)]
        end = [("a", datetime(2024, 3, 1), "end", 0, "p0", 1.0)]
        for part in ([("a", *r) for r in rows[:100]] + [("b", *r) for r in rows[:16]], [("a", *r) for r in rows[100:300]], late + [("a", *r) for r in rows[300:]], end):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
        got = {}
        for r in sorted(spark.table("rated").collect(), key=lambda r: r["period"]):
            got[r["league"], r["player"]] = r
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    for league, part in (("a", rows), ("b", rows[:16])):
        want = {r["player"]: r for r in glicko.glicko2(batch(spark, part)).collect()}
        assert {p for x, p in got if x == league} == set(want)
        for p, r in want.items():
            mine = got[league, p]
            assert mine["rating"] == pytest.approx(r["rating"], abs=1e-6) and mine["volatility"] == pytest.approx(r["volatility"], abs=1e-9) and mine["period"] == r["period"]
            if r["period"] == max(x["period"] for x in want.values()):
                assert mine["deviation"] == pytest.approx(r["deviation"], abs=1e-6)


def test_ridge(spark):
    """Line-ups of two and three, with and without a prior, against the normal equations."""
    from skirmish.operators import ratings

    rng, names = random.Random(4), [f"p{k}" for k in range(7)]
    rows = []
    for _ in range(80):
        players = rng.sample(names, 6)
        rows.append((players[:3], players[3:], rng.randrange(-40, 41)))
    rows += [rows[0], rows[0], (["p1", "p2"], ["p1", "p3"], 7), (None, ["p1"], 3), (["p1"], ["p2"], None), (["p4", None], ["p5"], 2)]
    games = spark.createDataFrame(rows, "side_a array<string>, side_b array<string>, diff int")
    x = np.zeros((len(rows), len(names)))
    y = np.array([0 if r[0] is None or r[2] is None else r[2] for r in rows], float)
    for k, (a, b, diff) in enumerate(rows):
        if a is not None and diff is not None:
            for side, s in ((a, 1), (b, -1)):
                for p in side:
                    if p:
                        x[k, names.index(p)] += s
    prior = {"p0": 5.0, "p3": -2.0}
    w0 = np.array([prior.get(n, 0.0) for n in names])
    for alpha, given in ((60.0, None), (90.0, spark.createDataFrame(list(prior.items()), "player string, strength double"))):
        base = w0 if given is not None else 0 * w0
        want = base + np.linalg.solve(x.T @ x + alpha * np.eye(len(names)), x.T @ (y - x @ base))
        got = {r["player"]: r["strength"] for r in ratings.ridge(games, alpha, given).collect()}
        assert [got[n] for n in names] == pytest.approx(want.tolist(), abs=1e-4)
    assert ratings.ridge(games.limit(0), 1.0).count() == 0
