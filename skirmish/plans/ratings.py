"""Registered queries of the rating operators, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skirmish.operators import glicko
from skirmish.plans.catalog import query
from skirmish.plans.standins import table

#: An order is a game of suppliers: its odd lines play the even ones, more units win; half a year is a period.
RESULTS = """l AS (SELECT l_orderkey AS game, (l_linenumber % 2)::INT AS side, l_suppkey::VARCHAR AS player, l_quantity AS units FROM lineitem),
u AS (SELECT game, side, sum(units) AS units FROM l GROUP BY ALL),
r AS (
  SELECT DISTINCT (year(o_orderdate) * 2 + (month(o_orderdate) > 6)::INT)::BIGINT AS period, l.game, l.side, player, CASE WHEN a.units > b.units THEN 1.0 WHEN a.units < b.units THEN 0.0 ELSE 0.5 END::DOUBLE AS score
  FROM l JOIN u a ON a.game = l.game AND a.side = l.side JOIN u b ON b.game = l.game AND b.side = 1 - l.side JOIN orders ON o_orderkey = l.game)"""


def results(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"), (F.col("l_linenumber") % 2).cast("int").alias("side"), F.col("l_suppkey").alias("player"), F.col("l_quantity").alias("units"))
    of = [F.sum(F.when(F.col("side") == k, F.col("units"))).over(Window.partitionBy("game")) for k in (0, 1)]
    units, theirs = F.when(F.col("side") == 0, of[0]).otherwise(of[1]), F.when(F.col("side") == 0, of[1]).otherwise(of[0])
    score = F.when(units > theirs, 1.0).when(units < theirs, 0.0).otherwise(0.5).alias("score")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("game"), (F.year("o_orderdate") * 2 + (F.month("o_orderdate") > 6).cast("int")).cast("long").alias("period"))
    return lines.select("game", "side", F.col("player").cast("string").alias("player"), score).join(orders, "game")


_SLOPE = "exp({0}) * (v * v * gain * gain - phi * phi - v - exp({0})) / (2 * (phi * phi + v + exp({0})) * (phi * phi + v + exp({0}))) - ({0} - ln(sigma * sigma)) / 0.25"


@query(f"""WITH RECURSIVE {RESULTS},
n AS (SELECT min(period) AS lo, max(period) AS hi FROM r),
s AS (
  SELECT lo - 1 AS period, player, 0.0::DOUBLE AS mu, (350 / 173.7178)::DOUBLE AS phi, 0.06::DOUBLE AS sigma, NULL::BIGINT AS last FROM (SELECT DISTINCT player FROM r), n
  UNION ALL (
  WITH o AS (SELECT s.*, r.game, r.side, r.score FROM s LEFT JOIN r ON r.period = s.period + 1 AND r.player = s.player WHERE s.period < (SELECT hi FROM n)),
  t AS (SELECT game, side, avg(mu) AS m, sqrt(sum(phi * phi)) / count(*) AS p FROM o WHERE game IS NOT NULL GROUP BY ALL),
  e AS (SELECT o.*, 1 / sqrt(1 + 3 * t.p * t.p / (pi() * pi())) AS g, 1 / (1 + exp(-(o.mu - t.m) / sqrt(1 + 3 * t.p * t.p / (pi() * pi())))) AS x FROM o LEFT JOIN t ON t.game = o.game AND t.side = 1 - o.side),
  q AS (SELECT period, player, mu, phi, sigma, last, count(game) AS games, 1 / sum(g * g * x * (1 - x)) AS v, sum(g * (score - x)) AS gain FROM e GROUP BY ALL),
  w AS (SELECT *, CASE WHEN games > 0 THEN exp(list_reduce(list_prepend([ln(sigma * sigma) - 5, ln(sigma * sigma) + 5], list_transform(range(60), lambda k: [0.0, 0.0])),
    lambda b, k: CASE WHEN {_SLOPE.format('((b[1] + b[2]) / 2)')} > 0 THEN [(b[1] + b[2]) / 2, b[2]] ELSE [b[1], (b[1] + b[2]) / 2] END)[1] / 2) END AS after FROM q)
  SELECT period + 1, player, CASE WHEN games > 0 THEN mu + gain / (1 / (phi * phi + after * after) + 1 / v) ELSE mu END,
    CASE WHEN games > 0 THEN 1 / sqrt(1 / (phi * phi + after * after) + 1 / v) WHEN last IS NULL THEN phi ELSE sqrt(phi * phi + sigma * sigma) END,
    CASE WHEN games > 0 THEN after ELSE sigma END, CASE WHEN games > 0 THEN period + 1 ELSE last END FROM w))
SELECT player, round(1500 + 173.7178 * mu, 2) AS rating, round(173.7178 * phi, 2) AS deviation, round(sigma, 4) AS volatility, last AS period FROM s WHERE period = (SELECT hi FROM n) AND last IS NOT NULL""")
def glicko_ratings(spark, d):
    """Glicko-2 ratings of suppliers after all half-years."""
    out = glicko.glicko2(results(spark, d))
    return out.select("player", F.round("rating", 2).alias("rating"), F.round("deviation", 2).alias("deviation"), F.round("volatility", 4).alias("volatility"), "period")
