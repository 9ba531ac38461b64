"""Registered queries of recordings' counts, filtered histories and lists in order, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.operators import history
from skirmish.operators.matches import both_sides
from skirmish.plans.catalog import SIDES, query
from skirmish.plans.standins import GAMES, games, table


@query("""WITH s AS (SELECT 't' || (o_custkey % 20) AS team, count(*) AS sessions FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 20 <> 7 GROUP BY 1),
r AS (SELECT 't' || (l_suppkey % 30) AS team, count(DISTINCT CASE WHEN l_linenumber < 4 THEN l_orderkey END) AS uploaded, count(*) AS maps FROM lineitem WHERE l_suppkey % 30 <> 3 GROUP BY 1)
SELECT team, coalesce(sessions, 0)::BIGINT AS sessions, coalesce(uploaded, 0)::BIGINT AS uploaded, coalesce(maps, 0)::BIGINT AS maps FROM s FULL JOIN r USING (team)""")
def recording_counts(spark, d):
    """Orders are sessions of twenty teams, one without; their lines recordings of thirty, one without, some of no session."""
    team = lambda c, n, none: F.when(F.col(c) % n != none, F.concat(F.lit("t"), F.col(c) % n)).alias("team")
    sessions = table(spark, d, "orders").select(team("o_custkey", 20, 7), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("recording").alias("status"))
    recordings = table(spark, d, "lineitem").select(team("l_suppkey", 30, 3), F.when(F.col("l_linenumber") < 4, F.col("l_orderkey")).alias("session"))
    return history.recording_counts(sessions, recordings)


@query(f"WITH {GAMES}, {SIDES} SELECT id, played_at, own, other FROM sides WHERE team = 't1' AND map = 'R' AND opponent = 't4' AND id IN (SELECT o_orderkey * 10 + 1 FROM orders WHERE o_orderstatus = 'F')")
def history_filtered(spark, d):
    """A team's recorded games on a map against an opponent; the first lines of finished orders are recorded."""
    recorded = table(spark, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 10 + 1).alias("id"))
    return history.filtered(both_sides(games(spark, d)).where("team = 't1'"), "R", "t4", recorded).select("id", "played_at", "own", "other")


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, word, min(i) AS i FROM w GROUP BY ALL) SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS words FROM f GROUP BY 1""")
def first_words_in_order(spark, d):
    """Words without repeats, in the order of their first places."""
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.sha2(F.array_join(F.array_distinct(F.split("text", " ")), " "), 256).alias("words"))
