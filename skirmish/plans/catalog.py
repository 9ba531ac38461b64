"""The registered queries of the match, chat, scheduling, interval and identity operators, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions import calendar as C
from skirmish.functions import strings as S
from skirmish.functions.numbers import buckets, half_up
from skirmish.operators import chat, identity, intervals, matches, profiles, schedule, search, sessions, upserts
from skirmish.plans.standins import AVAILABILITY, GAMES, MESSAGES, PLAYERS, availability, games, messages, players, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


SIDES = """sides AS (
  SELECT id, played_at, map, team_a AS team, team_b AS opponent, frags_a AS own, frags_b AS other FROM games
  UNION ALL SELECT id, played_at, map, team_b, team_a, frags_b, frags_a FROM games)"""
WLD = "count_if(own > other)::BIGINT AS wins, count_if(own < other)::BIGINT AS losses, count_if(own = other)::BIGINT AS draws"
OURS, THEIRS = ["t1", "t2"], ["t3", "t4", "t5"]
_IN = {k: "(" + ", ".join(f"'{t}'" for t in v) + ")" for k, v in (("ours", OURS), ("theirs", THEIRS))}
_WON = f"count_if((team_a IN {_IN['ours']} AND frags_a > frags_b) OR (team_b IN {_IN['ours']} AND frags_a < frags_b))::BIGINT AS wins, count_if((team_a IN {_IN['ours']} AND frags_a < frags_b) OR (team_b IN {_IN['ours']} AND frags_a > frags_b))::BIGINT AS losses"


@query(f"WITH {GAMES}, {SIDES} SELECT team, opponent, count(*)::BIGINT AS games, {WLD} FROM sides GROUP BY ALL")
def perspective_record(spark, d):
    """Record per team and opponent over both sides of each game."""
    return matches.opponent_record(games(spark, d))


@query(f"WITH {GAMES}, {SIDES} SELECT team, map, count(*)::BIGINT AS games, {WLD}, round(avg(own - other), 1) AS avg_diff, max(played_at) AS last_played FROM sides GROUP BY ALL")
def team_map_stats(spark, d):
    return matches.team_maps(games(spark, d))


@query(f"WITH {GAMES} SELECT CASE WHEN team_a IN {_IN['ours']} THEN team_b ELSE team_a END AS opponent, count(*)::BIGINT AS games, {_WON} FROM games WHERE team_a IN {_IN['ours']} OR team_b IN {_IN['ours']} GROUP BY 1")
def opponent_record_tags(spark, d):
    """Opponents of a tag list; a game between two of its tags counts as won and lost."""
    return matches.opponents(games(spark, d), OURS)


_MAPS = f"""(SELECT map, count(*)::BIGINT AS games, {_WON}, round(avg(CASE WHEN team_a IN {_IN['ours']} THEN frags_a - frags_b ELSE frags_b - frags_a END), 1) AS avg_diff
  FROM games WHERE (team_a IN {_IN['ours']} OR team_b IN {_IN['ours']}) AND (team_a IN {_IN['theirs']} OR team_b IN {_IN['theirs']}) GROUP BY map)"""


@query(f"WITH {GAMES} SELECT *, floor(100.0 * wins / games + 0.5)::INT AS win_rate FROM {_MAPS}")
def map_record_signed_diff(spark, d):
    return matches.maps(games(spark, d), OURS, THEIRS)


_SEEN = f"""seen AS (SELECT id, played_at, map, CASE WHEN team_a IN {_IN['ours']} THEN team_a ELSE team_b END AS team, CASE WHEN team_a IN {_IN['ours']} THEN team_b ELSE team_a END AS opponent,
  CASE WHEN team_a IN {_IN['ours']} THEN frags_a ELSE frags_b END AS own, CASE WHEN team_a IN {_IN['ours']} THEN frags_b ELSE frags_a END AS other FROM games"""
_RESULT = "CASE WHEN own > other THEN 'W' WHEN own < other THEN 'L' ELSE 'D' END AS result"


@query(f"WITH {GAMES}, {_SEEN} WHERE (team_a IN {_IN['ours']} AND team_b IN {_IN['theirs']}) OR (team_a IN {_IN['theirs']} AND team_b IN {_IN['ours']})) SELECT *, {_RESULT} FROM seen ORDER BY played_at DESC, id DESC LIMIT 10")
def h2h_recent(spark, d):
    """The ten latest games between two tag lists: the limit is the feature."""
    return matches.head_to_head(games(spark, d), OURS, THEIRS)


@query(f"WITH {GAMES}, {_SEEN} WHERE team_a IN {_IN['ours']} OR team_b IN {_IN['ours']}) SELECT *, {_RESULT} FROM seen WHERE map = 'R' ORDER BY played_at DESC, id DESC LIMIT 10")
def form_recent(spark, d):
    return matches.form(games(spark, d), OURS, "R")


_EFF = "CASE WHEN kills + deaths > 0 THEN 100.0 * kills / (kills + deaths) ELSE 0 END"


@query(f"""WITH {PLAYERS}, g AS (SELECT o_orderkey AS game_id, o_orderdate AS played_at FROM orders)
SELECT name, count(DISTINCT game_id)::BIGINT AS games, count_if(won)::BIGINT AS wins, round(avg({_EFF}), 1) AS avg_eff, round(avg(damage), 0) AS avg_damage, max(played_at) AS last_played
FROM players JOIN g USING (game_id) GROUP BY name""")
def roster_activity(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("played_at"))
    return matches.roster(orders, players(spark, d))


@query(f"""WITH {PLAYERS}, s AS (SELECT game_id, team, sum(kills)::BIGINT AS kills, sum(deaths)::BIGINT AS deaths, sum(damage) AS damage FROM players GROUP BY ALL)
SELECT game_id, team, kills, deaths, round(damage, 2) AS damage, round({_EFF}, 1) AS eff FROM s""")
def scoreboard_totals(spark, d):
    """Team rows of every match: ratios of sums, not means of ratios."""
    return matches.scoreboard(players(spark, d)).withColumn("damage", F.round("damage", 2))


@query(f"""WITH {GAMES}, a AS (SELECT map, count(*) AS g, count_if((team_a = 't1' AND frags_a > frags_b) OR (team_b = 't1' AND frags_a < frags_b)) AS w FROM games WHERE (team_a = 't1' OR team_b = 't1') AND map <> 'N' GROUP BY map),
b AS (SELECT map, count(*) AS g, count_if((team_a = 't2' AND frags_a > frags_b) OR (team_b = 't2' AND frags_a < frags_b)) AS w FROM games WHERE (team_a = 't2' OR team_b = 't2') AND map <> 'R' GROUP BY map),
m AS (SELECT map, coalesce(a.g, 0)::BIGINT AS games_1, coalesce(a.w, 0)::BIGINT AS wins_1, coalesce(b.g, 0)::BIGINT AS games_2, coalesce(b.w, 0)::BIGINT AS wins_2 FROM a FULL JOIN b USING (map)),
r AS (SELECT *, games_1 + games_2 AS games, CASE WHEN games_1 > 0 THEN floor(100.0 * wins_1 / games_1 + 0.5)::INT END AS rate_1, CASE WHEN games_2 > 0 THEN floor(100.0 * wins_2 / games_2 + 0.5)::INT END AS rate_2 FROM m)
SELECT *, CASE WHEN games_1 = 0 THEN 't2 plays, t1 doesn''t' WHEN games_2 = 0 THEN 't1 plays, t2 doesn''t' WHEN least(rate_1, rate_2) >= 60 THEN 'Both teams strong' WHEN rate_1 - rate_2 >= 30 THEN 't1 dominates' WHEN rate_1 - rate_2 <= -30 THEN 't2 dominates'
  WHEN rate_1 - rate_2 >= 15 THEN 't1 favors' WHEN rate_1 - rate_2 <= -15 THEN 't2 favors' WHEN greatest(rate_1, rate_2) < 40 THEN 'Neither team favors' ELSE 'Even' END AS note FROM r""")
def map_merge_full_outer(spark, d):
    g = games(spark, d)
    return matches.compare_maps(matches.maps(g.where("map <> 'N'"), ["t1"]), matches.maps(g.where("map <> 'R'"), ["t2"]), ("t1", "t2"))


@query(f"WITH {GAMES} SELECT map, count_if(duration > timelimit * 60 + 30)::BIGINT AS over, count_if(NOT duration > timelimit * 60 + 30)::BIGINT AS within FROM games GROUP BY map")
def overtime_games(spark, d):
    g = games(spark, d)
    both = matches.overtime(g).select("map", F.lit(1).alias("o")).union(matches.overtime(g, False).select("map", F.lit(0)))
    return both.groupBy("map").agg(F.count_if(F.col("o") == 1).alias("over"), F.count_if(F.col("o") == 0).alias("within"))


_AVG = f"averages AS (SELECT name, count(*)::BIGINT AS games, round(avg(kills), 6) AS kills, round(avg({_EFF}), 6) AS eff, round(avg(damage), 6) AS damage, round(avg(accuracy), 6) AS accuracy FROM players GROUP BY name HAVING count(*) >= 20)"


def _averages(spark, d):
    # damage has two decimals: a sum of doubles hangs on its order, which shows where a mean lies on the edge of two roundings
    measures = {"kills": F.col("kills"), "eff": matches.efficiency(F.col("kills"), F.col("deaths")), "damage": F.col("damage").cast("decimal(15,2)"), "accuracy": F.col("accuracy")}
    out = profiles.averages(players(spark, d), "name", measures, 20)
    return out.select("name", "games", *[F.round(m, 6).cast("double").alias(m) for m in measures])


@query(f"WITH {PLAYERS}, {_AVG} SELECT * FROM averages")
def season_averages_having(spark, d):
    """Means per player of twenty lines or more; accuracy only of lines of some volume."""
    return _averages(spark, d)


_POINTS = [10, 25, 50, 75, 90, 99]


@query(f"""WITH {PLAYERS}, {_AVG}, long AS (UNPIVOT (SELECT kills, eff, damage FROM averages) ON kills, eff, damage INTO NAME measure VALUE v),
l AS (SELECT measure, list_sort(list(v)) AS vs, count(*) AS n FROM long GROUP BY measure)
SELECT measure, point, vs[least((n * point // 100), n - 1) + 1] AS value FROM l, (SELECT unnest({_POINTS})::INT AS point)""")
def percentile_points(spark, d):
    return profiles.percentile_points(_averages(spark, d), ["kills", "eff", "damage"], _POINTS)


_RANK = "round(100.0 * cume_dist() OVER (ORDER BY {0}), 6)"


@query(f"WITH {PLAYERS}, {_AVG} SELECT name, {_RANK.format('kills')} AS kills_rank, {_RANK.format('eff')} AS eff_rank FROM averages")
def percentile_rank(spark, d):
    return profiles.percentile_ranks(_averages(spark, d), ["kills", "eff"], "name").select("name", *[F.round(f"{m}_rank", 6).alias(f"{m}_rank") for m in ("kills", "eff")])


@query(f"""WITH {PLAYERS}, {_AVG}, r AS (SELECT name, 100.0 * cume_dist() OVER (ORDER BY kills) AS k, 100.0 * cume_dist() OVER (ORDER BY eff) AS e, 100.0 * cume_dist() OVER (ORDER BY damage) AS m FROM averages),
s AS (SELECT name, floor((0.0 + k * 0.5 + e * 0.3 + (100 - m) * 0.2) * 10 + 0.5) / 10 AS rating FROM r)
SELECT name, rating, row_number() OVER (ORDER BY rating DESC, name)::BIGINT AS place FROM s""")
def composite_rating(spark, d):
    return profiles.composite(_averages(spark, d), {"kills": 0.5, "eff": 0.3}, {"damage": 0.2}, "name").select("name", "rating", "place")


@query(f"""WITH {PLAYERS}, {_AVG}, r AS (SELECT name, 100.0 * cume_dist() OVER (ORDER BY kills) AS k, 100.0 * cume_dist() OVER (ORDER BY accuracy) AS a FROM averages)
SELECT name, round(k, 6) AS kills_rank FROM r WHERE k >= 75 AND a <= 35 ORDER BY k DESC, name LIMIT 5""")
def archetypes(spark, d):
    """The five (the feature) best by kills among those of low accuracy."""
    return profiles.archetype(_averages(spark, d), ["kills"], ["accuracy"], "name").select("name", F.round("kills_rank", 6).alias("kills_rank"))


_PAIRS = [("kills", "eff"), ("kills", "damage"), ("kills", "accuracy"), ("eff", "damage"), ("eff", "accuracy"), ("damage", "accuracy")]


@query(f"WITH {PLAYERS}, {_AVG} " + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, count(*)::BIGINT AS n, round(corr({x}, {y}), 6) AS r FROM averages WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in _PAIRS))
def correlation_matrix(spark, d):
    return profiles.correlations(_averages(spark, d), ["kills", "eff", "damage", "accuracy"]).withColumn("r", F.round("r", 6))


@query(f"""WITH {PLAYERS}, {_AVG}, p AS (SELECT *, row_number() OVER (ORDER BY kills, name) - 1 AS p, count(*) OVER () AS c FROM averages)
SELECT (1 + (p >= c // 4)::INT + (p >= c // 2)::INT + (p >= c * 3 // 4)::INT)::INT AS quartile, count(*)::BIGINT AS n, round(avg(eff), 6) AS eff, round(avg(coalesce(accuracy, 0)), 6) AS accuracy FROM p GROUP BY 1""")
def quartile_means(spark, d):
    out = profiles.quartile_means(_averages(spark, d), "kills", ["eff", "accuracy"], "name")
    return out.select("quartile", "n", F.round("eff", 6).alias("eff"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {GAMES} SELECT map, id, frags_a, place FROM (SELECT *, row_number() OVER (PARTITION BY map ORDER BY frags_a DESC, id)::BIGINT AS place FROM games) WHERE place <= 10")
def top_n_per_group(spark, d):
    return profiles.top_per_group(games(spark, d), ["map"], [F.desc("frags_a"), F.col("id")], 10).select("map", "id", "frags_a", "place")


@query(f"""WITH {PLAYERS}, w AS (SELECT game_id, name, kills, avg(kills) OVER (PARTITION BY map) AS m, stddev_pop(kills) OVER (PARTITION BY map) AS s, map FROM players)
SELECT map, round(sum(abs(kills - m)), 2) AS off, round(max((kills - m) / s), 6) AS best_z, count(*)::BIGINT AS n FROM w GROUP BY map""")
def map_residuals_z(spark, d):
    rows = profiles.residuals(players(spark, d), "kills", "map")
    return rows.groupBy("map").agg(F.round(F.sum(F.abs("residual")), 2).alias("off"), F.round(F.max("z"), 6).alias("best_z"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT CASE WHEN n < 5 THEN 'few' WHEN n < 15 THEN 'some' ELSE 'many' END AS bucket, count(*)::BIGINT AS customers, sum(n)::BIGINT AS orders, min(n)::BIGINT AS least FROM c GROUP BY 1""")
def nested_histogram(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.groupBy(buckets(F.col("n"), [(5, "few"), (15, "some")], "many").alias("bucket")).agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.min("n").alias("least"))


@query("""SELECT count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS customers, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean,
  count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS done, count_if(o_orderpriority LIKE '1%')::BIGINT AS urgent FROM orders""")
def filtered_counts(spark, d):
    return table(spark, d, "orders").agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.avg("o_totalprice"), 4).alias("mean"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"),
    )


GAP = 12 * 3600
_SESSIONS = f"""m AS (SELECT *, CASE WHEN event_type <> 'error' THEN epoch_us(ts) / 1e6 END AS own FROM messages),
b AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
n AS (SELECT *, sum(CASE WHEN own IS NOT NULL AND (before IS NULL OR own - before > {GAP}) THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k, count(own) OVER (PARTITION BY channel) AS voiced FROM b),
s AS (SELECT *, CASE WHEN voiced > 0 THEN greatest(k, 1)::BIGINT END AS session FROM n),
t AS (SELECT channel, session, min(ts) FILTER (event_type <> 'error') AS started_at, max(ts) FILTER (event_type <> 'error') AS ended_at, count(*)::BIGINT AS messages,
  count_if(event_type IN ('view', 'click'))::BIGINT AS chat_messages FROM s WHERE session IS NOT NULL GROUP BY ALL)"""


def _rides():
    return F.col("event_type") == "error"


def _sessions(spark, d):
    return sessions.gap_sessions(messages(spark, d), ["channel"], "ts", GAP, _rides(), "event_id")


def _session_table(spark, d):
    return sessions.session_table(_sessions(spark, d), ["channel"], "ts", _rides(), F.col("event_type").isin("view", "click"), "event_type").drop("participants")


@query(f"WITH {MESSAGES}, {_SESSIONS} SELECT event_id, session FROM s")
def gap_sessions_events(spark, d):
    """Sessions of twelve hours' silence; error events ride along."""
    return _sessions(spark, d).select("event_id", "session")


@query(f"WITH {MESSAGES}, {_SESSIONS} SELECT * FROM t")
def session_stats(spark, d):
    return _session_table(spark, d)


@query(f"WITH {MESSAGES}, {_SESSIONS} SELECT CASE WHEN messages < 2 THEN 'single' WHEN messages < 5 THEN 'short' ELSE 'long' END AS size, count(*)::BIGINT AS sessions, sum(messages)::BIGINT AS messages FROM t GROUP BY 1")
def session_size_buckets(spark, d):
    return _session_table(spark, d).groupBy(buckets(F.col("messages"), [(2, "single"), (5, "short")], "long").alias("size")).agg(F.count("*").alias("sessions"), F.sum("messages").alias("messages"))


@query("""WITH g AS (SELECT event_id, user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, (1 + sum(CASE WHEN gap >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS part FROM g""")
def gap_groups_inclusive(spark, d):
    return sessions.gap_groups(table(spark, d, "events"), ["user_id"], "ts", 7200, True, "event_id").select("event_id", "part")


@query("""SELECT ts::DATE::VARCHAR AS day, count_if(event_type = 'click')::BIGINT AS click, count_if(event_type = 'view')::BIGINT AS view, count_if(event_type = 'purchase')::BIGINT AS purchase FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1""")
def events_by_day_pivot(spark, d):
    rows = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    return rows.groupBy(F.to_date("ts").cast("string").alias("day")).pivot("event_type", ["click", "view", "purchase"]).count().na.fill(0)


@query("SELECT event_type, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def share_of_total(spark, d):
    from pyspark.sql import Window as W

    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("""WITH w AS (SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1),
e AS (SELECT unnest(generate_series((SELECT min(week) FROM w)::TIMESTAMP, (SELECT max(week) FROM w)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS week)
SELECT week::VARCHAR AS week, coalesce(n, 0)::BIGINT AS n FROM e LEFT JOIN w USING (week)""")
def weekly_activity_filled(spark, d):
    return sessions.weekly_series(table(spark, d, "events").where("event_type = 'signup'"), "ts").withColumn("week", F.col("week").cast("string"))


@query("""SELECT printf('%04d-%02d', isoyear(ts), weekofyear(ts)) AS week, count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT user_id % 8)::BIGINT AS teams,
  count_if(event_type = 'view')::BIGINT AS proposals, count_if(event_type = 'purchase')::BIGINT AS matches FROM events GROUP BY 1""")
def engagement_weekly(spark, d):
    kind = F.when(F.col("event_type") == "view", "proposal").when(F.col("event_type") == "purchase", "match")
    rows = table(spark, d, "events").select("ts", F.col("user_id").alias("user"), (F.col("user_id") % 8).alias("team"), kind.alias("kind"))
    return schedule.engagement(rows, C.week_id(F.col("ts")))


@query("""SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day, isoyear(o_orderdate)::INT AS year, weekofyear(o_orderdate)::INT AS week, date_trunc('week', o_orderdate)::DATE::VARCHAR AS monday,
  (date_trunc('week', o_orderdate)::DATE + INTERVAL 6 DAY)::DATE::VARCHAR AS sunday FROM orders""")
def iso_week_parts(spark, d):
    ts, week = F.col("o_orderdate"), C.week_id(F.col("o_orderdate"))
    return table(spark, d, "orders").select(F.to_date(ts).cast("string").alias("day"), C.iso_year(ts).alias("year"), F.weekofyear(ts).alias("week"), C.monday_of_week(week).cast("string").alias("monday"), F.to_date(C.week_expiry(week)).cast("string").alias("sunday")).distinct()


@query("""SELECT event_id, list_extract(['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'], isodow(ts)) || printf('_%02d%02d', hour(ts), minute(ts) // 30 * 30) AS slot,
  (((isodow(ts) - 1) * 48 + hour(ts) * 2 + minute(ts) // 30 + 2) % 336)::INT AS cet FROM events""")
def slot_from_ts(spark, d):
    slot = C.slot_id(C.slot_number(F.col("ts")))
    return table(spark, d, "events").select("event_id", slot.alias("slot"), C.shifted(C.slot_number_of(slot), 1).alias("cet"))


@query("SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day, ((date_trunc('month', o_orderdate) - INTERVAL 3 MONTH)::DATE + (day(o_orderdate) - 1)::INT)::DATE::VARCHAR AS cutoff FROM orders")
def month_lookback(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("day"), C.months_before(F.col("o_orderdate"), 3).cast("string").alias("cutoff")).distinct()


@query("SELECT event_id, floor(value - 100.5 + 0.5)::BIGINT AS rounded, floor(value * 1000 + 0.5) / 1000 AS to_three FROM events")
def rounding(spark, d):
    return table(spark, d, "events").select("event_id", half_up(F.col("value") - 100.5).alias("rounded"), half_up(F.col("value"), 3).alias("to_three"))


#: Fixed lines that play what some conversations say, so that each rule of the classifier meets rows.
LINES = [
    "!help me", ".stats", "Learn this", "TTOP10 dm3", "", "gg", "GG", ":)", "lol", "lolol", "+1", "???", "\U0001f44d\U0001f3fd", "\U0001f44d\U0001f44d\U0001f44d",
    "https://a.example/b", "https://a.example/b https://c.example", "see https://a.example", "my luck is out", "xd",
]
_LINES = "[" + ", ".join(f"'{x}'" for x in LINES) + "]"


@query(f"""WITH t AS (SELECT conv_id, turn, role, trim(CASE WHEN conv_id % 20 < {len(LINES)} THEN list_extract({_LINES}, (conv_id % 20 + 1)::INT) ELSE coalesce(text, '') END) AS text, turn % 2 = 1 AS files, conv_id % 7 = 3 AS bot FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'system' WHEN bot THEN 'bot' WHEN text = '' THEN CASE WHEN files THEN 'link' ELSE 'reaction' END
  WHEN regexp_matches(text, '^[!.][A-Za-z0-9_]') OR regexp_matches(lower(text), '^(my luck|fishbot |learn |forget |suka|logan|ttop10|!ttop10|!top10)') THEN 'bot'
  WHEN text IN (':)', 'gg', 'lol', '+1', 'xd', '\U0001f44d\U0001f3fd') THEN 'reaction' WHEN regexp_matches(text, '^https?://[^ ]+$') THEN 'link' ELSE 'chat' END AS class FROM t""")
def classify_messages(spark, d):
    said = F.when(F.col("conv_id") % 20 < len(LINES), F.get(F.array(*map(F.lit, LINES)), (F.col("conv_id") % 20).cast("int"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", chat.message_class(said, F.col("role") == "system", F.col("conv_id") % 7 == 3, F.col("turn") % 2 == 1).alias("class"))


@query("SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role)) AS document FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def conversation_documents(spark, d):
    docs = search.conversation_documents(table(spark, d, "conversations"), "conv_id", ["turn"], "role", "text")
    return docs.select("conv_id", F.sha2("document", 256).alias("document"))


_POSTINGS = r"""t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)"""
TERMS = ["the", "of", "and"]
_TERMS = "('the', 'of', 'and')"


def _index(spark, d):
    return search.postings(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_POSTINGS} SELECT doc_id, sum(tf)::BIGINT AS hits FROM p WHERE term IN {_TERMS} GROUP BY 1 HAVING count(*) = 3")
def fts_match(spark, d):
    return search.match_all(table(spark, d, "documents"), "doc_id", "text", TERMS)


@query(f"""WITH {_POSTINGS}, l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY 1), c AS (SELECT count(*) AS n, avg(len) AS mean FROM l), h AS (SELECT * FROM p WHERE term IN {_TERMS}),
df AS (SELECT term, count(*) AS df FROM h GROUP BY 1), e AS (SELECT doc_id FROM h GROUP BY 1 HAVING count(*) = 3)
SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score
FROM h JOIN e USING (doc_id) JOIN df USING (term) JOIN l USING (doc_id), c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def bm25_topk(spark, d):
    """The ten best documents, the feature of a ranked search."""
    return search.bm25_scan(table(spark, d, "documents"), "doc_id", "text", TERMS).withColumn("score", F.round("score", 9))


@query("SELECT page_id // 3 AS session, count(*)::BIGINT AS rows FROM pages WHERE page_id // 3 IN (SELECT page_id // 3 FROM pages WHERE contains(url, '?')) GROUP BY 1")
def question_sessions(spark, d):
    """Three pages play a session, their URLs what is said."""
    rows = table(spark, d, "pages").select(F.floor(F.col("page_id") / 3).alias("session"), "url")
    return chat.with_questions(rows, "session", "url").groupBy("session").agg(F.count("*").alias("rows"))


@query("""WITH t AS (SELECT role, length(text) / 15.0 AS s, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM conversations)
SELECT role, count(*)::BIGINT AS segments, round(sum(s), 4) AS seconds, sum(w)::BIGINT AS words, round(avg(s), 6) AS mean_seconds, CASE WHEN sum(s) > 0 THEN round(60.0 * sum(w) / sum(s), 1) ELSE 0 END AS words_per_minute FROM t GROUP BY 1""")
def talk_stats(spark, d):
    out = chat.talk_statistics(table(spark, d, "conversations"), ["role"], "text", F.length("text") / 15.0)
    return out.withColumns({"seconds": F.round("seconds", 4), "mean_seconds": F.round("mean_seconds", 6)})


@query("""SELECT c_custkey, regexp_replace(lower(regexp_replace(regexp_replace(c_name, '^[^a-zA-Z0-9]+', ''), '[^a-zA-Z0-9]+$', '')), 'x', 'x') AS edge, trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g')) AS norm,
  translate(lower(c_name), '013457$', 'oieasts') AS letters FROM customer""")
def normalize_names(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", S.edge_trim(name).alias("edge"), S.normalize_name(name).alias("norm"), S.leet_to_letters(F.lower(name)).alias("letters"))


@query("SELECT l_suppkey_a AS a, l_suppkey_b AS b, count(*)::BIGINT AS together FROM (SELECT DISTINCT x.l_orderkey, x.l_suppkey AS l_suppkey_a, y.l_suppkey AS l_suppkey_b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey) GROUP BY ALL")
def cooccurrence_pairs(spark, d):
    return identity.cooccurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


_PARTS = "n AS (SELECT DISTINCT p_name AS a, left(p_name, 4) AS k FROM part)"


@query(f"WITH {_PARTS} SELECT x.a, y.a AS b FROM n x JOIN n y ON x.k = y.k AND x.a < y.a")
def prefix_blocked_pairs(spark, d):
    return identity.blocked_pairs(table(spark, d, "part"), "p_name", 4)


@query(f"WITH {_PARTS} SELECT x.a, y.a AS b FROM n x JOIN n y ON x.k = y.k AND x.a < y.a WHERE jaro_winkler_similarity(x.a, y.a) >= 0.88")
def jaro_winkler_pairs(spark, d):
    return identity.similar_names(table(spark, d, "part"), "p_name", 0.88, 4).select("a", "b")


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS cosine FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id")
def cosine_fingerprint(spark, d):
    """Cosines within a label, the blocking key."""
    return identity.cosines_within(table(spark, d, "embeddings"), "vec_id", "embedding", "label", digits=5)


_SPANS = "s AS (SELECT user_id AS u, event_id, epoch(ts)::DOUBLE AS s, epoch(ts) + value AS e FROM events)"


@query(f"WITH {_SPANS} SELECT x.u AS first, y.u AS second, greatest(x.s, y.s) AS start, least(x.e, y.e) AS \"end\" FROM s x JOIN s y ON x.u <> y.u AND (x.s < y.s OR (x.s = y.s AND x.u < y.u)) AND least(x.e, y.e) - greatest(x.s, y.s) > 0.1")
def interval_overlap(spark, d):
    """Events of different users that overlap, each lasting value seconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, d, "events").select("user_id", at.alias("s"), (at + F.col("value")).alias("e"))
    return intervals.overlaps(rows, "user_id", "s", "e", 0.1, 120.0)


@query(f"""WITH {_SPANS}, g AS (SELECT u, max(e) OVER (PARTITION BY u ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS f, lead(s) OVER (PARTITION BY u ORDER BY s, e) AS t FROM s)
SELECT u AS user_id, 'between' AS kind, f AS gap_start, t AS gap_end FROM g WHERE t - f >= 86400""")
def interval_gaps(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, d, "events").select("user_id", at.alias("s"), (at + F.col("value")).alias("e"))
    return intervals.gaps(rows, ["user_id"], "s", "e", 86400)


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderkey = o.o_orderkey AND t.o_orderkey % 2 = 0)")
def anti_join_new(spark, d):
    """The incoming third of the keys that the table of even keys lacks."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return upserts.new_rows(rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 2 = 0"), ["o_orderkey"], ["o_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upsert_ignore(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey")
    return upserts.insert_or_ignore(rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 2 = 0"), ["o_orderkey"], ["o_orderkey"])


@query(f"""WITH {AVAILABILITY}, a AS (SELECT week, slot, count(DISTINCT user) AS ours FROM availability WHERE team = 't1' GROUP BY ALL), b AS (SELECT week, slot, count(DISTINCT user) AS theirs FROM availability WHERE team = 't2' GROUP BY ALL),
bl AS (SELECT DISTINCT week, slot + x AS slot FROM availability, (SELECT unnest([-1, 0, 1]) AS x) WHERE team = 't3' AND user = 3 AND slot + x BETWEEN 0 AND 335)
SELECT week, slot, coalesce(ours, 0)::BIGINT AS ours, coalesce(theirs, 0)::BIGINT AS theirs FROM a FULL JOIN b USING (week, slot)
WHERE least(4, coalesce(ours, 0) + 1) >= 2 AND coalesce(theirs, 0) >= 1 AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.week = coalesce(a.week, b.week) AND bl.slot = coalesce(a.slot, b.slot))""")
def slot_matching(spark, d):
    """Slots that two teams share, with a stand-in, where neither has a match; the free slots of a user play the booked ones."""
    free = availability(spark, d)
    booked = free.where("user = 3").select("week", "slot").distinct().select("week", "slot", F.lit("t1").alias("team_a"), F.lit("t2").alias("team_b"))
    return schedule.viable_slots(free, F.lit("t1"), F.lit("t2"), schedule.blocked(booked), 2, 1, standin=True)


@query(f"WITH {AVAILABILITY} SELECT week, user, min(team) AS team, array_to_string(list_sort(list(DISTINCT slot)), ',') AS slots FROM availability WHERE slot IN (84, 96, 108) GROUP BY ALL")
def community_any_slot(spark, d):
    return schedule.free_users(availability(spark, d), [84, 96, 108]).withColumn("slots", F.array_join(F.transform("slots", lambda s: s.cast("string")), ","))


@query(f"WITH {AVAILABILITY}, h AS (SELECT week, slot, count(DISTINCT (team, user)) AS users FROM availability GROUP BY ALL) SELECT week, slot, users::BIGINT AS users, round(0.2 + 0.8 * users / max(users) OVER (PARTITION BY week), 6) AS intensity FROM h")
def community_heat(spark, d):
    return schedule.heat(availability(spark, d)).withColumn("intensity", F.round("intensity", 6))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 60)
SELECT user_id, 'added' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT user_id, 'removed' FROM (FROM a EXCEPT FROM b)""")
def set_ops(spark, d):
    events = table(spark, d, "events")
    old, new = events.where("event_type = 'purchase'").select("user_id").distinct(), events.where("event_type = 'signup' AND value > 60").select("user_id").distinct()
    return upserts.differences(old, new)


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN r_regionkey < 2 THEN n_name END, r_name, 'unknown') AS resolved
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def resolution_cascade(spark, d):
    """A customer's name by the first source that knows it."""
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    df = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return df.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.when(F.col("r_regionkey") < 2, F.col("n_name")), "r_name", F.lit("unknown")).alias("resolved"))


@query("SELECT event_id, coalesce((props::JSON->>'k')::BIGINT, 0) AS k, coalesce(props::JSON->>'missing', '') AS missing FROM events")
def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("")).alias("missing"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, d):
    return upserts.keep_first(table(spark, d, "documents"), ["text"], ["doc_id"]).select("doc_id", "source")


@query("""WITH RECURSIVE p AS (SELECT a, b FROM (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(DISTINCT x.l_orderkey) AS n FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey WHERE x.l_quantity > 45 AND y.l_quantity > 45 GROUP BY ALL) WHERE n >= 1),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS id, a AS y FROM e UNION SELECT id, b FROM r JOIN e ON y = a)
SELECT id, min(y) AS label FROM r GROUP BY id""")
def player_components(spark, d):
    """Players connected by matches in which both did well."""
    strong = table(spark, d, "lineitem").where("l_quantity > 45")
    return identity.components(identity.cooccurrence(strong, "l_orderkey", "l_suppkey"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL UNION ALL SELECT l_returnflag, NULL, count(*)::BIGINT, round(sum(l_extendedprice * (1 - l_discount)), 2) FROM lineitem GROUP BY 1")
def totals_with_subtotals(spark, d):
    rows = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return rows.where("l_returnflag IS NOT NULL")
