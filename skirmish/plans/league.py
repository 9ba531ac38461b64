"""More registered queries, of games, names, history, pairing, proposals, calendar, text and interval operators, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions import calendar as C
from skirmish.functions import names as N
from skirmish.functions import numbers as M
from skirmish.functions import strings as S
from skirmish.operators import chat, history, identity, intervals, matches, pairing, profiles, proposals, schedule, search, sessions, upserts, validity
from skirmish.plans.catalog import _SESSIONS, GAP, SIDES, _averages, _AVG, _index, _session_table, _sessions, query
from skirmish.plans.standins import AVAILABILITY, GAMES, MESSAGES, PLAYERS, availability, games, messages, players, table

# ---- games and tags ------------------------------------------------------------------------------------------------

#: Tags that some of the twenty teams go by, so that each kind of tag occurs.
TAGS = {"t3": "red", "t4": "FuMix", "t5": "mix", "t6": " Blue ", "t7": ""}
_TAG = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + f" ELSE {c} END"
_GENERIC = "(" + ", ".join(f"'{t}'" for t in validity.GENERIC_TAGS) + ")"
TAGGED = f"""{GAMES}, tagged AS (SELECT * REPLACE ({_TAG('team_a')} AS team_a, {_TAG('team_b')} AS team_b) FROM games),
flagged AS (SELECT *, lower(team_a) NOT IN {_GENERIC} AND lower(team_b) NOT IN {_GENERIC} AS is_clan FROM tagged)"""
_SIDES = SIDES.replace("SELECT id,", "SELECT is_clan, id,").replace("FROM games", "FROM flagged")


def _tagged(spark, d):
    rows = games(spark, d)
    for c in ("team_a", "team_b"):
        new = F.col(c)
        for k, v in TAGS.items():
            new = F.when(F.col(c) == k, v).otherwise(new)
        rows = rows.withColumn(c, new)
    return rows.withColumn("is_clan", validity.is_clan_game(F.lower("team_a"), F.lower("team_b")))


_WLD = "count(*)::BIGINT AS games, count_if(own > other)::BIGINT AS wins, count_if(own < other)::BIGINT AS losses, count_if(own = other)::BIGINT AS draws, round(100.0 * count_if(own > other) / count(*), 1) AS win_pct, round(avg(own - other), 1) + 0.0 AS avg_diff"


@query(f"WITH {TAGGED}, {_SIDES} SELECT team, map, is_clan, {_WLD}, round(avg(own), 0) AS avg_frags, round(avg(other), 0) AS avg_other, max(played_at) AS last_played FROM sides GROUP BY ALL")
def view_team_map_stats(spark, d):
    """Record per team, map and clan flag."""
    return matches.team_map_stats(_tagged(spark, d))


@query(f"WITH {TAGGED}, {_SIDES} SELECT team, opponent, is_clan, {_WLD}, min(played_at) AS first_played, max(played_at) AS last_played FROM sides GROUP BY ALL")
def view_opponent_record(spark, d):
    return matches.opponent_stats(_tagged(spark, d))


_ROSTER = f"""g AS (SELECT o_orderkey AS game_id, o_orderdate AS played_at, o_orderstatus = 'F' AS is_clan FROM orders),
roster AS (SELECT team, is_clan, name, count(*)::BIGINT AS games, count_if(won)::BIGINT AS wins, round(100.0 * count_if(won) / count(*), 1) AS win_pct, round(avg(CASE WHEN kills + deaths > 0 THEN 100.0 * kills / (kills + deaths) ELSE 0 END), 1) AS avg_eff,
  round(avg(damage), 0) AS avg_damage, round(avg(kills), 1) AS avg_kills, round(avg(deaths), 1) AS avg_deaths, round(avg(accuracy), 1) AS avg_accuracy, min(played_at) AS first_game, max(played_at) AS last_game FROM players JOIN g USING (game_id) GROUP BY ALL)"""


def _roster(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("played_at"), (F.col("o_orderstatus") == "F").alias("is_clan"))
    return matches.roster_stats(players(spark, d), own)


@query(f"WITH {PLAYERS}, {_ROSTER} SELECT * FROM roster")
def view_roster_stats(spark, d):
    return _roster(spark, d)


@query(f"WITH {PLAYERS}, {_ROSTER} SELECT team, sum(games)::BIGINT AS games, round(sum(avg_eff * games) / nullif(sum(games), 0), 6) AS avg_eff, round(sum(avg_damage * games) / nullif(sum(games), 0), 4) AS avg_damage FROM roster GROUP BY team")
def weighted_team_means(spark, d):
    """Means of the players' means, weighted by games."""
    out = matches.weighted_means(_roster(spark, d), ["team"], "games", ["avg_eff", "avg_damage"])
    return out.withColumns({"avg_eff": F.round("avg_eff", 6), "avg_damage": F.round("avg_damage", 4)})


@query(f"""WITH {TAGGED}, s AS (SELECT 'a' AS side, team_a AS team, count(*) AS g, count_if(frags_a > frags_b) AS w, round(avg(frags_a), 0) AS f, round(avg(frags_a - frags_b), 0) AS x FROM flagged WHERE is_clan GROUP BY 2 HAVING count(*) >= 3
UNION ALL SELECT 'b', team_b, count(*), count_if(frags_b > frags_a), round(avg(frags_b), 0), round(avg(frags_b - frags_a), 0) FROM flagged WHERE is_clan GROUP BY 2 HAVING count(*) >= 3)
SELECT team, sum(g)::BIGINT AS games, sum(w)::BIGINT AS wins, floor(100.0 * sum(w) / sum(g) + 0.5)::INT AS win_pct, floor(sum(f * g) / sum(g) + 0.5)::INT AS avg_frags, floor(sum(x * g) / sum(g) + 0.5)::INT AS avg_diff FROM s GROUP BY team""")
def top_clans(spark, d):
    """Clan games of each team, from rounded means of either side."""
    return matches.top_teams(_tagged(spark, d).where("is_clan"))


@query(f"WITH {TAGGED} SELECT tag, count(*)::BIGINT AS games FROM (SELECT trim(lower(team_a)) AS tag FROM tagged UNION ALL SELECT trim(lower(team_b)) FROM tagged) GROUP BY 1")
def tag_frequency(spark, d):
    return matches.tag_counts(_tagged(spark, d), lambda c: S.normalize_name(c))


@query(f"WITH {TAGGED}, f AS (SELECT 'team_a' AS place, CASE WHEN id % 2 = 0 THEN upper(team_a) ELSE team_a END AS form FROM tagged UNION ALL SELECT 'team_b', team_b FROM tagged) SELECT lower(form) AS tag, form, place, count(*)::BIGINT AS n FROM f GROUP BY ALL")
def tag_case_audit(spark, d):
    """Every other first tag is written in capitals."""
    rows = _tagged(spark, d).withColumn("team_a", F.when(F.col("id") % 2 == 0, F.upper("team_a")).otherwise(F.col("team_a")))
    return matches.tag_forms(rows, ["team_a", "team_b"])


_MIXED = "(" + ", ".join(f"'{t}'" for t in validity.MIXED_TAGS) + ")"
_CLASS = lambda c: f"CASE WHEN trim(lower({c})) IN {_MIXED} THEN 'generic' WHEN contains(lower({c}), 'mix') THEN 'mix-ish' ELSE 'clan' END"


@query(f"""WITH {TAGGED}, k AS (SELECT {_CLASS('team_a')} AS a, {_CLASS('team_b')} AS b FROM tagged)
SELECT CASE WHEN a = 'clan' AND b = 'clan' THEN 'clan_vs_clan' WHEN a = 'generic' AND b = 'generic' THEN 'pure_mix' ELSE 'hybrid' END AS kind, a, b, count(*)::BIGINT AS games FROM k GROUP BY ALL""")
def game_classes(spark, d):
    rows = _tagged(spark, d).select(validity.game_class(F.col("team_a"), F.col("team_b")).alias("kind"), validity.tag_class(F.col("team_a")).alias("a"), validity.tag_class(F.col("team_b")).alias("b"))
    return rows.groupBy("kind", "a", "b").agg(F.count("*").alias("games"))


@query("""WITH p AS (SELECT l_orderkey AS id, count(*) AS n, count_if(l_linenumber % 4 <> 1 OR l_quantity > 40) AS active, sum(l_quantity) * 10 AS duration FROM lineitem GROUP BY 1)
SELECT id, n >= 2 AND active = 4 AND duration >= 600 AND id % 5 <> 0 AS valid FROM p""")
def valid_matches(spark, d):
    """Orders as matches of four active players; a ping is missing where the line's quantity is above 40, and 0 in every fourth line."""
    ping = F.when(F.col("l_quantity") > 40, F.lit(None)).when(F.col("l_linenumber") % 4 == 1, 0).otherwise(30)
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct("l_linenumber", ping.alias("ping"))).alias("players"), (F.sum("l_quantity") * 10).alias("duration"))
    mode = F.when(F.col("id") % 5 == 0, "duel").otherwise("team")
    return rows.select("id", validity.is_valid(F.col("players"), mode, F.col("duration"), F.array(F.lit("a"), F.lit("b")), 4).alias("valid"))


@query("WITH p AS (SELECT l_orderkey AS id, count(*) AS n, sum(l_quantity) * 10 AS duration, CASE min(l_returnflag) WHEN 'A' THEN 'dm2' WHEN 'N' THEN 'dm3' ELSE 'dm6' END AS map FROM lineitem GROUP BY 1) SELECT id, map FROM p WHERE n = 4 AND duration >= 600 AND map IN ('dm2', 'dm3')")
def competition_games(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("player_count"), (F.sum("l_quantity") * 10).alias("duration"), F.min("l_returnflag").alias("f"))
    rows = rows.select("id", "player_count", "duration", F.lit("team").alias("mode"), F.when(F.col("f") == "A", "dm2").when(F.col("f") == "N", "dm3").otherwise("dm6").alias("map"))
    return validity.in_competition(rows, players=4).select("id", "map")


@query(f"WITH {PLAYERS} SELECT name, count(*)::BIGINT AS games, round(avg(damage), 4) AS mean FROM players GROUP BY name HAVING count(*) >= 5 AND avg(damage) < 52000")
def bot_detection(spark, d):
    return matches.little_damage(players(spark, d), "name", "damage", 5, 52000.0).withColumn("mean", F.round("mean", 4))


@query(f"WITH {PLAYERS} SELECT map || team AS team, count(DISTINCT game_id)::BIGINT AS games, count(DISTINCT name)::BIGINT AS names FROM players GROUP BY 1 HAVING count(DISTINCT name) >= 5")
def busy_teams(spark, d):
    return matches.busy_teams(players(spark, d).withColumn("team", F.concat("map", "team")), 5)


@query(f"WITH {PLAYERS} SELECT map || team AS team, count(DISTINCT game_id)::BIGINT AS games, count(DISTINCT name)::BIGINT AS names FROM players WHERE name IN ('p1', 'p2', 'p3', 'p4') GROUP BY 1 HAVING count(DISTINCT name) >= 3 ORDER BY 2 DESC, 1 LIMIT 5")
def roster_tags(spark, d):
    """The five (the feature) tags under which three of four names played most."""
    return matches.roster_tags(players(spark, d).withColumn("team", F.concat("map", "team")), ["p1", "p2", "p3", "p4"], 3, 5)


# ---- names ---------------------------------------------------------------------------------------------------------

#: How names are decorated, by the part's number.
SHAPES = ["{}", "[fu]{}", "{} =ht=", ".tag.{}", "•{}•dc", "(1) {}", "xX{}xx", "{}_afk", "362. {}", "{}.........axe", "d2•{}", ">> {}", "{{a}} {}|gf", "{} (x)", "-ab- {}", "]sr[ {}", "{} 1337$", " {} away "]


def _decorated(spark, d):
    name, out = F.lower("p_name"), F.lit(None)
    for k, shape in enumerate(SHAPES):
        before, after = (x.replace("{{", "{").replace("}}", "}") for x in shape.split("{}"))
        out = F.when(F.col("p_partkey") % len(SHAPES) == k, F.concat(F.lit(before), name, F.lit(after))).otherwise(out)
    return table(spark, d, "part").select("p_partkey", out.alias("name"), F.col("p_size").alias("games"))


_SHAPES = "CASE p_partkey % {} ".format(len(SHAPES)) + " ".join("WHEN {} THEN '{}' || lower(p_name) || '{}'".format(k, *(x.replace("{{", "{").replace("}}", "}") for x in s.split("{}"))) for k, s in enumerate(SHAPES)) + " END"


def _core_sql(name: str, rules: list[tuple[str, str]]) -> str:
    out = f"trim({name})"
    for pattern, instead in rules:
        out = f"regexp_replace({out}, '{pattern}', '{instead.replace('$', chr(92))}')"
    return f"trim(lower(translate({out}, '013457$', 'oieasts')))"


_CORES = f"n AS (SELECT p_partkey, p_size AS games, {_SHAPES} AS name FROM part)"


@query(f"WITH {_CORES} SELECT p_partkey, {_core_sql('name', N.CLAN_RULES)} AS core, {_core_sql('name', N.EXPLORE_RULES)} AS explored FROM n")
def core_names(spark, d):
    return _decorated(spark, d).select("p_partkey", N.core_name(F.col("name")).alias("core"), N.core_name(F.col("name"), N.EXPLORE_RULES).alias("explored"))


@query(f"""WITH {_CORES}, c AS (SELECT {_core_sql('name', N.CLAN_RULES)} AS core, name, sum(games) AS games FROM n GROUP BY ALL)
SELECT core, arg_min(name, (-games, name)) AS best, count(*)::BIGINT AS names, string_agg(name, ',' ORDER BY name) AS all_names FROM c WHERE length(core) >= 3 GROUP BY core HAVING count(*) >= 2""")
def exact_core_groups(spark, d):
    """Names of one core, the one of most games first."""
    rows = _decorated(spark, d).withColumn("core", N.core_name(F.col("name"))).groupBy("core", "name").agg(F.sum("games").alias("games"))
    return identity.best_per_core(rows.where(F.length("core") >= 3), "core", "name", "games").where("names >= 2")


@query("""WITH c AS (SELECT c_custkey, list_transform(string_split(chr((1 + c_custkey % 255)::INT) || c_name || chr((1 + c_custkey * 7 % 255)::INT), ''), lambda x: CASE WHEN ord(x) >= 128 THEN ord(x) - 128 ELSE ord(x) END) AS codes FROM customer)
SELECT c_custkey, trim(array_to_string(list_transform(codes, lambda u: CASE WHEN u >= 32 THEN chr(u) WHEN u IN (0, 2, 29, 30, 31) THEN '=' WHEN u IN (5, 14, 15, 28) THEN '•' WHEN u = 10 THEN ' ' WHEN u = 16 THEN '[' WHEN u = 17 THEN ']' WHEN u BETWEEN 18 AND 27 THEN (u - 18)::VARCHAR ELSE '?' END), '')) AS plain FROM c""")
def charset_ascii(spark, d):
    """Customers' names between two game characters."""
    glyph = lambda k: F.char(k.cast("long"))
    name = F.concat(glyph(1 + F.col("c_custkey") % 255), "c_name", glyph(1 + F.col("c_custkey") * 7 % 255))
    return table(spark, d, "customer").select("c_custkey", S.to_ascii(name).alias("plain"))


@query("""WITH p AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON left(x.p_name, 3) = left(y.p_name, 3) AND x.p_name < y.p_name), g AS (SELECT a, b, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS y FROM p)
SELECT a, b, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 9) AS dice, levenshtein(a, b)::INT AS edits FROM g""")
def bigram_dice(spark, d):
    pairs = identity.blocked_pairs(table(spark, d, "part"), "p_name", 3)
    return pairs.select("a", "b", F.round(S.dice(F.col("a"), F.col("b")), 9).alias("dice"), F.levenshtein("a", "b").alias("edits"))


@query("SELECT c_custkey, list_filter(list_transform(string_split(c_name || ' , A,,' || c_mktsegment || ' ', ','), lambda x: lower(trim(x))), lambda x: x <> '')::VARCHAR AS parts, upper(hex(encode(c_name))) AS bytes FROM customer")
def comma_lists(spark, d):
    text = F.concat("c_name", F.lit(" , A,,"), "c_mktsegment", F.lit(" "))
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("["), F.array_join(S.list_of(text), ", "), F.lit("]")).alias("parts"), F.hex(F.encode("c_name", "UTF-8")).alias("bytes"))


@query(f"""WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM s x JOIN s y USING (l_orderkey) WHERE x.l_suppkey < y.l_suppkey GROUP BY ALL),
c AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier) SELECT c.a, c.b, coalesce(n, 0)::BIGINT AS together, coalesce(n, 0) > 0 AS apart FROM c LEFT JOIN p USING (a, b)""")
def shared_count(spark, d):
    """Candidate pairs that met in a match can't be one person."""
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    met = identity.cooccurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", pairs)
    together = F.coalesce("together", F.lit(0))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", together.alias("together"), (together > 0).alias("apart"))


# ---- history -------------------------------------------------------------------------------------------------------

_OURS = """ours AS (SELECT id, played_at, map, CASE WHEN team_a = 't1' THEN team_b ELSE team_a END AS opponent, CASE WHEN team_a = 't1' THEN frags_a ELSE frags_b END AS own, CASE WHEN team_a = 't1' THEN frags_b ELSE frags_a END AS other FROM games WHERE team_a = 't1' OR team_b = 't1'),
o AS (SELECT *, CASE WHEN own > other THEN 'W' WHEN own < other THEN 'L' ELSE 'D' END AS result FROM ours)"""


def _breakdown_sql(by: str) -> str:
    return f"""WITH {GAMES}, {_OURS}, f AS (SELECT {by}, string_agg(result, '' ORDER BY played_at, id) AS form FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY played_at, id) AS n FROM o) WHERE n <= 5 GROUP BY 1)
SELECT {by}, count(*)::BIGINT AS games, count_if(result = 'W')::BIGINT AS wins, count_if(result = 'L')::BIGINT AS losses, floor(100.0 * count_if(result = 'W') / count(*) + 0.5)::INT AS win_pct, floor(100.0 * count_if(result = 'L') / count(*) + 0.5)::INT AS loss_pct,
  floor(sum(own - other) / count(*) + 0.5)::INT AS avg_diff, any_value(form) AS form FROM o JOIN f USING ({by}) GROUP BY 1"""


@query(_breakdown_sql("opponent"))
def history_by_opponent(spark, d):
    return history.breakdown(matches.seen_from(games(spark, d), ["t1"]), "opponent")


@query(_breakdown_sql("map"))
def history_by_map(spark, d):
    return history.breakdown(matches.seen_from(games(spark, d), ["t1"]), "map")


@query(f"WITH {GAMES}, {SIDES}, r AS (SELECT *, CASE WHEN own > other THEN 'W' WHEN own < other THEN 'L' ELSE 'D' END AS result FROM sides) SELECT team, count(*)::BIGINT AS games, count_if(result = 'W')::BIGINT AS wins, count_if(result = 'L')::BIGINT AS losses, count_if(result = 'D')::BIGINT AS draws, floor(100.0 * count_if(result = 'W') / count(*) + 0.5)::INT AS win_rate FROM r GROUP BY 1")
def record_summary(spark, d):
    return history.record(matches.both_sides(games(spark, d)), ["team"])


@query(f"WITH {GAMES}, {SIDES} SELECT team, string_agg(CASE WHEN own > other THEN 'W' WHEN own < other THEN 'L' ELSE 'D' END, '' ORDER BY played_at DESC, id DESC, own DESC) AS form FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY played_at DESC, id DESC, own DESC) AS n FROM sides) WHERE n <= 5 GROUP BY 1")
def last_five(spark, d):
    """Newest first."""
    return history.recent_form(matches.both_sides(games(spark, d)), ["team"], [F.desc("played_at"), F.desc("id"), F.desc("own")], "result")


@query(f"WITH {PLAYERS}, m AS (SELECT game_id, name, kills, deaths, max(kills) OVER w AS mk, max(deaths) OVER w AS md FROM players WINDOW w AS (PARTITION BY game_id)) SELECT game_id, name, kills, deaths, kills > 0 AND kills = mk AND count_if(kills = mk) OVER (PARTITION BY game_id) = 1 AS top_kills, deaths > 0 AND deaths = md AND count_if(deaths = md) OVER (PARTITION BY game_id) = 1 AS top_deaths FROM m")
def unique_highlights(spark, d):
    return history.unique_tops(players(spark, d).select("game_id", "name", "kills", "deaths"), ["game_id"], ["kills", "deaths"])


@query(f"WITH {GAMES} SELECT id FROM games f WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM games g WHERE g.id % 3 <> 0 AND g.played_at::DATE = f.played_at::DATE AND least(g.team_a, g.team_b) = least(f.team_a, f.team_b) AND greatest(g.team_a, g.team_b) = greatest(f.team_a, f.team_b))")
def not_played_that_day(spark, d):
    rows = games(spark, d).select("id", "team_a", "team_b", "played_at")
    return history.not_played_that_day(rows.where("id % 3 = 0"), rows.where("id % 3 <> 0")).select("id")


@query(f"""WITH {GAMES}, {SIDES}, m AS (SELECT opponent, count(*)::BIGINT AS games FROM sides WHERE team = 't1' AND opponent <> 't2' GROUP BY 1),
t AS (SELECT c_custkey AS team, unnest([lower(c_mktsegment), 't' || (c_nationkey % 20), 't' || (c_custkey % 40), 't5']) AS tag, unnest([1, 2, 3, 4]) AS pos FROM customer)
SELECT team, arg_min(opponent, pos) AS opponent, arg_min(games, pos) AS games FROM t JOIN m ON tag = opponent GROUP BY team""")
def alias_overlap(spark, d):
    """Customers as teams of four tags, the opponents of t1 as those that are known."""
    met = matches.both_sides(games(spark, d)).where("team = 't1' AND opponent <> 't2'").groupBy("opponent").agg(F.count("*").alias("games"))
    tags = F.array(F.lower("c_mktsegment"), F.concat(F.lit("t"), F.col("c_nationkey") % 20), F.concat(F.lit("t"), F.col("c_custkey") % 40), F.lit("t5"))
    return history.known_opponents(table(spark, d, "customer").select(F.col("c_custkey").alias("team"), tags.alias("tags")), met)


_CALLED = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'nobody' WHEN c_custkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END AS called FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"WITH f AS ({_CALLED}) SELECT c_custkey, n_nationkey, n_nationkey IS NOT NULL AS matched FROM f LEFT JOIN nation ON lower(called) = lower(n_name)")
def lookup_by_name(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    own = table(spark, d, "customer").join(nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("own")), "c_nationkey")
    called = F.when(F.col("c_custkey") % 5 == 0, "nobody").when(F.col("c_custkey") % 2 == 0, F.upper("own")).otherwise(F.lower("own"))
    return history.looked_up(own.select("c_custkey", called.alias("called")), "called", nations, "n_name").select("c_custkey", "n_nationkey", "matched")


@query("SELECT user, string_agg(team, ',' ORDER BY since, team) AS teams, arg_min(team, (since, team)) AS \"primary\" FROM (SELECT o_custkey AS user, 't' || (o_orderkey % 5) AS team, min(o_orderdate) AS since FROM orders GROUP BY ALL) GROUP BY user")
def primary_teams(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("user"), F.concat(F.lit("t"), F.col("o_orderkey") % 5).alias("team"), F.col("o_orderdate").alias("joined_at"))
    return history.primary_teams(rows).withColumn("teams", F.array_join("teams", ","))


@query("WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL) SELECT s, max(n)::BIGINT AS n, arg_min(p, (-n, p)) AS p FROM c GROUP BY s")
def most_children(spark, d):
    parent = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    return history.most_children(table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), parent.alias("p")), "s", "p")


@query(f"""WITH {GAMES}, r AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'alone-' || id ELSE 's' || (id // 10) END AS series, team_b AS opponent, played_at, map, CASE WHEN frags_a > frags_b THEN 'W' WHEN frags_a < frags_b THEN 'L' ELSE 'D' END AS result, frags_a % 9 <> 0 AS whole FROM games)
SELECT series, opponent, string_agg(map, ',' ORDER BY played_at, id) AS maps, count_if(result = 'W')::BIGINT AS won, count_if(result = 'L')::BIGINT AS lost, bool_and(whole) AS whole, max(played_at) AS last_at FROM r GROUP BY ALL""")
def recording_series(spark, d):
    """Lines of one order, number and day follow each other as in the table."""
    g = games(spark, d, F.struct("_metadata.file_path", "_metadata.row_index").alias("position"))
    session = F.when(F.col("id") % 4 != 0, F.concat(F.lit("s"), F.floor(F.col("id") / 10)))
    return history.series(g.select("id", session.alias("session"), F.col("team_b").alias("opponent"), F.col("played_at").alias("started_at"), "map", matches.outcome(F.col("frags_a"), F.col("frags_b")).alias("result"), (F.col("frags_a") % 9 != 0).alias("whole"), "position"), "position")


@query("SELECT lower(p_name) AS name, count(*)::BIGINT AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS keys FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    rows = table(spark, d, "part").withColumn("p_name", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return history.duplicate_names(rows, "p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3")
def orphan_references(spark, d):
    return history.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").where("c_custkey % 7 <> 3"), "c_custkey").select("o_orderkey")


# ---- pairing -------------------------------------------------------------------------------------------------------

KNOWN = ["red ring", "widget", "COLD GEAR", "gear", "small"]
_KNOWN = "[" + ", ".join(f"'{k}'" for k in KNOWN) + "]"


@query(f"""SELECT p_partkey, coalesce(list_extract(list_filter({_KNOWN}, lambda k: lower(k) = lower(trim(p_name))), 1), list_extract(list_filter({_KNOWN}, lambda k: contains(lower(k), lower(trim(p_name))) OR contains(lower(trim(p_name)), lower(k))), 1)) AS known FROM part""")
def fuzzy_known_names(spark, d):
    """Exact names before contained ones."""
    return table(spark, d, "part").select("p_partkey", pairing.best_known(F.col("p_name"), KNOWN).alias("known"))


_NAME = lambda u: f"'•p' || ({u}) || '.x'"
_PAIRS = f"""rec AS (SELECT event_id AS recording, 't' || (user_id % 8) AS tag, epoch(ts)::DOUBLE AS starts, epoch(ts) + 40 * value AS ends, ['p' || user_id || '.x', 'P' || (user_id + 1) || '.X!', '.p' || (user_id + 2) || '.x', 'p'] AS names FROM events WHERE event_type = 'signup'),
mat AS (SELECT event_id AS match, epoch(ts)::DOUBLE AS began, ['T' || (user_id % 8), 'q'] AS tags, [{_NAME('user_id')}, {_NAME('user_id + 1')}, {_NAME('user_id + 2')}, '•'] AS names, value > 50 AS has_stats FROM events WHERE event_type = 'purchase'),
j AS (SELECT recording, match, began - starts AS "offset", has_stats, list_contains(list_transform(tags, lambda t: lower(t)), tag) AS ours,
  list_transform(rec.names, lambda n: lower(regexp_replace(regexp_replace(n, '^[^a-zA-Z0-9]+', ''), '[^a-zA-Z0-9]+$', ''))) AS x, list_filter(list_transform(mat.names, lambda n: lower(regexp_replace(regexp_replace(n, '^[^a-zA-Z0-9]+', ''), '[^a-zA-Z0-9]+$', ''))), lambda n: n <> '') AS y
  FROM rec JOIN mat ON began >= starts - 120 AND began < ends + 120),
k AS (SELECT *, len(list_filter(x, lambda a: length(a) >= 2 AND len(list_filter(y, lambda b: contains(a, b) OR contains(b, a))) > 0)) AS n2, len(list_filter(x, lambda a: length(a) >= 3 AND len(list_filter(y, lambda b: contains(a, b) OR contains(b, a))) > 0)) AS n3 FROM j)"""


@query(f"""WITH {_PAIRS} SELECT recording, match, round("offset", 3) AS "offset", floor((CASE WHEN "offset" > 60 THEN 0.3::DOUBLE WHEN "offset" > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN has_stats THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN n3 >= 3 THEN 0.3::DOUBLE WHEN n3 >= 1 THEN 0.3::DOUBLE * (n3 / 3) ELSE 0 END + CASE WHEN "offset" > 0 AND "offset" < {pairing.LONGEST} THEN 0.2::DOUBLE ELSE 0 END) * 100 + 0.5) / 100 AS score,
  CASE WHEN n3 >= 3 THEN n3 || ' player names match recording tracks' WHEN n3 >= 1 THEN n3 || ' player name(s) match recording tracks' ELSE 'no player name overlap with recording tracks' END AS reason FROM k WHERE ours OR n2 >= 2""")
def match_recordings(spark, d):
    """Signups as recordings of 40 times their value in seconds, purchases as matches."""
    at, user = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.col("user_id")
    rows = table(spark, d, "events")
    tracks = F.array(F.concat(F.lit("p"), user, F.lit(".x")), F.concat(F.lit("P"), user + 1, F.lit(".X!")), F.concat(F.lit(".p"), user + 2, F.lit(".x")), F.lit("p"))
    recordings = rows.where("event_type = 'signup'").select(F.col("event_id").alias("recording"), F.concat(F.lit("t"), user % 8).alias("tag"), at.alias("starts"), (at + 40 * F.col("value")).alias("ends"), tracks.alias("names"))
    own = F.array(*[F.concat(F.lit("•p"), user + k, F.lit(".x")) for k in range(3)], F.lit("•"))
    met = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("match"), at.alias("at"), F.array(F.concat(F.lit("T"), user % 8), F.lit("q")).alias("tags"), own.alias("names"), (F.col("value") > 50).alias("has_stats"))
    # by itself, so that no other text is made
    found = pairing.paired(recordings, met).select("recording", "match", "offset", "score", F.get("reasons", 2).alias("reason"))
    return found.withColumn("offset", M.half_away(F.col("offset"), 3))


@query("""WITH p AS (SELECT l_orderkey AS game_id, l_linenumber AS pos, l_linestatus || l_returnflag AS team, l_suppkey % 3 = 0 AS heard FROM lineitem), s AS (SELECT game_id, team, count(*) AS n, min(pos) AS pos FROM p WHERE heard GROUP BY ALL)
SELECT game_id, arg_min(team, (-n, pos, team)) AS team, max(n)::BIGINT AS n FROM s GROUP BY game_id""")
def our_team(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("at"), F.concat("l_linestatus", "l_returnflag").alias("team"), F.concat(F.lit(" P"), "l_suppkey").alias("name"))
    speakers = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("p"), "s_suppkey").alias("name"))
    return pairing.our_team(line, speakers)


@query("""WITH l AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'team' ELSE 'opponents' END AS side, (l_quantity % 4)::INT AS count, (l_quantity % 3)::INT AS took FROM lineitem),
i AS (SELECT side, 'ra' AS item, CASE WHEN count <> 0 THEN count ELSE took END AS n FROM l UNION ALL SELECT side, 'quad', took FROM l) SELECT side, item, sum(n)::BIGINT AS n FROM i WHERE n > 0 GROUP BY ALL""")
def item_totals(spark, d):
    q = F.col("l_quantity")
    held = lambda count: F.struct(count.cast("int").alias("count"), (q % 3).cast("int").alias("took"))
    rows = table(spark, d, "lineitem").select("l_linestatus", F.create_map(F.lit("ra"), held(q % 4), F.lit("quad"), held(F.lit(None))).alias("items"))
    return pairing.item_totals(rows, F.col("l_linestatus") == "F")


# ---- availability and proposals ------------------------------------------------------------------------------------

_ROSTERS = "members AS (SELECT DISTINCT 't' || (user_id % 8) AS team, user_id AS user FROM events WHERE user_id % 3 <> 1 OR event_id % 2 = 0)"


def _members(spark, d):
    return table(spark, d, "events").where("user_id % 3 <> 1 OR event_id % 2 = 0").select(F.concat(F.lit("t"), F.col("user_id") % 8).alias("team"), F.col("user_id").alias("user")).distinct()


_TEXT = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"""WITH {AVAILABILITY}, {_ROSTERS}, r AS (SELECT team, list_sort(list(user)) AS users FROM members GROUP BY 1), f AS (SELECT team, week, slot, list(DISTINCT user) AS users FROM availability GROUP BY ALL)
SELECT team, week, slot, array_to_string(list_filter(r.users, lambda u: list_contains(f.users, u)), ',') AS free, array_to_string(list_filter(r.users, lambda u: NOT list_contains(f.users, u)), ',') AS busy FROM f JOIN r USING (team)""")
def roster_availability(spark, d):
    rosters = _members(spark, d).groupBy("team").agg(F.collect_list("user").alias("users"))
    return proposals.rosters_split(rosters, availability(spark, d)).withColumns({"free": _TEXT("free"), "busy": _TEXT("busy")})


@query(f"WITH {AVAILABILITY}, {_ROSTERS}, w AS (SELECT DISTINCT team, week FROM availability) SELECT team, week, user, EXISTS (SELECT 1 FROM availability a WHERE a.team = m.team AND a.week = w.week AND a.user = m.user AND slot IN (84, 96, 108)) AS is_free FROM members m JOIN w USING (team)")
def free_that_week(spark, d):
    return proposals.free_that_week(_members(spark, d), availability(spark, d), [84, 96, 108])


PROPOSALS = """proposals AS (
  SELECT event_id AS id, 't' || (user_id % 8) AS proposer, 't' || ((user_id + 3) % 8) AS opponent, printf('%04d-%02d', isoyear(ts), weekofyear(ts)) AS week, ts, CASE event_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'cancelled' ELSE 'active' END AS status,
         ts + INTERVAL 5 DAY AS expires_at, (event_id % 3 + 1)::INT AS least_proposer, (event_id % 4 + 1)::INT AS least_opponent, event_id % 2 = 0 AS proposer_standin, event_id % 3 = 0 AS opponent_standin FROM events WHERE event_type = 'signup')"""


def _proposals(spark, d):
    """A signup is a proposal of its user's team to another."""
    n, user = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").where("event_type = 'signup'").select(
        n.alias("id"), F.concat(F.lit("t"), user % 8).alias("proposer"), F.concat(F.lit("t"), (user + 3) % 8).alias("opponent"), C.week_id(F.col("ts")).alias("week"), "ts", F.when(n % 5 == 0, "confirmed").when(n % 5 == 1, "cancelled").otherwise("active").alias("status"),
        (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"), (n % 3 + 1).cast("int").alias("least_proposer"), (n % 4 + 1).cast("int").alias("least_opponent"), (n % 2 == 0).alias("proposer_standin"), (n % 3 == 0).alias("opponent_standin"),
    )


@query(f"""WITH {AVAILABILITY}, {PROPOSALS}, c AS (SELECT team, week, slot, count(DISTINCT user) AS n FROM availability GROUP BY ALL),
o AS (SELECT id, week, CASE WHEN proposer = 't1' THEN opponent ELSE proposer END AS opponent, proposer <> 't1' AS is_incoming, CASE WHEN proposer = 't1' THEN least_proposer ELSE least_opponent END AS l, CASE WHEN proposer = 't1' THEN least_opponent ELSE least_proposer END AS m,
  CASE WHEN proposer = 't1' THEN proposer_standin ELSE opponent_standin END::INT AS s, CASE WHEN proposer = 't1' THEN opponent_standin ELSE proposer_standin END::INT AS u FROM proposals WHERE 't1' IN (proposer, opponent)),
k AS (SELECT o.*, slot, coalesce(max(n) FILTER (team = 't1'), 0) AS ours, coalesce(max(n) FILTER (team = opponent), 0) AS theirs FROM o JOIN c ON c.week = o.week AND c.team IN ('t1', opponent) GROUP BY ALL)
SELECT o.id, o.week, o.opponent, o.is_incoming, count_if(least(4, ours + k.s) >= k.l AND least(4, theirs + k.u) >= k.m)::BIGINT AS viable FROM o LEFT JOIN k USING (id) GROUP BY ALL""")
def enriched_proposals(spark, d):
    return proposals.enriched(_proposals(spark, d), availability(spark, d), "t1")


@query(f"""WITH {PROPOSALS} SELECT id, CASE WHEN status <> 'active' OR expires_at < TIMESTAMP '2024-01-17' THEN 'archived' WHEN week = '2024-03' THEN 'current' WHEN week > '2024-03' THEN 'future' ELSE 'past' END AS shelf FROM proposals WHERE status <> 'confirmed'""")
def proposal_shelves(spark, d):
    return proposals.shelves(_proposals(spark, d), "2024-03", F.lit("2024-01-17").cast("timestamp_ntz")).select("id", "shelf")


@query(f"WITH {PROPOSALS} SELECT id, CASE WHEN status = 'active' AND expires_at < TIMESTAMP '2024-01-20' THEN 'expired' ELSE status END AS status FROM proposals")
def expired_proposals(spark, d):
    return schedule.expire(_proposals(spark, d), F.lit("2024-01-20").cast("timestamp_ntz")).select("id", "status")


@query(f"WITH {PROPOSALS} SELECT id, CASE WHEN ts + INTERVAL 30 MINUTE <= TIMESTAMP '2024-01-20' THEN 'completed' ELSE 'upcoming' END AS status FROM proposals")
def completed_matches(spark, d):
    rows = _proposals(spark, d).select("id", F.lit("upcoming").alias("status"), F.col("ts").alias("starts_at"))
    return schedule.complete(rows, F.lit("2024-01-20").cast("timestamp_ntz")).select("id", "status")


@query(f"WITH {PROPOSALS} SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 's1,s2' ELSE 's1' END WHEN id % 2 = 0 THEN 's2' ELSE '' END AS confirmed FROM proposals")
def confirmed_slots(spark, d):
    """Slots s1 and s2, confirmed by the numbers' divisors."""
    yes = F.lit(True)
    mine = F.create_map(F.lit("s2"), yes, F.lit("s1"), yes, F.lit("s9"), yes)
    theirs = F.map_concat(F.when(F.col("id") % 3 == 0, F.create_map(F.lit("s1"), yes)).otherwise(F.create_map(F.lit("x"), yes)), F.when(F.col("id") % 2 == 0, F.create_map(F.lit("s2"), yes)).otherwise(F.create_map(F.lit("y"), yes)))
    rows = _proposals(spark, d).select("id", mine.alias("proposer_slots"), theirs.alias("opponent_slots"))
    return schedule.confirmed_slots(rows).select("id", F.array_join("confirmed", ",").alias("confirmed"))


@query(f"""WITH {AVAILABILITY}, c AS (SELECT week, slot, count(DISTINCT user) FILTER (team = 't1') AS ours, count(DISTINCT user) FILTER (team = 't2') AS theirs FROM availability GROUP BY ALL)
SELECT week, arg_min(slot, (-ours - theirs, slot)) AS slot, arg_min(ours, (-ours - theirs, slot))::BIGINT AS ours, arg_min(theirs, (-ours - theirs, slot))::BIGINT AS theirs FROM c GROUP BY week""")
def best_slots(spark, d):
    who = lambda t: F.count_distinct(F.when(F.col("team") == t, F.col("user")))
    counts = availability(spark, d).groupBy("week", "slot").agg(who("t1").alias("ours"), who("t2").alias("theirs"))
    return proposals.best_slots(counts, ["week"])


_SLOT = "list_extract(['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'], isodow(ts)) || printf('_%02d%02d', hour(ts), minute(ts) // 30 * 30)"


@query(f"""WITH {PROPOSALS}, m AS (SELECT id, proposer, opponent, ts::DATE AS day, {_SLOT} AS slot FROM proposals WHERE status = 'active' ORDER BY ts::DATE, id LIMIT 100)
SELECT id, slot, day::VARCHAR || 'T' || substr(slot, 5, 2) || ':' || substr(slot, 7, 2) || ':00Z' AS starts_at FROM m WHERE lower(proposer) = 't1' OR lower(opponent) = 't1'""")
def scheduled_games(spark, d):
    """The first hundred (the interface's limit) upcoming matches; then those of a tag."""
    rows = _proposals(spark, d).select("id", F.when(F.col("status") == "active", "upcoming").otherwise("cancelled").alias("status"), "week", F.to_date("ts").alias("day"), C.slot_id(C.slot_number(F.col("ts"))).alias("slot"), F.col("proposer").alias("tag_a"), F.upper("opponent").alias("tag_b"))
    return proposals.listing(rows, tag="T1", limit=500).select("id", "slot", "starts_at")


@query(f"""WITH c AS (SELECT 't' || (user_id % 8) AS team, user_id AS user, printf('%04d-%02d', isoyear(ts), weekofyear(ts)) AS week, ((isodow(ts) - 1) * 48 + hour(ts) * 2 + minute(ts) // 30)::INT // 12 * 12 AS slot, ts, event_id,
  CASE event_type WHEN 'view' THEN 'remove' WHEN 'error' THEN 'unavailable' ELSE 'add' END AS action FROM events), l AS (SELECT team, week, slot, user, arg_max(action, (ts, event_id)) AS action FROM c GROUP BY ALL)
SELECT team, week, slot, user, CASE action WHEN 'add' THEN 'free' ELSE 'unavailable' END AS state FROM l WHERE action <> 'remove'""")
def availability_log(spark, d):
    """Events as a log of changes."""
    action = F.when(F.col("event_type") == "view", "remove").when(F.col("event_type") == "error", "unavailable").otherwise("add")
    slot = (F.floor(C.slot_number(F.col("ts")) / 12) * 12).cast("int")
    rows = table(spark, d, "events").select(F.concat(F.lit("t"), F.col("user_id") % 8).alias("team"), C.week_id(F.col("ts")).alias("week"), slot.alias("slot"), F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_id").alias("id"), action.alias("action"))
    return proposals.latest_states(rows)


@query(f"WITH {AVAILABILITY} SELECT DISTINCT team, week, slot, user FROM availability")
def availability_documents(spark, d):
    """Rows to documents (map of slot to users) and back."""
    slots = availability(spark, d).groupBy("team", "week", "slot").agg(F.collect_list("user").alias("users"))
    documents = slots.groupBy("team", "week").agg(F.map_from_entries(F.collect_list(F.struct("slot", "users"))).alias("slots"))
    return schedule.slots_of(documents)


@query(f"WITH {AVAILABILITY} SELECT DISTINCT team, '2024-04' AS week, slot, user FROM availability a WHERE week = '2024-02' AND NOT EXISTS (SELECT 1 FROM availability t WHERE t.week = '2024-04' AND t.user = a.user AND t.slot < 100)")
def template_applied(spark, d):
    """Week 2 as template for week 4, of whose slots only the first hundred count as taken."""
    free = availability(spark, d)
    template = free.where("week = '2024-02'").select("team", "slot", "user").distinct()
    return schedule.apply_template(free.where("week <> '2024-04' OR slot < 100"), template, "2024-04")


@query(f"WITH {AVAILABILITY} SELECT DISTINCT team, slot, user, '2024-03' AS week FROM availability a WHERE week = '2024-02' AND NOT EXISTS (SELECT 1 FROM availability t WHERE t.week = '2024-03' AND t.user = a.user AND t.team = a.team AND t.slot = a.slot)")
def week_copied(spark, d):
    return schedule.copy_week(availability(spark, d).distinct(), "2024-02", "2024-03")


@query(f"WITH {GAMES}, r AS (SELECT unnest(['t1', 't2']) AS tag, unnest(['x1', 't1']) AS new) SELECT id, coalesce(a.new, team_a) AS team_a, coalesce(b.new, team_b) AS team_b FROM games LEFT JOIN r a ON team_a = a.tag LEFT JOIN r b ON team_b = b.tag")
def renamed_tags(spark, d):
    renames = spark.range(1).select(F.explode(F.array(F.struct(F.lit("t1").alias("tag"), F.lit("x1").alias("renamed")), F.struct(F.lit("t2").alias("tag"), F.lit("t1").alias("renamed"))))).select("col.*")
    return proposals.renamed(games(spark, d).select("id", "team_a", "team_b"), renames, ["team_a", "team_b"])


_TEAMS = "teams AS (SELECT c_name AS team, c_mktsegment AS tag, ['d' || (c_custkey % 4), 'd' || (c_custkey % 3)] AS divisions, c_custkey % 11 = 0 AS hidden, c_custkey % 5 = 0 AS hides, ['u' || c_custkey, 'u' || (c_custkey + 1)] AS users FROM customer)"


def _teams(spark, d):
    k = F.col("c_custkey")
    named = lambda p, n: F.concat(F.lit(p), n)
    return table(spark, d, "customer").select(F.col("c_name").alias("team"), F.col("c_mktsegment").alias("tag"), F.array(named("d", k % 4), named("d", k % 3)).alias("divisions"), (k % 11 == 0).alias("hidden"), (k % 5 == 0).alias("hides"), F.array(named("u", k), named("u", k + 1)).alias("users"))


@query(f"WITH {_TEAMS} SELECT team FROM teams WHERE NOT hidden AND (list_contains(divisions, 'd3') OR list_contains(divisions, 'd1')) AND (contains(lower(team), '7') OR contains(lower(tag), 'auto'))")
def browse_teams(spark, d):
    sevens, autos = (proposals.offered(_teams(spark, d), ["d3", "d1"], q).select("team") for q in ("7", "AUTO"))
    return sevens.union(autos).distinct()


@query(f"WITH {_TEAMS} SELECT team, CASE WHEN hides THEN 'Player 1,Player 2' ELSE array_to_string(users, ',') END AS users FROM teams WHERE NOT hidden")
def hidden_rosters(spark, d):
    return proposals.shown_roster(_teams(spark, d)).select("team", F.array_join("users", ",").alias("users"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AND c_nationkey % 5 <> 0")
def candidate_members(spark, d):
    """No bots (of some nations), not on the roster, not known."""
    own = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    rest = upserts.new_rows(own.where("c_nationkey % 5 <> 0"), own.where("c_custkey % 4 = 0"), ["c_custkey"], ["c_custkey"])
    return upserts.new_rows(rest, own.where("c_custkey % 3 = 0"), ["c_custkey"], ["c_custkey"]).select("c_custkey")


@query("SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-19 23:50:00' THEN 'interrupted' WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS status FROM events")
def stale_sessions(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").alias("beat_at"))
    return proposals.stale(rows, F.lit("2024-01-20").cast("timestamp"), 600).select("event_id", "status")


@query("""WITH e AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t, CASE WHEN event_type = 'error' THEN value END AS pause FROM events)
SELECT event_id, round(t + coalesce(sum(pause) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS wall FROM e""")
def wall_clock(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, d, "events").select("user_id", "event_id", at.alias("at"), F.when(F.col("event_type") == "error", F.col("value")).alias("pause"))
    return proposals.wall_clock(rows.withColumn("at", F.col("at")), "user_id", "at", "pause").select("event_id", F.round("wall", 3).alias("wall"))


# ---- calendar ------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT DISTINCT printf('%04d-%02d', isoyear(o_orderdate), weekofyear(o_orderdate)) AS week, date_trunc('week', o_orderdate)::DATE AS monday FROM orders)
SELECT week, (abs(monday - DATE '1998-01-05') // 7)::INT AS distance, monday::TIMESTAMP + INTERVAL 6 DAY + INTERVAL 86399999 MILLISECOND AS expiry, (monday::TIMESTAMP + INTERVAL 61 HOUR)::VARCHAR AS wednesday FROM w""")
def week_arithmetic(spark, d):
    """Distance to week 2 of 1998, the last millisecond, and the time of a slot, Wednesday at 13:00."""
    week = table(spark, d, "orders").select(C.week_id(F.col("o_orderdate")).alias("week")).distinct()
    slot = F.date_format(C.instant_of(F.col("week"), F.lit("wed_1300")), "yyyy-MM-dd HH:mm:ss")
    return week.select("week", C.week_distance(F.col("week"), F.lit("1998-02")).alias("distance"), C.week_expiry(F.col("week")).cast("timestamp_ntz").alias("expiry"), slot.alias("wednesday"))


@query("""WITH t AS (SELECT o_orderkey, (o_orderdate + to_minutes((o_orderkey % 2880)::INT)) AS ts FROM orders), z AS (SELECT o_orderkey, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS a, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata' AS b FROM t)
SELECT o_orderkey, list_extract(['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'], isodow(a)) || printf('_%02d%02d', hour(a), minute(a) // 30 * 30) AS berlin, list_extract(['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'], isodow(b)) || printf('_%02d%02d', hour(b), minute(b) // 30 * 30) AS kolkata FROM z""")
def slots_in_zones(spark, d):
    ts = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 2880).cast("int"))
    at = lambda zone: C.slot_id(C.slot_number(C.zoned(ts, zone)))
    return table(spark, d, "orders").select("o_orderkey", at("Europe/Berlin").alias("berlin"), at("Asia/Kolkata").alias("kolkata"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderdate - INTERVAL 90 MINUTE)::VARCHAR END AS utc, CASE WHEN o_orderkey % 4 < 2 THEN 1210::DOUBLE ELSE (o_orderkey % 4 * 100)::DOUBLE END AS seconds FROM orders""")
def offset_times(spark, d):
    """Times with a numeric offset, some of them broken; durations that are missing or not positive take the default."""
    n = F.col("o_orderkey")
    text = F.when(n % 9 == 0, "no time").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0130")))
    seconds = F.when(n % 4 != 1, (n % 4).cast("double") * 100)
    return table(spark, d, "orders").select("o_orderkey", F.date_format(C.with_offset(text), "yyyy-MM-dd HH:mm:ss").alias("utc"), C.duration_or(seconds, 1210.0).alias("seconds"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '86,90,100' WHEN c_custkey % 3 = 1 THEN '85,86,100' ELSE '85,86,90,100' END AS slots FROM customer")
def visible_slots(spark, d):
    """Base slots 85, 86 and 100 without hidden ones, and with extra ones, in order."""
    k = F.col("c_custkey") % 3
    none = F.array().cast("array<int>")
    hidden = F.when(k == 0, F.array(F.lit(85), F.lit(7))).otherwise(none)
    extra = F.when(k != 1, F.array(F.lit(90), F.lit(86))).otherwise(none)
    return table(spark, d, "customer").select("c_custkey", _TEXT(C.visible(F.array(F.lit(100), F.lit(86), F.lit(85)), hidden, extra)).alias("slots"))


@query("""WITH w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 7 DAY)) AS monday), s AS (SELECT 't' || (user_id % 8) AS team, ts FROM events WHERE event_type = 'signup')
SELECT event_id, max(c.ts) AS latest FROM events e LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'click') c ON c.user_id = e.user_id AND c.ts <= e.ts WHERE event_type = 'purchase' GROUP BY 1""")
def asof_clicks(spark, d):
    """The last click at or before each purchase of a user."""
    rows = table(spark, d, "events")
    clicks = rows.where("event_type = 'click'").select("user_id", "ts", F.col("ts").alias("latest"))
    return intervals.asof(rows.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), clicks, ["user_id"], "ts", "latest").select("event_id", "latest")


# ---- intervals and text --------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT user_id, epoch(ts)::DOUBLE AS t, CASE event_type WHEN 'signup' THEN 'start' ELSE 'end' END AS kind, event_id FROM events WHERE event_type IN ('signup', 'purchase')),
l AS (SELECT *, lead(kind) OVER w AS k, lead(t) OVER w AS e FROM m WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, t AS start, CASE WHEN k = 'end' THEN e END AS "end" FROM l WHERE kind = 'start' AND (k IS NULL OR k = 'end')""")
def marker_pairs(spark, d):
    """Signups open, purchases close; the last start before an end wins."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, d, "events").where("event_type IN ('signup', 'purchase')").select("user_id", at.alias("at"), F.when(F.col("event_type") == "signup", "start").otherwise("end").alias("kind"))
    return intervals.marker_pairs(rows, ["user_id"], "at", "kind")


_FOLD = """s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch(ts)::DOUBLE AS s, epoch(ts) + 300 * value AS e FROM events WHERE event_type = 'view' AND user_id % 2 = 0)"""


@query(f"""WITH RECURSIVE {_FOLD}, r AS (SELECT user_id, n, s, e, s AS own_s FROM s WHERE n = 1
UNION ALL SELECT s.user_id, s.n, s.s, s.e, CASE WHEN r.e > s.s THEN (r.e + s.s) / 2 ELSE s.s END FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT r.user_id, round(r.own_s, 3) AS starts, round(CASE WHEN x.s IS NOT NULL AND r.e > x.s THEN (r.e + x.s) / 2 ELSE r.e END, 3) AS ends FROM r LEFT JOIN s x ON x.user_id = r.user_id AND x.n = r.n + 1""")
def midpoint_trims(spark, d):
    """Views last 300 times their value; overlaps with the next are cut at the middle, one after the other."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, d, "events").where("event_type = 'view' AND user_id % 2 = 0").select("user_id", at.alias("starts"), (at + 300 * F.col("value")).alias("ends"))
    return intervals.trim_at_midpoints(rows, ["user_id"], "starts", "ends").withColumns({"starts": F.round("starts", 3), "ends": F.round("ends", 3)})


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch(ts)::DOUBLE AS t, value > 20 AS hot, lag(value > 20) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events), p AS (SELECT *, sum((hot AND NOT coalesce(was, false))::INT) OVER (PARTITION BY user_id ORDER BY t) AS run FROM o),
m AS (SELECT user_id, (min(t) + max(t)) / 2 AS mid FROM p WHERE hot GROUP BY user_id, run), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mid) AS n FROM m),
k AS (SELECT user_id, n, mid, mid AS last, true AS kept FROM q WHERE n = 1 UNION ALL SELECT q.user_id, q.n, q.mid, CASE WHEN q.mid - k.last >= 50000 THEN q.mid ELSE k.last END, q.mid - k.last >= 50000 FROM k JOIN q ON q.user_id = k.user_id AND q.n = k.n + 1)
SELECT user_id, round(mid, 3) AS mid FROM k WHERE kept""")
def runs_above(spark, d):
    """Midpoints of runs of high values, 50,000 seconds apart at least."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return intervals.runs_above(table(spark, d, "events").select("user_id", at.alias("at"), "value"), ["user_id"], "at", "value", 20.0, 50_000.0).withColumn("mid", F.round("mid", 3))


_WORDS = """w AS (SELECT user_id, ts::DATE::VARCHAR AS segment, epoch(ts)::DOUBLE AS s, epoch(ts) + value AS e, CASE event_type WHEN 'error' THEN ' ' ELSE ' ' || event_type END AS word FROM events),
g AS (SELECT *, CASE WHEN s - lag(e) OVER v >= 7200 THEN 1 ELSE 0 END AS cut FROM w WINDOW v AS (PARTITION BY user_id, segment ORDER BY s, e, word)), p AS (SELECT *, sum(cut) OVER (PARTITION BY user_id, segment ORDER BY s, e, word ROWS UNBOUNDED PRECEDING) AS part FROM g)"""


@query(f"WITH {_WORDS} SELECT * FROM (SELECT user_id, segment, floor(min(s) * 1000 + 0.5) / 1000 AS start, floor(arg_max(e, (s, e, word)) * 1000 + 0.5) / 1000 AS \"end\", trim(string_agg(word, '' ORDER BY s, e, word)) AS text, count(*)::BIGINT AS words FROM p GROUP BY user_id, segment, part) WHERE text <> ''")
def transcript_segments(spark, d):
    """Events as words of a user's day; two hours' silence ends a stretch."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    word = F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit(" "), "event_type"))
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("segment"), at.alias("s"), (at + F.col("value")).alias("e"), word.alias("w"))
    return chat.resegmented(rows, ["user_id", "segment"], "s", "e", "w", 7200.0)


@query("SELECT event_id, printf('[%02d:%05.2f] %s: %s', floor(value / 60)::INT, value - 60 * floor(value / 60), 'u' || user_id, event_type) AS line FROM events")
def timeline_lines(spark, d):
    return table(spark, d, "events").select("event_id", chat.timeline_text(F.col("value"), F.concat(F.lit("u"), "user_id"), F.col("event_type")).alias("line"))


@query("SELECT count(*)::BIGINT AS segments, round(sum(value), 4) AS speaking, count(DISTINCT user_id)::BIGINT AS speakers, floor((1 - sum(value) / (100000.0 * count(DISTINCT user_id))) * 1000 + 0.5) / 10 AS silence FROM events")
def silence_share(spark, d):
    return chat.silence_share(table(spark, d, "events"), "user_id", F.col("value"), 100_000.0).withColumn("speaking", F.round("speaking", 4))


@query("SELECT count(*)::BIGINT AS messages, round(avg(length(text)), 6) AS mean_length, round(avg((turn > 0)::INT), 6) AS replies, round(avg((role = 'assistant')::INT), 6) AS bots, round(avg((length(text) > 200)::INT), 6) AS files FROM conversations")
def message_shares(spark, d):
    out = chat.message_shares(table(spark, d, "conversations"), "text", F.col("turn") > 0, F.col("role") == "assistant", F.length("text") > 200)
    return out.select("messages", *[F.round(c, 6).alias(c) for c in ("mean_length", "replies", "bots", "files")])


@query("""WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) SELECT event_id, CASE WHEN gap > 1200 THEN floor(gap / 60 + 0.5)::INT END AS gap_minutes FROM g""")
def gap_markers(spark, d):
    return chat.gap_markers(table(spark, d, "events"), ["user_id"], "ts", 1200.0, "event_id").select("event_id", "gap_minutes")


@query("SELECT event_type, CASE WHEN strftime(ts, '%M') = '00' THEN ':00' WHEN strftime(ts, '%M') = '30' THEN ':30' ELSE 'other' END AS mark, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def minute_marks(spark, d):
    minute = F.substring(F.date_format("ts", "HH:mm"), 4, 2)
    mark = F.when(minute == "00", ":00").when(minute == "30", ":30").otherwise("other")
    return table(spark, d, "events").groupBy("event_type", mark.alias("mark")).agg(F.count("*").alias("n"))


@query(f"""WITH {MESSAGES}, {_SESSIONS} SELECT event_id, s.channel, s.session, t.messages, t.started_at FROM s JOIN t ON s.channel = t.channel AND s.session = t.session WHERE event_type IN ('view', 'click')""")
def labelled_messages(spark, d):
    """Spoken messages with their sessions."""
    spoken = _sessions(spark, d).where("event_type IN ('view', 'click')").select("event_id", "channel", "session")
    return spoken.join(_session_table(spark, d).select("channel", "session", "messages", "started_at"), ["channel", "session"])


@query(f"""WITH {MESSAGES}, {_SESSIONS}, a AS (SELECT channel, session, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM s GROUP BY ALL) SELECT t.channel, t.session, kinds FROM t JOIN a USING (channel, session) WHERE chat_messages = 0""")
def silent_sessions(spark, d):
    """Sessions in which nothing is said, with the kinds of their messages."""
    empty = _session_table(spark, d).where("chat_messages = 0").select("channel", "session")
    kinds = _sessions(spark, d).groupBy("channel", "session").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    return empty.join(kinds, ["channel", "session"])


@query(f"""WITH {MESSAGES}, {_SESSIONS}, f AS (SELECT channel, session, event_type AS who, min((ts, event_id)) AS pos FROM s WHERE session IS NOT NULL GROUP BY ALL) SELECT channel, session, to_json(list(who ORDER BY pos))::VARCHAR AS who FROM f GROUP BY ALL""")
def participants_json(spark, d):
    """Who took part, in the order of the first message, as JSON."""
    rows = _sessions(spark, d).where("session IS NOT NULL")
    said = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return rows.groupBy("channel", "session").agg(F.to_json(F.array_distinct(said)).alias("who"))


_TERMS = r"t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)"


@query(rf"WITH {_TERMS}, u AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS at FROM t) SELECT a.doc_id, count(*)::BIGINT AS hits FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.at = a.at + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
def fts_phrase(spark, d):
    return search.match_phrase(_index(spark, d), "doc_id", ["of", "the"])


@query(rf"WITH {_TERMS}, m AS (SELECT doc_id, len(list_filter(t, lambda x: x IN ('was', 'dans') OR starts_with(x, 'thea'))) AS hits FROM t) SELECT doc_id, hits::BIGINT AS hits FROM m WHERE hits > 0")
def fts_any_prefix(spark, d):
    """was OR dans OR thea*."""
    return search.match_any(table(spark, d, "documents"), "doc_id", "text", ["was", "Dans", "thea*"])


@query(r"WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents) SELECT term, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM t GROUP BY 1")
def folded_terms(spark, d):
    """Terms without accents."""
    return search.terms(table(spark, d, "documents"), "doc_id", "text", fold=True).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_split_to_array(text, '\s+') AS w FROM conversations), p AS (SELECT *, list_position(list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')), 'the') AS pos FROM t), q AS (SELECT *, greatest(pos - 20, 1) AS f FROM p WHERE pos > 0)
SELECT conv_id, turn, CASE WHEN f > 1 THEN '... ' ELSE '' END || array_to_string(list_transform(w[f:f + 39], lambda x, i: CASE WHEN i + f - 1 = pos THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN f + 40 <= len(w) THEN ' ...' ELSE '' END AS snippet FROM q""")
def snippets(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", search.snippet(F.col("text"), "the").alias("snippet")).where("snippet IS NOT NULL")


@query(r"""WITH c AS (SELECT conv_id, list_filter(regexp_split_to_array(lower(string_agg(text, ' ')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM conversations GROUP BY 1), h AS (SELECT conv_id, len(t) AS l, len(list_filter(t, lambda x: x = 'of')) AS n FROM c),
s AS (SELECT conv_id, greatest(ln(((SELECT count(*) FROM h) - (SELECT count(*) FROM h WHERE n > 0) + 0.5) / ((SELECT count(*) FROM h WHERE n > 0) + 0.5)), 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * l / (SELECT avg(l) FROM h))) AS score FROM h WHERE n > 0)
SELECT conv_id, turn, sha256(text) AS text FROM conversations WHERE conv_id = (SELECT conv_id FROM s ORDER BY round(score, 12) DESC, conv_id LIMIT 1)""")
def best_conversation(spark, d):
    """The whole conversation of the best hit."""
    rows = table(spark, d, "conversations")
    docs = rows.groupBy("conv_id").agg(F.array_join(F.collect_list("text"), " ").alias("document"))
    best = search.bm25_scan(docs, "conv_id", "document", ["of"], top=1)
    return search.conversation_of_best(rows, best, "conv_id").select("conv_id", "turn", F.sha2("text", 256).alias("text"))


# ---- sets, numbers, writes -----------------------------------------------------------------------------------------


@query("SELECT o_custkey, string_agg(k::VARCHAR, ',' ORDER BY k) AS users FROM (SELECT DISTINCT o_custkey, unnest([o_orderkey % 5, o_orderkey % 3 + 10]) AS k FROM orders) WHERE k <> 11 GROUP BY 1")
def set_updates(spark, d):
    """Sets united, and one member taken out."""
    own = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 5).alias("a"), F.collect_set(F.col("o_orderkey") % 3 + 10).alias("b"))
    return own.select("o_custkey", _TEXT(F.array_sort(upserts.updated(F.col("a"), F.col("b"), F.array(F.lit(11).cast("long"))))).alias("users"))


@query("SELECT c_custkey, array_to_string(list_slice(parts, 1, 3), ' ') || CASE WHEN len(parts) > 3 THEN ' +' || (len(parts) - 3) ELSE '' END AS shown FROM (SELECT c_custkey, list_transform(range(0, c_custkey % 7), lambda i: 'n' || i) AS parts FROM customer)")
def truncated_lists(spark, d):
    """The first three and how many more."""
    k = F.col("c_custkey") % 7
    parts = F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.concat(F.lit("n"), i))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select("c_custkey", S.shortened(parts, 3).alias("shown"))


@query("SELECT event_id, greatest(least(value, 80.0), 10.0) AS clamped, least(value, 55.5) AS low FROM events")
def clamped_values(spark, d):
    return table(spark, d, "events").select("event_id", M.clamp(F.col("value"), 10.0, 80.0).alias("clamped"), F.least("value", F.lit(55.5)).alias("low"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey % 2 <> 0")
def children_of_new(spark, d):
    """Lines of the orders that an insert-or-ignore would insert."""
    orders = table(spark, d, "orders").select("o_orderkey")
    new = upserts.new_rows(orders.where("o_orderkey % 3 = 0"), orders.where("o_orderkey % 2 = 0"), ["o_orderkey"], ["o_orderkey"])
    return upserts.children_of(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), new, ["o_orderkey"]).select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber")


@query(f"WITH {PLAYERS}, {_AVG}, r AS (" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS r FROM averages WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in [("kills", "eff"), ("kills", "damage"), ("eff", "damage")]) + ") SELECT x, y, round(r, 6) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' WHEN abs(r) > 0.2 THEN 'weak' ELSE 'none' END AS strength, rank() OVER (ORDER BY abs(r) DESC)::BIGINT AS place FROM r")
def correlation_ranking(spark, d):
    from pyspark.sql import Window as W

    rows = profiles.correlations(_averages(spark, d), ["kills", "eff", "damage"])
    # a row per pair of measures: as many as are asked for
    return rows.select("x", "y", F.round("r", 6).alias("r"), profiles.strength(F.col("r")).alias("strength"), F.rank().over(W.orderBy(F.desc(F.abs("r")))).cast("long").alias("place"))


@query(f"WITH {PLAYERS}, {_AVG} SELECT name, eff FROM averages ORDER BY eff, name LIMIT 5")
def bottom_five(spark, d):
    """The last five (the feature) by efficiency."""
    return _averages(spark, d).orderBy("eff", "name").limit(5).select("name", "eff")


@query(f"WITH {GAMES}, {SIDES}, r AS (SELECT team, floor(100.0 * count_if(own > other) / count(*) + 0.5)::INT AS win_pct, count(*)::BIGINT AS games FROM sides GROUP BY 1) SELECT *, row_number() OVER (ORDER BY win_pct DESC, games DESC, team)::BIGINT AS place FROM r ORDER BY place LIMIT 8")
def sorted_by_two(spark, d):
    """The first eight (the feature) teams by win rate, then games."""
    top = history.record(matches.both_sides(games(spark, d)), ["team"]).select("team", F.col("win_rate").alias("win_pct"), "games").orderBy(F.desc("win_pct"), F.desc("games"), "team").limit(8)
    return profiles.top_per_group(top.withColumn("_all", F.lit(1)), ["_all"], [F.desc("win_pct"), F.desc("games"), F.col("team")], 8).drop("_all")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c), q AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS q FROM events GROUP BY 1),
k AS (SELECT u.user_id, q.event_type, coalesce(p, 0) AS p, q FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN q LEFT JOIN p ON p.user_id = u.user_id AND p.event_type = q.event_type)
SELECT user_id, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) / 2 ELSE 0 END + q * ln(q / ((p + q) / 2)) / 2), 9) AS divergence FROM k GROUP BY 1""")
def profile_divergence(spark, d):
    """How far each user's kinds of events are from those of all: Jensen-Shannon."""
    rows, kinds = table(spark, d, "events"), ["click", "error", "purchase", "signup", "view"]
    shares = F.array(*[F.avg((F.col("event_type") == k).cast("double")) for k in kinds])
    every = rows.agg(shares.alias("q"))
    return rows.groupBy("user_id").agg(shares.alias("p")).join(F.broadcast(every)).select("user_id", F.round(identity.divergence(F.col("p"), F.col("q")), 9).alias("divergence"))


@query("""WITH p AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b, left(x.p_brand, 7) = left(y.p_brand, 7) AS brand, x.p_size = y.p_size AS size FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_partkey < y.p_partkey),
w AS (SELECT a, brand, size, CASE WHEN brand THEN log2(0.9 / 0.05) ELSE log2((1 - 0.9) / (1 - 0.05)) END + CASE WHEN size THEN log2(0.8 / 0.02) ELSE log2((1 - 0.8) / (1 - 0.02)) END AS weight FROM p GROUP BY ALL)
SELECT a, brand, size, round(weight, 9) AS weight, CASE WHEN 0.01 * 2 ** weight / (1 - 0.01 + 0.01 * 2 ** weight) >= 0.95 THEN 'same' WHEN 0.01 * 2 ** weight / (1 - 0.01 + 0.01 * 2 ** weight) >= 0.7 THEN 'maybe' ELSE 'other' END AS band FROM w""")
def linkage_weights(spark, d):
    """Pairs of parts of one name, by whether brand and size agree."""
    # parts that agree in all that is compared are one row: some pair of two such rows is in order if the least key and the greatest are
    part = table(spark, d, "part").select("p_partkey", "p_name", F.substring("p_brand", 1, 7).alias("brand"), "p_size")
    x = part.groupBy("p_name", "brand", "p_size").agg(F.min("p_partkey").alias("p_partkey"))
    y = part.groupBy("p_name", F.col("brand").alias("b2"), F.col("p_size").alias("s2")).agg(F.max("p_partkey").alias("k2"))
    pairs = x.join(y, "p_name").where("p_partkey < k2").select(F.col("p_name").alias("a"), (F.col("brand") == F.col("b2")).alias("brand"), (F.col("p_size") == F.col("s2")).alias("size")).distinct()
    weight = identity.link_weight({"brand": (0.9, 0.05), "size": (0.8, 0.02)})
    return pairs.select("a", "brand", "size", F.round(weight, 9).alias("weight"), identity.link_band(weight, 0.01).alias("band"))


@query(f"""WITH RECURSIVE {GAMES}, o AS (SELECT *, row_number() OVER () AS row FROM games), x AS (SELECT row, player, sum(s) AS s FROM (SELECT row, team_a AS player, 1.0 AS s FROM o UNION ALL SELECT row, team_b, -1.0 FROM o) GROUP BY ALL HAVING sum(s) <> 0),
n AS (SELECT player, row_number() OVER (ORDER BY player) AS i FROM (SELECT DISTINCT player FROM x)), c AS (SELECT n.i, x.row, x.s, frags_a - frags_b AS diff FROM x JOIN n USING (player) JOIN o USING (row)),
a AS (SELECT p.i, q.i AS j, sum(p.s * q.s) AS v FROM c p JOIN c q USING (row) GROUP BY ALL), b AS (SELECT i, sum(s * diff) AS v FROM c GROUP BY 1),
r AS (SELECT p.i, list(coalesce(a.v, 0)::DOUBLE + CASE WHEN p.i = q.i THEN 10.0 ELSE 0.0 END ORDER BY q.i) AS r FROM n p CROSS JOIN n q LEFT JOIN a ON a.i = p.i AND a.j = q.i GROUP BY 1),
g AS (SELECT 0::BIGINT AS k, list(list_append(r.r, b.v::DOUBLE) ORDER BY i) AS m FROM r JOIN b USING (i)
UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / r[k + 1]) ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM g WHERE k < len(m))
SELECT player, round(m[i][-1], 6) AS strength FROM n, g WHERE k = len(m)""")
def ridge_lineups(spark, d):
    """Strength of twenty teams from the score differences of all games, by ridge regression; the SQL solves the normal equations."""
    from skirmish.operators import ratings

    found = ratings.ridge(games(spark, d).select(F.array("team_a").alias("side_a"), F.array("team_b").alias("side_b"), (F.col("frags_a") - F.col("frags_b")).alias("diff")), 10.0)
    return found.select("player", F.round("strength", 6).alias("strength"))
