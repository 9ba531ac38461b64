"""Reading match documents: one JSON file per match, players nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.strings import normalize_name, to_ascii
from skirmish.operators import validity

WEAPON = "STRUCT<acc: STRUCT<attacks: INT, hits: INT>, damage: STRUCT<enemy: INT>, kills: STRUCT<enemy: INT>>"
MATCH = f"""date STRING, map STRING, hostname STRING, matchtag STRING, mode STRING, duration INT, tl INT, teams ARRAY<STRING>,
players ARRAY<STRUCT<name: STRING, team: STRING, ping: INT, login: STRING,
  stats: STRUCT<frags: INT, kills: INT, deaths: INT, tk: INT, suicides: INT, `spawn-frags`: INT>,
  dmg: STRUCT<given: INT, taken: INT, team: INT, self: INT, `enemy-weapons`: INT, `taken-to-die`: DOUBLE>, xferRL: INT, xferLG: INT,
  spree: STRUCT<max: INT, quad: INT>, speed: STRUCT<avg: DOUBLE, max: DOUBLE>,
  weapons: MAP<STRING, {WEAPON}>, items: MAP<STRING, STRUCT<took: INT, time: INT>>>>"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents with ``sha256``, the name of each one's file. Files that don't parse give nulls."""
    rows = spark.read.schema(MATCH).option("multiLine", True).json(path)
    return rows.withColumn("sha256", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.mvd\.ktxstats)?\.json$", 1))


def games(documents: DataFrame) -> DataFrame:
    """One row per document that has a time and two teams or more, with team frags summed over the players."""
    frags = lambda t: F.aggregate(F.filter("players", lambda p: p["team"] == t), F.lit(0), lambda n, p: n + F.coalesce(p["stats"]["frags"], F.lit(0)))
    rows = documents.where(F.size("teams") >= 2).withColumn("played_at", F.try_to_timestamp(F.substring("date", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))
    a, b = F.get("teams", 0), F.get("teams", 1)
    return rows.where("played_at IS NOT NULL").select(
        "sha256", "played_at", "map", "hostname", "matchtag", "mode", "duration", F.col("tl").alias("timelimit"),
        a.alias("team_a"), b.alias("team_b"), frags(a).alias("frags_a"), frags(b).alias("frags_b"), F.size("players").alias("player_count"),
    )


def players(documents: DataFrame) -> DataFrame:
    """One row per player of each document. A weapon's accuracy is in percent, to one decimal, halves up."""
    rows = documents.select("sha256", F.explode("players").alias("p"))
    hit = lambda w: F.when(F.col(f"p.weapons.{w}.acc.attacks") > 0, F.floor(1000 * F.col(f"p.weapons.{w}.acc.hits") / F.col(f"p.weapons.{w}.acc.attacks") + 0.5) / 10)
    return rows.select(
        "sha256", "p.name", "p.team", "p.ping", "p.login", "p.stats.frags", "p.stats.kills", "p.stats.deaths", "p.stats.tk", "p.stats.suicides",
        F.col("p.dmg.given").alias("dmg_given"), F.col("p.dmg.taken").alias("dmg_taken"), F.col("p.dmg.taken-to-die").alias("taken_to_die"),
        *[hit(w).alias(f"{w}_acc") for w in ("sg", "rl", "lg")], F.col("p.items.q.took").alias("quad_took"),
    )


#: Where the numbers of a player's row are found in a document; what is missing counts as 0. A dash is part of a name.
NUMBERS = {
    **{c: f"stats.{c}" for c in ("frags", "kills", "deaths", "tk", "suicides")}, "spawn_frags": "stats.spawn-frags",
    "dmg_given": "dmg.given", "dmg_taken": "dmg.taken", "dmg_team": "dmg.team", "dmg_self": "dmg.self", "dmg_enemy_weapons": "dmg.enemy-weapons", "taken_to_die": "dmg.taken-to-die",
    "spree_max": "spree.max", "spree_quad": "spree.quad", "speed_avg": "speed.avg", "speed_max": "speed.max", "xfer_rl": "xferRL", "xfer_lg": "xferLG",
}
#: Weapons with an accuracy, the others with attacks, and the items by their keys, with a time or without.
ACCURATE, WEAPONS, TIMED = ("sg", "rl", "lg"), ("sg", "rl", "lg", "gl", "ssg"), {"ya": "ya", "ra": "ra", "ga": "ga", "quad": "q", "pent": "p", "ring": "r"}


def _number(path: str) -> Column:
    value = F.col("p")
    for part in path.split("."):
        value = value[part]
    return F.coalesce(value, F.lit(0))


def _weapon(weapon: str) -> dict[str, Column]:
    w = F.col("p.weapons")[weapon]
    attacks, hits = (F.coalesce(w["acc"][c], F.lit(0)) for c in ("attacks", "hits"))
    out = {f"{weapon}_attacks": attacks, f"{weapon}_hits": hits}
    if weapon in ACCURATE:
        out[f"{weapon}_acc"] = F.when(attacks > 0, F.floor(1000 * hits / attacks + 0.5) / 10).otherwise(F.lit(0.0))
    return out | {f"{weapon}_dmg": F.coalesce(w["damage"]["enemy"], F.lit(0))}


def match_tables(documents: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The games and their players, a row each, with all columns; texts that are missing are empty, numbers 0.

    Players with a ping of 0 are bogus and left out. strict: eight players are left, the mode is team, it took 600 seconds or
    more, and there are two teams. Otherwise two players are enough, and teams that are missing are empty. A document of
    which nothing could be read fits neither. won is false for both sides of a draw. A player's row carries the game's sha256.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = documents.withColumn("players", validity.active_players(F.col("players")))
    fits = validity.is_valid(F.col("players"), F.col("mode"), F.col("duration"), F.col("teams")) if strict else (F.size("players") >= 2)
    a, b = text(F.get("teams", 0)), text(F.get("teams", 1))
    frags = lambda t: F.aggregate(F.filter("players", lambda p: text(p["team"]) == t), F.lit(0), lambda n, p: n + F.coalesce(p["stats"]["frags"], F.lit(0)))
    rows = rows.where(F.coalesce(fits, F.lit(False))).withColumns({"team_a": a, "team_b": b, "team_a_frags": frags(a), "team_b_frags": frags(b)})
    lower_ascii = lambda c: F.lower(to_ascii(c))
    rows = rows.withColumns({"team_a_ascii": lower_ascii(F.col("team_a")), "team_b_ascii": lower_ascii(F.col("team_b"))})
    winner = F.when(F.col("team_a_frags") > F.col("team_b_frags"), F.col("team_a")).when(F.col("team_b_frags") > F.col("team_a_frags"), F.col("team_b"))
    clan = (F.col("team_a") != "") & (F.col("team_b") != "") & validity.is_clan_game(F.col("team_a_ascii"), F.col("team_b_ascii"))
    played = F.coalesce(F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp(F.substring("date", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))
    games = rows.select(
        "sha256", played.alias("played_at"), F.coalesce("map", F.lit("unknown")).alias("map"), "hostname", "matchtag", "mode", "duration", F.nullif("tl", F.lit(0)).alias("timelimit"), "team_a", "team_b", "team_a_ascii", "team_b_ascii",
        "team_a_frags", "team_b_frags", F.size("players").alias("player_count"), clan.alias("is_clan_game"),
    )
    own = rows.select("sha256", winner.alias("_winner"), F.explode("players").alias("p"))
    name = to_ascii(text(F.col("p.name")))
    columns = {"player_name_raw": text(F.col("p.name")), "player_name_ascii": name, "player_name_normalized": normalize_name(name), "team": text(F.col("p.team")), "team_ascii": lower_ascii(text(F.col("p.team")))}
    columns |= {"ping": F.coalesce("p.ping", F.lit(0)), "login": text(F.col("p.login"))} | {c: _number(p) for c, p in NUMBERS.items()}
    for weapon in WEAPONS:
        columns |= _weapon(weapon)
    item = lambda key, what: F.coalesce(F.col("p.items")[key][what], F.lit(0))
    columns["health_100"] = item("health_100", "took")
    for column, key in TIMED.items():
        columns |= {f"{column}_took": item(key, "took"), f"{column}_time": item(key, "time")}
    columns["won"] = F.coalesce(text(F.col("p.team")) == F.col("_winner"), F.lit(False))
    return games, own.select("sha256", *[c.alias(n) for n, c in columns.items()])
