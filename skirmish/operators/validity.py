"""Which matches count, and what kind of game they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags of teams that are no clans, plain and in lower case; and the shorter list of the game classes.
GENERIC_TAGS = (
    "blue red green yellow team1 team2 pink brown brwn brw orange oran orng violet vio purple white black teal gold wine plum mint snow "
    "lime sky skyb skyblue bleu grn gree yllw ylw brow mix mix1 mix2 m1x t1 t2 1 2 11 0 000 lol asdf xxx xx x zzz zz 666 69 99 999 123 "
    "1337 4 7777 555 98 pug quad pent test afk"
).split() + [""]
MIXED_TAGS = (
    "red blue green yellow pink brown brwn brw orange oran orng violet vio purple white black teal gold wine plum mint snow lime sky skyb "
    "skyblue bleu mix mix1 mix2 m1x t1 t2 1 2 11 team1 team2 test"
).split() + [""]
# The maps of competitive games.
COMPETITION_MAPS = ["dm2", "dm3", "e1m2", "schloss", "phantombase"]


def is_generic(tag: Column) -> Column:
    return F.coalesce(tag, F.lit("")).isin(GENERIC_TAGS)


def is_clan_game(tag_a: Column, tag_b: Column) -> Column:
    """Neither tag, plain and in lower case, is generic."""
    return ~is_generic(tag_a) & ~is_generic(tag_b)


def tag_class(tag: Column) -> Column:
    """generic, mix-ish (it says mix) or clan."""
    plain = F.trim(F.lower(F.coalesce(tag, F.lit(""))))
    return F.when(plain.isin(MIXED_TAGS), "generic").when(F.contains(plain, F.lit("mix")), "mix-ish").otherwise("clan")


def game_class(tag_a: Column, tag_b: Column) -> Column:
    """clan_vs_clan, pure_mix (both generic) or hybrid."""
    a, b = tag_class(tag_a), tag_class(tag_b)
    return F.when((a == "clan") & (b == "clan"), "clan_vs_clan").when((a == "generic") & (b == "generic"), "pure_mix").otherwise("hybrid")


def active_players(players: Column) -> Column:
    """Players without a ping of 0; a missing ping is not 0."""
    return F.filter(players, lambda p: F.coalesce(p["ping"], F.lit(-1)) != 0)


def is_valid(players: Column, mode: Column, duration: Column, teams: Column, needed: int = 8, least_seconds: int = 600) -> Column:
    """Two players or more, as many active ones as needed, team mode, long enough, two teams."""
    ok = (F.size(players) >= 2) & (F.size(active_players(players)) == needed) & (mode == "team") & (duration >= least_seconds) & (F.size(teams) >= 2)
    return F.coalesce(ok, F.lit(False))


def in_competition(games: DataFrame, maps: list[str] = COMPETITION_MAPS, players: int = 8, least_seconds: int = 600) -> DataFrame:
    """games: player_count, mode, map, duration."""
    return games.where((F.col("player_count") == players) & (F.col("mode") == "team") & F.col("map").isin(maps) & (F.col("duration") >= least_seconds))
