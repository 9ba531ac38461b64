"""A team's past games: breakdowns, form, highlights, lookups by tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skirmish.functions.numbers import half_up


def recent_form(rows: DataFrame, by: list[str], order: list[Column], result: str, n: int = 5) -> DataFrame:
    """``form``: the results of the first n rows of each key in the order, as one string."""
    placed = rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)
    held = F.array_sort(F.collect_list(F.struct("_n", F.col(result).alias("r"))))
    return placed.groupBy(*by).agg(F.array_join(F.transform(held, lambda x: x["r"]), "").alias("form"))


def breakdown(games: DataFrame, by: str) -> DataFrame:
    """Games, wins, losses, rates and mean difference per map or opponent, with the form of the first five games.

    games: of matches.seen_from(). The rates count draws as games. The reference list is newest first and its last five
    are shown, so the form is that of the oldest games, oldest first.
    """
    own = games.groupBy(by).agg(F.count("*").alias("games"), F.count_if(F.col("result") == "W").alias("wins"), F.count_if(F.col("result") == "L").alias("losses"), F.sum(F.col("own") - F.col("other")).alias("_diff"))
    rate = lambda c: half_up(100.0 * F.col(c) / F.col("games")).cast("int")
    own = own.withColumns({"win_pct": rate("wins"), "loss_pct": rate("losses"), "avg_diff": half_up(F.col("_diff") / F.col("games")).cast("int")}).drop("_diff")
    return own.join(recent_form(games, [by], [F.col("played_at"), F.col("id")], "result"), by)


def record(games: DataFrame, by: list[str]) -> DataFrame:
    """Games, wins, losses, draws and the share of wins, draws included."""
    won = lambda r: F.count_if(F.col("result") == r)
    return games.groupBy(*by).agg(F.count("*").alias("games"), won("W").alias("wins"), won("L").alias("losses"), won("D").alias("draws"), half_up(100.0 * won("W") / F.count("*")).cast("int").alias("win_rate"))


def unique_tops(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Adds ``top_`` columns: the row holds the greatest value of its group, above 0, alone."""
    own = W.partitionBy(*by)
    df = rows.withColumns({f"_m_{m}": F.max(m).over(own) for m in measures})
    df = df.withColumns({f"top_{m}": F.coalesce((F.col(m) > 0) & (F.col(m) == F.col(f"_m_{m}")) & (F.count_if(F.col(m) == F.col(f"_m_{m}")).over(own) == 1), F.lit(False)) for m in measures})
    return df.drop(*[f"_m_{m}" for m in measures])


def not_played_that_day(fixtures: DataFrame, games: DataFrame) -> DataFrame:
    """Fixtures whose two teams, either way round, have no game on that day. Both: team_a, team_b, played_at."""
    key = [F.to_date("played_at").alias("_day"), F.least("team_a", "team_b").alias("_x"), F.greatest("team_a", "team_b").alias("_y")]
    return fixtures.select("*", *key).join(games.select(*key).distinct(), ["_day", "_x", "_y"], "left_anti").drop("_day", "_x", "_y")


def known_opponents(teams: DataFrame, opponents: DataFrame) -> DataFrame:
    """Teams with the record of the first of their tags that occurs among the opponents.

    teams: team, tags in order. opponents: opponent and further columns, one row each.
    """
    tags = teams.select("team", F.posexplode("tags").alias("_at", "opponent"))
    met = tags.join(opponents, "opponent")
    rest = [c for c in opponents.columns if c != "opponent"]
    return met.groupBy("team").agg(F.min_by(F.struct("opponent", *rest), "_at").alias("_o")).select("team", "_o.*")


def looked_up(rows: DataFrame, name: str, table: DataFrame, key: str) -> DataFrame:
    """rows with table's columns by the name, letters' case aside, and ``matched``. table: one row per key in lower case."""
    known = table.withColumn("_key", F.lower(key)).withColumn("_there", F.lit(True))
    return rows.join(known, F.lower(F.col(name)) == F.col("_key"), "left").withColumn("matched", F.coalesce("_there", F.lit(False))).drop("_key", "_there")


def primary_teams(memberships: DataFrame) -> DataFrame:
    """Teams of each user in the order of joining, and the first as ``primary``. memberships: user, team, joined_at."""
    own = memberships.groupBy("user", "team").agg(F.min("joined_at").alias("joined_at"))
    held = F.array_sort(F.collect_list(F.struct("joined_at", "team")))
    return own.groupBy("user").agg(F.transform(held, lambda x: x["team"]).alias("teams")).withColumn("primary", F.get("teams", 0))


def most_children(rows: DataFrame, within: str, parent: str) -> DataFrame:
    """The parent of most rows within each group, the least of ties; null parents don't count."""
    counts = rows.where(F.col(parent).isNotNull()).groupBy(within, parent).agg(F.count("*").alias("n"))
    return counts.groupBy(within).agg(F.max("n").alias("n"), F.min_by(parent, F.struct(-F.col("n"), F.col(parent))).alias(parent))


def series(recordings: DataFrame, position: str | None = None) -> DataFrame:
    """Recordings of a session against one opponent: maps in order, map wins of both sides (draws are neither), whether all are
    whole. recordings: id, session (null: a series of its own), opponent, started_at, map, result, whole. position: a column
    that puts recordings of one id and time in order; else their maps do."""
    key = F.coalesce(F.col("session"), F.concat(F.lit("alone-"), F.col("id").cast("string")))
    order = ["started_at", "id"] if position is None else ["started_at", "id", position]
    maps = F.transform(F.array_sort(F.collect_list(F.struct(*order, "map"))), lambda x: x["map"])
    return recordings.groupBy(key.alias("series"), "opponent").agg(
        F.array_join(maps, ",").alias("maps"), F.count_if(F.col("result") == "W").alias("won"), F.count_if(F.col("result") == "L").alias("lost"), F.bool_and("whole").alias("whole"), F.max("started_at").alias("last_at")
    )


def duplicate_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Names, letters' case aside, of several rows, and these rows' keys."""
    return rows.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("keys")).where("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows that refer to a parent which isn't there; null refers to none."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def filtered(games: DataFrame, map_name: str | None = None, opponent: str | None = None, recorded: DataFrame | None = None) -> DataFrame:
    """games (id, map, opponent) on a map, against an opponent, and with a recording; what is None is not asked for.

    recorded: ids that have one; repeated and null ids don't matter.
    """
    rows = games if map_name is None else games.where(F.col("map") == map_name)
    rows = rows if opponent is None else rows.where(F.col("opponent") == opponent)
    return rows if recorded is None else rows.join(recorded.select("id"), "id", "left_semi")


def recording_counts(sessions: DataFrame, recordings: DataFrame) -> DataFrame:
    """team, ``sessions`` (completed ones), ``uploaded`` (distinct sessions with a recording) and ``maps`` (recordings).

    sessions: team, status; recordings: team, session. Both are summed by team before they are merged, and a team that only one of
    them has counts 0 in the other. Rows without a team are left out; a recording without a session counts as a map only.
    """
    held = sessions.where("team IS NOT NULL AND status = 'completed'").groupBy("team").agg(F.count("*").alias("sessions"))
    made = recordings.where("team IS NOT NULL").groupBy("team").agg(F.count_distinct("session").alias("uploaded"), F.count("*").alias("maps"))
    return held.join(made, "team", "full").select("team", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "uploaded", "maps")])
