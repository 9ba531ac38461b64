"""Match statistics: perspectives, head-to-head, opponents, maps, rosters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions.numbers import half_up, ratio


def both_sides(games: DataFrame) -> DataFrame:
    """Each game once per side: ``team``, ``opponent``, ``own``, ``other`` (scores), ``result`` (W, L, D). One scan."""
    side = lambda a, b: F.struct(F.col(f"team_{a}").alias("team"), F.col(f"team_{b}").alias("opponent"), F.col(f"frags_{a}").alias("own"), F.col(f"frags_{b}").alias("other"))
    rows = games.withColumn("_side", F.explode(F.array(side("a", "b"), side("b", "a")))).select("*", "_side.*").drop("_side", "team_a", "team_b", "frags_a", "frags_b")
    return rows.withColumn("result", outcome(F.col("own"), F.col("other")))


def outcome(own: Column, other: Column) -> Column:
    return F.when(own > other, "W").when(own < other, "L").otherwise("D")


def _is_ours(side: str, tags: list[str]) -> Column:
    return F.col(f"team_{side}").isin(tags)


def seen_from(games: DataFrame, tags: list[str]) -> DataFrame:
    """Games of a tag list from its side: A if A's tag is listed, else B. Adds team, opponent, own, other, result."""
    a = _is_ours("a", tags)
    pick = lambda x, y: F.when(a, F.col(x)).otherwise(F.col(y))
    df = games.where(a | _is_ours("b", tags)).withColumns({
        "team": pick("team_a", "team_b"), "opponent": pick("team_b", "team_a"), "own": pick("frags_a", "frags_b"), "other": pick("frags_b", "frags_a"),
    })
    return df.withColumn("result", outcome(F.col("own"), F.col("other")))


def _won_lost(tags: list[str]) -> tuple[Column, Column]:
    """Wins and losses by either side: a game between two listed tags is both."""
    a, b = _is_ours("a", tags), _is_ours("b", tags)
    up, down = F.col("frags_a") > F.col("frags_b"), F.col("frags_a") < F.col("frags_b")
    return F.count_if((a & up) | (b & down)), F.count_if((a & down) | (b & up))


def opponents(games: DataFrame, tags: list[str]) -> DataFrame:
    """Games, wins and losses per opponent. A draw is neither."""
    wins, losses = _won_lost(tags)
    mine = games.where(_is_ours("a", tags) | _is_ours("b", tags)).withColumn("opponent", F.when(_is_ours("a", tags), F.col("team_b")).otherwise(F.col("team_a")))
    return mine.groupBy("opponent").agg(F.count("*").alias("games"), wins.alias("wins"), losses.alias("losses"))


def maps(games: DataFrame, tags: list[str], versus: list[str] | None = None) -> DataFrame:
    """Games, wins, losses, mean score difference (one digit) and win rate per map; versus must be on either side."""
    mine = games.where(_is_ours("a", tags) | _is_ours("b", tags))
    if versus:
        mine = mine.where(_is_ours("a", versus) | _is_ours("b", versus))
    wins, losses = _won_lost(tags)
    diff = F.when(_is_ours("a", tags), F.col("frags_a") - F.col("frags_b")).otherwise(F.col("frags_b") - F.col("frags_a"))
    out = mine.groupBy("map").agg(F.count("*").alias("games"), wins.alias("wins"), losses.alias("losses"), F.round(F.avg(diff), 1).alias("avg_diff"))
    return out.withColumn("win_rate", half_up(100.0 * F.col("wins") / F.col("games")).cast("int"))


def team_maps(games: DataFrame) -> DataFrame:
    """Record per team and map over both sides, draws apart."""
    return both_sides(games).groupBy("team", "map").agg(
        F.count("*").alias("games"), F.count_if(F.col("result") == "W").alias("wins"), F.count_if(F.col("result") == "L").alias("losses"), F.count_if(F.col("result") == "D").alias("draws"),
        F.round(F.avg(F.col("own") - F.col("other")), 1).alias("avg_diff"), F.max("played_at").alias("last_played"),
    )


def opponent_record(games: DataFrame) -> DataFrame:
    return both_sides(games).groupBy("team", "opponent").agg(
        F.count("*").alias("games"), F.count_if(F.col("result") == "W").alias("wins"), F.count_if(F.col("result") == "L").alias("losses"), F.count_if(F.col("result") == "D").alias("draws")
    )


def head_to_head(games: DataFrame, ours: list[str], theirs: list[str], game_map: str | None = None, since: Column | None = None, limit: int = 10) -> DataFrame:
    """The latest games between two tag lists, from the first one's side."""
    pair = (_is_ours("a", ours) & _is_ours("b", theirs)) | (_is_ours("a", theirs) & _is_ours("b", ours))
    return _latest(seen_from(games.where(pair), ours), game_map, since, limit)


def form(games: DataFrame, tags: list[str], game_map: str | None = None, since: Column | None = None, limit: int = 10) -> DataFrame:
    return _latest(seen_from(games, tags), game_map, since, limit)


def _latest(games: DataFrame, game_map: str | None, since: Column | None, limit: int) -> DataFrame:
    if game_map is not None:
        games = games.where(F.col("map") == game_map)
    if since is not None:
        games = games.where(F.col("played_at") >= since)
    return games.select("id", "played_at", "map", "team", "opponent", "own", "other", "result").orderBy(F.desc("played_at"), F.desc("id")).limit(limit)


def efficiency(kills: Column, deaths: Column) -> Column:
    """Percent; 0 without kills and deaths. Average it per game, don't take it of sums."""
    return ratio(kills.cast("double"), kills + deaths, 100.0)


def roster(games: DataFrame, players: DataFrame, key: str = "name") -> DataFrame:
    """Activity per player: games, wins, mean efficiency, mean damage, last game."""
    both = players.join(games.select(F.col("id").alias("game_id"), "played_at"), "game_id")
    return both.groupBy(key).agg(
        F.count_distinct("game_id").alias("games"), F.count_if("won").alias("wins"), F.round(F.avg(efficiency(F.col("kills"), F.col("deaths"))), 1).alias("avg_eff"),
        F.round(F.avg("damage"), 0).alias("avg_damage"), F.max("played_at").alias("last_played"),
    )


def scoreboard(players: DataFrame, team: str = "team") -> DataFrame:
    """Team rows of a scoreboard: sums, and ratios of the sums."""
    out = players.groupBy("game_id", team).agg(F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"), F.sum("damage").alias("damage"))
    return out.withColumn("eff", F.round(efficiency(F.col("kills"), F.col("deaths")), 1))


def compare_maps(first: DataFrame, second: DataFrame, tags: tuple[str, str]) -> DataFrame:
    """Two map records side by side, maps of either, with a note on who is ahead; a side without games has a null rate."""
    x = first.select("map", F.col("games").alias("games_1"), F.col("wins").alias("wins_1"))
    y = second.select("map", F.col("games").alias("games_2"), F.col("wins").alias("wins_2"))
    df = x.join(y, "map", "full").na.fill(0)
    rate = lambda k: F.when(F.col(f"games_{k}") > 0, half_up(100.0 * F.col(f"wins_{k}") / F.col(f"games_{k}")).cast("int"))
    df = df.withColumns({"rate_1": rate(1), "rate_2": rate(2), "games": F.col("games_1") + F.col("games_2")})
    a, b, (one, two) = F.col("rate_1"), F.col("rate_2"), tags
    # The notes, their thresholds and their order.
    note = (
        F.when(a.isNull(), f"{two} plays, {one} doesn't").when(b.isNull(), f"{one} plays, {two} doesn't")
        .when((a >= 60) & (b >= 60), "Both teams strong")
        .when(a - b >= 30, f"{one} dominates").when(b - a >= 30, f"{two} dominates")
        .when(a - b >= 15, f"{one} favors").when(b - a >= 15, f"{two} favors")
        .when((a < 40) & (b < 40), "Neither team favors").otherwise("Even")
    )
    return df.withColumn("note", note)


def overtime(games: DataFrame, yes: bool = True) -> DataFrame:
    """Games that ran over (or not); a game without a time limit is in neither."""
    over = F.col("duration") > F.col("timelimit") * 60 + 30
    return games.where(over if yes else ~over)


def _record() -> list[Column]:
    won = lambda r: F.count_if(F.col("result") == r)
    return [F.count("*").alias("games"), won("W").alias("wins"), won("L").alias("losses"), won("D").alias("draws"), F.round(100.0 * won("W") / F.count("*"), 1).alias("win_pct"), F.round(F.avg(F.col("own") - F.col("other")), 1).alias("avg_diff")]


def team_map_stats(games: DataFrame) -> DataFrame:
    """Per team, map and clan flag. games: with is_clan."""
    return both_sides(games).groupBy("team", "map", "is_clan").agg(*_record(), F.round(F.avg("own"), 0).alias("avg_frags"), F.round(F.avg("other"), 0).alias("avg_other"), F.max("played_at").alias("last_played"))


def opponent_stats(games: DataFrame) -> DataFrame:
    """Per team, opponent and clan flag."""
    return both_sides(games).groupBy("team", "opponent", "is_clan").agg(*_record(), F.min("played_at").alias("first_played"), F.max("played_at").alias("last_played"))


def roster_stats(players: DataFrame, games: DataFrame) -> DataFrame:
    """Per team, clan flag and player. games: id, played_at, is_clan. An accuracy is null where there were no shots."""
    both = players.join(games.select(F.col("id").alias("game_id"), "played_at", "is_clan"), "game_id")
    return both.groupBy("team", "is_clan", "name").agg(
        F.count("*").alias("games"), F.count_if("won").alias("wins"), F.round(100.0 * F.count_if("won") / F.count("*"), 1).alias("win_pct"),
        F.round(F.avg(efficiency(F.col("kills"), F.col("deaths"))), 1).alias("avg_eff"), F.round(F.avg("damage"), 0).alias("avg_damage"), F.round(F.avg("kills"), 1).alias("avg_kills"),
        F.round(F.avg("deaths"), 1).alias("avg_deaths"), F.round(F.avg("accuracy"), 1).alias("avg_accuracy"), F.min("played_at").alias("first_game"), F.max("played_at").alias("last_game"),
    )


def weighted_means(rows: DataFrame, by: list[str], weight: str, means: list[str]) -> DataFrame:
    """Means of means, by their numbers of games; null without games."""
    total = F.sum(weight)
    return rows.groupBy(*by).agg(total.alias(weight), *[F.try_divide(F.sum(F.col(m) * F.col(weight)), F.nullif(total, F.lit(0))).alias(m) for m in means])


def top_teams(games: DataFrame, least: int = 3) -> DataFrame:
    """Teams by win rate, then games: each side's means are rounded, and need enough games, before both sides are merged."""
    sides = games.select(F.explode(F.array(*[F.struct(F.lit(a).alias("side"), F.col(f"team_{a}").alias("team"), F.col(f"frags_{a}").alias("own"), F.col(f"frags_{b}").alias("other")) for a, b in ("ab", "ba")])).alias("s")).select("s.*")
    one = sides.groupBy("side", "team").agg(F.count("*").alias("games"), F.count_if(F.col("own") > F.col("other")).alias("wins"), F.round(F.avg("own"), 0).alias("frags"), F.round(F.avg(F.col("own") - F.col("other")), 0).alias("diff")).where(F.col("games") >= least)
    both = one.groupBy("team").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins"), F.sum(F.col("frags") * F.col("games")).alias("frags"), F.sum(F.col("diff") * F.col("games")).alias("diff"))
    mean = lambda c: half_up(F.col(c) / F.col("games")).cast("int")
    return both.select("team", "games", "wins", half_up(100.0 * F.col("wins") / F.col("games")).cast("int").alias("win_pct"), mean("frags").alias("avg_frags"), mean("diff").alias("avg_diff"))


def tag_counts(games: DataFrame, plain: Callable[[Column], Column]) -> DataFrame:
    """How often each tag, in plain characters, plays on either side."""
    tags = games.select(F.explode(F.array("team_a", "team_b")).alias("tag"))
    return tags.groupBy(plain(F.col("tag")).alias("tag")).agg(F.count("*").alias("games"))


def tag_forms(games: DataFrame, columns: list[str]) -> DataFrame:
    """The spellings of each tag, letters aside, over several columns."""
    forms = games.select(F.explode(F.array(*[F.struct(F.lit(c).alias("place"), F.col(c).alias("form")) for c in columns])).alias("f")).select("f.*")
    return forms.groupBy(F.lower("form").alias("tag"), "form", "place").agg(F.count("*").alias("n"))


def little_damage(players: DataFrame, name: str, damage: str, least_games: int, below: float) -> DataFrame:
    """Names of enough lines with a low mean damage: bots and onlookers."""
    return players.groupBy(name).agg(F.count("*").alias("games"), F.avg(damage).alias("mean")).where((F.col("games") >= least_games) & (F.col("mean") < below))


def busy_teams(players: DataFrame, least_names: int) -> DataFrame:
    """Games and names of each team of enough names."""
    out = players.groupBy("team").agg(F.count_distinct("game_id").alias("games"), F.count_distinct("name").alias("names"))
    return out.where(F.col("names") >= least_names)


def roster_tags(players: DataFrame, names: list[str], least: int, top: int) -> DataFrame:
    """Tags under which enough of the names played: the first by games."""
    rows = players.where(F.col("name").isin(names)).groupBy("team").agg(F.count_distinct("game_id").alias("games"), F.count_distinct("name").alias("names"))
    return rows.where(F.col("names") >= least).orderBy(F.desc("games"), "team").limit(top)
