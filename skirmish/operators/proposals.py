"""Match proposals, rosters and who is free when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rosters_split(rosters: DataFrame, available: DataFrame) -> DataFrame:
    """For each team's free slots, who of its roster is free and who isn't. rosters: team, users (array). available: team, week,
    slot, user."""
    free = available.groupBy("team", "week", "slot").agg(F.collect_set("user").alias("_free"))
    both = free.join(rosters, "team")
    return both.select("team", "week", "slot", F.array_sort(F.array_intersect("users", "_free")).alias("free"), F.array_sort(F.array_except("users", "_free")).alias("busy"))


def free_that_week(members: DataFrame, available: DataFrame, slots: list[int]) -> DataFrame:
    """Members (team, user) with ``is_free`` per week in which the team has any free slot: the user is free in one of the slots."""
    weeks = available.select("team", "week").distinct()
    free = available.where(F.col("slot").isin(slots)).select("team", "week", "user").distinct().withColumn("is_free", F.lit(True))
    return members.join(weeks, "team").join(free, ["team", "week", "user"], "left").na.fill(False, ["is_free"])


def enriched(proposals: DataFrame, available: DataFrame, team: str) -> DataFrame:
    """A team's proposals from its side: ``opponent``, ``is_incoming`` and the number of ``viable`` slots.

    proposals: id, proposer, opponent, week, least_proposer, least_opponent, proposer_standin, opponent_standin. A slot is
    viable if both sides have enough users, a stand-in counting as one, and four at most; blocked and past slots count.
    """
    first = F.col("proposer") == team
    swap = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    own = proposals.where(first | (F.col("opponent") == team)).select(
        "id", "week", swap("opponent", "proposer").alias("opponent"), (~first).alias("is_incoming"), swap("least_proposer", "least_opponent").alias("_least"), swap("least_opponent", "least_proposer").alias("_other_least"),
        swap("proposer_standin", "opponent_standin").alias("_standin"), swap("opponent_standin", "proposer_standin").alias("_other_standin"),
    )
    # proposals that are alike in all that counts are one row until the end
    alike = ["week", "opponent", "_least", "_other_least", "_standin", "_other_standin"]
    cases = own.select(alike).distinct().withColumn("id", F.struct(alike))
    counts = available.groupBy("team", "week", "slot").agg(F.count_distinct("user").alias("n"))
    ours = counts.where(F.col("team") == team).select("week", "slot", F.col("n").alias("_ours"))
    sides = cases.join(ours, "week").select("id", "slot", "_ours", F.lit(None).cast("long").alias("_theirs"))
    sides = sides.union(cases.join(counts.withColumnRenamed("team", "opponent"), ["opponent", "week"]).select("id", "slot", F.lit(None).cast("long"), "n"))
    slots = sides.groupBy("id", "slot").agg(F.coalesce(F.max("_ours"), F.lit(0)).alias("_ours"), F.coalesce(F.max("_theirs"), F.lit(0)).alias("_theirs"))
    enough = lambda n, standin, least: F.least(F.lit(4), F.col(n) + F.col(standin).cast("int")) >= F.col(least)
    viable = cases.join(slots, "id").where(enough("_ours", "_standin", "_least") & enough("_theirs", "_other_standin", "_other_least")).groupBy(alike).agg(F.count("*").alias("viable"))
    found = viable.withColumnsRenamed({c: f"_of_{c}" for c in alike})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in alike]
    return own.join(found, same, "left").select("id", "week", "opponent", "is_incoming", "viable").na.fill(0, ["viable"])


def best_slots(counts: DataFrame, by: list[str]) -> DataFrame:
    """The slot of most users of both sides together; of equals the earlier. counts: slot, ours, theirs."""
    best = F.max_by(F.struct("slot", "ours", "theirs"), F.struct(F.col("ours") + F.col("theirs"), -F.col("slot")))
    return counts.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def shelves(proposals: DataFrame, week: str, now: Column) -> DataFrame:
    """``shelf`` of each proposal: current, future, past (by its week) or archived; confirmed ones have left the shelves."""
    active = F.col("status") == "active"
    shelf = (
        F.when(~active | (F.col("expires_at") < now), "archived").when(F.col("week") == week, "current")
        .when(F.col("week") > week, "future").otherwise("past")
    )
    return proposals.where("status <> 'confirmed'").withColumn("shelf", shelf)


def listing(matches: DataFrame, status: str = "upcoming", tag: str | None = None, week: str | None = None, limit: int | None = None) -> DataFrame:
    """The first matches by date, 50 if not said and 100 at most; only then those of a tag, in the order of their times.

    matches: id, status, week, day, slot (ddd_HHMM), tag_a, tag_b.
    """
    if status not in ("upcoming", "completed", "cancelled", "all"):
        raise ValueError(f"no such status: {status}")
    rows = matches if status == "all" else matches.where(F.col("status") == status)
    if week is not None:
        rows = rows.where(F.col("week") == week)
    rows = rows.orderBy("day", "id").limit(min(limit or 50, 100))
    if tag is not None:
        rows = rows.where((F.lower("tag_a") == tag.lower()) | (F.lower("tag_b") == tag.lower()))
    return rows.withColumn("starts_at", F.concat(F.col("day").cast("string"), F.lit("T"), F.substring("slot", 5, 2), F.lit(":"), F.substring("slot", 7, 2), F.lit(":00Z"))).orderBy("starts_at", "id")


def latest_states(changes: DataFrame) -> DataFrame:
    """Who is free or unavailable after a log of changes: the last one of each user and slot counts.

    changes: team, week, slot, user, at, id, action (add, remove, unavailable). A user is in one of the two sets at most.
    """
    key = ["team", "week", "slot", "user"]
    last = changes.groupBy(*key).agg(F.max_by("action", F.struct("at", "id")).alias("action"))
    return last.where("action <> 'remove'").select(*key, F.when(F.col("action") == "add", "free").otherwise("unavailable").alias("state"))


def renamed(matches: DataFrame, renames: DataFrame, columns: list[str]) -> DataFrame:
    """matches with the new names of renamed tags in the columns. renames: tag, renamed, one row per tag."""
    for c in columns:
        new = renames.select(F.col("tag").alias(c), F.col("renamed").alias("_new"))
        matches = matches.join(new, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return matches


def offered(teams: DataFrame, divisions: list[str], query: str, favourites: list[str] | None = None) -> DataFrame:
    """Teams that aren't hidden, play in one of the divisions and have the query in their name or tag. teams: team, tag,
    divisions, hidden."""
    rows = teams.where(~F.col("hidden") & F.arrays_overlap("divisions", F.array(*map(F.lit, divisions))))
    if favourites is not None:
        rows = rows.where(F.col("team").isin(favourites))
    return rows.where(F.contains(F.lower("team"), F.lit(query.lower())) | F.contains(F.lower("tag"), F.lit(query.lower())))


def shown_roster(teams: DataFrame) -> DataFrame:
    """Teams that aren't hidden; the names of those that hide their roster become Player 1, Player 2 ... teams: users, hides."""
    masked = F.transform("users", lambda u, i: F.concat(F.lit("Player "), (i + 1).cast("string")))
    return teams.where("NOT hidden").withColumn("users", F.when(F.col("hides"), masked).otherwise(F.col("users")))


def stale(sessions: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Running sessions without a heartbeat for so long are interrupted. sessions: status, beat_at."""
    late = F.unix_micros(now) - F.unix_micros(F.col("beat_at").cast("timestamp")) > seconds * 1e6
    return sessions.withColumn("status", F.when((F.col("status") == "running") & late, "interrupted").otherwise(F.col("status")))


def wall_clock(events: DataFrame, by: str, at: str, pause: str) -> DataFrame:
    """Adds ``wall``: the time of each event with all pauses that began before it. pause: its length, null for other events."""
    before = W.partitionBy(by).orderBy(at).rangeBetween(W.unboundedPreceding, -1)
    return events.withColumn("wall", F.col(at) + F.coalesce(F.sum(pause).over(before), F.lit(0)))
