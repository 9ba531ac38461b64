"""Availability and matches: slots, blocking, engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions.calendar import neighbours


def slots_of(documents: DataFrame) -> DataFrame:
    """Availability documents (team, week, slots: map of slot to users) as rows of team, week, slot, user."""
    return documents.select("team", "week", F.explode("slots").alias("slot", "users")).select("team", "week", "slot", F.explode(F.array_distinct("users")).alias("user"))


def blocked(matches: DataFrame) -> DataFrame:
    """team, week, slot: the booked slots and their neighbours, of both teams."""
    rows = matches.select("week", F.explode(neighbours(F.col("slot"))).alias("slot"), F.explode(F.array("team_a", "team_b")).alias("team"))
    return rows.select("team", "week", "slot").distinct()


def viable_slots(available: DataFrame, ours: Column, theirs: Column, booked: DataFrame, least_ours: int, least_theirs: int, standin: bool = False) -> DataFrame:
    """week, slot, users of both teams where both have enough, neither is blocked; a stand-in adds one of ours, up to four.

    available: team, week, slot, user. A full outer join of the two teams' counts; an absent side counts 0.
    """
    counts = lambda who, name: available.where(F.col("team") == who).groupBy("week", "slot").agg(F.count_distinct("user").alias(name))
    both = counts(ours, "ours").join(counts(theirs, "theirs"), ["week", "slot"], "full").na.fill(0)
    mine = F.least(F.lit(4), F.col("ours") + 1) if standin else F.col("ours")
    free = both.where((mine >= least_ours) & (F.col("theirs") >= least_theirs))
    return free.join(booked.where(F.col("team").isin(ours, theirs)).select("week", "slot"), ["week", "slot"], "left_anti")


def heat(available: DataFrame) -> DataFrame:
    """Users per week and slot, once per team, and an intensity from 0.2 to 1."""
    from pyspark.sql import Window as W

    out = available.groupBy("week", "slot").agg(F.count_distinct("team", "user").alias("users"))
    return out.withColumn("intensity", 0.2 + 0.8 * F.col("users") / F.max("users").over(W.partitionBy("week")))


def free_users(available: DataFrame, slots: list[int]) -> DataFrame:
    """Users free in any of the slots, with the first team and those slots in order."""
    rows = available.where(F.col("slot").isin(slots))
    return rows.groupBy("week", "user").agg(F.min("team").alias("team"), F.array_sort(F.collect_set("slot")).alias("slots"))


def engagement(activity: DataFrame, week: Column) -> DataFrame:
    """Per week: distinct users and teams, proposals and matches. activity: user, team, kind."""
    return activity.groupBy(week.alias("week")).agg(
        F.count_distinct("user").alias("users"), F.count_distinct("team").alias("teams"),
        F.count_if(F.col("kind") == "proposal").alias("proposals"), F.count_if(F.col("kind") == "match").alias("matches"),
    )


def expire(proposals: DataFrame, now: Column) -> DataFrame:
    """Active proposals past their expiry become expired."""
    return proposals.withColumn("status", F.when((F.col("status") == "active") & (F.col("expires_at") < now), "expired").otherwise(F.col("status")))


def complete(matches: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Upcoming matches become completed some minutes after their start."""
    over = F.col("starts_at") + F.make_dt_interval(mins=F.lit(minutes)) <= now
    return matches.withColumn("status", F.when((F.col("status") == "upcoming") & over, "completed").otherwise(F.col("status")))


def confirmed_slots(proposals: DataFrame) -> DataFrame:
    """Slots that both sides confirmed."""
    return proposals.withColumn("confirmed", F.array_sort(F.array_intersect(F.map_keys("proposer_slots"), F.map_keys("opponent_slots"))))


def apply_template(available: DataFrame, template: DataFrame, week: str) -> DataFrame:
    """Rows that a user's template (team, slot, user) adds to a week: none for users with any slot in it."""
    there = available.where(F.col("week") == week).select("user").distinct()
    return template.join(there, "user", "left_anti").select("team", F.lit(week).alias("week"), "slot", "user")


def copy_week(available: DataFrame, source: str, target: str) -> DataFrame:
    """Rows of the source week that the target week lacks, moved to it."""
    key = ["team", "slot", "user"]
    return available.where(F.col("week") == source).select(key).join(available.where(F.col("week") == target).select(key), key, "left_anti").withColumn("week", F.lit(target))
