"""The library's domain tables, played by the star-schema test tables; each with the SQL of the same view for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """An order line is a game between two of twenty teams. more: columns of the line, or of its file."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("played_at"), F.col("l_returnflag").alias("map"),
        F.concat(F.lit("t"), F.col("l_suppkey") % 20).alias("team_a"), F.concat(F.lit("t"), F.col("l_partkey") % 20).alias("team_b"),
        F.col("l_quantity").cast("int").alias("frags_a"), (F.col("l_partkey") % 50).cast("int").alias("frags_b"),
        (F.col("l_quantity") * 30).cast("int").alias("duration"), F.when(F.col("l_linenumber") < 4, F.lit(10)).alias("timelimit"), *more,
    )


GAMES = """games AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS played_at, l_returnflag AS map, 't' || (l_suppkey % 20) AS team_a, 't' || (l_partkey % 20) AS team_b,
         l_quantity::INT AS frags_a, (l_partkey % 50)::INT AS frags_b, (l_quantity * 30)::INT AS duration, CASE WHEN l_linenumber < 4 THEN 10 END AS timelimit FROM lineitem)"""


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order line is also a player's line in a match, the order; the supplier is the player."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.concat(F.lit("p"), F.col("l_suppkey")).alias("name"), F.col("l_linestatus").alias("team"), F.col("l_returnflag").alias("map"),
        F.col("l_quantity").cast("int").alias("kills"), (F.col("l_partkey") % 50).cast("int").alias("deaths"), F.col("l_extendedprice").alias("damage"),
        F.when(F.col("l_quantity") > 10, F.col("l_discount") * 100).alias("accuracy"), (F.col("l_returnflag") == "R").alias("won"),
    )


PLAYERS = """players AS (
  SELECT l_orderkey AS game_id, 'p' || l_suppkey AS name, l_linestatus AS team, l_returnflag AS map, l_quantity::INT AS kills, (l_partkey % 50)::INT AS deaths, l_extendedprice AS damage,
         CASE WHEN l_quantity > 10 THEN l_discount * 100 END AS accuracy, l_returnflag = 'R' AS won FROM lineitem)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a message of a channel, its user; errors play system messages, views and clicks what is said."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("channel"), "event_type", "value")


MESSAGES = "messages AS (SELECT event_id, ts, user_id AS channel, event_type, value FROM events)"


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event says that its user, of one of eight teams, is free in the slot it falls into."""
    from skirmish.functions.calendar import slot_number, week_id

    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), F.col("user_id") % 8).alias("team"), week_id(F.col("ts")).alias("week"), (F.floor(slot_number(F.col("ts")) / 12) * 12).cast("int").alias("slot"), F.col("user_id").alias("user")
    )


AVAILABILITY = """availability AS (
  SELECT 't' || (user_id % 8) AS team, printf('%04d-%02d', isoyear(ts), weekofyear(ts)) AS week,
         ((isodow(ts) - 1) * 48 + hour(ts) * 2 + minute(ts) // 30)::INT // 12 * 12 AS slot, user_id AS user FROM events)"""
