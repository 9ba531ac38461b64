"""Gap-based sessions over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_sessions(rows: DataFrame, by: list[str], ts: str, gap_seconds: float, riding: Column, tiebreak: str) -> DataFrame:
    """Adds ``session``, numbered from 1 per key: a silence of more than the gap between opening rows starts the next.

    Riding rows neither open nor extend a session; they go with the one that is open, leading ones with the first. A key
    of riding rows only has no session: null. One shuffle by key, one sort.
    """
    order = W.partitionBy(*by).orderBy(ts, tiebreak)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    df = rows.withColumns({"_rides": riding, "_at": F.when(~riding, seconds)})
    df = df.withColumn("_before", F.last("_at", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    opens = ~F.col("_rides") & (F.col("_before").isNull() | (F.col("_at") - F.col("_before") > gap_seconds))
    df = df.withColumn("_n", F.sum(opens.cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    some = F.max((~F.col("_rides")).cast("int")).over(W.partitionBy(*by)) == 1
    return df.withColumn("session", F.when(some, F.greatest(F.col("_n"), F.lit(1).cast("long")))).drop("_rides", "_at", "_before", "_n")


def session_table(rows: DataFrame, by: list[str], ts: str, riding: Column, spoken: Column, author: str) -> DataFrame:
    """One row per session of gap_sessions(): span of the opening rows, all rows, and those and the authors of spoken ones."""
    open_ts = F.when(~riding, F.col(ts))
    return rows.where("session IS NOT NULL").groupBy(*by, "session").agg(
        F.min(open_ts).alias("started_at"), F.max(open_ts).alias("ended_at"), F.count("*").alias("messages"),
        F.count_if(spoken).alias("chat_messages"), F.array_sort(F.collect_set(F.when(spoken, F.col(author)))).alias("participants"),
    )


def gap_groups(rows: DataFrame, by: list[str], ts: str, gap_seconds: float, inclusive: bool, tiebreak: str) -> DataFrame:
    """Adds ``part`` from 1 per key: a gap of the length (or, if not inclusive, more) starts the next."""
    order = W.partitionBy(*by).orderBy(ts, tiebreak)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(order))) / 1e6
    df = rows.withColumn("_gap", gap)
    cut = (F.col("_gap") >= gap_seconds) if inclusive else (F.col("_gap") > gap_seconds)
    return df.withColumn("part", 1 + F.sum(F.coalesce(cut, F.lit(False)).cast("long")).over(order)).drop("_gap")


def weekly_series(rows: DataFrame, ts: str) -> DataFrame:
    """Rows per Monday-started week, weeks without any included."""
    weeks = rows.groupBy(F.to_date(F.date_trunc("week", ts)).alias("week")).agg(F.count("*").alias("n"))
    span = weeks.agg(F.min("week").alias("a"), F.max("week").alias("b")).where("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return every.join(weeks, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))
