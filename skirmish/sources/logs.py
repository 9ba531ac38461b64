"""Reading chat archives: plain text logs, whose lines depend on those before, and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A header's month, day, hour and year, after the name of the weekday.
HEADER = r"^Session Start: \w{3} (\w{3}) +(\d{1,2}) (\d{2}):\d{2}:\d{2} (\d{4})"
SAID, ACTED = r"^\[(\d{2}):(\d{2})\] <([^>]+)> ?(.*)$", r"^\[(\d{2}):(\d{2})\] \* (\S+) (.*)$"
OTHER = r"^\[(\d{2}):(\d{2})\] (.*)$"

EXPORT = """id STRING, content STRING, author_id STRING, author_username STRING, author_display_name STRING, author_is_bot BOOLEAN,
channel_id STRING, message_type INT, referenced_message_id STRING, created_at TIMESTAMP, edited_at TIMESTAMP"""


def read_text_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line``, ``created_at``, ``kind`` (message, action, system), ``author``, ``content`` of each timed line.

    A header sets the date and the hour; a step from an hour after 20 to one before 4, the header's included, is midnight. Lines before the first header have no
    time and are left out. A file's lines are ordered in one task, files run in parallel.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    month = F.regexp_extract("value", HEADER, 1)
    day = F.concat_ws(" ", F.regexp_extract("value", HEADER, 4), month, F.lpad(F.regexp_extract("value", HEADER, 2), 2, "0"))
    rows = whole.withColumns({
        "date": F.when(month != "", F.try_to_timestamp(day, F.lit("yyyy MMM dd")).cast("date")),
        "hour": F.when(month != "", F.regexp_extract("value", HEADER, 3).cast("int")).when(F.col("value").rlike(OTHER), F.regexp_extract("value", OTHER, 1).cast("int")),
        "head": month != "",
    })
    in_file = W.partitionBy("file").orderBy("line")
    rows = rows.withColumn("part", F.count("date").over(in_file))
    in_part = W.partitionBy("file", "part").orderBy("line")
    rows = rows.withColumn("date", F.first("date", ignorenulls=True).over(in_part.rowsBetween(W.unboundedPreceding, 0))).where("part > 0 AND hour IS NOT NULL")
    turned = (F.lag("hour").over(in_part) > 20) & (F.col("hour") < 4)
    rows = rows.withColumn("days", F.sum(F.coalesce(turned, F.lit(False)).cast("int")).over(in_part).cast("int")).where("NOT head")
    seconds = F.col("hour") * 3600 + F.regexp_extract("value", OTHER, 2).cast("int") * 60
    at = F.timestamp_seconds(F.unix_timestamp(F.date_add("date", F.col("days")).cast("timestamp")) + seconds)
    said, acted = F.col("value").rlike(SAID), F.col("value").rlike(ACTED)
    pick = lambda k: F.when(said, F.regexp_extract("value", SAID, k)).when(acted, F.regexp_extract("value", ACTED, k))
    kind = F.when(said, "message").when(acted, "action").otherwise("system")
    return rows.select("file", "line", at.alias("created_at"), kind.alias("kind"), pick(3).alias("author"), F.coalesce(pick(4), F.regexp_extract("value", OTHER, 3)).alias("content"))


def read_chat_exports(spark: SparkSession, path: str, kinds: dict[int, str]) -> DataFrame:
    """The messages of JSON array files, with ``kind`` by message_type; types that kinds lacks are system messages."""
    rows = spark.read.schema(EXPORT).json(path, multiLine=True)
    kind: Column = F.lit("system")
    for code, name in kinds.items():
        kind = F.when(F.col("message_type") == code, name).otherwise(kind)
    return rows.withColumn("kind", kind)
