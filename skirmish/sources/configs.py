"""Reading clients' configuration files: variables, key bindings, aliases and the files they run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skirmish.stages import stored

# Commands that are no variables, and those that set one.
SKIPPED = "unbind unbindall unaliasall tp_pickup tp_took tp_point filter mapgroup skygroup floodprot hud_recalculate sb_sourceunmarkall sb_sourcemark".split()
SETTERS = ["set", "set_tp", "set_calc"]


def _unquoted(value):
    return F.when(value.rlike(r'(?s)^".*"$') & (F.length(value) >= 2), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def read_configs(spark: SparkSession, path: str, glob: str = "*.cfg") -> DataFrame:
    """file, line (from 0), kind, name and value of every line that says something.

    kind: ``bind`` (name in capitals), ``alias``, ``exec`` (no name; the path) or ``cvar``, also by set commands. Comments, lines that
    begin with a plus or minus, commands without a value and those of SKIPPED are left out. Quotes around a value go.
    """
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "t")).withColumn("t", F.regexp_replace("t", r"^\s+|\s+$", ""))
    rows = rows.where((F.col("t") != "") & ~F.col("t").rlike(r"^(//|[+-])"))
    rows = rows.select("file", "line", F.regexp_extract("t", r"^(\S+)", 1).alias("word"), F.regexp_extract("t", r"^\S+\s+(.*)$", 1).alias("rest"))
    low = F.lower("word")
    named = low.isin("bind", "alias", "tempalias", *SETTERS)
    kind = F.when(low == "bind", "bind").when(low.isin("alias", "tempalias"), "alias").when(low == "exec", "exec").when(~low.isin(SKIPPED), "cvar")
    first, second = F.regexp_extract("rest", r"^(\S+)", 1), F.regexp_extract("rest", r"^\S+\s+(.*)$", 1)
    name = F.when(low == "bind", F.upper(first)).when(named, first).when(low == "exec", F.lit(None)).otherwise(F.col("word"))
    value = F.when(low == "exec", F.regexp_replace("rest", '^"+|"+$', "")).when(named, _unquoted(second)).otherwise(_unquoted(F.col("rest")))
    there = F.when(named, F.col("rest").rlike(r"^\S+\s+\S")).otherwise(F.col("rest") != "")
    return rows.where(there).select("file", "line", kind.alias("kind"), name.alias("name"), value.alias("value")).where("kind IS NOT NULL AND NOT (kind = 'exec' AND value = '')")


def settings(lines: DataFrame, kind: str) -> DataFrame:
    """file, name and value of a kind's last line for each name: what holds in the end."""
    last = W.partitionBy("file", "name").orderBy(F.desc("line"))
    return lines.where(F.col("kind") == kind).withColumn("_n", F.row_number().over(last)).where("_n = 1").select("file", "name", "value")


def runs(lines: DataFrame) -> DataFrame:
    """file, at (its order), and path of the files that a file runs: by exec lines, then by those within its cl_onload."""
    parts = F.posexplode(F.split("value", ";")).alias("k", "part")
    late = settings(lines, "cvar").where("name = 'cl_onload'").select("file", parts).withColumn("part", F.trim("part"))
    late = late.where(F.startswith("part", F.lit("exec "))).select("file", (F.col("k") + 1_000_000_000).alias("at"), F.regexp_replace(F.trim(F.substring("part", 6, 100_000)), '^"+|"+$', "").alias("path"))
    return lines.where("kind = 'exec'").select("file", F.col("line").alias("at"), F.col("value").alias("path")).union(late.where("path != ''"))


def reached(lines: DataFrame, most: int = 20) -> DataFrame:
    """root and file: each file with itself and all that it runs, directly or not; paths are compared by their ends.

    Files that run each other are met once. A frontier of new pairs is joined with the runs until there are none, most times
    at most.
    """
    names = lines.select("file").distinct().withColumn("_end", F.lower(F.element_at(F.split("file", "/"), -1)))
    steps = runs(lines).select("file", F.lower(F.element_at(F.split("path", "/"), -1)).alias("_end"))
    steps = stored(steps.join(names.withColumnRenamed("file", "to"), "_end").select("file", "to").distinct())
    found = frontier = stored(names.select(F.col("file").alias("root"), "file"))
    for _ in range(most):
        frontier = stored(frontier.join(steps, "file").select("root", F.col("to").alias("file")).distinct().join(found, ["root", "file"], "left_anti"))
        if not frontier.limit(1).count():
            return found
        found = stored(found.union(frontier))
    return found
