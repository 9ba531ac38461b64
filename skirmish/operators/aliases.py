"""Commands expanded through a table of aliases, by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skirmish.stages import stored

#: Levels of aliases and branches that are followed; a command below is taken as it is, which also ends cycles.
DEPTH = 10
_THEN = r"(?is)^if[ (].*? then (.*)$"
_ELSE = r"""(?is)^((?:[^'"]|['"][^'"]*['"])*?) else(?: (.*))?$"""


def branches(command: Column) -> Column:
    """The commands of an if's then and else, without empty ones; an else within quotes is none. Empty for other commands."""
    then = F.regexp_extract(command, _THEN, 1)
    both = F.when(then.rlike(_ELSE), F.array(F.trim(F.regexp_extract(then, _ELSE, 1)), F.trim(F.regexp_extract(then, _ELSE, 2)))).otherwise(F.array(F.trim(then)))
    return F.filter(both, lambda b: b != "")


def expanded(commands: DataFrame, aliases: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, at (from 0) and command: what each command comes down to, in order.

    commands: scope, id, command; aliases: scope, name, command (one per scope and name). A command is split at semicolons; both
    branches of an if are followed; a part whose first word is an alias, or is one without its plus, is replaced by the alias's
    command; of a word with a ``$`` after other letters the first alias, by name, that begins like it and has no ``$``; all others
    stay. Ends after depth levels, whatever is left then. Null and blank commands come down to nothing.

    Each level is a join of the open commands with the aliases of their scope, and the levels are written one by one.
    """
    known = aliases.where("scope IS NOT NULL AND name IS NOT NULL").select("scope", F.col("name").alias("_name"), F.coalesce("command", F.lit("")).alias("_to"))
    apart = lambda df: df.hint("merge")  # noqa: E731 - the aliases grow with the commands: no copy passes through the driver
    open_ = commands.select("scope", "id", F.array().cast("array<int>").alias("place"), F.trim("command").alias("command"))
    closed = None
    for level in range(depth + 2):
        if level > depth:
            rest = open_.where("command IS NOT NULL").select("id", "place", "command")
            closed = closed.union(rest)
            break
        parts = open_.select("scope", "id", "place", F.posexplode(F.split("command", ";")).alias("k", "command")).select("scope", "id", F.concat("place", F.array("k")).alias("place"), F.trim("command").alias("command"))
        parts = parts.where("command != ''").withColumn("_b", branches(F.col("command")))
        forked = parts.where(F.size("_b") > 0).select("scope", "id", "place", F.posexplode("_b").alias("k", "command")).select("scope", "id", F.concat("place", F.array("k")).alias("place"), "command")
        word = F.regexp_extract("command", r"^(\S+)", 1)
        plain = parts.where(F.size("_b") == 0).drop("_b").withColumns({"_w": word, "_plus": F.when(word.startswith("+"), F.substring(word, 2, 100_000)), "_prefix": F.nullif(F.regexp_extract(word, r"^([^$]+)\$", 1), F.lit(""))})
        own = known.withColumnsRenamed({"_name": "_w", "_to": "_own"})
        plus = known.withColumnsRenamed({"_name": "_plus", "_to": "_without"})
        looked = plain.join(apart(own), ["scope", "_w"], "left").join(apart(plus), ["scope", "_plus"], "left")
        wild = looked.where("_own IS NULL AND _plus IS NULL AND _prefix IS NOT NULL").select("scope", "_prefix").distinct()
        fits = wild.join(apart(known.where(~F.contains("_name", F.lit("$")))), "scope").where(F.startswith("_name", F.col("_prefix")))
        like = fits.groupBy("scope", "_prefix").agg(F.min_by("_to", "_name").alias("_like"))
        looked = looked.join(apart(like), ["scope", "_prefix"], "left").withColumn("_next", F.coalesce("_own", "_without", F.when(F.col("_plus").isNull(), F.col("_like"))))
        looked = stored(looked.select("scope", "id", "place", "command", "_next"))
        ended = looked.where("_next IS NULL").select("id", "place", "command")
        closed = ended if closed is None else closed.union(ended)
        open_ = stored(looked.where("_next IS NOT NULL").select("scope", "id", "place", F.col("_next").alias("command")).union(forked).withColumn("command", F.trim("command")))
        if not open_.limit(1).count():
            break
    order = W.partitionBy("id").orderBy("place")
    return closed.select("id", (F.row_number().over(order) - 1).alias("at"), "command")
