"""Which recording belongs to which match, and how sure that is."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions.numbers import half_up
from skirmish.functions.strings import edge_trim
from skirmish.stages import stored

#: The longest recording, in seconds, that a match may lie in.
LONGEST = 4 * 3600
#: Numbers of 64 bits that tell whether two lists of names may be alike.
BITS = 4
#: So many pairs of one tag and time bin are looked at by a task on the average.
PAIRS = 20_000_000


def plain_names(names: Column) -> Column:
    """The distinct names, trimmed at the edges, without empty ones."""
    return F.array_distinct(F.filter(F.transform(names, edge_trim), lambda n: n != ""))


def _alike(own: Column, others: Column, least: int) -> Column:
    return F.size(F.filter(own, lambda a: (F.length(a) >= least) & F.exists(others, lambda b: F.contains(a, b) | F.contains(b, a))))


def alike_names(own: Column, others: Column, least: int) -> Column:
    """How many of own's distinct names, trimmed at the edges, hold one of the others or are held by one; shorter ones don't count."""
    return _alike(plain_names(own), plain_names(others), least)


def best_known(name: Column, known: list[str]) -> Column:
    """The known name that equals the name, letters' case aside, or else the first that holds it or is held by it."""
    plain, listed = F.lower(F.trim(name)), F.array(*map(F.lit, known))
    exact = F.get(F.filter(listed, lambda k: F.lower(k) == plain), 0)
    near = F.get(F.filter(listed, lambda k: F.contains(F.lower(k), plain) | F.contains(plain, F.lower(k))), 0)
    return F.when(plain != "", F.coalesce(exact, near))


def confidence(offset: Column, has_stats: Column, names: Column) -> Column:
    """(score, reasons): the match starts well within the recording, its length is known, names agree."""
    n = F.least(names, F.lit(3))
    seconds = F.format_string("%.1f", offset)
    score = (
        F.when(offset > 60, 0.3).when(offset > 0, 0.15).otherwise(0.0) + F.when(has_stats, 0.2).otherwise(0.0)
        + F.when(names >= 3, 0.3).when(names >= 1, 0.3 * (n / 3)).otherwise(0.0) + F.when((offset > 0) & (offset < LONGEST), 0.2).otherwise(0.0)
    )
    # The reasons' texts.
    reasons = F.array(
        F.when(offset > 60, "offset > 60s into recording").when(offset > 0, F.concat(F.lit("offset positive but small ("), seconds, F.lit("s)"))).otherwise(F.concat(F.lit("offset negative ("), seconds, F.lit("s) - match before recording"))),
        F.when(has_stats, "ktxstats available (exact duration)").otherwise("no ktxstats (using default duration)"),
        F.when(names >= 3, F.concat(names.cast("string"), F.lit(" player names match recording tracks"))).when(names >= 1, F.concat(names.cast("string"), F.lit(" player name(s) match recording tracks"))).otherwise("no player name overlap with recording tracks"),
        F.when((offset > 0) & (offset < LONGEST), "offset within reasonable session window").otherwise(F.concat(F.lit("offset "), seconds, F.lit("s outside expected range"))),
    )
    return F.struct(half_up(score, 2).alias("score"), reasons.alias("reasons"))


def _alike_pairs(own: DataFrame, others: DataFrame) -> DataFrame:
    """``_a``, ``_b``: names of own (_a) and others (_b), of which one holds the other, by joins on all stretches of the longer."""
    stretches = lambda name: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.transform(F.sequence(F.lit(1), F.length(name) - i + 1), lambda n: F.substring(name, i, n)))))
    held = own.select("_a", F.explode(stretches(F.col("_a"))).alias("_b")).join(others, "_b", "left_semi")
    holds = others.select("_b", F.explode(stretches(F.col("_b"))).alias("_a")).join(own, "_a", "left_semi")
    return held.select("_a", "_b").union(holds.select("_a", "_b")).distinct()


def _bit(name: Column, k: int) -> Column:
    """One of 64 bits by the k-th six bits of a name's hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(F.xxhash64(name), 6 * k), F.lit(64)).cast("int"))


def _scored(pairs: DataFrame, names: Column) -> DataFrame:
    offset = F.col("at") - F.col("starts")
    known = confidence(offset, F.col("has_stats"), names)
    # each field by itself, so that no struct of all texts is made where one is asked for
    return pairs.select("recording", "match", offset.alias("offset"), known["score"].alias("score"), known["reasons"].alias("reasons"))


def paired(recordings: DataFrame, matches: DataFrame, buffer: float = 120.0, bin_seconds: float = 3600.0) -> DataFrame:
    """Matches within a recording's time, of its team or with two alike names: ``recording``, ``match``, ``offset``, ``score``,
    ``reasons``.

    recordings: recording, tag, starts, ends (seconds), names. matches: match, at, tags, names, has_stats. Range joins on
    equal time bins and, besides, one of equal tags and one of names known to be alike, so that what meets is what is wanted,
    but for pairs with one alike name. A match lies in one bin, and a pair is taken at its tag or at its first alike names
    only, so that none is doubled.

    Of a pair of one tag, names are compared only where they may be alike: a match's names, and the names that are alike to
    some of a recording's, are bits of BITS numbers, and pairs without a common bit in each have no alike names.
    """
    number = lambda x: F.floor(x / bin_seconds)
    bits = lambda k: F.aggregate("_others", F.lit(0).cast("long"), lambda s, n: s.bitwiseOR(_bit(n, k)))
    # names are trimmed once
    own = stored(recordings.select("recording", F.lower("tag").alias("_tag"), "starts", "ends", plain_names(F.col("names")).alias("_own")))
    met = stored(matches.select("match", "at", F.array_distinct(F.filter(F.transform("tags", F.lower), lambda t: t != "")).alias("_tags"), plain_names(F.col("names")).alias("_others"), "has_stats", number(F.col("at")).alias("bin")))
    alike = stored(_alike_pairs(own.select(F.explode("_own").alias("_a")).where(F.length("_a") >= 2).distinct(), met.select(F.explode("_others").alias("_b")).distinct()))
    own = own.withColumn("_set", F.xxhash64("_own"))
    near = own.select("_set", F.explode("_own").alias("_a")).distinct().join(alike, "_a").groupBy("_set").agg(*[F.bit_or(_bit(F.col("_b"), k)).alias(f"_near{k}") for k in range(BITS)])
    spans = stored(own.join(near, "_set", "left").drop("_set")).withColumn("bin", F.explode(F.sequence(number(F.col("starts") - buffer), number(F.col("ends") + buffer))))
    met = stored(met.withColumns({f"_has{k}": bits(k) for k in range(BITS)}))
    in_time = (F.col("at") >= F.col("starts") - buffer) & (F.col("at") < F.col("ends") + buffer)
    may = reduce(Column.__and__, [F.coalesce(F.col(f"_near{k}").bitwiseAND(F.col(f"_has{k}")) != 0, F.lit(False)) for k in range(BITS)])
    tagged = met.withColumn("_tag", F.explode("_tags"))
    # few rows may make many pairs, so tasks are counted by these
    made = spans.groupBy("bin", "_tag").agg(F.count("*").alias("_n")).join(tagged.groupBy("bin", "_tag").agg(F.count("*").alias("_m")), ["bin", "_tag"]).agg(F.sum(F.col("_n") * F.col("_m").cast("double"))).first()[0]
    tasks = max(int(recordings.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((made or 0) / PAIRS))
    # no broadcast of tables that grow: their files are much smaller than their rows
    ours = spans.repartition(tasks, "bin", "_tag").join(tagged.repartition(tasks, "bin", "_tag").hint("merge"), ["bin", "_tag"])
    named = spans.withColumn("_a", F.explode("_own")).join(alike.hint("merge"), "_a").join(met.withColumn("_b", F.explode("_others")).hint("merge"), ["bin", "_b"])
    one = lambda a, b: F.contains(a, b) | F.contains(b, a)
    hits = F.filter("_own", lambda a: (F.length(a) >= 2) & F.exists("_others", lambda b: one(a, b)))
    # the time first: names are compared one by one
    named = named.where(in_time & ~F.coalesce(F.array_contains("_tags", F.col("_tag")), F.lit(False)) & (F.size(hits) >= 2) & (F.get(hits, 0) == F.col("_a")) & (F.get(F.filter("_others", lambda b: one(F.col("_a"), b)), 0) == F.col("_b")))
    kept = ["recording", "match", "at", "starts", "_own", "_others", "has_stats"]
    compared = ours.where(in_time & may).select(kept).union(named.select(kept)).withColumn("_n", _alike(F.col("_own"), F.col("_others"), 3))
    return _scored(ours.where(in_time & ~may), F.lit(0)).union(_scored(compared, F.col("_n")))


def our_team(players: DataFrame, speakers: DataFrame) -> DataFrame:
    """The team of each game with most speakers' names among its players, the first that plays of equals.

    players: game_id, at (their order), team, name. speakers: name, in lower case.
    """
    heard = players.withColumn("name", F.lower(F.trim("name"))).join(speakers.select("name").distinct(), "name", "left_semi")
    scores = heard.groupBy("game_id", "team").agg(F.count("*").alias("n"), F.min("at").alias("_at"))
    return scores.groupBy("game_id").agg(F.min_by("team", F.struct(-F.col("n"), F.col("_at"), F.col("team"))).alias("team"), F.max("n").alias("n"))


def item_totals(players: DataFrame, ours: Column) -> DataFrame:
    """Items per side: the count, or what was taken where that is 0 or missing. players: team, items (map of name to count, took)."""
    rows = players.select(F.when(ours, "team").otherwise("opponents").alias("side"), F.explode("items").alias("item", "held"))
    n = F.coalesce(F.nullif(F.col("held.count"), F.lit(0)), F.col("held.took"), F.lit(0))
    return rows.select("side", "item", n.alias("n")).where("n > 0").groupBy("side", "item").agg(F.sum("n").alias("n"))
