"""Chat messages: classes, questions, talk statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skirmish.functions.numbers import half_up
from skirmish.functions.strings import word_count


# Words that are reactions, as they are written.
REACTIONS = (
    ":) :( :D :P :p :/ :\\ :> :< ;) ;( :-) :-( :-D :-P :-/ :-\\ :o :O :x :X xD XD xd :3 <3 >:( "
    "lol heh hehe rofl lmao ah oh ha haha k ok ya ye jo yep yea nah mhm hmm +1 gg gl hf ns nt wp gj thx ty np"
).split()
# How messages to bots begin.
BOT_COMMANDS = [r"^[!.]\w", r"(?i)^(my luck|fishbot |learn |forget |suka|logan)", r"(?i)^(ttop10|!ttop10|!top10)"]
#: One to three pictographs; ranges of code points stand for the classes that Java's expressions lack.
PICTOGRAPHS = r"^[\x{231A}\x{231B}\x{23E9}-\x{23F3}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{1F000}-\x{1FAFF}]{1,3}$"


def message_class(content: Column, is_system: Column, is_bot: Column, has_files: Column) -> Column:
    """The first that fits: system, bot (by author), link or reaction (no text), bot (a command), reaction (up to 5 UTF-16
    units, a word of REACTIONS or pictographs), link (one URL), chat."""
    text = F.trim(F.coalesce(content, F.lit("")))
    units = F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    command = F.lit(False)
    for pattern in BOT_COMMANDS:
        command = command | text.rlike(pattern)
    return (
        F.when(is_system, "system").when(is_bot, "bot").when((text == "") & has_files, "link").when(text == "", "reaction").when(command, "bot")
        .when((units <= 5) & (text.isin(REACTIONS) | text.rlike(PICTOGRAPHS)), "reaction").when(text.rlike(r"^https?://\S+$"), "link").otherwise("chat")
    )


def with_questions(rows: DataFrame, by: str, text: str) -> DataFrame:
    """All rows of the groups in which a text holds a question mark."""
    return rows.join(rows.where(F.contains(F.col(text), F.lit("?"))).select(by), by, "left_semi")


def talk_statistics(rows: DataFrame, by: list[str], text: str, seconds: Column) -> DataFrame:
    """Segments, time, words, mean length and words per minute."""
    out = rows.groupBy(*by).agg(F.count("*").alias("segments"), F.sum(seconds).alias("seconds"), F.sum(word_count(F.col(text))).alias("words"), F.avg(seconds).alias("mean_seconds"))
    return out.withColumn("words_per_minute", F.when(F.col("seconds") > 0, F.round(60.0 * F.col("words") / F.col("seconds"), 1)).otherwise(F.lit(0.0)))


def silence_share(rows: DataFrame, who: str, seconds: Column, duration: float) -> DataFrame:
    """Segments, speaking time, speakers, and the percent of their time together in which none of them speaks."""
    out = rows.agg(F.count("*").alias("segments"), F.sum(seconds).alias("speaking"), F.count_distinct(who).alias("speakers"))
    share = half_up((1 - F.col("speaking") / (duration * F.col("speakers"))) * 1000) / 10
    return out.withColumn("silence", F.when(F.col("speakers") > 0, share))


def timeline_text(start: Column, who: Column, text: Column) -> Column:
    """[MM:SS.ss] who: text."""
    minutes = F.floor(start / 60)
    return F.format_string("[%02d:%05.2f] %s: %s", minutes, start - minutes * 60, who, text)


def resegmented(words: DataFrame, by: list[str], start: str, end: str, word: str, gap_seconds: float) -> DataFrame:
    """``start``, ``end``, ``text`` and ``words`` of stretches of words: a silence of the gap or more after a word ends one.

    The run starts anew with each key. Times are rounded to milliseconds, the text is the trimmed words as they are; blank
    stretches are left out.
    """
    order = W.partitionBy(*by).orderBy(start, end, word)
    df = words.withColumn("_new", F.coalesce(F.col(start) - F.lag(end).over(order) >= gap_seconds, F.lit(False)).cast("int"))
    df = df.withColumn("_part", F.sum("_new").over(order))
    said = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(word).alias("w"))))
    df = df.groupBy(*by, "_part").agg(said.alias("_w"))
    out = df.select(*by, half_up(F.get("_w", 0)["s"], 3).alias("start"), half_up(F.element_at("_w", -1)["e"], 3).alias("end"), F.trim(F.array_join("_w.w", "")).alias("text"), F.size("_w").cast("long").alias("words"))
    return out.where("text <> ''")


def message_shares(rows: DataFrame, text: str, reply: Column, bot: Column, files: Column) -> DataFrame:
    """Messages, their mean length, and the shares of replies, bots and attachments."""
    share = lambda c, name: F.avg(c.cast("double")).alias(name)
    return rows.agg(F.count("*").alias("messages"), F.avg(F.length(F.coalesce(F.col(text), F.lit("")))).alias("mean_length"), share(reply, "replies"), share(bot, "bots"), share(files, "files"))


def gap_markers(rows: DataFrame, by: list[str], ts: str, gap_seconds: float, tiebreak: str) -> DataFrame:
    """Adds ``gap_minutes`` since the message before where it is longer than the gap, else null."""
    order = W.partitionBy(*by).orderBy(ts, tiebreak)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(order))) / 1e6
    return rows.withColumn("_gap", gap).withColumn("gap_minutes", F.when(F.col("_gap") > gap_seconds, half_up(F.col("_gap") / 60).cast("int"))).drop("_gap")
