"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import count_of, has_word, words

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, Spanish and French.
STOP_WORDS = (
    "the of and to in that is with for was on as it by be this are or an from at which have not "
    "der die das und zu den von mit im ist ein eine nicht sich auf dem des für "
    "de la que el en los se del las un por con una su para es al lo "
    "le les et des du est pour une dans qui sur pas au avec ce il"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; a bound of None is open. A null metric passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (F.col(self.metric) >= self.low)
        if self.high is not None:
            ok = ok & (F.col(self.metric) <= self.high)
        return F.coalesce(ok, F.lit(True))


#: Production thresholds.
RULES = (
    Rule("length", "n_words", 50, 100_000),
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("exclamation", "exclamation_ratio", None, 0.2),
    Rule("stop_words", "stop_word_ratio", 0.04, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("line_length", "words_per_line", 3.0, None),
    Rule("repetition", "repeat_ratio", None, 0.5),
)

#: Columns that annotate() adds; they replace columns of the same name.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def annotate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Add the metrics, ``base_failed``, ``failed_rules`` (names in table order) and ``kept`` to every row.

    All is one narrow projection: no shuffle, no user function, rows are independent of each other.
    Metrics: ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a
    word equal to an earlier line), ``n_repeat_words`` (word positions inside a 3-word window that occurs
    twice or more in the text, its first occurrence included).

    Null and empty texts have no words and all metrics 0, so they fail the length rule. Repeated rows get equal results. Input columns
    that share a name with a metric are replaced. An empty table gives an empty table. A text may be of any
    length: the window count sorts 64-bit hashes of its windows, so the work grows as n log n (two different
    windows of a text of 20,000 words share a hash with a probability of about 1e-11).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({
        "_w": words(F.col(text)),
        "_l": F.filter(F.split(t, "\n"), has_word),
        "n_symbols": count_of(t, SYMBOLS),
        "_bangs": count_of(t, "!"),
    })
    n = F.size("_w")
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.concat_ws("", "_w")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_stops": F.size(F.filter("_w", lambda w: w.isin(list(stop_words)))),
        "_win": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))),
    })
    # windows of a text that repeats none are not sorted
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("k"), i.alias("p"))))))
    same = lambda e, i, d: F.coalesce(F.get("_sorted", i + d)["k"] == e["k"], F.lit(False))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda e, i: same(e, i, 1) | same(e, i, -1)), lambda e: e["p"])))
    gain = F.transform("_at", lambda p, i: F.coalesce(F.least(p - F.get("_at", i - 1), F.lit(3)), F.lit(3)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gain, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    df = df.withColumns({
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "exclamation_ratio": ratio("_bangs", "n_words"),
        "stop_word_ratio": ratio("_stops", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "words_per_line": ratio("n_words", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    df = df.withColumn("failed_rules", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return df.drop("_w", "_l", "_bangs", "_stops", "_win", "_sorted", "_at")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    plain = docs.select(F.struct("*").alias("_row"), F.col(text).alias("text"))
    # The optimizer would copy the metrics into a filter, each as often as it is used, and the filter would take for ever.
    # It leaves filters on columns that aren't deterministic where they are; rand() is below 1.
    sure = annotate(plain, rules).select("_row", (F.col("kept").cast("int") + F.rand(0)).alias("_kept"))
    return sure.where("_kept >= 1").select("_row.*")
