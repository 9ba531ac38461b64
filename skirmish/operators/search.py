"""Full-text search: documents from conversations, postings, match, BM25, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conversation_documents(rows: DataFrame, by: str, order: list[str], author: str, text: str) -> DataFrame:
    """One text per conversation: ``author: text`` lines in order, blank ones left out."""
    said = rows.where(F.trim(text) != "")
    line = F.struct(*order, F.concat_ws(": ", author, text).alias("line"))
    return said.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("document"))


# Accented letters and what they are without the accent.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column, fold: bool = False) -> Column:
    """Array of the runs of letters and digits, lower-cased; with fold without accents."""
    low = F.lower(text)
    return F.filter(F.split(F.translate(low, ACCENTED, PLAIN) if fold else low, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def terms(docs: DataFrame, key: str, text: str, fold: bool = False) -> DataFrame:
    """``key``, ``at`` (from 0), ``term``."""
    return docs.select(key, F.posexplode(tokens(F.col(text), fold)).alias("at", "term"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The index: of each term and document how often and where. Store it where several queries follow."""
    return terms(docs, key, text).groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("places"))


def _counted(docs: DataFrame, key: str, text: str, query: list[str]) -> tuple[list[str], DataFrame]:
    """The query's terms, and of each document ``_len`` and the terms' counts: one projection, nothing exploded."""
    wanted = sorted({t.lower() for t in query})
    own = docs.select(key, tokens(F.col(text)).alias("_t"))
    count = lambda t: F.size(F.filter("_t", lambda x: x == t)).cast("long")
    return wanted, own.select(key, F.size("_t").alias("_len"), *[count(t).alias(f"_n{k}") for k, t in enumerate(wanted)])


def match_all(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """Documents with all query terms, and how often these occur, without an index: one scan."""
    wanted, own = _counted(docs, key, text, query)
    hits = sum((F.col(f"_n{k}") for k in range(len(wanted))), F.lit(0))
    for k in range(len(wanted)):
        own = own.where(F.col(f"_n{k}") > 0)
    return own.select(key, hits.cast("long").alias("hits"))


def match_any(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """Documents with any of the terms; one that ends in * stands for all terms that begin so."""
    plain = [t.lower() for t in query if not t.endswith("*")]
    starts = [t[:-1].lower() for t in query if t.endswith("*")]
    hit = lambda x: x.isin(plain) | (F.lit(False) if not starts else _any(x.startswith(p) for p in starts))
    return docs.select(key, F.size(F.filter(tokens(F.col(text)), hit)).cast("long").alias("hits")).where("hits > 0")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def bm25_scan(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75, top: int = 10) -> DataFrame:
    """The best documents that have all query terms, by BM25, ties by key; without an index: one scan for the corpus figures, one row, and one for the scores."""
    wanted, own = _counted(docs, key, text, query)
    there = range(len(wanted))
    corpus = own.agg(F.count_if(F.col("_len") > 0).alias("_docs"), F.avg(F.when(F.col("_len") > 0, F.col("_len"))).alias("_mean"), *[F.count_if(F.col(f"_n{k}") > 0).alias(f"_df{k}") for k in there])
    df, score = own, F.lit(0.0)
    for k in there:
        df = df.where(F.col(f"_n{k}") > 0)
    df = df.join(F.broadcast(corpus))
    for k in there:
        idf = F.greatest(F.log((F.col("_docs") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"_n{k}") * (k1 + 1) / (F.col(f"_n{k}") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    return df.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(top)


def conversation_of_best(rows: DataFrame, best: DataFrame, by: str) -> DataFrame:
    """All rows of the best conversation. best: one of by's keys, of a ranked search."""
    return rows.join(F.broadcast(best.select(by).limit(1)), by, "left_semi")


def match_phrase(index: DataFrame, key: str, phrase: list[str]) -> DataFrame:
    """Documents where the terms stand one after the other, and how often."""
    starts = None
    for k, term in enumerate(phrase):
        own = index.where(F.col("term") == term.lower()).select(key, F.explode("places").alias("at")).select(key, (F.col("at") - k).alias("at"))
        starts = own if starts is None else starts.join(own, [key, "at"], "left_semi")
    return starts.groupBy(key).agg(F.count("*").alias("hits"))


def snippet(text, term: str, width: int = 40):
    """Up to width tokens around the first hit, the hit in brackets, with ellipses where the text goes on; null without a hit."""
    plain = lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]", "")

    def shown(tokens: Column, at: Column) -> Column:
        first = F.greatest(at - width // 2, F.lit(1)).cast("int")
        window = F.transform(F.slice(tokens, first, F.lit(width)), lambda t, i: F.when(i + first == at, F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
        more = F.when(first + width <= F.size(tokens), F.lit(" ...")).otherwise(F.lit(""))
        return F.when(at > 0, F.concat(F.when(first > 1, F.lit("... ")).otherwise(F.lit("")), F.array_join(window, " "), more))

    # arrays of one element bind the tokens and the place, so that each text is split and searched once
    split = F.transform(F.array(F.split(text, r"\s+")), lambda ts: F.struct(ts.alias("ts"), F.array_position(F.transform(ts, plain), term.lower()).alias("at")))
    return F.get(F.transform(split, lambda x: shown(x["ts"], x["at"])), 0)
