"""Near-duplicate paragraphs: MinHash banding, exact verification, removal by connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import discard, keyed, restricted, stored
from skirmish.llm.minhash import SIGNED, Plan, band_keys, fingerprints, linked, lists, samples, shingle_sets
from skirmish.llm.texts import runs, word_hashes, word_places

#: 20 bands of 4 samples miss a pair of similarity 0.8 with a probability of 3e-5.
PARAGRAPHS = Plan(20, 4, 256, 1024)
#: Paragraphs of fewer words recur in clean texts (names, dates, rules) and are left alone.
LEAST_WORDS = 25


def line_ends(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of a run of texts end, in bytes (the line feed included), and how many each text has."""
    feeds = np.flatnonzero(data == 10) + 1
    # of a feed at the end of a text, and that end, the feed comes first
    both = np.concatenate([feeds, ends])
    return both[np.argsort(both, kind="stable")], np.bincount(np.searchsorted(ends, feeds - 1, "right"), minlength=len(ends)) + 1


def _sign(size: int, least_words: int, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v = (batch.column(c).to_numpy() for c in ("k", "v"))
            for own, data, ends in runs(batch.column("text")):
                starts, stops, _ = word_places(data, ends)
                lines, count = line_ends(data, ends)
                n = np.diff(np.searchsorted(starts, lines), prepend=0)
                long = n >= least_words
                if not long.any():
                    continue
                doc = np.repeat(np.arange(own.start, own.stop), count)[long]
                at = (np.arange(len(lines)) - np.repeat(np.cumsum(count) - count, count))[long]
                hashes, stop = shingle_sets(word_hashes(data, starts, stops)[np.repeat(long, n)], n[long], size)
                prints = fingerprints(hashes, stop)
                columns = [k[doc], v[doc], at.astype(np.int32), np.diff(stop, prepend=0), prints[:, 0].copy(), prints[:, 1].copy()]
                keys = lists(band_keys(samples(hashes, stop, plan), plan))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), keys], names=["k", "v", "at", "n_shingles", "hi", "lo", "keys"])

    return run


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept, counts, words = [], [], []
        for text, gone in zip(batch["text"], batch["gone"], strict=True):
            lines = np.array(text.split("\n"), object)
            counts.append(len(lines))
            words.append(sum(len(x.encode("utf-8", "surrogatepass").split()) for x in lines[gone]))
            kept.append("\n".join(np.delete(lines, gone)))
        yield batch[["doc_id", "gone", "copied"]].assign(n_paragraphs=np.array(counts, np.int64), n_gone_words=np.array(words, np.int64), text=kept)


_LISTS = "doc_id long, gone array<int>, copied array<int>, n_paragraphs long, n_gone_words long, text string"


def drop_repeated_paragraphs(docs: DataFrame, size: int = 5, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id``, ``n_paragraphs``, ``gone`` (removed paragraph numbers, from 0), ``n_gone_words`` (words in them), ``copied``
    (numbers of the ones that stay and have copies elsewhere) and ``text``, what is left, for every row.

    A paragraph is a line. Paragraphs of least_words words or more are linked if their sets of word shingles (``size``
    words, A-Z lower-cased) share ``percent`` of their union. Of each connected component the first paragraph, by
    (doc_id, number), stays, and all others go. Equal sets are merged by fingerprint before banding.

    Null texts count as empty, with one empty paragraph; documents of short paragraphs only stay whole. Rows that repeat
    an id and a text are one document, and get equal results; rows that share an id only are told apart by a 64-bit hash
    of the text, and those of null ids by one of 126 bits. Null ids sort first. Further columns are ignored. An empty table
    gives an empty table. Paragraphs are taken whole, whatever their length.
    """
    plain = keyed(docs)
    signs = stored(plain.select("k", "v", "text").mapInArrow(_sign(size, least_words, PARAGRAPHS), f"k long, v long, at int, {SIGNED}"))
    at = F.struct("k", "at", "v")
    groups = signs.groupBy("hi", "lo").agg(F.min(at).alias("first"), F.max(at).alias("_last"))
    # written once, so that the numbers don't change
    groups = stored(groups.select("hi", "lo", "first", (F.col("first") != F.col("_last")).alias("several"), F.monotonically_increasing_id().alias("id")))
    own = signs.join(groups.select("hi", "lo", "id", "first"), ["hi", "lo"]).where(at == F.col("first"))
    keys = stored(own.select("id", "keys"))

    def texts(ids: DataFrame) -> DataFrame:
        places = stored(restricted(groups, ids).select("id", "first.k", "first.v", "first.at"))
        near = restricted(plain.select("k", "v", "text"), places.select("k", "v")).join(places, ["k", "v"])
        return near.select("id", F.get(F.split("text", "\n"), F.col("at")).alias("text")).dropDuplicates(["id"])

    labels = linked(keys, texts, size, percent, PARAGRAPHS)
    discard(keys)
    known = groups.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    clusters = stored(known.groupBy("label").agg(F.min("first").alias("keep"), (F.bool_or("several") | (F.count("*") > 1)).alias("several")).where("several"))
    doomed = stored(known.select("hi", "lo", "label").join(clusters.select("label", "keep"), "label").select("hi", "lo", "keep"))
    marks = signs.select("k", "v", "at", "hi", "lo").join(doomed, ["hi", "lo"])
    pick = lambda where, name: F.sort_array(F.collect_set(F.when(where, F.col("at")))).alias(name)
    marks = stored(marks.groupBy("k", "v").agg(pick(at != F.col("keep"), "gone"), pick(at == F.col("keep"), "copied")))
    discard(signs)
    ids = marks.select("k", "v")
    cut = restricted(plain, ids).join(marks, ["k", "v"]).select("doc_id", "text", "gone", "copied").mapInPandas(_cut, _LISTS)
    whole, none = restricted(plain, ids, outside=True), F.array().cast("array<int>")
    whole = whole.select("doc_id", none.alias("gone"), none.alias("copied"), F.size(F.split("text", "\n")).cast("long").alias("n_paragraphs"), F.lit(0).cast("long").alias("n_gone_words"), "text")
    return cut.union(whole).select("doc_id", "n_paragraphs", "gone", "n_gone_words", "copied", "text")
