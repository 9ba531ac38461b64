"""Repeated passages across lines: winnowed word grams find earlier places, chains on near diagonals are cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import BROADCAST_IDS, discard, keyed, restricted, stored
from skirmish.llm.texts import hashed_words, runs, word_hashes, word_places

#: Words of a gram, and of the stretch of gram starts that elects one: any GRAM + STRETCH - 1 equal words elect the same one.
GRAM, STRETCH = 12, 13
#: Words of a passage: 50, of which edits may leave 80 %.
PASSAGE_WORDS = 40
#: Grams on one chain start within so many words of each other, and shift by so many words at most.
GAP, SHIFT = GRAM + 2 * STRETCH, 5
#: Low bits of an election that hold the gram's place; a longer run of words is dealt with in overlapping pieces.
PLACE_BITS = 24

_STEP = np.uint64(0x9E3779B97F4A7C15)


def elected(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the elected grams of a run of texts: the least of every STRETCH successive ones, the first of
    equals. w: the hashes of the words, n: how many each text has."""
    least_words, most = GRAM + STRETCH - 1, 1 << PLACE_BITS
    if len(w) < least_words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = w[: len(w) - GRAM + 1].copy()
    for k in range(1, GRAM):
        h = h * _STEP + w[k : k + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(w))  # words from each on, to the end of its text
    low, found = np.uint64(most - 1), []
    for a in range(0, len(h), most - STRETCH):
        own = h[a : a + most - 1]
        least, width = (own & ~low) | np.arange(len(own), dtype=np.uint64), 1
        while width < STRETCH:
            step = min(width, STRETCH - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        found.append((least[left[a : a + len(least)] >= least_words] & low).astype(np.int64) + a)
    at = np.unique(np.concatenate(found))
    return at, h[at].view(np.int64)


def _elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, v = (batch.column(c).to_numpy() for c in ("k", "v"))
        for own, w, n in hashed_words(batch.column("text")):
            at, key = elected(w, n)
            doc = np.searchsorted(np.cumsum(n), at, "right")
            places = (at - (np.cumsum(n) - n)[doc]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, k[own][doc], v[own][doc], places)], names=["key", "k", "v", "at"])


_SPANS = ["k", "v", "lo", "hi", "a_k", "a_v", "a_lo", "a_hi"]


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of a document whose grams follow each other in one earlier place as well."""
    for batch in batches:
        if not len(batch):
            continue
        doc = np.repeat(np.arange(len(batch)), batch["at"].map(len))
        at, a_k, a_v, a_at = (np.concatenate(batch[c].to_numpy()).astype(np.int64) for c in ("at", "a_k", "a_v", "a_at"))
        order = np.lexsort((at, a_v, a_k, doc))
        doc, at, a_k, a_v, a_at = (x[order] for x in (doc, at, a_k, a_v, a_at))
        same = (doc[1:] == doc[:-1]) & (a_k[1:] == a_k[:-1]) & (a_v[1:] == a_v[:-1])
        same &= (np.diff(at) <= GAP) & (np.abs(np.diff(at) - np.diff(a_at)) <= SHIFT) & (np.diff(a_at) > 0)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        # equal words may go on for less than a gram beyond either end
        long = at[last] - at[first] + 3 * GRAM >= PASSAGE_WORDS
        first, last = first[long], last[long]
        k, v = (batch[c].to_numpy()[doc[first]] for c in ("k", "v"))
        yield pd.DataFrame(dict(zip(_SPANS, (k, v, at[first], at[last] + GRAM, a_k[first], a_v[first], a_at[first], a_at[last] + GRAM), strict=True)))


def _sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words around the earlier places."""
    for batch in batches:
        rows = []
        for own, words, n in hashed_words(pa.array(batch["text"])):
            stops = np.cumsum(n)
            for r, (a, b) in zip(range(own.start, own.stop), zip(stops - n, stops, strict=True), strict=True):
                w, row = words[a:b].view(np.int64), batch.iloc[r]
                rows += [(row["k"], row["v"], s["a_lo"], s["a_hi"], w[max(s["a_lo"] - STRETCH, 0) : s["a_lo"]], w[s["a_hi"] : s["a_hi"] + STRETCH]) for s in row["spans"]]
        yield pd.DataFrame(rows, columns=["a_k", "a_v", "a_lo", "a_hi", "before", "after"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for own, data, ends in runs(pa.array(batch["text"])):
            starts, stops, n = word_places(data, ends)
            words, until = word_hashes(data, starts, stops).view(np.int64), np.cumsum(n)
            for r, (a, b), (c, d) in zip(range(own.start, own.stop), zip(until - n, until, strict=True), zip([0, *ends[:-1]], ends, strict=True), strict=True):
                row, w = batch.iloc[r], words[a:b].tolist()
                gone = []
                for s in row["spans"]:
                    lo, hi, before, after = s["lo"], s["hi"], list(s["before"]), list(s["after"])
                    while before and lo and w[lo - 1] == before[-1]:
                        lo -= 1
                        before.pop()
                    for x in after:
                        if hi >= len(w) or w[hi] != x:
                            break
                        hi += 1
                    if hi - lo >= PASSAGE_WORDS:
                        gone.append((lo, hi))
                kept, cut, last, passages = [], 0, 0, 0  # last: the first word not dealt with
                after_word = lambda j: int(stops[a + j - 1]) if j else c  # noqa: E731, B023
                for lo, hi in sorted(gone):
                    if hi > last:
                        passages += lo > last or not last
                        lo = max(lo, last)
                        kept.append(data[after_word(last) : starts[a + lo]].tobytes())
                        cut, last = cut + hi - lo, hi
                kept.append(data[after_word(last) : d].tobytes())
                rows.append((row["k"], row["v"], cut, passages, b"".join(kept).decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["k", "v", "n_cut_words", "n_passages", "cut"])


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """docs with ``text`` without passages that occur earlier, by (doc_id, place), and ``n_cut_words`` and ``n_passages``, the
    words and passages removed, and ``n_copied_passages``, those that stay and are cut elsewhere.

    Texts are taken as words, A-Z lower-cased, whatever their lines. A stretch of PASSAGE_WORDS or more that stands in an
    earlier place, but for edits that leave some 24 equal words in a row between them, is cut there; what stays is the
    earlier one. Each gram is held against its first place only, so that a passage in many documents costs no pairs of
    them; a passage whose grams each occur first in another document is not found.

    Null texts count as empty, and stay null. Rows that repeat an id and a text are one document. Null ids sort first.
    Columns named like the three new ones are replaced. An empty table gives an empty table.
    """
    plain = keyed(docs).select("k", "v", "text")
    signs = stored(plain.mapInArrow(_elect, "key long, k long, v long, at int"))
    several = stored(signs.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"))
    again = stored(restricted(signs, several))
    discard(signs)
    place = F.struct("k", "at", "v")
    firsts = again.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("_last")).where("first != _last").select("key", "first")
    # written, so that the join deals a very common gram's places anew, over several tasks
    firsts = stored(firsts)
    known = F.broadcast(firsts) if firsts.count() <= BROADCAST_IDS else firsts
    hits = again.join(known, "key").where(place != F.col("first")).select("k", "v", F.struct("at", F.col("first.k").alias("a_k"), F.col("first.v").alias("a_v"), F.col("first.at").alias("a_at")).alias("hit"))
    hits = hits.groupBy("k", "v").agg(F.collect_set("hit").alias("hits")).select("k", "v", *[F.col(f"hits.{c}").alias(c) for c in ("at", "a_k", "a_v", "a_at")])
    spans = stored(hits.mapInPandas(_chain, "k long, v long, lo int, hi int, a_k long, a_v long, a_lo int, a_hi int"))
    discard(again)
    wanted = stored(spans.groupBy(F.col("a_k").alias("k"), F.col("a_v").alias("v")).agg(F.collect_set(F.struct("a_lo", "a_hi")).alias("spans")))
    earlier = restricted(plain, wanted.select("k", "v")).join(wanted, ["k", "v"])
    sides = stored(earlier.mapInPandas(_sides, "a_k long, a_v long, a_lo int, a_hi int, before array<long>, after array<long>").dropDuplicates(["a_k", "a_v", "a_lo", "a_hi"]))
    full = spans.join(sides, ["a_k", "a_v", "a_lo", "a_hi"]).groupBy("k", "v").agg(F.collect_list(F.struct("lo", "hi", "before", "after")).alias("spans"))
    full = stored(full)
    later = restricted(plain, full.select("k", "v")).join(full, ["k", "v"])
    cut = later.mapInPandas(_cut, "k long, v long, n_cut_words long, n_passages long, cut string").dropDuplicates(["k", "v"])
    copied = wanted.select("k", "v", F.size("spans").cast("long").alias("n_copied_passages"))
    marks = stored(cut.join(copied, ["k", "v"], "full").withColumnsRenamed({"k": "_k", "v": "_v"}))
    new = ["n_cut_words", "n_passages", "n_copied_passages"]
    rows = docs.drop(*new)
    # the key columns beside the rows as they are
    rows = keyed(rows.withColumns({"_row": F.struct(*rows.columns), "_id": F.col("doc_id"), "_text": F.col("text")}), "_id", "_text", also=["_row"]).select("_row", F.col("k").alias("_k"), F.col("v").alias("_v"))
    own = [c for c in docs.columns if c not in new]
    hit = restricted(rows, marks.select("_k", "_v")).join(marks, ["_k", "_v"])
    hit = hit.select(*[F.coalesce("cut", "_row.text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in own], *[F.coalesce(c, F.lit(0)).alias(c) for c in new])
    clean = restricted(rows, marks.select("_k", "_v"), outside=True)
    return hit.union(clean.select(*[F.col("_row")[c].alias(c) for c in own], *[F.lit(0).cast("long").alias(c) for c in new]))
