"""Benchmark decontamination: exact pieces of the items on near diagonals find candidate windows, exact edit distances decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import restricted, stored

#: Items of fewer words, edited, can't be told from ordinary text: they are looked for as they are, from word to word.
LEAST_WORDS = 8
#: Bytes of a piece that are looked up; items too short for it take shorter pieces.
PIECE = 8
#: A window is a leak if its edit distance is at most this share of the item's length.
MOST_EDITS = 0.1
#: Length of the byte grams that the exact check counts first.
GRAM = 5
#: Items and their bytes that one pass over the documents looks for; a larger benchmark takes several passes.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8_000_000
#: Bytes of text that one numpy step handles; a longer document is one step.
CHUNK = 1_000_000

_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words with ASCII punctuation taken for spaces, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split() if text else []


def pieces_at(text: bytes) -> np.ndarray:
    """The PIECE bytes from each place of text on, as a number; zeros follow the text."""
    padded, out = text + bytes(2 * PIECE), np.empty(len(text), np.uint64)
    for k in range(PIECE):
        own = out[k::PIECE]
        own[:] = np.frombuffer(padded, "<u8", len(own), k)
    return out


def grams(text: bytes) -> list[bytes]:
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]


class Items:
    """A block of benchmark items with an index of their pieces; small enough to be sent to every task.

    An item of which ``limit`` edits are allowed is cut into limit + least disjoint pieces, least being as large as pieces
    of PIECE bytes allow, and 1 at least. An edit spoils one piece at most, so any leak holds ``least`` pieces as they are,
    and their places differ from those in the item by shifts that are within limit of each other.
    """

    def __init__(self, rows: list[tuple[int, str]], most_edits: float):
        self.ids, self.patterns, self.grams, self.exact, self.index = [], [], [], [], {}
        limits, least, parts = [], [], {}
        for item_id, text in rows:
            found = words_of(text)
            if not found:
                continue
            pattern, exact = b" ".join(found), len(found) < LEAST_WORDS
            n, limit = len(pattern), 0 if exact else math.floor(most_edits * len(pattern))
            cuts = max(limit + 1, n // PIECE)
            size = min(PIECE, n // cuts)
            for k in range(cuts):
                at = k * n // cuts
                parts.setdefault(size, []).append((int.from_bytes(pattern[at : at + size], "little"), len(self.ids), at))
            self.ids.append(item_id)
            self.patterns.append(pattern)
            self.exact.append(exact)
            self.grams.append(grams(pattern))
            limits.append(limit)
            least.append(cuts - limit)
        self.limits, self.least = np.array(limits, np.int64), np.array(least, np.int64)
        self.lengths = np.array([len(p) for p in self.patterns], np.int64)
        for size, rows in parts.items():
            key = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(key, kind="stable")
            item, offset = (np.array([r[k] for r in rows], np.int64)[order] for k in (1, 2))
            bits = min(24, max(16, len(key).bit_length() + 5))
            seen = np.zeros(1 << bits, np.bool_)
            seen[(key * _SPREAD) >> np.uint64(64 - bits)] = True
            self.index[size] = (key[order], item, offset, seen, np.uint64(64 - bits))

    def candidates(self, text: bytes, ends: np.ndarray) -> np.ndarray:
        """(document, item, start, end) of all windows that may hold an item; ends: where the documents of text end."""
        whole, out = pieces_at(text), []
        for size, (key, item, offset, seen, shift) in self.index.items():
            own = whole if size == PIECE else whole & np.uint64((1 << 8 * size) - 1)
            at = np.nonzero(seen[(own * _SPREAD) >> shift])[0]
            lo, hi = np.searchsorted(key, own[at], "left"), np.searchsorted(key, own[at], "right")
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(at, n)
            doc = np.searchsorted(ends, place, "right")
            # by item and document, then by shift; an item's shift may be as low as minus its length
            out.append(((item[which] * len(ends) + doc) << 32) + (place - offset[which] + (1 << 30)))
        hits = np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)
        if not len(hits):
            return np.empty((0, 4), np.int64)
        items = (hits >> 32) // len(ends)
        last = np.arange(len(hits)) + self.least[items] - 1
        near = hits[np.minimum(last, len(hits) - 1)] - hits <= self.limits[items]
        hits, items = hits[near & (last < len(hits))], items[near & (last < len(hits))]
        if not len(hits):
            return np.empty((0, 4), np.int64)
        # windows of one item and document with shifts near each other are checked as one
        first = np.concatenate([[True], np.diff(hits) > self.limits[items[1:]]])
        final = np.concatenate([first[1:], [True]])
        items, docs = items[first], (hits[first] >> 32) % len(ends)
        low, high = ((hits[x] & 0xFFFFFFFF) - (1 << 30) for x in (first, final))
        starts = np.concatenate([[0], ends[:-1]])
        begin = np.maximum(low - self.limits[items], starts[docs])
        end = np.minimum(high + self.lengths[items] + self.limits[items], ends[docs])
        return np.stack([docs, items, begin, end], axis=1)


def edit_distance_within(pattern: bytes, text: bytes) -> int:
    """The least edit distance of pattern to any part of text: Myers' bit vectors, in Python's long integers."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks = dict.fromkeys(pattern, 0)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(x | up)), up & x
        score += bool(right & top) - bool(left & top)
        best = min(best, score)
        right, left = (right << 1) & full, (left << 1) & full
        y = eq | down
        up, down = left | (full & ~(y | right)), right & y
    return best


def _search(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: Items = shared.value
        for batch in batches:
            found = []
            ids, texts = batch["doc_id"].to_numpy(), batch["text"]
            at, stack, size = 0, [], 0
            for k, text in enumerate(texts):
                # words hold no line feed, so no piece reaches over the end of a document
                stack.append(b" ".join(words_of(text)) + b"\n")
                size += len(stack[-1])
                if size >= CHUNK or k == len(ids) - 1:
                    found += _leaks(items, stack, ids[at : k + 1])
                    at, stack, size = k + 1, [], 0
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance"]).astype("int64")

    return run


def _leaks(items: Items, found: list[bytes], ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(id, item, distance) for every document of found."""
    best: dict[tuple[int, int], int] = {}
    run, ends = b"".join(found), np.cumsum([len(x) for x in found])
    for doc, item, a, b in items.candidates(run, ends).tolist():
        if best.get((doc, item)) == 0:
            continue
        pattern, text, limit = items.patterns[item], run[a:b], int(items.limits[item])
        if items.exact[item]:
            if text != pattern or run[a - 1 : a].strip() or run[b : b + 1].strip():
                continue
            distance = 0
        elif pattern in text:
            distance = 0
        else:
            # an edit spoils at most GRAM of the item's grams
            there, own = set(grams(text)), items.grams[item]
            if sum(g in there for g in own) < len(own) - GRAM * limit:
                continue
            distance = edit_distance_within(pattern, text)
        if distance <= limit and distance < best.get((doc, item), limit + 1):
            best[doc, item] = distance
    return [(int(ids[doc]), int(items.ids[item]), d) for (doc, item), d in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """``doc_id``, ``item_id`` and ``distance`` for every document that holds a benchmark item, edited or not.

    Both are lower-cased, ASCII punctuation counts as space, and words are joined by one space; a leak is a part of the
    document within ``most_edits`` times the item's length in edit operations on UTF-8 bytes. Every leak is found, with its
    least distance: of an item cut into more pieces than the edits allowed, some stand unedited in every leak (see Items).

    Items of fewer than LEAST_WORDS words must stand as they are, from the start of a word to the end of one.

    Candidate search and check run in one narrow pass: documents are not shuffled. The items are sent to the tasks in blocks
    of some BLOCK_ITEMS items and BLOCK_BYTES bytes at most; each further block is a further pass, and one block's index at
    a time is held by the driver.

    Null and empty texts hold nothing, and are held by nothing. Items with a null id are not looked for; documents
    with a null id are not reported. Of ties the least distance counts. A text may be of any length. Repeated rows of either table are reported once. Further columns are ignored. An
    empty table on either side gives an empty table.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(math.ceil(size["n"] / BLOCK_ITEMS), math.ceil(size["bytes"] / BLOCK_BYTES), 1)
    plain = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "doc_id long, item_id long, distance long")
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in block.distinct().collect()], most_edits))
        found = plain.mapInPandas(_search(shared), "doc_id long, item_id long, distance long")
        if blocks > 1:
            found = stored(found)
            shared.unpersist()
        out = out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """The rows of docs that hold no benchmark item, with the columns of docs.

    As find_leaks(), and rows with a null id are searched too: a hash of the text stands in for the id, from 2^62 on. All
    rows that share an id with a leak go. Null and empty texts stay. The ids that go are broadcast up to a number, so that
    the texts stay where they are.
    """
    stand_in = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(2**62))
    own = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), stand_in))
    leaks = find_leaks(own.select(F.col("_k").alias("doc_id"), "text"), benchmark, most_edits)
    return restricted(own, stored(leaks.select(F.col("doc_id").alias("_k")).distinct()), outside=True).select(docs.columns)
