"""Exact substring dedup: every byte under a string of LENGTH bytes that starts twice or more anywhere is cut out.

The texts are sharded by content instead of by place. Each window of LENGTH bytes elects one gram inside it (the least
hash, the rightmost of equals). The choice depends on the window's bytes only, so equal windows elect the same gram at the
same offset and meet in that gram's shard; windows whose gram occurs once are settled at once.

Within a shard the strings around the gram stand aligned, and its Burrows-Wheeler transform is kept by columns: the bytes of
a column in the order of the suffixes that start right of it. A stable deal by these bytes turns that order into the one of
the suffixes that start in the column itself, and common prefixes of neighbours follow from those before (sweep()). Grams of
more strings than a shard holds have several shards, whose transforms are made apart, one a task, and then merged: the
interleave of the shards' suffixes is refined column by column from their transforms alone (merged()), without sorting or
even seeing a suffix again. A window is repeated where a neighbour shares LENGTH bytes with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import discard, keyed, restricted, stored
from skirmish.llm.texts import powers

LENGTH = 200
#: Bytes of the elected gram.
GRAM = 80
#: Grams that a window elects from.
SPAN = LENGTH - GRAM + 1
#: Columns of a shard: as many bytes before the gram as a window can have, and LENGTH bytes from its start.
COLUMNS = SPAN - 1 + LENGTH
#: Strings of a shard, about.
SHARD = 4_096
#: Strings of one gram whose shards one task merges, at some 40 bytes each; the windows of a gram of more are counted instead.
MERGED = 4_000_000
#: Never part of UTF-8: stands where a string has no byte.
PAD = 0xFF
#: Bytes of text that one numpy step handles; positions must fit the low bits of a packed election.
CHUNK, PLACE_BITS = 1 << 20, 24

_TABLE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each gram of data, from running sums."""
    n = len(data) - GRAM + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * powers(pow(_BASE, -1, 2**64), n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def elections(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gram hash, document, gram place, first window start and number of windows of each election in a run of texts.

    data: the texts' bytes one after the other; ends: where each ends. Places are relative to their document.
    """
    if len(data) < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    h = gram_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, width = (h & ~low) | (low - place), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    starts = np.concatenate([[0], ends[:-1]])
    # a window start is valid if its document goes on for LENGTH bytes
    step = np.zeros(len(data) + 1, np.int32)
    whole = ends - starts >= LENGTH
    np.add.at(step, starts[whole], 1)
    np.add.at(step, ends[whole] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(step[: len(least)]) > 0)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    gram = (low - (least[at] & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    lo, gram = at[first], gram[first]
    doc = np.searchsorted(ends, lo, "right")
    return h[gram].view(np.int64), doc, gram - starts[doc], lo - starts[doc], count


def _elect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, versions, texts = batch["k"].to_numpy(), batch["v"].to_numpy(), [t.encode() for t in batch["text"]]
        at, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK or k == len(texts) - 1:
                part = texts[at : k + 1]
                ends = np.cumsum([len(t) for t in part])
                for own, stop, base in _pieces(part, ends):
                    g, doc, place, lo, n = elections(own, stop)
                    yield pd.DataFrame({
                        "g": g,
                        "k": ids[at + base[0] + doc],
                        "v": versions[at + base[0] + doc],
                        "lo": (lo + base[1]).astype(np.int32),
                        "d": (place - lo).astype(np.int32),
                        "n": n.astype(np.int32),
                    })
                at, size = k + 1, 0


def _pieces(part: list[bytes], ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int]]]:
    """The run of texts as one piece, or a text beyond the packed places in overlapping pieces of its own: bytes, ends,
    and (first document, place of the first byte)."""
    most = 1 << (PLACE_BITS - 1)
    if ends[-1] <= most:
        yield np.frombuffer(b"".join(part), np.uint8), ends, (0, 0)
        return
    for k, text in enumerate(part):
        for a in range(0, max(1, len(text) - LENGTH + 1), most):
            own = np.frombuffer(text[a : a + most + LENGTH - 1], np.uint8)
            yield own, np.array([len(own)]), (k, a)


_STRINGS = {"g": "long", "c1": "long", "c2": "long", "k": "long", "v": "long", "lo": "int", "n": "int", "d": "int", "own": "binary"}


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The string under each election's windows, with a fingerprint of it and of the gram's offset in it."""
    for batch in batches:
        rows = []
        for k, v, text, *found in batch[["k", "v", "text", "g", "lo", "d", "n"]].itertuples(index=False):
            data = text.encode()
            for g, lo, d, n in zip(*(x.tolist() for x in found), strict=True):
                own = data[lo : lo + n - 1 + LENGTH]
                print_ = xxhash.xxh3_128_intdigest(own, seed=d)
                rows.append((g, (print_ >> 64) - 2**63, (print_ & (2**64 - 1)) - 2**63, k, v, lo, n, d, own))
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=list(_STRINGS))
                rows = []
        yield pd.DataFrame(rows, columns=list(_STRINGS))


def columns_of(strings: list[bytes], offsets: np.ndarray) -> np.ndarray:
    """The strings as rows of columns, aligned so that column SPAN - 1 holds the gram's first byte; returned by columns."""
    cells = np.full((len(strings), COLUMNS), PAD, np.uint8)
    for i, (own, d) in enumerate(zip(strings, offsets.tolist(), strict=True)):
        a = SPAN - 1 - d
        cells[i, a : a + len(own)] = np.frombuffer(own, np.uint8)
    return np.ascontiguousarray(cells.T)


def sweep(group: np.ndarray, column: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each column from the last to the first: its number, its bytes in the order of the suffixes right of it (the
    transform), the order of the suffixes that start in it, and the prefix that each shares with the one before.

    group: of each string, ascending; strings of different groups share nothing. column: gives a column's bytes for the
    order of the suffixes right of it.
    """
    order, common = np.arange(len(group)), np.zeros(len(group) + 1, np.int32)
    base = group.astype(np.int64) << 8
    for j in range(COLUMNS - 1, -1, -1):
        byte = column(j, order)
        key = base[order] | byte
        p = np.argsort(key, kind="stable")
        key = key[p]
        near = np.flatnonzero((key[1:] == key[:-1]) & ((key[1:] & 0xFF) != PAD))  # k-th and k+1-th stay neighbours
        after = np.zeros(len(group) + 1, np.int32)
        if len(near):
            cuts = np.stack([p[near] + 1, p[near + 1] + 1], axis=1).ravel()
            after[near + 1] = np.minimum.reduceat(common, cuts)[::2] + 1
        order, common = order[p], after
        yield j, byte, order, common


def transform(strings: list[bytes], offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """sweep() over a shard of its own."""
    cells = columns_of(strings, offsets)
    return sweep(group, lambda j, order: cells[j][order])


def merged(shard: np.ndarray, transforms: Iterator[list[np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """sweep() over the union of a gram's shards. shard: of each string, ascending; transforms: of each column from the last
    to the first, the shards' bytes. The order so far says how the shards' suffixes interleave, so it deals their bytes
    out, and these refine it."""

    def column(j: int, order: np.ndarray) -> np.ndarray:
        byte = np.empty(len(order), np.uint8)
        byte[np.argsort(shard[order], kind="stable")] = np.concatenate(next(transforms))
        return byte

    return sweep(np.zeros(len(shard), np.int64), column)


def repeated(steps: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of a sweep that share LENGTH bytes with a neighbour: string, first and last start in the string."""
    last, found = np.full(len(offsets), -1), []
    for j, _, order, common in steps:
        if j < SPAN:
            hit = np.zeros(len(offsets), np.bool_)
            hit[order] = np.maximum(common[:-1], common[1:]) >= LENGTH
            last[hit & (last < 0)] = j
            done = np.flatnonzero(~hit & (last >= 0))
            found.append((done, np.full(len(done), j + 1), last[done]))
            last[done] = -1
    done = np.flatnonzero(last >= 0)
    found.append((done, np.zeros(len(done), np.int64), last[done]))
    which, first, final = (np.concatenate([f[k] for f in found]) for k in range(3))
    shift = SPAN - 1 - offsets[which]
    return which, first - shift, final - shift


_OUT = "g long, c1 long, c2 long, a int, b int"


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settles the grams of one shard in a stream that is sorted by g, many small ones at a time."""

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        g, d = part["g"].to_numpy(), part["d"].to_numpy().astype(np.int64)
        group = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))
        which, a, b = repeated(transform(part["own"].tolist(), d, group), d)
        return part[["g", "c1", "c2"]].iloc[which].assign(a=a.astype(np.int32), b=b.astype(np.int32))

    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows >= SHARD:
            part = pd.concat(held, ignore_index=True)
            g = part["g"].to_numpy()
            cut = int(np.argmax(g == g[-1]))  # the last group may go on
            for at in _cuts(g[:cut]):
                yield settle(part.iloc[at].reset_index(drop=True))
            held, rows = [part.iloc[cut:]], len(part) - cut
    if rows:
        part = pd.concat(held, ignore_index=True)
        for at in _cuts(part["g"].to_numpy()):
            yield settle(part.iloc[at].reset_index(drop=True))


def _cuts(g: np.ndarray) -> Iterator[slice]:
    """Whole groups of some SHARD rows together."""
    if len(g):
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        _, first = np.unique(begin // SHARD, return_index=True)
        edges = [*begin[first].tolist(), len(g)]
        yield from (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True))


_TRANSFORM = "g long, shard int, j int, bytes binary"


def _transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shards of a stream that is sorted by (g, shard), as rows: the strings' fingerprints and offsets as column COLUMNS,
    then the transform."""
    rows = (r for batch in batches for r in batch[["g", "shard", "c1", "c2", "d", "own"]].itertuples(index=False, name=None))
    for (g, shard), own in groupby(rows, itemgetter(0, 1)):
        _, _, c1, c2, d, strings = zip(*own, strict=True)
        d = np.array(d, np.int64)
        held = [(g, shard, COLUMNS, np.stack([np.array(c1, np.int64), np.array(c2, np.int64), d]).tobytes())]
        held += [(g, shard, j, byte.tobytes()) for j, byte, _, _ in transform(list(strings), d, np.zeros(len(d), np.int64))]
        yield pd.DataFrame(held, columns=["g", "shard", "j", "bytes"])


def _merge_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the transforms of a stream that is sorted by g, falling column, and shard; one column is held at a time."""
    rows = (r for batch in batches for r in batch[["g", "j", "shard", "bytes"]].itertuples(index=False, name=None))
    for g, own in groupby(rows, itemgetter(0)):
        columns = ([r[3] for r in shards] for _, shards in groupby(own, itemgetter(1)))
        heads = [np.frombuffer(h, np.int64).reshape(3, -1) for h in next(columns)]
        c1, c2, d = np.concatenate(heads, axis=1)
        shard = np.repeat(np.arange(len(heads)), [h.shape[1] for h in heads])
        transforms = ([np.frombuffer(x, np.uint8) for x in column] for column in columns)
        which, a, b = repeated(merged(shard, transforms), d)
        yield pd.DataFrame({"g": np.full(len(which), g), "c1": c1[which], "c2": c2[which], "a": a.astype(np.int32), "b": b.astype(np.int32)})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per window of each string: its start, and a fingerprint of its bytes."""
    for batch in batches:
        for g, c1, c2, own in zip(batch["g"], batch["c1"], batch["c2"], batch["own"], strict=True):
            prints = [xxhash.xxh3_128_intdigest(own[k : k + LENGTH]) for k in range(len(own) - LENGTH + 1)]
            yield pd.DataFrame({"g": g, "c1": c1, "c2": c2, "a": np.arange(len(prints), dtype=np.int32), "w1": [(x >> 64) - 2**63 for x in prints], "w2": [(x & (2**64 - 1)) - 2**63 for x in prints]})


def repeated_runs(distinct: DataFrame) -> DataFrame:
    """``g``, ``c1``, ``c2``, ``a`` and ``b``: the strings' windows, from start a to start b, that other strings of their gram hold
    too. distinct: g, c1, c2, d, own; no string twice."""
    key = ["g", "c1", "c2"]
    # written, so that the joins deal the strings anew and may split a gram of very many
    sizes = stored(distinct.groupBy("g").agg(F.count("*").alias("_n")))
    sized = lambda where: distinct.join(sizes.where(where), "g")
    small = sized(f"_n BETWEEN 2 AND {SHARD}").select(*key, "d", "own").repartition("g").sortWithinPartitions("g", "c1", "c2").mapInPandas(_shards, _OUT)
    shard = F.pmod("c1", F.ceil(F.col("_n") / SHARD)).cast("int").alias("shard")
    large = sized(f"_n > {SHARD} AND _n <= {MERGED}").select(*key, "d", "own", shard)
    transforms = stored(large.repartition("g", "shard").sortWithinPartitions("g", "shard", "c1", "c2").mapInPandas(_transform, _TRANSFORM))
    joined = transforms.repartition("g").sortWithinPartitions("g", F.desc("j"), "shard").mapInPandas(_merge_shards, _OUT)
    # a gram of more strings still: its windows are counted one by one
    windows = sized(f"_n > {MERGED}").select(*key, "own").mapInPandas(_windows, "g long, c1 long, c2 long, a int, w1 long, w2 long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("_n")).where("_n > 1").select("w1", "w2")
    counted = windows.join(twice, ["w1", "w2"], "left_semi").select(*key, "a", F.col("a").alias("b"))
    return small.union(joined).union(counted)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``k``, ``v`` and ``starts``, ``ends``: the byte ranges, merged and in order, of each text's repeated strings.

    docs: k long, v long, text, none null; v tells texts of one k apart. Only texts with such strings are returned.
    """
    found = stored(docs.mapInPandas(_elect, "g long, k long, v long, lo int, d int, n int"))
    # written, so that the join deals both sides anew and may split a gram of very many elections
    often = stored(found.groupBy("g").agg(F.count("*").alias("_n")).where("_n > 1").select("g"))
    mine = found.join(often, "g", "left_semi").groupBy("k", "v").agg(F.collect_list(F.struct("g", "lo", "d", "n")).alias("_f"))
    mine = stored(mine.select("k", "v", *[F.col(f"_f.{c}").alias(c) for c in ("g", "lo", "d", "n")]))
    discard(found)
    discard(often)
    texts = restricted(docs, mine.select("k", "v")).join(mine, ["k", "v"])
    strings = stored(texts.mapInPandas(_strings, ", ".join(f"{c} {t}" for c, t in _STRINGS.items())))
    discard(mine)
    key = ["g", "c1", "c2"]
    distinct = stored(strings.groupBy(*key).agg(F.count("*").alias("copies"), F.first("own").alias("own"), F.first("d").alias("d"), F.first("n").alias("n")))
    copied = distinct.where("copies > 1").select(*key, F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))
    spans = strings.select(*key, "k", "v", "lo").join(copied.union(repeated_runs(distinct)), key)
    spans = spans.select("k", "v", (F.col("lo") + F.col("a")).alias("s"), (F.col("lo") + F.col("b") + LENGTH).alias("e"))
    spans = spans.groupBy("k", "v").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("_s"))
    spans = spans.select("k", "v", F.col("_s.s").alias("s"), F.col("_s.e").alias("e"))
    spans = stored(spans.mapInPandas(_merge, "k long, v long, starts array<int>, ends array<int>"))
    discard(strings)
    discard(distinct)
    return spans


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Touching spans become one."""
    for batch in batches:
        starts, ends = [], []
        for s, e in zip(batch["s"], batch["e"], strict=True):
            reach = np.maximum.accumulate(e)
            opens = np.concatenate([[True], s[1:] > reach[:-1]])
            starts.append(s[opens])
            ends.append(reach[np.concatenate([opens[1:], [True]])])
        yield batch[["k", "v"]].assign(starts=starts, ends=ends)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept = []
        for text, starts, ends in zip(batch["text"], batch["starts"], batch["ends"], strict=True):
            data = text.encode()
            kept.append(b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True)))
        yield batch[["doc_id", "n_bytes", "starts", "ends"]].assign(kept=kept)


def cut_repeated(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``starts`` and ``ends`` of the removed byte ranges, and ``kept``, the bytes left, as binary.

    Texts are compared as UTF-8 bytes, matches never cross documents, and strings are judged on the input: a byte goes if
    any string of LENGTH bytes over it also starts anywhere else, in the same text or another.

    Null texts count as empty; texts of fewer than LENGTH bytes lose nothing. Repeated rows are copies of each other and lose
    all they share. Rows that repeat an id with another text are told apart by a 64-bit hash of the text, and those of
    null ids, which are documents too, by one of 126 bits. Further columns are ignored. An empty table gives an empty table. A text may be of any length.
    """
    plain = keyed(docs)
    spans = repeated_spans(plain.select("k", "v", "text"))
    sized = plain.withColumn("n_bytes", F.octet_length("text").cast("long"))
    ids = spans.select("k", "v")
    hit = restricted(sized, ids).join(spans, ["k", "v"])
    hit = hit.select("doc_id", "n_bytes", "text", "starts", "ends").mapInPandas(_cut, "doc_id long, n_bytes long, starts array<int>, ends array<int>, kept binary")
    none = F.array().cast("array<int>")
    clean = restricted(sized, ids, outside=True).select("doc_id", "n_bytes", none.alias("starts"), none.alias("ends"), F.encode("text", "UTF-8").alias("kept"))
    return hit.union(clean)
