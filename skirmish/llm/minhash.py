"""Near-duplicate detection: MinHash bands find candidates, odd sketches sift them, full sets confirm the links."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skirmish.llm.common import discard, restricted, stored
from skirmish.llm.components import components
from skirmish.llm.texts import hashed_words

#: Standard deviations that a sketch may be off before a true link is lost.
DEVIATIONS = 6.5
#: Sets of a bucket that meet in one cell, at most on average, and shingles of those that meet with their full sets.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Pairs of sets that one numpy step compares.
STEP = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Bands and rows of MinHash samples; bits of the odd sketch of the samples, and of the one of the whole set.

    A pair of similarity s becomes a candidate with the probability 1 - (1 - s^rows)^bands.
    """

    bands: int
    rows: int
    sample_bits: int
    whole_bits: int

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def sample_limit(self, similarity: float) -> int:
        """The most bits in which the sample sketches of two sets of at least this similarity should differ."""
        least = similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / self.samples)
        return math.ceil(self.sample_bits / 2 * (1 - math.exp(-4 * self.samples * (1 - least) / self.sample_bits)))


#: For documents: misses a pair of similarity 0.8 with a probability of 5e-6.
DOCUMENTS = Plan(40, 6, 1024, 2048)


@lru_cache
def _random(plan: Plan) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20240229)
    odd = lambda *shape: rng.integers(0, 2**63, shape, dtype=np.uint64) | np.uint64(1)
    small = lambda: rng.integers(0, 2**32, plan.samples, dtype=np.uint32)
    return small() | np.uint32(1), small(), odd(plan.bands, plan.rows), odd(plan.bands), odd(plan.samples)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(w: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct word shingles, one text after the other, and where each ends.

    w: the hashes of the texts' words, n: how many each has. A text of fewer words than size makes one shingle, one
    without words none.
    """
    starts, count = np.cumsum(n) - n, np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.cumsum(count)
    h = w.copy()
    for k in range(1, size):
        h[: len(w) - k] = h[: len(w) - k] * _STEP + w[k:]
    h = _mix(h[np.repeat(starts - (ends - count), count) + np.arange(int(count.sum()))] + np.uint64(size))
    for short in np.flatnonzero((n > 0) & (n < size)).tolist():
        one = w[starts[short] : starts[short] + 1]
        for k in range(1, n[short]):
            one = one * _STEP + w[starts[short] + k]
        h[ends[short] - 1] = _mix(one + np.uint64(n[short]))[0]
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), np.bool_)
    new[1:] = h[1:] != h[:-1]
    new[(ends - count)[count > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[ends]


def samples(hashes: np.ndarray, ends: np.ndarray, plan: Plan) -> np.ndarray:
    """The MinHash samples of each set, which must not be empty."""
    multiply, add, *_ = _random(plan)
    starts = np.concatenate([[0], ends[:-1]])
    h, out = (hashes >> np.uint64(32)).astype(np.uint32), np.empty((len(ends), plan.samples), np.uint32)
    for k in range(plan.samples):
        out[:, k] = np.minimum.reduceat(h * multiply[k] + add[k], starts)
    return out.astype(np.uint64)


def band_keys(least: np.ndarray, plan: Plan) -> np.ndarray:
    _, _, multiply, add, _ = _random(plan)
    return _mix((least.reshape(-1, plan.bands, plan.rows) * multiply).sum(axis=2, dtype=np.uint64) + add).view(np.int64)


def _parity(owner: np.ndarray, places: np.ndarray, sets: int, bits: int) -> np.ndarray:
    flips = np.bincount(owner * bits + (places % np.uint64(bits)).astype(np.int64), minlength=sets * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(sets, bits), axis=1).view(np.int64)


def odd_sketches(hashes: np.ndarray, ends: np.ndarray, least: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Two odd sketches of each set, of its MinHash samples and of all its hashes.

    A member flips one bit, so that what two sets share cancels in the XOR of their sketches.
    """
    *_, multiply = _random(plan)
    sets = len(ends)
    places = _mix((least + np.arange(plan.samples, dtype=np.uint64)) * multiply)
    sample = _parity(np.repeat(np.arange(sets), plan.samples), places.ravel(), sets, plan.sample_bits)
    return sample, _parity(np.repeat(np.arange(sets), np.diff(ends, prepend=0)), hashes >> np.uint64(17), sets, plan.whole_bits)


def fingerprints(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two columns."""
    held, found = memoryview(hashes.tobytes()), []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        found.append(xxhash.xxh3_128_digest(held[8 * a : 8 * b]))
    return np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)


def lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


SIGNED = "n_shingles long, hi long, lo long, keys array<long>"


def signed(texts: pa.Array, size: int, plan: Plan) -> Iterator[tuple[slice, list[pa.Array]]]:
    """The columns of SIGNED for runs of texts, as slices. A text without words has no keys: null."""
    for own, w, n in hashed_words(texts):
        hashes, ends = shingle_sets(w, n, size)
        count = np.diff(ends, prepend=0)
        some = count > 0
        keys = band_keys(samples(hashes, ends[some], plan), plan) if some.any() else np.empty((0, plan.bands), np.int64)
        prints = fingerprints(hashes, ends)
        offsets = np.concatenate([[0], np.cumsum(some) * plan.bands]).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()), mask=pa.array(~some))
        yield own, [pa.array(count), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), found]


SET = "id long, n_shingles long, sample array<long>, whole array<long>, members array<long>"


def _sets(size: int, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, w, n in hashed_words(batch.column("text")):
                hashes, ends = shingle_sets(w, n, size)
                sample, whole = odd_sketches(hashes, ends, samples(hashes, ends, plan), plan)
                members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(hashes.view(np.int64)))
                columns = [batch.column("id")[own.start : own.stop], pa.array(np.diff(ends, prepend=0)), lists(sample), lists(whole), members]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "sample", "whole", "members"])

    return run


def _whole_limit(n, percent: int, bits: int, deviations: float = DEVIATIONS):
    """The most bits in which the whole sketches of two sets of n shingles together, alike to percent, should differ."""
    most = n * (100 - percent) / (100 + percent)
    left = np.exp(-4 * most / bits)
    # the variance of the count; the addend covers that it is an approximation
    return bits / 2 * (1 - np.exp(-2 * most / bits)) + deviations * np.sqrt(np.maximum(bits / 4 * (1 - left) - most * left, 0) + 1)


class Cells:
    """Whole cells of a stream of rows that is sorted by cell: the rows' arrays, and where the cells begin."""

    def __init__(self, rows: pa.Table, by: list[str]):
        self.rows = rows.combine_chunks()
        keys = [self.numbers(c) for c in by]
        new = np.ones(rows.num_rows, np.bool_)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(self.starts, append=rows.num_rows)

    def numbers(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy()

    def matrix(self, name: str) -> np.ndarray:
        return self.rows.column(name).combine_chunks().flatten().to_numpy().reshape(self.rows.num_rows, -1)

    @staticmethod
    def of(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 20_000) -> Iterator[Cells]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= least:
                rows = pa.Table.from_batches(held).combine_chunks()
                cut = int(Cells(rows, by).starts[-1])  # the last cell may go on
                if cut:
                    yield Cells(rows.slice(0, cut), by)
                held = rows.slice(cut).to_batches()
        if sum(b.num_rows for b in held):
            yield Cells(pa.Table.from_batches(held), by)

    def near(self, percent: int, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For cells of one size at a time, by their rows (cell, place): which pairs (place, earlier place) are near by
        their sketches, and which of them most likely have the similarity."""
        n, sample, whole = self.numbers("n_shingles"), self.matrix("sample"), self.matrix("whole")

        def differ(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            own, out = x.view(np.uint64)[rows], np.zeros((*rows.shape, rows.shape[1]), np.int32)
            for k in range(x.shape[1]):
                out += np.bitwise_count(own[:, :, None, k] ^ own[:, None, :, k])
            return out

        for size in np.unique(self.sizes[self.sizes > 1]).tolist():
            cells = self.starts[self.sizes == size]
            step = max(1, STEP // size**2)
            for k in range(0, len(cells), step):
                rows = cells[k : k + step, None] + np.arange(size)
                m = n[rows]
                near = np.tri(size, size, -1, np.bool_) & (100 * np.minimum(m[:, :, None], m[:, None, :]) >= percent * np.maximum(m[:, :, None], m[:, None, :]))
                near &= differ(sample, rows) <= plan.sample_limit(percent / 100)
                if near.any():
                    bits, both = differ(whole, rows), m[:, :, None] + m[:, None, :]
                    near &= bits <= _whole_limit(both, percent, plan.whole_bits)
                    yield rows, near, near & (bits <= _whole_limit(both, percent, plan.whole_bits, 0.0))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])


def _forest(percent: int, plan: Plan):
    """Of each set its first likely, or else its last near, partner among the earlier ones of its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in Cells.of(batches, ["key", "cell"]):
            ids, a, b = cells.numbers("id"), [], []
            for rows, near, likely in cells.near(percent, plan):
                size = rows.shape[1]
                to = np.where(likely.any(axis=2), likely.argmax(axis=2), size - 1 - near[:, :, ::-1].argmax(axis=2))
                i, j = np.nonzero(near.any(axis=2))
                a.append(ids[rows[i, j]])
                b.append(ids[rows[i, to[i, j]]])
            yield _pairs(a, b)

    return run


def _apart(percent: int, plan: Plan):
    """Sets that are near to one of another label in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in Cells.of(batches, ["key", "cell"]):
            ids, labels, found = cells.numbers("id"), cells.numbers("label"), []
            for rows, near, _ in cells.near(percent, plan):
                near &= labels[rows][:, :, None] != labels[rows][:, None, :]
                found.append(np.unique(ids[rows[near.any(axis=2) | near.any(axis=1)]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.empty(0, np.int64), pa.int64())], names=["id"])

    return run


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of the other sets has in common with own; all sorted as unsigned numbers, and not empty."""
    own, flat = own.view(np.uint64), np.concatenate(others).view(np.uint64)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def _settle(percent: int, plan: Plan):
    """Links, by full sets, that join all labels of a cell that any link joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in Cells.of(batches, ["key", "cell"], 2 * BLOCK):
            ids, labels, bucket, keys = cells.numbers("id"), cells.numbers("label"), cells.numbers("key"), cells.matrix("keys")
            sets, a, b = cells.rows.column("members").combine_chunks(), [], []
            held, ends = sets.flatten().to_numpy(), np.asarray(sets.offsets) - sets.offsets[0].as_py()
            members = lambda r: held[ends[r] : ends[r + 1]]  # noqa: E731, B023
            for rows, near, _ in cells.near(percent, plan):
                for place, close in zip(rows, near, strict=True):
                    root = {x: x for x in labels[place].tolist()}

                    def top(x: int) -> int:
                        while root[x] != x:  # noqa: B023
                            x = root[x]  # noqa: B023
                        return x

                    for i in np.flatnonzero(close.any(axis=1)).tolist():
                        r, other = place[i], place[np.flatnonzero(close[i])]
                        # a pair that meets in several buckets counts in the first one that it shares
                        first = keys[other][np.arange(len(other)), (keys[other] == keys[r]).argmax(axis=1)]
                        mine = top(int(labels[r]))
                        other = [j for j, f in zip(other.tolist(), first, strict=True) if f == bucket[r] and top(int(labels[j])) != mine]
                        if not other:
                            continue
                        common = _shared(members(r), [members(j) for j in other])
                        for j, c in zip(other, common.tolist(), strict=True):
                            linked = 100 * c >= percent * (len(members(r)) + len(members(j)) - c)
                            x, y = top(int(labels[r])), top(int(labels[j]))
                            if linked and x != y:
                                root[max(x, y)] = min(x, y)
                                a.append(ids[[r]])
                                b.append(ids[[j]])
            yield _pairs(a, b)

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            x, y = (batch.column(c) for c in ("x", "y"))
            for k in range(batch.num_rows):
                own, other = (np.asarray(z[k].values) for z in (x, y))
                c = int(_shared(own, [other])[0])
                ok.append(100 * c >= percent * (len(own) + len(other) - c))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have at least this percentage of their union in common."""
    side = lambda name, members: sets.select(F.col("id").alias(name), F.col("members").alias(members))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def _dealt(rows: DataFrame, cell) -> DataFrame:
    """rows by their cells, each whole in one task and in the order of its ids."""
    return rows.withColumn("cell", cell).repartition("key", "cell").sortWithinPartitions("key", "cell", "id")


def forest(members: DataFrame, sets: DataFrame, percent: int, plan: Plan) -> DataFrame:
    """Likely links (a, b) within buckets: in blocks of some BLOCK sets, each with the bucket's smallest as well."""
    whole = members.groupBy("key").agg(F.min("id").alias("_center"), F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    own = F.array(F.pmod(F.xxhash64("id", "key"), F.col("_blocks")).cast("int"))
    every = F.when(F.col("id") == F.col("_center"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(own)
    rows = members.join(whole, "key").select("key", "id", F.explode(every).alias("_cell"))
    rows = rows.join(sets.select("id", "n_shingles", "sample", "whole"), "id")
    return _dealt(rows, F.col("_cell")).drop("_cell").mapInArrow(_forest(percent, plan), "a long, b long").distinct()


def cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Cells in which each two sets of a bucket that have different labels meet. members: key, id, label.

    A bucket of some BLOCK sets, and of BLOCK_SHINGLES, is one cell. In a larger one, the sets of the most frequent label
    are its main part and the others strays: blocks of strays meet blocks of all, so that no task holds a bucket.
    """
    rows = members.join(sets, "id")
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max(F.struct("n", "m", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, m: F.ceil(F.greatest(n / BLOCK, m / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("key", F.col("main.label").alias("_main"), blocks(F.col("n"), F.col("m")).alias("_cols"), blocks(F.col("n") - F.col("main.n"), F.col("m") - F.col("main.m")).alias("_rows"))
    spot = lambda seed, n: F.pmod(F.xxhash64("id", "key", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    column = F.transform(upto("_rows"), lambda r: r * F.col("_cols") + spot(1, "_cols"))
    row = F.when(F.col("label") != F.col("_main"), F.transform(upto("_cols"), lambda c: spot(2, "_rows") * F.col("_cols") + c)).otherwise(F.array().cast("array<int>"))
    met = F.when(F.col("_cols") == 1, F.array(F.lit(0))).otherwise(F.array_union(column, row))
    return _dealt(rows.join(sizes, "key").withColumn("_cell", F.explode(met)), F.col("_cell")).drop("_main", "_cols", "_rows", "_cell")


def linked(keys: DataFrame, texts: Callable[[DataFrame], DataFrame], size: int, percent: int, plan: Plan, also: DataFrame | None = None) -> DataFrame:
    """``id`` and ``label``, the smallest id of its component, for every set that is linked to another.

    keys: id long, keys (of signed()); the sets are distinct and not empty. texts: gives (id, text) for a table of ids.
    also: more links (a, b).

    Only sets that share a bucket go on; their sketches and full sets are made once and stored. forest() proposes a likely
    link for each, and full sets confirm it, which joins most of what belongs together. What is then still apart and near
    by its sketches meets once more in cells(), with the full sets: no link between different labels is lost there.
    """
    buckets = keys.select("id", F.explode("keys").alias("key"))
    several = stored(buckets.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"))
    members = stored(restricted(buckets, several).select("key", "id"))
    discard(several)
    ids = stored(members.select("id").distinct())
    sets = stored(texts(ids).select("id", "text").mapInArrow(_sets(size, plan), SET))
    links = stored(confirmed(stored(forest(members, sets, percent, plan)), sets, percent))
    if also is not None:
        links = links.union(also)
    labels = stored(components(links))
    sketches = sets.select("id", "n_shingles", "sample", "whole")
    name = F.coalesce("label", "id").alias("label")
    while True:
        # of a bucket in very many parts, one set of each first
        parted = members.join(labels, "id", "left").select("key", "id", name)
        parts = parted.groupBy("key", "label").agg(F.min("id").alias("id")).select("key", "label", "id")
        large = stored(parts.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).select("key"))
        if not large.limit(1).count():
            break
        more = stored(confirmed(stored(forest(restricted(parts, large).select("key", "id"), sets, percent, plan)), sets, percent))
        if not more.limit(1).count():
            break
        links = stored(links.union(more))
        labels = stored(components(links))
    apart = stored(cells(parted, sketches).mapInArrow(_apart(percent, plan), "id long").distinct())
    if apart.limit(1).count():
        rest = parted.join(apart, "id", "left_semi").join(keys, "id")
        more = stored(cells(rest, sets).mapInArrow(_settle(percent, plan), "a long, b long"))
        if more.limit(1).count():
            labels = stored(components(links.union(more)))
    for done in (members, sets):
        discard(done)
    return labels


def _documents(size: int, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, columns in signed(batch.column("text"), size, plan):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[own.start : own.stop], *columns], names=["doc_id", "n_shingles", "hi", "lo", "keys"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of docs.

    Documents are linked if their sets of word shingles (``size`` words, A-Z lower-cased) share ``percent`` of their
    union. component_id is the smallest id reachable over links; one document of a component, the one of that id, is kept.
    Equal sets are merged by a 128-bit fingerprint first, so exact copies never meet again; linked() does the rest.

    Null and empty texts, and texts without words, have the empty set: linked with nothing, component_id is their own id.
    A null id can't be linked: its component_id is null and it is kept. Rows that repeat an id are one document: links
    of each of its texts count for all, each row shows its own n_shingles. Further columns of docs are ignored. An empty
    table gives an empty table. Texts are hashed whole, whatever their length.
    """
    plan = DOCUMENTS
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signs = stored(plain.mapInArrow(_documents(size, plan), f"doc_id long, {SIGNED}"))
    linkable = signs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = stored(linkable.groupBy("hi", "lo").agg(F.min("doc_id").alias("id")))
    rows = signs.select("doc_id", "n_shingles", "hi", "lo").join(reps, ["hi", "lo"], "left")
    rows = stored(rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("id")).otherwise(F.col("doc_id")).alias("id")))
    keys = linkable.select("doc_id", "hi", "lo", "keys").join(reps, ["hi", "lo"]).where("doc_id = id")
    keys = stored(keys.select("id", "keys"))
    discard(signs)
    # an id with several texts stands for several sets
    twice = rows.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("_m")).where("b < _m").select("doc_id", "b")
    same = rows.join(twice, "doc_id").where("id != b").select(F.col("id").alias("a"), "b")
    named = plain.withColumnRenamed("doc_id", "id")
    labels = linked(keys, lambda ids: restricted(named, ids), size, percent, plan, same)
    discard(keys)
    component = F.coalesce("label", "id")
    return rows.join(labels, "id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, the one of the smallest id, with the columns of docs.

    Of rows that repeat an id one stays, the one of the first text. Rows with a null id take part by a hash of their text,
    after all other ids, so of copies of one another one stays too. Null and empty texts have no duplicates but by
    their id. An empty table stays empty.
    """
    body = F.coalesce("text", F.lit(""))
    stand_in = F.shiftrightunsigned(F.xxhash64(body), 2).bitwiseOR(F.lit(2**62))
    own = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), stand_in))
    judged = stored(near_duplicates(own.select("_k", "text"), size, percent, doc_id="_k"))
    gone = stored(judged.where(~F.col("kept")).select(F.col("doc_id").alias("_k")).distinct())
    kept = restricted(own, gone, outside=True)
    twice = stored(judged.where("kept").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_k")))
    if twice.limit(1).count():
        first = F.row_number().over(W.partitionBy("_k").orderBy("text", *[F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]))
        one = restricted(kept, twice).withColumn("_n", first).where("_n = 1").drop("_n")
        kept = restricted(kept, twice, outside=True).unionByName(one)
    return kept.select(docs.columns)
