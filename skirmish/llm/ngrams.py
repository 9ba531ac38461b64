"""Jaccard join of word n-gram sets: equal parts of the hash space bring sets together, a prefix tree joins them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import BROADCAST_IDS, discard, restricted, stored
from skirmish.llm.components import components
from skirmish.llm.minhash import BLOCK, BLOCK_SHINGLES, Cells, _mix, cells, fingerprints, shingle_sets
from skirmish.llm.texts import hashed_words

#: Parts beyond those that the differences of two linked sets can spoil: so many may be empty without a key of their own.
SPARE = 2
#: How the sizes of sets that share a partition grow from class to class.
GROWTH = 1.5
#: Groups with so many strays are parted anew by other partitions, so many times: below, comparing them costs less.
WIDE, REFINED = 8 * BLOCK, 3
#: Random blocks that each set of such a group meets others in.
DEALS = 2

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_2 = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache
def partitions(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The least size of each class of sets, and in how many parts its sets are cut; 0 where linked sets are equal.

    Two linked sets of a and b members differ in (a + b) * (100 - percent) / (100 + percent) at most, and each of these
    spoils one part. Of SPARE + 1 more parts all are equal in both.
    """
    least = [1]
    while least[-1] < 1 << 32:
        least.append(max(least[-1] + 1, int(least[-1] * GROWTH)))
    least = np.array(least, np.int64)
    apart = 2 * (least[1:] - 1) * (100 - percent) // (100 + percent)
    return least, np.where(apart > 0, apart + 1 + SPARE, 0)


def part_keys(hashes: np.ndarray, ends: np.ndarray, percent: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The keys of sets' parts, one set after the other, and how many each set has. hashes, ends: as of shingle_sets().

    A part is a range of hashes; its key is made of its class, its number and its members. Sets that may be linked to ones
    of the next class have that one's keys as well. Any two linked sets that are not equal share a key.
    """
    if seed:
        hashes = _mix(hashes + np.uint64(seed * int(_ODD) % 2**64))
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            hashes[a:b].sort()
    least, parts = partitions(percent)
    n, starts = np.diff(ends, prepend=0), ends - np.diff(ends, prepend=0)
    own = np.searchsorted(least, n, "right") - 1
    both = (n > 0) & (100 * n >= percent * least[own + 1])
    who = np.concatenate([np.flatnonzero(n > 0), np.flatnonzero(both)])
    kind = np.concatenate([own[n > 0], own[both] + 1])
    who, kind = who[parts[kind] > 0], kind[parts[kind] > 0]
    if not len(who):
        return np.empty(0, np.int64), np.zeros(len(n), np.int64)
    count = n[who]
    at = np.repeat(starts[who] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    h, cuts = hashes[at], parts[kind].astype(np.uint64)
    part = (h >> np.uint64(32)) * np.repeat(cuts, count) >> np.uint64(32)
    base = np.cumsum(parts[kind]) - parts[kind]  # parts one after the other
    place = np.repeat(base, count) + part.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    sums = np.zeros(int(parts[kind].sum()), np.uint64)
    sums[place[first]] = np.add.reduceat(_mix(h ^ _ODD_2), first)
    filled = np.zeros(len(sums), np.bool_)
    filled[place] = True
    of = np.repeat(np.arange(len(who)), parts[kind])
    empty = parts[kind] - np.bincount(of[filled], minlength=len(who))
    held = filled | (empty > SPARE)[of]
    number = np.arange(len(sums)) - base[of]
    keys = _mix(sums + number.astype(np.uint64) * _ODD + kind[of].astype(np.uint64) * _ODD_2)[held]
    of = who[of[held]]
    order = np.argsort(of, kind="stable")
    return keys[order].view(np.int64), np.bincount(of, minlength=len(n))


SIGNED = "n_shingles long, hi long, lo long"


def _sign(size: int, percent: int | None):
    """Sizes and fingerprints of the sets, and with a percent their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, w, n in hashed_words(batch.column("text")):
                hashes, ends = shingle_sets(w, n, size)
                prints = fingerprints(hashes, ends)
                columns = [pa.array(x) for x in (batch.column("doc_id")[own.start : own.stop], np.diff(ends, prepend=0), prints[:, 0].copy(), prints[:, 1].copy())]
                if percent is not None:
                    keys, count = part_keys(hashes, ends, percent)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(keys)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "hi", "lo", "keys"][: len(columns)])

    return run


def _part_again(size: int, percent: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, w, n in hashed_words(batch.column("text")):
                keys, count = part_keys(*shingle_sets(w, n, size), percent, seed)
                of = pa.array(np.repeat(np.arange(own.start, own.stop), count))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(of), batch.column("id").take(of), pa.array(keys)], names=["key", "id", "part"])

    return run


class Tree:
    """A prefix tree of sets of hashes, all in the order of the hashes, over which each set is held against all others.

    Sets that begin alike share a node, and at a node it is known how many members each set has in common with that
    beginning, so that this is counted once for all sets below. A node is left out, with all below it, if no set can get
    enough in common with one below: by what is left of either, or because they are joined already.
    """

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, percent: int):
        packed = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=packed.__getitem__)
        sets = [sets[k] for k in self.order]
        self.percent, self.n = percent, np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.n) - self.n
        _, self.members, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.n)
        self.df, self.first = df, np.cumsum(df) - df
        self.holders = owner[np.argsort(self.members, kind="stable")]
        self.places = owner * len(df) + self.members
        self.roots = np.unique(labels[self.order], return_inverse=True)[1]
        self.alike = np.zeros(len(sets), np.int64)  # how many first members each set shares with the one before it
        for k in range(1, len(sets)):
            m = min(self.n[k - 1], self.n[k])
            differ = sets[k - 1][:m] != sets[k][:m]
            self.alike[k] = differ.argmax() if differ.any() else m

    def _common(self, k: int, a: int, b: int) -> np.ndarray:
        """How many of the a-th to b-th members of set k each set has."""
        own = self.members[self.starts[k] + a : self.starts[k] + b]
        own = own[self.df[own] > 1]
        n = self.df[own]
        at = np.repeat(self.first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.holders[at], minlength=len(self.n))

    def _enough(self, common: np.ndarray, n: np.ndarray | int, others: np.ndarray) -> np.ndarray:
        return (100 + self.percent) * common >= self.percent * (n + others)

    def components(self) -> np.ndarray:
        """The component of each set, by a number."""
        every = np.arange(len(self.n))
        stack = [(0, len(self.n), 0, np.zeros(len(self.n), np.int64), every)]
        while stack:
            lo, hi, depth, common, alive = stack.pop()
            roots = self.roots[lo:hi]
            if (roots == roots[0]).all():
                alive = alive[self.roots[alive] != roots[0]]
            if not len(alive):
                continue
            end = int(self.n[lo]) if hi - lo == 1 else int(self.alike[lo + 1 : hi].min())
            if end > depth:
                common = common + self._common(lo, depth, end)
            if hi - lo == 1:
                for k in alive[self._enough(common[alive], self.n[lo], self.n[alive])].tolist():
                    a, b = sorted((int(self.roots[lo]), int(self.roots[k])))
                    if a != b:
                        self.roots[self.roots == b] = a
                continue
            if end:
                # what is left of each set beyond the last member of the beginning, and the most that any set below can add
                last = self.members[self.starts[lo] + end - 1]
                left = self.n[alive] - (np.searchsorted(self.places, alive * len(self.df) + last, "right") - self.starts[alive])
                best = np.clip(end + left, self.n[lo:hi].min(), self.n[lo:hi].max())
                alive = alive[self._enough(common[alive] + np.minimum(left, best - end), best, self.n[alive])]
            cuts = [lo, *(np.flatnonzero(self.alike[lo + 1 : hi] == end) + lo + 1).tolist(), hi]
            stack += [(a, b, end, common, alive) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out = np.empty(len(self.n), np.int64)
        out[self.order] = self.roots
        return out


def _join(size: int, percent: int):
    """Each set of a cell with the least id that links there join it to, if that is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in Cells.of(batches, ["key", "cell"], 2 * BLOCK):
            ids, labels, a, b = held.numbers("id"), held.numbers("label"), [], []
            texts = held.rows.column("text")
            for start, n in zip(held.starts.tolist(), held.sizes.tolist(), strict=True):
                if n < 2:
                    continue
                sets = []
                for _, w, count in hashed_words(texts.slice(start, n).combine_chunks()):
                    hashes, ends = shingle_sets(w, count, size)
                    sets += np.split(hashes, ends[:-1])
                own = ids[start : start + n]
                to = Tree(sets, labels[start : start + n], percent).components()
                least = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(least, to, own)
                a.append(own[own != least[to]])
                b.append(least[to][own != least[to]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], names=["a", "b"])

    return run


def _met(parts: DataFrame, by: list[str]) -> DataFrame:
    """``first`` and ``id``: groups, named by their least id, in which all ids meet that share a part. parts: by, id.

    An id is in as many groups as its parts have different least ids. Parts of one id have none.
    """
    least = stored(parts.groupBy(*by).agg(F.min("id").alias("first"), F.max("id").alias("_last")).where("first != _last").drop("_last"))
    known = F.broadcast(least) if least.count() <= BROADCAST_IDS else least
    return parts.join(known, by)


def _deal(rows: DataFrame) -> DataFrame:
    """rows by their cells, each whole in one task."""
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "id")


def joined(keys: DataFrame, texts: Callable[[DataFrame], DataFrame], size: int, percent: int, also: DataFrame | None = None) -> DataFrame:
    """``id`` and ``label``, the smallest id of its component, for every set that is linked to another.

    keys: id, n_shingles and keys (of part_keys()) of distinct sets. texts: gives (id, text) for a table of ids. also: more
    links (a, b).

    Linked sets share a key, and so a group, that of the key's least id. A group of some BLOCK sets is one tree. The sets of a
    larger one meet others in DEALS random blocks first, which joins most of what belongs together; where many are left
    apart, the group is parted anew by other partitions of the hash space, which parts sets that shared a key by chance, and
    then blocks of the strays meet blocks of all others: no link is lost.
    """
    sized = keys.select("id", "n_shingles")
    groups = stored(_met(keys.select("id", F.explode("keys").alias("part")), ["part"]).select(F.col("first").alias("key"), "id").distinct())
    members = groups.join(sized, "id")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = stored(members.groupBy("key").agg(blocks.alias("_blocks")))
    deals = F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.col("_blocks")).cast("int") + k * F.col("_blocks") for k in range(DEALS)])
    dealt = members.join(sizes, "key").select("key", "id", F.col("id").alias("label"), F.explode(F.when(F.col("_blocks") > 1, deals).otherwise(F.array(F.lit(0)))).alias("cell"))
    sets = texts(stored(groups.select("id").distinct())).select("id", "text")
    links = stored(_deal(dealt.join(sets, "id")).mapInArrow(_join(size, percent), "a long, b long"))
    if also is not None:
        links = links.union(also)
    labels = stored(components(links))
    large = stored(sizes.where("_blocks > 1").select("key"))
    if not large.limit(1).count():
        return labels
    name = F.coalesce("label", "id").alias("label")
    # all but the sets of a group's most frequent label
    strays = lambda parted: parted.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg((F.sum("n") - F.max("n")).alias("_strays")).where("_strays > 0")
    parted, before = stored(restricted(groups, large).join(labels, "id", "left").select("key", "id", name)), None
    for seed in range(1, REFINED + 1):
        wide = stored(strays(parted).where(F.col("_strays") > WIDE))
        left = wide.agg(F.sum("_strays")).first()[0]
        # sets that are alike, but not linked, stay together whatever the parts
        if not left or before and left > before / 2:
            break
        wide, before = wide.select("key"), left
        own = restricted(parted, wide)
        again = stored(own.join(texts(stored(own.select("id").distinct())), "id").select("key", "id", "text").mapInArrow(_part_again(size, percent, seed), "key long, id long, part long"))
        # what shares no part with another has no link either
        finer = _met(again, ["key", "part"]).select("key", "id", F.xxhash64("key", "first").alias("_key")).distinct()
        finer = own.join(finer, ["key", "id"]).select(F.col("_key").alias("key"), "id", "label")
        parted = stored(finer.union(restricted(parted, wide, outside=True)))
        discard(again)
    parted = restricted(parted, stored(strays(parted).select("key")))
    if parted.limit(1).count():
        more = cells(parted, texts(stored(parted.select("id").distinct())).join(sized, "id"))
        more = stored(more.mapInArrow(_join(size, percent), "a long, b long"))
        # these links join labels
        known = lambda end: F.coalesce(f"_{end}", end).alias(end)
        for end in ("a", "b"):
            more = more.join(labels.withColumnsRenamed({"id": end, "label": f"_{end}"}), end, "left").select(known(end), "b" if end == "a" else "a")
        joins = stored(components(stored(more.where("a != b").distinct())).select(F.col("id").alias("label"), F.col("label").alias("_to")))
        single = joins.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("id"), F.col("_to").alias("label"))
        labels = stored(labels.join(joins, "label", "left").select("id", F.coalesce("_to", "label").alias("label")).union(single))
    return labels


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable over links, for every row of docs.

    Documents are linked if their sets of word shingles (``size`` words, A-Z lower-cased) share ``percent`` of their
    union. Equal sets are merged by a 128-bit fingerprint first; joined() does the rest and loses no link. percent of 50
    or more: the lower it is, the smaller and the more common the parts that sets meet by.

    Null and empty texts, and texts without words, have the empty set: linked with nothing, component_id is their own id.
    A null id can't be linked: its component_id is null. Rows that repeat an id are one document: links of each of its
    texts count for all, each row shows its own n_shingles. Further columns of docs are ignored. An empty table gives an
    empty table. Texts are hashed whole, whatever their length; shingles are told by 64-bit hashes.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signs = stored(plain.mapInArrow(_sign(size, None), f"doc_id long, {SIGNED}"))
    linkable = "n_shingles > 0 AND doc_id IS NOT NULL"
    reps = stored(signs.where(linkable).groupBy("hi", "lo").agg(F.min("doc_id").alias("id")))
    rows = signs.select("doc_id", "n_shingles", "hi", "lo").join(reps, ["hi", "lo"], "left")
    rows = stored(rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("id")).otherwise(F.col("doc_id")).alias("id")))
    # made from the texts once more: cheaper than to keep the keys of all documents
    keyed = plain.where("doc_id IS NOT NULL").mapInArrow(_sign(size, percent), f"doc_id long, {SIGNED}, keys array<long>").where(linkable)
    keys = stored(keyed.join(reps, ["hi", "lo"]).where("doc_id = id").select("id", "n_shingles", "keys"))
    discard(signs)
    # an id with several texts stands for several sets
    twice = rows.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("_m")).where("b < _m").select("doc_id", "b")
    same = rows.join(twice, "doc_id").where("id != b").select(F.col("id").alias("a"), "b")
    named = plain.withColumnRenamed("doc_id", "id")
    labels = joined(keys, lambda ids: restricted(named, ids), size, percent, same)
    discard(keys)
    return rows.join(labels, "id", "left").select("doc_id", "n_shingles", F.coalesce("label", "id").alias("component_id"))
