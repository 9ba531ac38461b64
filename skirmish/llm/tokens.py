"""Token-ID output: Parquet list columns with chosen encodings, read back selectively."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.texts import runs, word_places, word_prints

#: Words whose ids a Python worker remembers; a word costs some 50 bytes.
REMEMBERED = 2_000_000
#: Stands between words that are encoded together.
MARK = "\x00"

#: How the files are written. Version 2 pages encode integers as deltas in bit-packed blocks where there is no dictionary;
#: ids take a dictionary as long as it pays. Row groups are bounded for the memory of a task that reads one, pages for
#: selective reads through the page index.
WRITE_OPTIONS = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "5000",
    "compression": "zstd",
}
FILE_SCHEMA = "part int, start_in_part long, doc_id long, n_tokens int, ids array<int>"


#: Texts whose ids show whether a tokenizer treats the words between white space one by one.
PROBES = ["a b", " a", "a ", "a  b", "Ab\tc", "a\nb\r\n", "x\x0b\x0cy", "1 2 34", "x, y! (z)", "\u00e9 \u00fc", "it's ok", "\u03a3\u03a3 \u03a3"]


class Encoder:
    """A column's ids, equal to the tokenizer's on the whole texts.

    No token of a tokenizer that drops white space spans a space, so the ids of a text are those of its words one after the
    other; words recur, and each is given to the tokenizer once until the memory is full. Words are told apart by two 64-bit
    hashes; where one of them is equal and the other not, the texts are encoded whole. by_words: None lets PROBES
    decide; True demands it, and fails on a tokenizer that encodes spaces; False gives it whole texts.
    """

    def __init__(self, path: str, end_id: int | None, by_words: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = np.empty(0, np.int32) if end_id is None else np.array([end_id], np.uint32).view(np.int32)
        apart = self.splits_at_space()
        if by_words and not apart:
            raise ValueError(f"{path} encodes white space: its texts can't be encoded word by word")
        self.by_words = apart if by_words is None else by_words
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)  # two hashes of the known words, by the first
        self.number = np.empty(0, np.int64)  # their places in the order of arrival
        self.sizes, self.pool = np.empty(0, np.int64), np.empty(0, np.int32)  # how many ids each has, and these, in that order

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def splits_at_space(self) -> bool:
        # bytes.split() splits at ASCII white space only
        return all(whole == [i for ids in self._ids([w.decode() for w in p.encode().split()]) for i in ids] for p, whole in zip(PROBES, self._ids(PROBES), strict=True))

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them. Many words are one text, with a mark between, which is far cheaper."""
        sizes, pool = [], []
        mark = self._ids([MARK])[0]
        for k in range(0, len(words), 1000):
            own = words[k : k + 1000]
            ids = np.array(self._ids([f" {MARK} ".join(own)])[0], np.uint32).view(np.int32)
            cuts = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else []
            if len(cuts) == len(own) - 1 and not any(MARK in w for w in own):
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                pool.append(np.delete(ids, cuts))
            else:
                apart = self._ids(own)
                sizes.append(np.fromiter(map(len, apart), np.int64, len(apart)))
                pool.append(np.array([i for x in apart for i in x], np.uint32).view(np.int32))
        return np.concatenate(sizes), np.concatenate(pool)

    def _by_words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a run of texts; None if the hashes of two words can't be told apart."""
        starts, stops, count = word_places(data, ends)
        key, check = word_prints(data, starts, stops)
        key, first, which = np.unique(key, return_index=True, return_inverse=True)
        if (check[first][which] != check).any():
            return None
        check = check[first]
        if len(self.keys) + len(key) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), np.bool_)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        if (self.checks[at[known]] != check[known]).any():
            return None
        new = np.flatnonzero(~known)
        if len(new):
            words = [data[a:b].tobytes().decode() for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)]
            sizes, pool = self._word_ids(words)
            self.keys, self.checks = np.insert(self.keys, at[new], key[new]), np.insert(self.checks, at[new], check[new])
            self.number = np.insert(self.number, at[new], len(self.sizes) + np.arange(len(new)))
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, pool])
        word = self.number[np.searchsorted(self.keys, key)][which]
        size = self.sizes[word]
        until = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat((np.cumsum(self.sizes) - self.sizes)[word] - until[:-1], size) + np.arange(until[-1])]
        return ids, np.diff(until[np.concatenate([[0], np.cumsum(count)])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one text after the other; and how many each has. Null is empty."""
        ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for own, data, ends in runs(texts):
            found = self._by_words(data, ends) if self.by_words else None
            if found is None:
                whole = self._ids(texts[own.start : own.stop].fill_null("").to_pylist())
                found = np.array([i for x in whole for i in x], np.uint32).view(np.int32), np.fromiter(map(len, whole), np.int64, len(whole))
            ids.append(found[0])
            counts.append(found[1])
        flat, count = np.concatenate(ids), np.concatenate(counts)
        out = np.empty(len(flat) + len(count) * len(self.end), np.int32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(count)), count) * len(self.end)] = flat
        if len(self.end):
            out[np.cumsum(count + 1) - 1] = self.end[0]
        return out, count + len(self.end)


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int | None, by_words: bool | None) -> Encoder:
    """A task's encoder, kept for the next task of the same Python worker with all the words that it knows."""
    return Encoder(path, end_id, by_words)


def _encode(path: str, end_id: int | None, by_words: bool | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, start = _encoder(path, end_id, by_words), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids, sizes = encoder.encode(batch.column("text"))
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), part), pa.int32()), pa.array(start + ends - sizes, pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int32()), lists],
                    names=["part", "start_in_part", "doc_id", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, by_words: bool | None = None) -> None:
    """Encode every whole text and write the ids to Parquet below path, in ascending order of doc_id over the part files.

    tokenizer: path of a tokenizers JSON file that every executor can open. end_id: appended to each document. by_words: as
    of Encoder, which gives the ids of whole texts in any case. A file's rows: ``part`` (its place in the order), ``start_in_part`` (ids before the row in its part), ``doc_id``,
    ``n_tokens``, ``ids``. The texts are dealt by ranges of doc_id and sorted within them; encoding comes after the one
    shuffle, so ids are never shuffled.

    Null and empty texts have the end id only. Null ids come first. Rows that repeat an id stand together, in the order of
    their texts. Further columns of docs are dropped. An empty table writes no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode(tokenizer, end_id, by_words), FILE_SCHEMA).write.options(**WRITE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of write_tokens() with ``start``, the ids before each document over all parts.

    first, last: only the documents of these ids and those between; the files are sorted by doc_id, so that other row
    groups and pages of ids are not read. The parts' sizes come from two narrow columns. Their running sum has one row per
    part file and is broadcast, so that ids are not shuffled.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # pairs of parts would do, but a running sum over as many rows as there are files is small
    before = sums.selectExpr("part", "coalesce(sum(_n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("start_in_part") + F.col("_before")).drop("_before", "part", "start_in_part")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = pa.array(np.diff(offsets), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), sizes, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) of read_tokens()' rows."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
