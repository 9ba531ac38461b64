"""Reading recordings: frames of binary logs, the JSON header of raw files, their text metadata, and the tracks' files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the format: the kinds by the lower three bits of a frame's second byte; one has four bytes more.
KINDS = ["cmd", "read", "set", "multiple", "single", "stats", "all", "empty"]
MULTIPLE = KINDS.index("multiple")
#: A body of more bytes can't be one: the scan of the file ends there.
MOST_BYTES = 1_000_000
#: Frames of one Arrow batch.
BATCH = 50_000

FRAMES = "path string, frame long, at_ms long, duration_ms int, kind string, client int, last_to long, offset long, size long, cut boolean"
_NAMES = [f.split()[0] for f in FRAMES.split(", ")]


def frames_of(data: bytes) -> Iterator[tuple]:
    """frame, at_ms (of its end), duration_ms, kind, client, last_to, offset and size of the body, and whether the file ends in it."""
    at = frame = clock = 0
    while at + 6 < len(data):
        duration, mixed = data[at], data[at + 1]
        head = 10 if mixed & 7 == MULTIPLE else 6
        if at + head > len(data):
            return
        *last_to, size = struct.unpack_from("<II" if head == 10 else "<I", data, at + 2)
        if size > MOST_BYTES:
            return
        clock += duration
        at += head
        yield frame, clock, duration, KINDS[mixed & 7], mixed >> 3, last_to[0] if last_to else None, at, size, at + size > len(data)
        at, frame = at + size, frame + 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows = []
            for row in frames_of(content.as_py() or b""):
                rows.append((path.as_py(), *row))
                if len(rows) == BATCH:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)


def read_frames(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The frames of every file, without their bodies; see frames_of().

    Files are read in parallel, each by one task, which must hold it: a frame's place follows from those before it. A last
    frame whose body is cut off is marked; one whose header is cut off is left out, and so is all from a body of more than
    MOST_BYTES on. An empty file has no rows.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(_scan, FRAMES)


def frame_counts(frames: DataFrame) -> DataFrame:
    """Of every file and kind: frames, the clients of those that name one, and hidden frames (to nobody)."""
    named = F.col("kind").isin("stats", "single")
    hidden = (F.col("kind") == "multiple") & (F.col("last_to") == 0)
    return frames.groupBy("path", "kind").agg(F.count("*").alias("frames"), F.array_sort(F.collect_set(F.when(named, F.col("client")))).alias("clients"), F.count_if(hidden).alias("hidden"), F.sum("duration_ms").alias("duration_ms"))


def header_end(data: bytes) -> int:
    """Where the JSON object at the beginning of data ends, by counting braces outside of strings; 0 if it doesn't."""
    depth, quoted, escaped = 0, False, False
    for k, c in enumerate(data):
        if quoted:
            quoted, escaped = escaped or c != 0x22, not escaped and c == 0x5C
        elif c == 0x22:
            quoted = True
        elif c == 0x7B:
            depth += 1
        elif c == 0x7D:
            depth -= 1
            if depth == 0:
                return k + 1
    return 0


HEADERS = "path string, started_at string, tracks array<struct<number:int,username:string,display_name:string>>"


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    track = pa.list_(pa.struct([("number", pa.int32()), ("username", pa.string()), ("display_name", pa.string())]))
    for batch in batches:
        paths, started, tracks = [], [], []
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            data = content.as_py() or b""
            try:
                head = json.loads(data[: header_end(data)])
            except ValueError:
                head = {}
            own = []
            for number, t in sorted(head.get("tracks", {}).items(), key=lambda x: int(x[0])):
                user = t.get("username", f"track_{number}")
                own.append({"number": int(number), "username": user, "display_name": t.get("globalName") or user})
            paths.append(path.as_py())
            started.append(head.get("startTime"))
            tracks.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(started, pa.string()), pa.array(tracks, track)], names=["path", "started_at", "tracks"])


def read_headers(spark: SparkSession, path: str, glob: str = "*.dat") -> DataFrame:
    """path, started_at and tracks (number, username, display_name) of raw recordings, from the JSON before the binary part.

    A file without such a header, or whose header isn't JSON, has a null time and no tracks.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(_headers, HEADERS)
    return rows.withColumn("started_at", F.try_to_timestamp("started_at"))


def read_infos(spark: SparkSession, path: str, glob: str = "info.txt") -> DataFrame:
    """path, recording_id, guild, channel, started_at and tracks (number, username) of the text that describes a recording.

    Names end at the first parenthesis; tracks are the lines after ``Tracks:``, up to ``#`` or a parenthesis, numbered from 1. What
    a file lacks is null.
    """
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("t"))
    pick = lambda p: F.nullif(F.btrim(F.regexp_extract("t", p, 1), F.lit(" \t")), F.lit(""))
    lines = F.filter(F.transform(F.split(F.regexp_extract("t", r"(?s)(?:^|\n)[ \t]*Tracks:[ \t]*\n(.*)", 1), "\n"), lambda x: F.trim(F.regexp_replace(x, "\t", " "))), lambda x: x != "")
    tracks = F.transform(lines, lambda x, k: F.struct((k + 1).alias("number"), F.trim(F.regexp_extract(x, r"^([^#]*?)(?:#|\(|$)", 1)).alias("username")))
    return whole.select(
        "path", pick(r"(?m)^[ \t]*Recording (.*)$").alias("recording_id"), pick(r"(?m)^[ \t]*Guild:([^(\n]*)").alias("guild"), pick(r"(?m)^[ \t]*Channel:([^(\n]*)").alias("channel"),
        F.try_to_timestamp(pick(r"(?m)^[ \t]*Start time:[ \t]*(\S*)")).alias("started_at"), tracks.alias("tracks"),
    )


def track_files(tracks: DataFrame, files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tracks (by, number) with ``file``, the one whose name begins with their number and a dash; .ogg is preferred to .flac.

    files: by, path. by names a recording; a track without a file keeps a null one. Other files are ignored; of several of one
    kind the first path is taken.
    """
    by, name = by or [], F.element_at(F.split("path", "/"), -1)
    named = files.select(*by, F.regexp_extract(name, r"^(\d+)(?:-.*)?\.(ogg|flac)$", 1).alias("_n"), F.regexp_extract(name, r"\.(\w+)$", 1).alias("_kind"), F.col("path").alias("file")).where("_n != ''")
    best = W.partitionBy(*by, "_n").orderBy(F.desc("_kind"), "file")
    first = named.withColumn("_n", F.col("_n").cast("int")).withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*by, F.col("_n").alias("number"), "file")
    return tracks.join(first, [*by, "number"], "left")
