"""Binary frames, headers, text metadata and track files of hand-made recordings."""

from __future__ import annotations

import json
import random
import struct
from datetime import timezone

from pyspark.sql import functions as F

from skirmish.sources import recordings


def frame(ms, kind, client, body, last_to=0):
    return bytes([ms, client << 3 | kind]) + (struct.pack("<I", last_to) if kind == 3 else b"") + struct.pack("<I", len(body)) + body


def test_frames_round_trip(spark, tmp_path):
    rng, files = random.Random(6), {}
    for name in ("a.mvd", "b.mvd"):
        files[name] = [(rng.randrange(256), rng.randrange(8), rng.randrange(32), rng.randbytes(rng.randrange(300)), rng.randrange(3)) for _ in range(400)]
        (tmp_path / name).write_bytes(b"".join(frame(*f[:4], last_to=f[4]) for f in files[name]) + bytes(2))
    (tmp_path / "empty.mvd").write_bytes(b"")
    got = recordings.read_frames(spark, str(tmp_path), "*.mvd")
    for name, own in files.items():
        rows, data, clock = got.where(F.col("path").endswith(name)).orderBy("frame").collect(), (tmp_path / name).read_bytes(), 0
        # a last frame of an empty body can't be told from the end of the file
        assert len(rows) == len(own)
        for r, (ms, kind, client, body, last_to) in zip(rows, own, strict=True):
            clock += ms
            assert (r["at_ms"], r["duration_ms"], r["kind"], r["client"], r["last_to"]) == (clock, ms, recordings.KINDS[kind], client, last_to if kind == 3 else None)
            assert data[r["offset"] : r["offset"] + r["size"]] == body and not r["cut"]
    counts = {(r["path"][-5:], r["kind"]): r for r in recordings.frame_counts(got).collect()}
    own = [f for f in files["a.mvd"] if f[1] == 3]
    assert counts["a.mvd", "multiple"]["frames"] == len(own) and counts["a.mvd", "multiple"]["hidden"] == sum(f[4] == 0 for f in own)
    assert counts["b.mvd", "stats"]["clients"] == sorted({f[2] for f in files["b.mvd"] if f[1] == 5}) and counts["b.mvd", "cmd"]["clients"] == []


def test_cut_and_broken_frames(spark, tmp_path, monkeypatch):
    good = frame(5, 5, 3, b"x" * 10) + frame(7, 3, 0, b"yz", last_to=9)
    cases = {"body": good + frame(1, 0, 0, b"w" * 20)[:-4], "head": good + frame(1, 3, 0, b"")[:8], "huge": good + bytes([1, 0]) + struct.pack("<I", 1_000_001) + b"q" * 50, "long": good * 100}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    rows = recordings.read_frames(spark, str(tmp_path)).collect()
    cut = {n: [r["cut"] for r in sorted(rows, key=lambda r: r["frame"]) if r["path"].endswith(n)] for n in cases}
    assert cut["body"] == [False, False, True] and cut["head"] == cut["huge"] == [False, False] and len(cut["long"]) == 200


def test_headers(spark, tmp_path):
    head = json.dumps({"startTime": "2026-02-01T15:54:44.674Z", "note": 'a } and a \\" { in text', "tracks": {"2": {"username": "bob"}, "1": {"username": "ann", "globalName": "Ann"}, "10": {}}})
    (tmp_path / "raw.dat").write_bytes(head.encode() + b"\xff}{\x00" * 50)
    (tmp_path / "none.dat").write_bytes(b'{"startTime": "x"')
    (tmp_path / "junk.dat").write_bytes(b"\xff\xfe}{}{")
    rows = {r["path"].rpartition("/")[2]: r for r in recordings.read_headers(spark, str(tmp_path)).collect()}
    raw = rows["raw.dat"]
    assert raw["started_at"].astimezone(timezone.utc).isoformat() == "2026-02-01T15:54:44.674000+00:00"
    assert [tuple(t) for t in raw["tracks"]] == [(1, "ann", "Ann"), (2, "bob", "bob"), (10, "track_10", "track_10")]
    assert all(rows[n]["started_at"] is None and rows[n]["tracks"] == [] for n in ("none.dat", "junk.dat"))


def test_infos_and_files(spark, tmp_path):
    text = "Recording abc123\r\n\r\nGuild:\t\tThe Clan (77)\r\nChannel:\tvoice (5)\r\nRequester:\tx#0 (1)\r\nStart time:\t2026-02-01T15:54:44.674Z\r\n\r\nTracks:\r\n\tann#0 (1)\r\n\tbob (2)\r\n\r\n\tcy#1 (3)\r\n"
    (tmp_path / "info.txt").write_text(text)
    row = recordings.read_infos(spark, str(tmp_path)).first()
    assert (row["recording_id"], row["guild"], row["channel"]) == ("abc123", "The Clan", "voice") and row["started_at"] is not None
    assert [tuple(t) for t in row["tracks"]] == [(1, "ann"), (2, "bob"), (3, "cy")]
    tracks = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3), ("q", 1)], "rec string, number int")
    files = spark.createDataFrame([("r", p) for p in ("/x/1-ann.flac", "/x/1-ann.ogg", "/x/02-bob.flac", "/x/3-cy.txt", "/x/n-3.ogg")], "rec string, path string")
    got = {(r["rec"], r["number"]): r["file"] for r in recordings.track_files(tracks, files, ["rec"]).collect()}
    assert got == {("r", 1): "/x/1-ann.ogg", ("r", 2): "/x/02-bob.flac", ("r", 3): None, ("q", 1): None}
