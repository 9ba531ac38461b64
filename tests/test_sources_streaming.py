"""Files and streams of small hand-made rows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skirmish.sources import logs, matches
from skirmish.streaming import live


def test_text_logs(spark, tmp_path):
    text = "[10:00] <x> before any header\nSession Start: Sat Mar 02 21:00:00 2002\n[23:59] <ann> hi\n[00:01] * bob waves\n[00:02] joined\nSession Close: x\nSession Start: Mon Mar 04 09:00:00 2002\n[09:05] <ann> \n"
    (tmp_path / "a.log").write_text(text)
    got = [(str(r["created_at"]), r["kind"], r["author"], r["content"]) for r in logs.read_text_logs(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [("2002-03-02 23:59:00", "message", "ann", "hi"), ("2002-03-03 00:01:00", "action", "bob", "waves"), ("2002-03-03 00:02:00", "system", None, "joined"), ("2002-03-04 09:05:00", "message", "ann", "")]


def test_a_header_before_midnight_sets_the_hour(spark, tmp_path):
    (tmp_path / "a.log").write_text("Session Start: Sat Mar 02 23:50:00 2002\n[00:02] <ann> late\n[00:03] <bob> later\n[23:59] <ann> z\n[00:00] <ann> y\n")
    got = [str(r["created_at"]) for r in logs.read_text_logs(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == ["2002-03-03 00:02:00", "2002-03-03 00:03:00", "2002-03-03 23:59:00", "2002-03-04 00:00:00"]


def test_chat_exports(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "message_type": 0, "content": "a"}, {"id": "2", "message_type": 7}, {"id": "3"}]))
    got = {r["id"]: r["kind"] for r in logs.read_chat_exports(spark, str(tmp_path), {0: "message", 19: "reply"}).collect()}
    assert got == {"1": "message", "2": "system", "3": "system"}


def test_match_documents(spark, tmp_path):
    player = lambda name, team, frags, hits: {"name": name, "team": team, "stats": {"frags": frags}, "weapons": {"sg": {"acc": {"attacks": 16, "hits": hits}}}, "items": {"q": {"took": 2}}}
    game = {"date": "2025-05-19 18:20:27 +0000", "map": "dm3", "teams": ["a", "b"], "players": [player("x", "a", 3, 5), player("y", "a", 4, 0), player("z", "b", 9, 16)]}
    (tmp_path / "f00.json").write_text(json.dumps(game))
    (tmp_path / "bad.json").write_text("{not json")
    docs = matches.read_documents(spark, str(tmp_path))
    assert [tuple(r) for r in matches.games(docs).select("sha256", "frags_a", "frags_b", "player_count").collect()] == [("f00", 7, 9, 3)]
    assert {r["name"]: (r["sg_acc"], r["quad_took"]) for r in matches.players(docs).collect()} == {"x": (31.3, 2), "y": (0.0, 2), "z": (100.0, 2)}


def test_match_tables(spark, tmp_path):
    def player(name, team, frags, **more):
        return {"name": name, "team": team, "ping": 25, "stats": {"frags": frags, "spawn-frags": 2}} | more

    full = {"weapons": {"rl": {"acc": {"attacks": 7, "hits": 2}, "damage": {"enemy": 90}}, "gl": {"acc": {"attacks": 4, "hits": 1}}}, "items": {"q": {"took": 3, "time": 80}, "health_100": {"took": 5}}, "dmg": {"taken-to-die": 99.5, "enemy-weapons": 7}, "xferRL": 6}
    eight = [player(f"p{k}", "red" if k % 2 else "clan", k) for k in range(6)] + [player("\u00c1nn  X", "clan", 9, **full), player("bot", "red", 50, ping=0), player("y", "red", 4, login="me")]
    game = {"date": "2025-05-19 18:20:27 +0200", "mode": "team", "duration": 1200, "tl": 20, "teams": ["clan", "red"], "players": eight}
    few = {"date": "x", "mode": "ffa", "duration": 5, "players": [player("a", None, 1), player("b", "", 3)]}
    for name, doc in (("f0.mvd.ktxstats.json", game), ("f1.json", few), ("f2.json", few | {"players": eight[:1]}), ("f3.json", game | {"duration": 599}), ("f4.json", {})):
        (tmp_path / name).write_text(json.dumps(doc))
    docs = matches.read_documents(spark, str(tmp_path))
    games, players = matches.match_tables(docs)
    (row,) = games.collect()
    assert (row["sha256"], row["map"], row["timelimit"], row["team_a_frags"], row["team_b_frags"], row["player_count"], row["is_clan_game"]) == ("f0", "unknown", 20, 15, 13, 8, False)
    assert row["played_at"] == datetime(2025, 5, 19, 16, 20, 27)
    rows = {r["player_name_raw"]: r for r in players.collect()}
    ann = rows["\u00c1nn  X"]
    assert len(players.columns) == 58 and "bot" not in rows and len(rows) == 8
    assert (ann["player_name_ascii"], ann["player_name_normalized"], ann["rl_acc"], ann["rl_dmg"], ann["gl_hits"], ann["quad_time"], ann["health_100"], ann["taken_to_die"], ann["dmg_enemy_weapons"], ann["xfer_rl"], ann["spawn_frags"], ann["won"]) == ("Ann  X", "ann x", 28.6, 90, 1, 80, 5, 99.5, 7, 6, 2, True)
    assert rows["y"]["login"] == "me" and rows["y"]["lg_acc"] == 0 and rows["y"]["ring_time"] == 0 and not rows["y"]["won"] and all(v is not None for v in rows["p0"])
    loose, all_players = matches.match_tables(docs, strict=False)
    assert {r["sha256"]: (r["team_a"], r["team_a_frags"]) for r in loose.collect()} == {"f0": ("clan", 15), "f1": ("", 4), "f3": ("clan", 15)}
    assert all_players.where("sha256 = 'f1' AND won").count() == 0 and all_players.count() == 18


@pytest.fixture
def stream(spark, tmp_path):
    """Writes batches of rows as files, one per micro-batch, and returns all rows of the query over them."""
    turns = iter(range(100))

    def run(batches, schema, plan):
        source = tmp_path / f"in{next(turns)}"
        source.mkdir()
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        name = f"out{next(turns)}"
        query = plan(reader).writeStream.format("memory").queryName(name).outputMode("append").start()
        try:
            for rows in batches:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
                query.processAllAvailable()
            return [tuple(r) for r in spark.table(name).collect()]
        finally:
            query.stop()

    return run


T = datetime(2024, 1, 1, 12)  # a Monday
EVENT = "id int, who string, ts timestamp"


def at(seconds):
    return T + timedelta(seconds=seconds)


def test_first_seen(stream):
    got = stream([[(1, "a", at(0)), (1, "b", at(1))], [(1, "c", at(60)), (2, "d", at(70))]], EVENT, lambda s: live.first_seen(s, ["id"], "ts").select("id"))
    assert sorted(got) == [(1,), (2,)]


def test_weekly_counts(stream):
    week = 7 * 86400
    got = stream([[(1, "a", at(0)), (2, "a", at(-43200)), (3, "a", at(week - 43201))], [(4, "a", at(3 * week))], [(5, "a", at(3 * week))]], EVENT, lambda s: live.weekly_counts(s, "ts"))
    assert [(str(w), n) for w, n in got] == [("2024-01-01", 3)]


def test_live_sessions(stream):
    got = stream([[(1, "a", at(0)), (2, "a", at(600)), (3, "b", at(0))], [(4, "a", at(3000))], [(5, "z", at(90000))], [(6, "z", at(90001))]], EVENT, lambda s: live.live_sessions(s, ["who"], "ts").select("who", "messages"))
    assert sorted(got) == [("a", 1), ("a", 2), ("b", 1)]


def test_presence(stream):
    rows = [("c", at(0), 1), ("c", at(10), 1), ("c", at(20), -2), ("c", at(23), 1), ("c", at(40), -1)]
    later = [("d", at(4000), 1)]
    got = stream([rows, later, later], "channel string, ts timestamp, change int", lambda s: live.presence(s, 2, 5.0))
    assert got == [("c", at(10), at(40))]


def test_into_table(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(2):
        spark.createDataFrame([(1, "a", at(0)), (k + 5, "b", at(k))], EVENT).write.mode("append").parquet(str(source))
        writer = live.into_table(spark.readStream.schema(EVENT).parquet(str(source)), out, str(tmp_path / "state"), ["id"], ["ts"])
        writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).select(F.col("id")).collect()) == [1, 5, 6]
