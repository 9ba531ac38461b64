"""Snapshots of subscriptions: bursts, quiet seconds, polls, the end of the week; heartbeats."""

from __future__ import annotations

import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skirmish.streaming import snapshots

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T = datetime(2024, 1, 7, 23, 59, 0)  # a Sunday
ROW = "team string, ts timestamp, source string, documents map<string,string>"


def at(seconds):
    return T + timedelta(seconds=seconds)


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    turns = iter(range(100))

    def run(batches, schema, plan, wait=0):
        source, name = tmp_path / f"in{next(turns)}", f"shown{next(turns)}_{time.time_ns()}"
        source.mkdir()
        query = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))).writeStream.format("memory").queryName(name).outputMode("append").start()
        try:
            for rows in batches:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
                if not wait:  # by the clock, batches never end
                    query.processAllAvailable()
            deadline = time.time() + wait
            while time.time() < deadline and not spark.table(name).count():
                time.sleep(0.5)
            return spark.table(name).collect()
        finally:
            query.stop()

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def shown(rows, team="a"):
    return sorted((round((r["shown_at"] - T).total_seconds(), 3), r["cause"], dict(r["documents"]), r["missing"], r["extra"]) for r in rows if r["team"] == team)


def test_bursts_are_shown_once(stream):
    first = [("a", at(0), "current", {"x": "1"}), ("a", at(2), "current", {"x": "2"}), ("b", at(1), "current", {"y": "1"}), ("a", at(4.5), "next", {"z": "1"})]
    # quiet for more than three seconds: between batches, and within one
    second = [("a", at(10), "current", {}), ("a", at(10.5), "next", {"z": "2", "w": "1"}), ("a", at(20), "next", None)]
    got = stream([first, second, [("c", at(50), "current", {"q": "1"})], [("c", at(51), "current", {"q": "2"})]], ROW, snapshots.debounced)
    assert shown(got) == [(7.5, "quiet", {"x": "2", "z": "1"}, [], []), (13.5, "quiet", {"z": "2", "w": "1"}, [], []), (23, "quiet", {}, [], [])]
    assert shown(got, "b") == [(4, "quiet", {"y": "1"}, [], [])] and shown(got, "c") == []
    assert {r["week"] for r in got} == {date(2024, 1, 1)}


def test_two_subscriptions_with_one_second(spark, stream):
    """Proposals of both roles, unioned."""

    def both(rows):
        own = rows.where("source = 'proposer'").union(rows.where("source = 'opponent'"))
        return snapshots.debounced(own, "1 second")

    rows = [("a", at(0), "proposer", {"p1": "x"}), ("a", at(0.6), "opponent", {"p2": "y"}), ("a", at(1.5), "proposer", {"p1": "x", "p3": "z"}), ("a", at(3), "opponent", {})]
    got = stream([rows, [("b", at(30), "proposer", {})], [("b", at(31), "proposer", {})]], ROW, both)
    assert shown(got) == [(2.5, "quiet", {"p1": "x", "p2": "y", "p3": "z"}, [], []), (4, "quiet", {"p1": "x", "p3": "z"}, [], [])]


def test_polls_reconcile(stream):
    rows = [("a", at(0), "current", {"x": "1"}), ("a", at(5), None, {"x": ""}), ("a", at(6), None, {"y": ""}), ("a", at(7), "current", {"y": "1"}), ("a", at(12), None, {"y": ""})]
    got = stream([rows, [("b", at(40), None, {"q": ""})], [("b", at(41), "current", {})]], ROW, snapshots.debounced)
    assert shown(got) == [(3, "quiet", {"x": "1"}, [], []), (6, "stale", {"x": "1"}, ["y"], ["x"]), (10, "quiet", {"y": "1"}, [], [])]
    assert shown(got, "b") == [(40, "stale", {}, ["q"], [])]


def test_a_new_week_starts_empty(stream):
    """Monday is 60 seconds after T: what is pending then is not shown, and what was held is forgotten."""
    rows = [("a", at(10), "current", {"x": "1"}), ("a", at(59), "next", {"y": "1"}), ("b", at(20), "current", {"z": "1"})]
    later = [("a", at(70), "current", {"w": "1"}), ("a", at(80), None, {"w": ""})]
    got = stream([rows, later, [("c", at(200), "current", {})], [("c", at(201), "current", {})], [("b", at(202), None, {})]], ROW, snapshots.debounced)
    assert shown(got) == [(13, "quiet", {"x": "1"}, [], []), (73, "quiet", {"w": "1"}, [], [])]
    assert [r["week"] for r in sorted(got, key=lambda r: r["shown_at"]) if r["team"] == "a"] == [date(2024, 1, 1), date(2024, 1, 8)]
    assert shown(got, "b") == [(23, "quiet", {"z": "1"}, [], [])]


def test_by_the_clock(stream):
    got = stream([[("a", at(0), "current", {"x": "1"})]], ROW, lambda s: snapshots.debounced(s, "1 second", clock="processing"), wait=60)
    assert [(r["cause"], dict(r["documents"])) for r in got] == [("quiet", {"x": "1"})] and abs((got[0]["shown_at"] - datetime.now()).total_seconds()) < 86_400 * 2


def test_heartbeats(stream):
    schema = "session string, ts timestamp, kind string"
    first = [("s", at(0), "start"), ("s", at(60), "beat"), ("t", at(0), "start"), ("s", at(120), "beat"), ("t", at(60), "beat"), ("t", at(100), "end"), (None, at(0), "start")]
    got = stream([first, [("u", at(400), "start")], [("s", at(500), "beat"), ("u", at(460), "beat")], [("u", at(520), "end"), ("v", at(560), "start")], [("v", at(561), "beat")]], schema, snapshots.heartbeats)
    seconds = lambda x: (x - T).total_seconds()
    assert sorted((r["session"], seconds(r["started_at"]), seconds(r["ended_at"]), r["status"]) for r in got) == [("s", 0, 120, "interrupted"), ("t", 0, 100, "completed"), ("u", 400, 520, "completed")]
