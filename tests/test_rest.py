"""Paged listings, keyed objects and histories of a local HTTP service."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from datetime import date, datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

import pytest
from pyspark.sql import functions as F

from skirmish.sources import rest

GAMES = [{"id": i, "timestamp": f"2024-03-{1 + i // 24:02d}T{i % 24:02d}:00:00+00:00", "mode": "4on4" if i % 5 else "2on2", "map": ["dm2", "dm3", None][i % 3], "team_names": ["red", f"t{i % 4}"], "sha": None if i % 11 == 0 else f"{i:03d}abc"} for i in range(257)]
SCHEMA = "id long, timestamp timestamp, mode string, map string, team_names array<string>, sha string"
#: Rows of a page that the service sends at most, whatever it is asked for.
SHORT = 7


def fits(row, name, asked):
    op, _, value = asked.partition(".")
    if op == "not":
        return not fits(row, name, value)
    own = row[name]
    if op == "is":
        return own is None
    if own is None:
        return False
    if op == "in":
        return str(own) in [x.strip('"') for x in value[1:-1].split(",")]
    if op == "cs":
        return value[1:-1] in own
    if name == "timestamp":
        own, value = (datetime.fromisoformat(x if "T" in x else x + "T00:00:00+00:00") for x in (own, value))
    else:
        value = type(own)(value)
    return {"eq": own == value, "gt": own > value, "gte": own >= value, "lt": own < value, "lte": own <= value}[op]


@pytest.fixture
def service():
    """The address of a service, and what it was asked: conditions, open requests, tries of each key."""
    seen = {"asked": [], "open": 0, "most": 0, "tries": Counter(), "columns": set()}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            path, params = urlsplit(self.path).path, parse_qsl(urlsplit(self.path).query)
            with lock:
                seen["open"] += 1
                seen["most"] = max(seen["most"], seen["open"])
                seen["tries"][path] += 1
            try:
                self.answer(path, params)
            finally:
                with lock:
                    seen["open"] -= 1

        def answer(self, path, params):
            if path == "/games":
                rows = [g for g in GAMES if all(fits(g, k, v) for k, v in params if k not in ("select", "order", "limit", "offset"))]
                seen["asked"].append([(k, v) for k, v in params if k not in ("select", "order", "limit", "offset")])
                named = dict(params)
                if self.headers.get("Prefer") == "count=exact":
                    return self.send(200, [], {"Content-Range": f"0-0/{len(rows)}"})
                seen["columns"].add(named["select"])
                rows.sort(key=lambda g: (g["timestamp"], g["id"]), reverse="desc" in named["order"])
                at = int(named["offset"])
                return self.send(200, [{k: g[k] for k in named["select"].split(",")} for g in rows[at : at + min(SHORT, int(named["limit"]))]])
            if path == "/history":
                named = dict(params)
                rows = [{"id": i, "content": f"m{i}"} for i in range(30, 0, -1) if i < int(named.get("before", 99))]
                return self.send(200, rows[: int(named["limit"])])
            key = path.rpartition("/")[2]
            time.sleep(0.05)
            if path.split("/")[2] != key[:3] or key.endswith("9"):
                return self.send(404, {})
            if key.endswith("5") and seen["tries"][path] < 2:
                return self.send(503, {})
            self.send(200, {"key": key})

        def send(self, code, body, headers=None):
            self.send_response(code)
            for k, v in (headers or {}).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


@pytest.fixture(autouse=True)
def no_waiting(monkeypatch):
    monkeypatch.setattr(rest, "WAIT", 0.01)


def listing(spark, url, **more):
    return rest.read_listing(spark, f"{url}/games", SCHEMA, "timestamp.asc,id.asc", page_size=10, pages_per_task=3, **more)


def test_all_pages(spark, service):
    df = listing(spark, service[0])
    assert df.rdd.getNumPartitions() == 9
    got = {r["id"]: r for r in df.collect()}
    assert sorted(got) == list(range(257))
    assert got[25]["timestamp"].astimezone(timezone.utc).isoformat() == GAMES[25]["timestamp"] and got[25]["team_names"] == ["red", "t1"] and got[11]["sha"] is None


def test_filters_are_asked_of_the_service(spark, service):
    url, seen = service
    since = datetime(2024, 3, 5, 12, tzinfo=timezone.utc)
    rows = listing(spark, url, params={"mode": "eq.4on4"}).where((F.col("timestamp") > F.lit(since)) & F.col("sha").isNotNull() & F.col("map").isin("dm2", "dm3") & (F.length("sha") > 2))
    want = [g["id"] for g in GAMES if g["mode"] == "4on4" and g["timestamp"] > since.isoformat() and g["sha"] and g["map"] in ("dm2", "dm3")]
    assert sorted(r["id"] for r in rows.collect()) == want
    asked = dict(seen["asked"][-1])
    assert asked["mode"] == "eq.4on4" and asked["timestamp"].startswith("gt.2024-03-05T12:00:00") and asked["sha"] == "not.is.null" and asked["map"].startswith("in.(")


def test_only_the_columns_of_the_schema(spark, service):
    rest.read_listing(spark, f"{service[0]}/games", "id long, map string", "id.asc").collect()
    assert service[1]["columns"] == {"id,map"}


def test_window_and_count(spark, service):
    start = datetime(2024, 3, 2, 10, tzinfo=timezone.utc)
    ids = sorted(r["id"] for r in rest.in_window(listing(spark, service[0]), "timestamp", start, 7200, 3600).collect())
    assert ids == [33, 34, 35, 36]
    assert any(dict(a).get("timestamp", "").startswith(("gte.", "lt.")) for a in service[1]["asked"])
    assert rest.count_rows(f"{service[0]}/games", [("mode", "eq.2on2")]) == sum(g["mode"] == "2on2" for g in GAMES)


def test_recent_by_tags(spark, service):
    read = lambda tags, **more: rest.recent_by_tags(spark, f"{service[0]}/games", SCHEMA, tags, "team_names", "timestamp", "id", **more)
    want = sorted((g["id"] for g in GAMES if g["id"] % 4 in (1, 3)), reverse=True)[:12]
    assert [r["id"] for r in read(["T1", "t3", "t1"], limit=12).collect()] == want
    assert [r["id"] for r in read(["t2"], since=date(2024, 3, 11)).collect()] == [254, 250, 246, 242]
    assert read([]).count() == 0


def test_nothing_listed(spark, service):
    assert listing(spark, service[0], params={"mode": "eq.none"}).count() == 0


def test_objects_by_key(spark, service):
    url, seen = service
    keys = spark.createDataFrame([(f"{i:03d}x{i}",) for i in range(60)] + [("001x1",), (None,)], "sha string").withColumn("document", F.lit("x"))
    got = rest.fetch_objects(keys, "sha", url + "/o/{0:.3}/{0}", in_flight=5, tasks=2, retries=1).collect()
    assert sorted(r["sha"] for r in got) == [f"{i:03d}x{i}" for i in range(60) if i % 10 != 9]
    assert all(json.loads(r["document"]) == {"key": r["sha"]} for r in got) and seen["most"] <= 10
    assert {v for k, v in seen["tries"].items() if k.endswith("9")} == {1}
    bad = rest.fetch_objects(keys.where("sha LIKE '%9'"), "sha", url + "/o/{0:.3}/{0}", failures=True).collect()
    assert len(bad) == 6 and all(r["document"] is None and "404" in r["error"] for r in bad)


def test_history_goes_on_after_a_restart(spark, service, tmp_path):
    stream = rest.read_history(spark, f"{service[0]}/history", "id long, content string", page_size=4)
    write = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
    query = write().start()
    while sum(p["numInputRows"] for p in query.recentProgress) < 8:
        time.sleep(0.1)
    query.stop()
    before = spark.read.parquet(f"{tmp_path}/out").count()
    assert before >= 8
    query = write().start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.read.parquet(f"{tmp_path}/out").count() < 30:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(1, 31))


def test_kept_results(spark):
    now, made = [0.0], []
    kept = rest.Kept(300.0, lambda: now[0])
    make = lambda: made.append(1) or spark.range(3)
    assert kept.get("a", make) is kept.get("a", make) and len(made) == 1
    now[0] = 299.0
    kept.get("a", make)
    now[0] = 300.0
    assert kept.get("a", make).count() == 3 and len(made) == 2


def test_conditions():
    assert rest.condition(rest.Not(rest.IsNull(("a",)))) == ("a", "not.is.null") and rest.condition(rest.IsNull(("a",))) == ("a", "is.null")
    assert rest.condition(rest.Not(rest.EqualTo(("a",), True))) == ("a", "not.eq.true")
    assert rest.condition(rest.In(("a",), ("x,y", "z"))) == ("a", 'in.("x,y","z")')
    assert rest.condition(rest.EqualTo(("a", "b"), 1)) is None and rest.condition(rest.GreaterThan(("d",), date(2024, 1, 2))) == ("d", "gt.2024-01-02")
