"""Subscriptions to documents as state: snapshots merged by source, shown once they are quiet, reconciled, and reset by the week."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

SHOWN = "team string, shown_at timestamp, week date, cause string, documents map<string,string>, missing array<string>, extra array<string>"
WEEK_MS, MONDAY_MS = 7 * 86_400_000, 4 * 86_400_000  # 1970-01-05 was a Monday


def week_end(ms: int) -> int:
    """The first Monday, 00:00 UTC, after a time, in milliseconds."""
    return (ms - MONDAY_MS) // WEEK_MS * WEEK_MS + MONDAY_MS + WEEK_MS


class _Timed(StatefulProcessor):
    """Rows of a key in the order of their times, between which its timers go off; a key has one timer, its next one."""

    event_time = True

    def now(self, ms: int, timers: TimerValues) -> int:
        return ms if self.event_time else timers.getCurrentProcessingTimeInMs()

    def arm(self, at: int | None) -> None:
        set_ = list(self.handle.listTimers())
        for old in set_:
            if old != at:
                self.handle.deleteTimer(old)
        if at is not None and at not in set_:
            self.handle.registerTimer(at)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        times = batch["ts"].astype("datetime64[ms]").astype("int64")
        out = []
        for ms, row in zip(times, batch.itertuples(index=False), strict=True):
            at = self.now(int(ms), timerValues)
            out += self.until(key, at)
            out += self.take(key, at, row)
        self.arm(self.due())
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.until(key, expiredTimerInfo.getExpiryTimeInMs())
        self.arm(self.due())
        yield self.frame(out)

    def close(self) -> None:
        pass


class Snapshots(_Timed):
    def __init__(self, quiet_ms: int, event_time: bool):
        self.quiet_ms, self.event_time = quiet_ms, event_time

    def open(self) -> None:
        self.sources = self.handle.getMapState("sources", "source string", "documents string")
        self.times = self.handle.getValueState("times", "week_end long, due long")

    def _times(self) -> tuple[int, int]:
        return tuple(self.times.get()) if self.times.exists() else (0, 0)

    def due(self) -> int | None:
        week, due = self._times()
        return min(x for x in (week, due or week) if x) if week else None

    def _merged(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for _, held in sorted((k[0], v[0]) for k, v in self.sources.iterator()):
            out |= json.loads(held)
        return out

    def until(self, key: tuple, at: int) -> list[tuple]:
        """What goes off up to a time: the pending show, then the end of the week, which forgets everything."""
        out, (week, due) = [], self._times()
        if due and due <= at and due <= week:
            out.append((key[0], due, week, "quiet", self._merged(), [], []))
            due = 0
        if week and week <= at:
            for k in [tuple(k) for k in self.sources.keys()]:
                self.sources.removeKey(k)
            self.times.clear()
        else:
            self.times.update((week, due)) if week else None
        return out

    def take(self, key: tuple, at: int, row) -> list[tuple]:
        week = week_end(at)
        if row.source is None:
            known = set(self._merged())
            polled = set(row.documents)
            self.times.update((week, self._times()[1]))
            if known == polled:
                return []
            return [(key[0], at, week, "stale", self._merged(), sorted(polled - known), sorted(known - polled))]
        self.sources.updateValue((row.source,), (json.dumps(dict(row.documents or {})),))
        self.times.update((week, at + self.quiet_ms))
        return []

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        rows = [(team, pd.Timestamp(at, unit="ms"), pd.Timestamp(week - WEEK_MS, unit="ms").date(), *rest) for team, at, week, *rest in out]
        return pd.DataFrame(rows, columns=["team", "shown_at", "week", "cause", "documents", "missing", "extra"])


def debounced(stream: DataFrame, quiet: str = "3 seconds", late: str = "0 seconds", clock: str = "event") -> DataFrame:
    """Per team what its sources hold, whenever they have been quiet: team, shown_at, week, cause, documents, missing, extra.

    stream: team, ts, source and documents (map of id to content). A row is a snapshot: all that its source holds, in place of
    what it held. Each one moves the team's show to ``quiet`` after it, so that a burst is shown once, as ``quiet``.

    A row with a null source is a poll of the ids that all sources should hold together. If these are others than the state's,
    a row ``stale`` says at once which are missing and which are extra, for a new subscription; else nothing happens.

    At the end of the week (Monday, 00:00 UTC) a team's state is forgotten, a pending show after it as well: what is to
    be held then comes with new snapshots. So state does not outlive a week without rows. Rows of null teams or times are left
    out, a null map holds nothing. clock: ``event``, by ts with a watermark that is ``late`` behind, or ``processing``. Needs the
    RocksDB state store.
    """
    event = clock == "event"
    rows = stream.select(F.col("team").cast("string").alias("team"), "ts", F.col("source").cast("string").alias("source"), F.coalesce("documents", F.create_map().cast("map<string,string>")).alias("documents")).where("team IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withWatermark("ts", late) if event else rows
    run = Snapshots(int(pd.Timedelta(quiet).total_seconds() * 1000), event)
    return rows.groupBy("team").transformWithStateInPandas(run, SHOWN, "Append", "EventTime" if event else "ProcessingTime")


ENDED = "session string, started_at timestamp, ended_at timestamp, status string"


class Heartbeats(_Timed):
    def __init__(self, timeout_ms: int, event_time: bool):
        self.timeout_ms, self.event_time = timeout_ms, event_time

    def open(self) -> None:
        self.span = self.handle.getValueState("span", "started long, beat long")

    def due(self) -> int | None:
        return self.span.get()[1] + self.timeout_ms if self.span.exists() else None

    def until(self, key: tuple, at: int) -> list[tuple]:
        if not self.span.exists() or self.due() > at:
            return []
        started, beat = self.span.get()
        self.span.clear()
        return [(key[0], started, beat, "interrupted")]

    def take(self, key: tuple, at: int, row) -> list[tuple]:
        started = self.span.get()[0] if self.span.exists() else at
        if row.kind == "end":
            self.span.clear()
            return [(key[0], started, at, "completed")]
        self.span.update((started, at))
        return []

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(s, pd.Timestamp(a, unit="ms"), pd.Timestamp(b, unit="ms"), status) for s, a, b, status in out], columns=["session", "started_at", "ended_at", "status"])


def heartbeats(stream: DataFrame, timeout: str = "3 minutes", late: str = "0 seconds", clock: str = "event") -> DataFrame:
    """Sessions that have ended: ``completed`` with their end, or ``interrupted`` at the last beat, ``timeout`` after it.

    stream: session, ts, kind (start, beat or end). A beat after an interruption begins the session anew. Rows of null
    sessions or times are left out. Needs the RocksDB state store.
    """
    event = clock == "event"
    rows = stream.select(F.col("session").cast("string").alias("session"), "ts", "kind").where("session IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withWatermark("ts", late) if event else rows
    run = Heartbeats(int(pd.Timedelta(timeout).total_seconds() * 1000), event)
    return rows.groupBy("session").transformWithStateInPandas(run, ENDED, "Append", "EventTime" if event else "ProcessingTime")
