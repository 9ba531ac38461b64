"""Structured Streaming forms of the incremental parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skirmish.operators import upserts


def first_seen(stream: DataFrame, key: list[str], ts: str, late: str = "60 minutes") -> DataFrame:
    """Rows without repeats of a key that come up to ``late`` after each other."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def into_table(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[Column | str]) -> DataStreamWriter:
    """A writer that appends to a Parquet table the rows of keys it lacks; a batch that runs again adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: upserts.append_new(batch, path, key, order)).option("checkpointLocation", checkpoint)


def weekly_counts(stream: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """``week`` (its Monday) and ``n`` of weeks that the watermark has closed."""
    week = F.window(ts, "7 days", "7 days", "4 days")  # 1970-01-01 was a Thursday
    return stream.withWatermark(ts, late).groupBy(week.alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("week"), "n")


def live_sessions(stream: DataFrame, by: list[str], ts: str, gap: str = "15 minutes", late: str = "15 minutes") -> DataFrame:
    """Sessions of rows by key: a silence of the gap ends one. System rows should be filtered out before."""
    w = F.session_window(ts, gap)
    rows = stream.withWatermark(ts, late).groupBy(*by, w.alias("w")).agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("messages"))
    return rows.drop("w")


PRESENCE = "channel string, started_at timestamp, ended_at timestamp"
_HELD = "members int, started double, empty double"


def _presence(least: int, patience: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        members, started, empty = state.get if state.exists else (0, None, None)
        done = []
        time = lambda s: pd.Timestamp(s, unit="s")

        def close() -> None:
            nonlocal started, empty
            done.append((key[0], time(started), time(empty)))
            started = empty = None

        if state.hasTimedOut:
            if started is not None and empty is not None:
                close()
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for at, change in zip(rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, rows["change"], strict=True):
                if empty is not None and at - empty >= patience:
                    close()
                members = max(0, members + int(change))
                if started is None and members >= least:
                    started = at
                elif started is not None:
                    empty = None if members else at
        if members or started is not None:
            state.update((members, started, empty))
            if empty is not None:
                state.setTimeoutTimestamp(max(int((empty + patience) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=["channel", "started_at", "ended_at"])

    return run


def presence(stream: DataFrame, least: int = 4, patience: float = 5.0, late: str = "1 minute") -> DataFrame:
    """Spans in which a channel was in use, once they have ended.

    stream: channel, ts, change (1 joins, -1 leaves). A span opens when the members reach ``least`` and ends when the
    channel has stood empty for ``patience`` seconds; who comes back before then keeps it open.
    """
    rows = stream.withWatermark("ts", late).groupBy("channel")
    return rows.applyInPandasWithState(_presence(least, patience), PRESENCE, _HELD, "append", GroupStateTimeout.EventTimeTimeout)
