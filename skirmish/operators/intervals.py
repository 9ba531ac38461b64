"""Joins and folds over [start, end) intervals in seconds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps(rows: DataFrame, who: str, start: str, end: str, least: float, bin_seconds: float, within: list[str] | None = None) -> DataFrame:
    """Pairs of different speakers that overlap by more than least: ``first``, ``second``, ``start``, ``end``.

    A range join on equal time bins: each interval is written once per bin that it touches, and a pair is taken in
    the bin where its overlap starts only, so no pair is doubled and no nested loop is needed.
    """
    keys = within or []
    spans = rows.where(F.col(end) > F.col(start)).select(*keys, F.col(who).alias("w"), F.col(start).alias("s"), F.col(end).alias("e"))
    number = lambda x: F.floor(x / bin_seconds)
    binned = spans.withColumn("bin", F.explode(F.sequence(number(F.col("s")), number(F.col("e")))))
    a, b = binned.withColumnsRenamed({"w": "w1", "s": "s1", "e": "e1"}), binned.withColumnsRenamed({"w": "w2", "s": "s2", "e": "e2"})
    both = a.join(b, [*keys, "bin"])
    earlier = (F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("w1") < F.col("w2")))
    lo, hi = F.greatest("s1", "s2"), F.least("e1", "e2")
    both = both.where((F.col("w1") != F.col("w2")) & earlier & (hi - lo > least) & (number(lo) == F.col("bin")))
    return both.select(*keys, F.col("w1").alias("first"), F.col("w2").alias("second"), lo.alias("start"), hi.alias("end"))


def gaps(rows: DataFrame, by: list[str], start: str, end: str, least: float, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """``kind`` (pre, between, post), ``gap_start``, ``gap_end`` of silences of at least least seconds."""
    order = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, 0))
    df = rows.withColumns({"_from": reach, "_to": F.lead(start).over(order), "_prev": F.lag(start).over(order)})
    found = [F.struct(F.lit("between").alias("kind"), F.col("_from").alias("gap_start"), F.col("_to").alias("gap_end"))]
    if bounds:
        first, last = bounds
        found.append(F.struct(F.lit("pre").alias("kind"), first.alias("gap_start"), F.when(F.col("_prev").isNull(), F.col(start)).alias("gap_end")))
        found.append(F.struct(F.lit("post").alias("kind"), F.when(F.col("_to").isNull(), F.col("_from")).alias("gap_start"), last.alias("gap_end")))
    long = df.select(*by, F.explode(F.array(*found)).alias("g")).select(*by, "g.*")
    return long.where(F.col("gap_end") - F.col("gap_start") >= least)


def trim_at_midpoints(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping neighbours are cut at the midpoint of their overlap, left to right, each cut feeding the next."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([start, end], kind="stable").reset_index(drop=True)
        s, e = group[start].to_numpy().copy(), group[end].to_numpy().copy()
        for i in range(len(group) - 1):
            if e[i] > s[i + 1]:
                e[i] = s[i + 1] = (e[i] + s[i + 1]) / 2
        return group.assign(**{start: s, end: e})

    return rows.groupBy(*by).applyInPandas(fold, rows.schema)


def runs_above(rows: DataFrame, by: list[str], at: str, level: str, threshold: float, least_gap: float) -> DataFrame:
    """Midpoints of runs above the threshold; one closer than least_gap to the last kept one is dropped."""
    order = W.partitionBy(*by).orderBy(at)
    df = rows.withColumn("_on", F.col(level) > threshold)
    df = df.withColumn("_run", F.sum((F.col("_on") & ~F.coalesce(F.lag("_on").over(order), F.lit(False))).cast("int")).over(order)).where("_on")
    mids = df.groupBy(*by, "_run").agg(((F.min(at) + F.max(at)) / 2).alias("mid")).drop("_run")

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group, kept, last = group.sort_values("mid"), [], None
        for mid in group["mid"]:
            kept.append(last is None or mid - last >= least_gap)
            last = mid if kept[-1] else last
        return group[kept]

    return mids.groupBy(*by).applyInPandas(keep, mids.schema)


def marker_pairs(rows: DataFrame, by: list[str], at: str, kind: str) -> DataFrame:
    """``start``, ``end`` from start and end markers: the last start before an end wins, an unclosed start has a null end."""
    order = W.partitionBy(*by).orderBy(at)
    df = rows.withColumns({"_next": F.lead(kind).over(order), "_end": F.lead(at).over(order)}).where(F.col(kind) == "start")
    last = F.col("_next").isNull()
    return df.where((F.col("_next") == "end") | last).select(*by, F.col(at).alias("start"), F.when(~last, F.col("_end")).alias("end"))


def asof(rows: DataFrame, table: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """rows with the latest value of table at or before each row's time: a union and a running last, one shuffle."""
    left = rows.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(dict(table.dtypes)[value])})
    right = table.select(*by, at, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    order = W.partitionBy(*by).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(order))
    return both.where("_side = 1").drop("_side", "_v")
