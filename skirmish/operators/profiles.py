"""Player profiles: averages, percentiles, ranks, ratings, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skirmish.functions.numbers import half_up


def averages(rows: DataFrame, key: str, measures: dict[str, Column], least_games: int = 1) -> DataFrame:
    """Mean of each measure per key, for keys of enough rows. A null measure doesn't count."""
    out = rows.groupBy(key).agg(F.count("*").alias("games"), *[F.avg(c).alias(name) for name, c in measures.items()])
    return out.where(F.col("games") >= least_games)


def running_counts(counted: DataFrame, value: str, count: str, by: list[str] | None = None, cells: int = 256) -> DataFrame:
    """counted with ``_end``, the sum of count up to and with this row's value, and ``_n``, that of all rows.

    counted: one row per value (not null), within by if given. Values are dealt to cells by approximate percentiles, sums run
    within a cell, and the table of the cells' sums, cells rows for each of by, is small enough to go to every task.
    """
    by = by or []
    points = F.array(*[F.lit(k / cells) for k in range(1, cells)])
    edges = counted.groupBy(*by).agg(F.percentile_approx(value, points, 10_000).alias("_edges"))
    dealt = counted.join(F.broadcast(edges), by) if by else counted.join(F.broadcast(edges))
    dealt = dealt.withColumn("_cell", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    sums = dealt.groupBy(*by, "_cell").agg(F.sum(count).alias("_sum"))
    before = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*by, "_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(W.partitionBy(*by)).alias("_n"))
    placed = dealt.join(F.broadcast(offsets), [*by, "_cell"])
    upto = F.col("_before") + F.sum(count).over(W.partitionBy(*by, "_cell").orderBy(value))
    return placed.withColumn("_end", upto).drop("_cell", "_before")


def _long(rows: DataFrame, measures: list[str], *keep: str) -> DataFrame:
    """keep, ``measure`` and ``value``, a row for each measure that isn't null."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return rows.select(*keep, F.inline(pairs)).where("value IS NOT NULL")


def _placed(long: DataFrame) -> DataFrame:
    """running_counts() of the measures' values; equal values are one row, with their number ``_c``."""
    return running_counts(long.groupBy("measure", "value").agg(F.count("*").alias("_c")), "value", "_c", ["measure"])


def percentile_points(rows: DataFrame, measures: list[str], points: list[int]) -> DataFrame:
    """``measure``, ``point``, ``value``: the value at index min(floor(n p / 100), n - 1) of the sorted non-null ones."""
    wanted = _placed(_long(rows, measures)).withColumn("point", F.explode(F.array(*[F.lit(p) for p in points])))
    at = F.least(F.floor(F.col("_n") * F.col("point") / 100), F.col("_n") - 1)
    return wanted.where((at < F.col("_end")) & (at >= F.col("_end") - F.col("_c"))).select("measure", "point", "value")


def percentile_ranks(rows: DataFrame, measures: list[str], key: str) -> DataFrame:
    """rows with ``<measure>_rank``: 100 * share of rows that are not above its value; null gives 50, and doesn't count.

    key tells the rows apart. rows are read five times, whatever the number of measures: store them first where they are dear.
    """
    long = _long(rows, measures, key)
    rank = 100.0 * (F.col("_end") / F.col("_n"))
    each = [F.max(F.when(F.col("measure") == m, rank)).alias(f"{m}_rank") for m in measures]
    ranks = long.join(_placed(long), ["measure", "value"]).groupBy(key).agg(*each)
    return rows.join(ranks, key, "left").fillna(50.0, [f"{m}_rank" for m in measures])


def composite(rows: DataFrame, weights: dict[str, float], inverse: dict[str, float], key: str) -> DataFrame:
    """Weighted sum of percentile ranks (100 less the rank for inverse ones) to one digit, and the place.

    Ratings of one digit are few, so that their counts are one small table, whose window gives each rating's first place;
    rows of one rating are put in order by key, a task for each rating. The ranks are made twice: see percentile_ranks().
    """
    score = F.lit(0.0)
    for m, w in weights.items():
        score = score + F.col(f"{m}_rank") * w
    for m, w in inverse.items():
        score = score + (100 - F.col(f"{m}_rank")) * w
    df = percentile_ranks(rows, [*weights, *inverse], key).withColumn("rating", half_up(score, 1))
    counts = df.groupBy("rating").agg(F.count("*").alias("_c"))
    above = F.sum("_c").over(W.orderBy(F.desc("rating")).rowsBetween(W.unboundedPreceding, -1))
    first = counts.select("rating", F.coalesce(above, F.lit(0)).alias("_above"))
    place = F.col("_above") + F.row_number().over(W.partitionBy("rating").orderBy(key))
    return df.join(F.broadcast(first), "rating").withColumn("place", place.cast("long")).drop("_above")


def archetype(rows: DataFrame, high: list[str], low: list[str], key: str, top: int = 5) -> DataFrame:
    """The first rows, by the sum of high ranks, with ranks of 75 or more in all high and 35 or less in all low measures."""
    df = percentile_ranks(rows, [*high, *low], key)
    for m in high:
        df = df.where(F.col(f"{m}_rank") >= 75)
    for m in low:
        df = df.where(F.col(f"{m}_rank") <= 35)
    total = sum((F.col(f"{m}_rank") for m in high), F.lit(0.0))
    return df.withColumn("total", total).orderBy(F.desc("total"), key).limit(top)


def correlations(rows: DataFrame, measures: list[str], least: int = 5) -> DataFrame:
    """``x``, ``y``, ``n``, ``r`` per pair over rows that have both; 0 without variance or with fewer than least rows.

    One pass: six sums per pair.
    """
    aggregates = []
    for x, y in combinations(measures, 2):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
        aggregates.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.count(a).alias("n"), F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("u"), F.var_pop(b).alias("v")).alias(f"_{x}_{y}"))
    long = rows.agg(*aggregates).select(F.explode(F.array(*[f"_{x}_{y}" for x, y in combinations(measures, 2)])).alias("p")).select("p.*")
    r = F.when((F.col("n") >= least) & (F.col("u") > 0) & (F.col("v") > 0), F.col("c") / F.sqrt(F.col("u") * F.col("v"))).otherwise(F.lit(0.0))
    return long.select("x", "y", "n", r.alias("r"))


def strength(r: Column) -> Column:
    return F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.4, "moderate").when(F.abs(r) > 0.2, "weak").otherwise("none")


def quartile_means(rows: DataFrame, by: str, measures: list[str], key: str) -> DataFrame:
    """Means per quartile of by, cut at floor(n / 4), floor(n / 2), floor(3 n / 4); a missing measure counts as 0.

    Rows without by stand before all others; rows of one value are put in order by key, a task for each value.
    """
    values = _placed(_long(rows, [by])).select(F.col("value").alias("_v"), (F.col("_end") - F.col("_c")).alias("_first"))
    counts = rows.agg(F.count("*").alias("_n"), F.count_if(F.col(by).isNull()).alias("_without"))
    df = rows.join(values, F.col(by).cast("double") == F.col("_v"), "left").join(F.broadcast(counts))
    first = F.when(F.col(by).isNull(), 0).otherwise(F.col("_first") + F.col("_without"))
    df = df.withColumn("_p", first + F.row_number().over(W.partitionBy(by).orderBy(key)) - 1)
    quartile = F.lit(1)
    for k in (1, 2, 3):
        quartile = quartile + (F.col("_p") >= F.floor(F.col("_n") * k / 4)).cast("int")
    return df.withColumn("quartile", quartile).groupBy("quartile").agg(F.count("*").alias("n"), *[F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in measures])


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("place") <= n)


def residuals(rows: DataFrame, x: str, within: str) -> DataFrame:
    """x less its group's mean, and as z-score over the group (0 without variance). Two figures a group, joined back: no
    group is gathered in one task."""
    own = rows.groupBy(F.col(within).alias("_g")).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"))
    df = rows.join(own, F.col(within).eqNullSafe(F.col("_g")))
    off = F.col(x) - F.col("_mean")
    return df.withColumns({"residual": off, "z": F.when(F.col("_sd") > 0, off / F.col("_sd")).otherwise(F.lit(0.0))}).drop("_g", "_mean", "_sd")
