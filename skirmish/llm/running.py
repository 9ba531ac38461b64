"""Running totals within groups of any size: rows are dealt by ranges, and what a range begins with is added."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skirmish.llm.common import stored

_TOTALS = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """df, stored, with a column per name of totals: the total of its column over the rows of its group up to its own one.

    totals: name -> ("sum" or "xor", a long column without nulls). by and order: columns of df, nulls first. Ties in order
    come in any order, the same one for all totals. A group may be of any size: ranges of (by, order) are summed apart. A
    group that several ranges share begins or ends each of them, so there are at most two such per range, which is what is
    broadcast.
    """
    dealt = df.withColumns({f"_v_{name}": value for name, (_, value) in totals.items()})
    dealt = stored(dealt.repartitionByRange(*by, *order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    ends = dealt.groupBy("_part").agg(F.min(F.struct(*by)).alias("a"), F.max(F.struct(*by)).alias("b"))
    ends = ends.select("_part", F.explode(F.array("a", "b")).alias("_group")).distinct()
    shared = ends.groupBy("_group").agg(F.count("*").alias("_n")).where("_n > 1").select("_group")
    group = F.struct(*by).alias("_group")
    sums = dealt.withColumn("_group", group).join(F.broadcast(shared), "_group").groupBy("_group", "_part").agg(*[_TOTALS[kind][0](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in totals.items()])
    earlier = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = stored(sums.select("_group", "_part", *[F.coalesce(_TOTALS[kind][0](f"_t_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name, (kind, _) in totals.items()]))
    upto = W.partitionBy("_part", *by).orderBy(*order, "_row").rowsBetween(W.unboundedPreceding, 0)
    own = dealt.withColumns({f"_v_{name}": _TOTALS[kind][0](f"_v_{name}").over(upto) for name, (kind, _) in totals.items()}).withColumn("_group", group)
    own = own.join(F.broadcast(before), ["_group", "_part"], "left")
    return stored(own.select(*df.columns, *[_TOTALS[kind][1](F.col(f"_v_{name}"), F.coalesce(f"_b_{name}", F.lit(0))).alias(name) for name, (kind, _) in totals.items()]))
