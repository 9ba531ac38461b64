"""Mixing sources to target weights by hierarchical budgeting, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skirmish.llm.common import stored

#: Hexadecimal digits of the order key that one level of the prefix search looks at: 4,096 bins.
DIGITS = 3


def fill(children: DataFrame, parent: list[str], budget: str, weight: str, capacity: str, out: str) -> DataFrame:
    """Deal each parent's budget to its children in proportion to their weights, none above its capacity.

    What a full child can't take goes to its siblings, again by weight. Sorted by capacity per weight, the full
    children are a prefix, so the common level needs two window sums and no iteration. A weight of 0 gets nothing.
    """
    by = W.partitionBy(*parent).orderBy("_ratio", *[c for c in children.columns if c not in (budget, weight, capacity)])
    df = children.where(F.col(weight) > 0).withColumn("_ratio", F.col(capacity) / F.col(weight))
    df = df.withColumns({
        "_before": F.coalesce(F.sum(capacity).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "_open": F.sum(weight).over(by.rowsBetween(0, W.unboundedFollowing)),
    })
    df = df.withColumn("_level", (F.col(budget) - F.col("_before")) / F.col("_open"))
    df = df.withColumn("_full", F.col("_ratio") <= F.col("_level"))
    everyone = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumn("_level", F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(everyone))
    df = df.withColumn(out, F.when(F.col("_full"), F.col(capacity)).otherwise(F.greatest(F.lit(0.0), F.col(weight) * F.col("_level"))))
    return df.drop("_ratio", "_before", "_open", "_level", "_full")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, float]], budget: float | None, max_epochs: int) -> DataFrame:
    """One row per leaf with its ``budget`` in tokens, rounded down.

    leaves: a row per leaf with the level columns and its ``tokens``. The budget goes down the tree level by level;
    a subtree's capacity is max_epochs times its tokens, so a shortage is first shared among siblings, and passes to
    the parent's siblings only if a whole subtree is short.
    """
    caps = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs)
    total = caps.agg(F.sum("tokens").cast("double").alias("_all"))
    given = total.select((F.lit(float(budget)) if budget is not None else F.col("_all")).alias("_budget"), F.lit(0).alias("_root"))
    parent = ["_root"]
    for k, level in enumerate(levels):
        path = ["_root", *levels[: k + 1]]
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights[k].items() for x in kv]), F.col(level)), F.lit(1.0)) if weights[k] else F.lit(1.0)
        nodes = caps.withColumn("_root", F.lit(0)).groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("_weight", weight.cast("double")).join(given, parent)
        given = fill(nodes, parent, "_budget", "_weight", "capacity", "_share").select(*path, F.col("_share").alias("_budget"))
        parent = path
    # the small addend keeps a share that is a whole number up to rounding
    return given.select(*levels, F.floor(F.col("_budget") + 1e-6).cast("long").alias("budget"))


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def cutoffs(units: DataFrame, leaf: list[str]) -> DataFrame:
    """For each leaf the last (key, id) of the shortest prefix, in key order, that holds at least ``rest`` tokens.

    units: leaf columns, key, id, tokens, rest. No leaf is ever sorted whole: token sums by the key's leading digits
    find the bin where the prefix ends, sums by the next digits find the bin within it, and only that bin's rows,
    one in 16 million, are sorted.
    """
    units = units.where(F.col("rest") > 0)
    for k in range(2):
        bins = units.groupBy(*leaf, "rest", F.substring("key", 1 + DIGITS * k, DIGITS).alias("_bin")).agg(F.sum("tokens").alias("_sum"))
        upto = F.coalesce(F.sum("_sum").over(W.partitionBy(*leaf).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ends = bins.withColumn("_before", upto).where((F.col("_before") < F.col("rest"))).groupBy(*leaf).agg(F.max(F.struct("_bin", "_before")).alias("_end"))
        units = units.join(ends, leaf).where(F.substring("key", 1 + DIGITS * k, DIGITS) == F.col("_end._bin"))
        units = units.withColumn("rest", F.col("rest") - F.col("_end._before")).drop("_end")
    last = units.groupBy(*leaf, "rest", "key", "id").agg(F.sum("tokens").alias("_sum"))
    upto = F.coalesce(F.sum("_sum").over(W.partitionBy(*leaf).orderBy("key", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return last.withColumn("_before", upto).where(F.col("_before") < F.col("rest")).groupBy(*leaf).agg(F.max(F.struct("key", "id")).alias("_cut"))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: list[dict[str, float]],
    tokens: Column,
    budget: float | None = None,
    max_epochs: int = 2,
    seed: int = 1,
    doc_id: str = "doc_id",
) -> DataFrame:
    """The rows of docs as often as the mixture takes them, with ``mix_epoch`` (1, 2, ...) and ``mix_tokens`` added.

    levels: the tree from its root to its leaves, name and expression (domain, language, source). weights[k]: target
    weights among siblings at level k by name, 1 if not given. budget: tokens of the whole mixture, by default all
    tokens of docs. A leaf whose budget exceeds its tokens gives whole epochs first; of the next epoch it gives the
    shortest prefix, in that epoch's seeded order, that reaches the rest.

    A null level value is the leaf "". Null and empty texts have no tokens: they come along in whole epochs and where
    the prefix passes them. A null id is ordered as "". Rows that repeat an id stand together in the order, and are
    taken or left together. Columns of docs named like the two new ones are replaced. An empty table gives an empty table.
    """
    leaf = [f"_level{k}" for k in range(len(levels))]
    marked = docs.withColumns({a: F.coalesce(x.cast("string"), F.lit("")) for a, x in zip(leaf, levels.values(), strict=True)})
    marked = marked.withColumns({"mix_tokens": tokens.cast("long"), "_id": F.coalesce(F.col(doc_id).cast("string"), F.lit(""))})
    # the narrow table is read several times below, the texts only once more
    slim = stored(marked.select(*leaf, F.col("_id").alias("id"), F.col("mix_tokens").alias("tokens")))
    sums = slim.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(sums, leaf, weights, budget, max_epochs).join(sums, leaf)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    plan = stored(plan.withColumn("_whole", whole).select(*leaf, "_whole", (F.col("budget") - F.col("_whole") * F.col("tokens")).alias("rest")))
    key = order_key(F.col("id"), F.col("_whole") + 1, seed)
    cuts = cutoffs(slim.join(plan, leaf).select(*leaf, key.alias("key"), "id", "tokens", "rest"), leaf)
    plan = stored(plan.drop("rest").join(cuts, leaf, "left"))
    df = marked.join(plan, leaf)
    part = F.coalesce(F.struct(order_key(F.col("_id"), F.col("_whole") + 1, seed).alias("key"), F.col("_id").alias("id")) <= F.col("_cut"), F.lit(False))
    epochs = F.col("_whole") + part.cast("int")
    df = df.where(epochs > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), epochs)))
    return df.drop(*leaf, "_id", "_whole", "_cut")
