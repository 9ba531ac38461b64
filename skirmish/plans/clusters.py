"""Registered query of clusters under constraints, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.operators import identity
from skirmish.plans.catalog import query
from skirmish.plans.standins import table

#: Suppliers that share so many orders are linked.
TOGETHER = 20


@query(f"""WITH RECURSIVE n AS (SELECT s_suppkey AS id, s_nationkey AS nation, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
pairs AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS w FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) x JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL HAVING count(*) >= {TOGETHER}),
e AS (SELECT p.i AS x, q.i AS y, row_number() OVER (ORDER BY w DESC, a, b) AS k FROM pairs JOIN n p ON p.id = a JOIN n q ON q.id = b),
r AS (
  SELECT 0::BIGINT AS k, list(i ORDER BY i) AS l, list(nation ORDER BY i) AS c FROM n
  UNION ALL
  SELECT e.k, CASE WHEN l[x] <> l[y] AND NOT list_has_any(list_filter(c, lambda v, j: l[j] = l[x]), list_filter(c, lambda v, j: l[j] = l[y]))
    THEN list_transform(l, lambda v: CASE WHEN v = greatest(l[x], l[y]) THEN least(l[x], l[y]) ELSE v END) ELSE l END, c FROM r JOIN e ON e.k = r.k + 1),
last AS (SELECT l FROM r ORDER BY k DESC LIMIT 1)
SELECT n.id, m.id AS label FROM n, last JOIN n m ON m.i = l[n.i] WHERE n.i IN (SELECT x FROM e UNION SELECT y FROM e)""")
def constrained_clusters(spark, d):
    """Suppliers that are often in one order, but no two of one nation in a cluster."""
    pairs = identity.cooccurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey").where(F.col("together") >= TOGETHER)
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("group"))
    return identity.constrained_clusters(pairs.withColumnRenamed("together", "weight"), exclusive=nations)
