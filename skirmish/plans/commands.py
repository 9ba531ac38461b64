"""Registered query of expanded commands, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.operators import aliases
from skirmish.plans.catalog import query
from skirmish.plans.standins import table

#: A part is an alias of one of four scopes, which refers to earlier ones in the three ways there are; the first ones go round in circles.
ALIASES = """al AS (
  SELECT p_partkey % 4 AS scope, 'a' || p_partkey AS name,
         CASE WHEN p_partkey <= 12 THEN 'a' || (p_partkey + 4) || ';say  ' || p_partkey WHEN p_partkey % 3 = 0 THEN ' a' || (p_partkey - 8) || ' ;; say "' || p_size || '"' WHEN p_partkey % 3 = 1 THEN 'if ($x == 1) then a' || (p_partkey - 4) || ' else +b' || p_partkey ELSE '+a' || (p_partkey - 4) || ';wait' END AS command FROM part)"""


@query(rf"""WITH RECURSIVE {ALIASES},
r AS (
  SELECT p_partkey AS id, p_partkey % 4 AS scope, []::INT[] AS place, 'a' || p_partkey || '; echo $a' AS command, 0 AS depth, true AS open FROM part
  UNION ALL
  SELECT id, q.scope, CASE WHEN fork THEN list_concat(place, [i, j]) ELSE list_concat(place, [i]) END, CASE WHEN fork THEN b ELSE coalesce(x.command, y.command, part) END, depth + 1, fork OR x.name IS NOT NULL OR y.name IS NOT NULL
  FROM (
    SELECT *, len(bs) > 0 AS fork, unnest(CASE WHEN len(bs) > 0 THEN bs ELSE [part] END) AS b, unnest(range(1, greatest(len(bs), 1) + 1))::INT AS j, string_split(part, ' ')[1] AS w
    FROM (
      SELECT *, CASE WHEN starts_with(part, 'if (') THEN regexp_extract_all(part, '(?:then|else) ([^ ]+)', 1) ELSE [] END AS bs
      FROM (SELECT id, scope, place, depth, i, trim(part) AS part FROM (SELECT *, unnest(string_split(command, ';')) AS part, unnest(range(1, len(string_split(command, ';')) + 1))::INT AS i FROM r WHERE open AND depth <= {aliases.DEPTH}))
      WHERE part <> '')) q
  LEFT JOIN al x ON NOT fork AND x.scope = q.scope AND x.name = w LEFT JOIN al y ON NOT fork AND y.scope = q.scope AND '+' || y.name = w)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS at, trim(command) AS command FROM r WHERE NOT open OR depth > {aliases.DEPTH}""")
def expanded_commands(spark, d):
    """What a command of each part's alias comes down to."""
    k = F.col("p_partkey")
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    command = F.when(k <= 12, text("a", k + 4, ";say  ", k)).when(k % 3 == 0, text(" a", k - 8, ' ;; say "', F.col("p_size"), '"')).when(k % 3 == 1, text("if ($x == 1) then a", k - 4, " else +b", k)).otherwise(text("+a", k - 4, ";wait"))
    part = table(spark, d, "part").select((k % 4).alias("scope"), k.alias("id"), text("a", k).alias("name"), command.alias("command"))
    return aliases.expanded(part.select("scope", "id", text(F.col("name"), "; echo $a").alias("command")), part.select("scope", "name", "command"))
