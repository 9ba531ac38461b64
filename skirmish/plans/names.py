"""Registered query of name codes, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions import colours
from skirmish.plans.catalog import query
from skirmish.plans.standins import table

_MAP = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in colours.DOLLAR.items()) + "}"
_BYTE = f"CASE WHEN len(t) = 4 THEN greatest(('0x' || t[3:4])::INT, CASE WHEN t = '$x00' THEN 32 ELSE 0 END) WHEN len(t) = 2 AND t[1] = '^' THEN ascii(t[2]) | 128 WHEN len(t) = 2 THEN {_MAP}[t[2]] ELSE ascii(t) END"


@query(rf"""WITH n AS (SELECT c_custkey, '$x' || printf('%02x', c_custkey % 256) || '^' || chr((33 + c_custkey % 94)::INT) || '$' || chr((33 + c_custkey % 93)::INT) || c_name AS name FROM customer),
t AS (SELECT c_custkey, unnest(regexp_extract_all(name, '(?s)(\$x[0-9A-Fa-f]{{2}}|\$[\\:\[\]0-9,.<\->(=)aWGRYBbcd$^]|\^[^ ]|.)', 1)) AS t, generate_subscripts(regexp_extract_all(name, '(?s)(\$x[0-9A-Fa-f]{{2}}|\$[\\:\[\]0-9,.<\->(=)aWGRYBbcd$^]|\^[^ ]|.)', 1), 1) AS i FROM n),
b AS (SELECT *, {_BYTE} AS b FROM t),
c AS (SELECT c_custkey, i, CASE WHEN len(t) = 1 AND b >= 32 THEN t WHEN b & 127 < 32 THEN '{colours.GLYPHS}'[(b & 127) + 1] WHEN b & 127 = 127 THEN ' ' ELSE chr(b & 127) END AS ch,
  CASE WHEN len(t) = 1 AND b >= 32 THEN 'w' WHEN b & 127 BETWEEN 16 AND 27 THEN 'g' WHEN b >= 128 THEN 'b' ELSE 'w' END AS color FROM b),
g AS (SELECT *, sum((color IS DISTINCT FROM was)::INT) OVER (PARTITION BY c_custkey ORDER BY i) AS run FROM (SELECT *, lag(color) OVER (PARTITION BY c_custkey ORDER BY i) AS was FROM c))
SELECT c_custkey, run::INT - 1 AS at, string_agg(ch, '' ORDER BY i) AS text, any_value(color) AS color FROM g GROUP BY c_custkey, run""")
def colour_runs(spark, d):
    """Runs of one colour in names with codes: every byte, and every character after a dollar or a caret, occurs."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("$x"), F.lower(F.lpad(F.hex(k % 256), 2, "0")), F.lit("^"), F.chr(33 + k % 94), F.lit("$"), F.chr(33 + k % 93), "c_name")
    found = table(spark, d, "customer").select("c_custkey", F.posexplode(colours.runs(colours.expanded_codes(name))).alias("at", "run"))
    return found.select("c_custkey", "at", "run.text", "run.color")
