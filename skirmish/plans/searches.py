"""Registered queries of the full-text index and its query language, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions import stems
from skirmish.operators import fulltext
from skirmish.plans.catalog import query
from skirmish.plans.standins import table

MIXED = '("of the" OR thea* OR NEAR(was dans, 8)) AND the NOT (erst* OR "in the")'
RANKED = '"of the" OR was OR dans'


def _swaps(word: str, rules: dict[str, str]) -> str:
    """SQL of the first rule whose suffix a word has."""
    return "CASE " + " ".join(f"WHEN ends_with({word}, '{s}') THEN CASE WHEN regexp_matches(left({word}, -{len(s)}), '{_M}') THEN left({word}, -{len(s)}) || '{r}' ELSE {word} END" for s, r in rules.items()) + f" ELSE {word} END"


#: In the SQL a y that is a vowel is written Y. _M: a vowel and a consonant after it somewhere; _M2: twice.
_C, _V = "[^aeiouY]", "[aeiouY]"
_M, _M2, _CVC = f"^{_C}*{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}+{_C}", f"{_C}{_V}[^aeiouYwxy]$"
_SHORT = lambda w: f"(regexp_matches({w}, '{_M}') AND NOT regexp_matches({w}, '{_M2}') AND {{}} regexp_matches({w}, '{_CVC}'))"
_CUT = " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN regexp_matches(left(w, -{len(s)}), '{_M2}'){' AND regexp_matches(left(w, -3), ' + chr(39) + '[st]$' + chr(39) + ')' if s == 'ion' else ''} THEN left(w, -{len(s)}) ELSE w END" for s in stems.STEP_4)

STEMS = f"""v AS (SELECT term, len(term) < 3 AS short, regexp_replace(regexp_replace(term, '([^aeiouy])y', '\\1Y', 'g'), '([aeiou]y)y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT term FROM t)),
s1 AS (SELECT term, short, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, -2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, -1) ELSE w END AS w FROM v),
s2 AS (SELECT term, short, w, CASE WHEN ends_with(w, 'eed') THEN 0 WHEN ends_with(w, 'ed') AND regexp_matches(left(w, -2), '{_V}') THEN 2 WHEN ends_with(w, 'ing') AND regexp_matches(left(w, -3), '{_V}') THEN 3 ELSE 0 END AS cut FROM s1),
s3 AS (SELECT term, short, CASE WHEN cut > 0 THEN left(w, -cut) WHEN ends_with(w, 'eed') AND regexp_matches(left(w, -3), '{_M}') THEN left(w, -1) ELSE w END AS w, cut FROM s2),
s4 AS (SELECT term, short, CASE WHEN cut = 0 THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN len(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND regexp_matches(w, '[^aeiouYlsz]$') THEN left(w, -1)
  WHEN {_SHORT('w').format('')} THEN w || 'e' ELSE w END AS w FROM s3),
s5 AS (SELECT term, short, CASE WHEN ends_with(lower(w), 'y') AND regexp_matches(left(w, -1), '{_V}') THEN left(w, -1) || 'i' ELSE w END AS w FROM s4),
s6 AS (SELECT term, short, {_swaps('w', stems.STEP_2)} AS w FROM s5),
s7 AS (SELECT term, short, {_swaps('w', stems.STEP_3)} AS w FROM s6),
s8 AS (SELECT term, short, CASE {_CUT} ELSE w END AS w FROM s7),
s9 AS (SELECT term, short, CASE WHEN ends_with(w, 'e') AND (regexp_matches(left(w, -1), '{_M2}') OR {_SHORT('left(w, -1)').format('NOT')}) THEN left(w, -1) ELSE w END AS w FROM s8),
stems AS (SELECT term, CASE WHEN short THEN term WHEN ends_with(w, 'll') AND regexp_matches(w, '{_M2}') THEN lower(left(w, -1)) ELSE lower(w) END AS stem FROM s9)"""

PLACES = rf"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
{STEMS},
p AS (SELECT doc_id, n, stem, pos FROM t JOIN stems USING (term))"""


@query(f"WITH {PLACES} SELECT stem, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs, count(DISTINCT term)::BIGINT AS forms FROM t JOIN stems USING (term) GROUP BY 1")
def stemmed_terms(spark, d):
    """Stems of all documents' words, how often and in how many documents they stand, and in how many forms."""
    return fulltext.stem_counts(table(spark, d, "documents"), "doc_id", "text")


_AFTER = "SELECT a.doc_id, count(*) AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.stem = '{0}' AND b.stem = '{1}' GROUP BY 1"
_STEM_OF = {w: stems.stem(w) for w in ("of", "the", "was", "dans", "in")}


def _after(a: str, b: str) -> str:
    return _AFTER.format(_STEM_OF[a], _STEM_OF[b])


@query(f"""WITH {PLACES}, of_the AS ({_after('of', 'the')}), in_the AS ({_after('in', 'the')}),
n AS (SELECT doc_id, count(*) FILTER (starts_with(stem, 'thea')) AS thea, count(*) FILTER (stem = '{_STEM_OF['was']}') AS was, count(*) FILTER (stem = '{_STEM_OF['dans']}') AS dans, count(*) FILTER (stem = '{_STEM_OF['the']}') AS the, count(*) FILTER (starts_with(stem, 'erst')) AS erst FROM p GROUP BY 1),
near AS (SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.stem = '{_STEM_OF['was']}' AND b.stem = '{_STEM_OF['dans']}' AND abs(a.pos - b.pos) - 1 <= 8)
SELECT doc_id, (coalesce(of_the.n, 0) + thea + was + dans + the)::BIGINT AS hits FROM n LEFT JOIN of_the USING (doc_id)
WHERE (of_the.n > 0 OR thea > 0 OR doc_id IN (FROM near)) AND the > 0 AND erst = 0 AND doc_id NOT IN (SELECT doc_id FROM in_the)""")
def fts_mixed(spark, d):
    """A query of all operators, over an index that is built first."""
    return fulltext.match(fulltext.build(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"), MIXED)


@query(f"""WITH {PLACES}, c AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d WHERE len(w) > 0),
h AS (SELECT doc_id, 0 AS k, n FROM ({_after('of', 'the')}) UNION ALL SELECT doc_id, 1, count(*) FROM p WHERE stem = '{_STEM_OF['was']}' GROUP BY 1 UNION ALL SELECT doc_id, 2, count(*) FROM p WHERE stem = '{_STEM_OF['dans']}' GROUP BY 1),
df AS (SELECT k, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean))), 9) AS score FROM h JOIN df USING (k) JOIN d USING (doc_id), c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def fts_ranked(spark, d):
    """The ten best documents (the feature) of a query with a phrase, over an index that is built first."""
    index = fulltext.build(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return fulltext.ranked(index, RANKED).withColumn("score", F.round("score", 9))
