"""The registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import chat, decontam, lines, minhash, mixing, negatives, ngrams, paragraphs, passages, prefixes, quality, suffix, tokens, urls
from skirmish.llm.common import scratch, stored, table, words


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics and the verdict of the threshold table for every document."""
    judged = quality.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))


OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
         (length(t) - length(translate(t, '!', '')))::BIGINT AS bangs,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: x IN ({_stop_list()}))) AS stops
  FROM d LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND n_words <= 100000
        AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.1 AND bangs / n_words <= 0.2
        AND stops / n_words >= 0.04 AND n_dup_lines / n_lines <= 0.5 AND n_words / n_lines >= 3.0) AS kept
FROM m
"""

#: The tree of the production mixture: domain, language, source. The two domains' sources and all weights.
WEB_SOURCES = [f"src{k}" for k in range(10)]
MIX_WEIGHTS: list[dict[str, float]] = [{"web": 0.5, "curated": 0.5}, {"en": 0.5, "de": 0.2, "es": 0.15, "fr": 0.15}, {}]
MIX_EPOCHS, MIX_SEED = 2, 1


def mixture(docs: DataFrame) -> DataFrame:
    """The production mixture: as many tokens (words) as docs has, at most two epochs of a source."""
    domain = F.when(F.col("source").isin(WEB_SOURCES), "web").otherwise("curated")
    levels = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, MIX_WEIGHTS, F.size(words(F.col("text"))), None, MIX_EPOCHS, MIX_SEED)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document the mixture takes, once per epoch."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "mix_epoch", "mix_tokens")


def _fill_sql(source: str, parent: str, node: str, weight: str) -> str:
    """SQL of one level of budgeting: source has parent's budget b; caps by node."""
    return f"""
  (SELECT {node}, CASE WHEN full_ THEN capacity ELSE greatest(0, weight * first_value(CASE WHEN NOT full_ THEN level END IGNORE NULLS) OVER (PARTITION BY {parent} ORDER BY ratio, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS b
   FROM (SELECT *, (b - before) / open AS level, ratio <= (b - before) / open AS full_
     FROM (SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
           FROM (SELECT *, capacity / weight AS ratio FROM
                  (SELECT {node}, sum(capacity)::DOUBLE AS capacity, ({weight})::DOUBLE AS weight FROM caps GROUP BY {node}) JOIN {source} USING ({parent}))
           WINDOW w AS (PARTITION BY {parent} ORDER BY ratio, {node}))))"""


OP2_SQL = f"""
WITH d AS (
  SELECT *, coalesce(CASE WHEN source IN ({", ".join(f"'{x}'" for x in WEB_SOURCES)}) THEN 'web' ELSE 'curated' END, '') AS l0, coalesce(lang, '') AS l1, coalesce(source, '') AS l2,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS mix_tokens, 0 AS root
  FROM documents),
sums AS (SELECT root, l0, l1, l2, sum(mix_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
caps AS (SELECT *, tokens::DOUBLE * {MIX_EPOCHS} AS capacity FROM sums),
total AS (SELECT 0 AS root, sum(tokens)::DOUBLE AS b FROM sums),
f0 AS {_fill_sql("total", "root", "root, l0", "CASE l0 WHEN 'web' THEN 0.5 WHEN 'curated' THEN 0.5 ELSE 1 END")},
f1 AS {_fill_sql("f0", "root, l0", "root, l0, l1", "CASE l1 WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.2 WHEN 'es' THEN 0.15 WHEN 'fr' THEN 0.15 ELSE 1 END")},
f2 AS {_fill_sql("f1", "root, l0, l1", "root, l0, l1, l2", "1")},
plan AS (
  SELECT l0, l1, l2, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget
  FROM (SELECT *, floor(b + 1e-6)::BIGINT AS budget FROM f2) JOIN sums USING (l0, l1, l2)),
o AS (
  SELECT d.*, whole, budget, md5('{MIX_SEED}:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM d JOIN plan USING (l0, l1, l2)),
p AS (
  SELECT *, sum(mix_tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY key, doc_id::VARCHAR RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(mix_tokens) OVER (PARTITION BY l0, l1, l2, key, doc_id) AS before,
    budget - whole * sum(mix_tokens) OVER (PARTITION BY l0, l1, l2) AS rest
  FROM o)
SELECT doc_id, lang, source, unnest(range(1, (whole + CASE WHEN before < rest THEN 1 ELSE 0 END + 1)::BIGINT))::INTEGER AS mix_epoch, mix_tokens FROM p
"""

#: The rules of op3's contract, as (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]
#: The listed sites, each with all its pages, and the site of which single pages are listed.
URL_SITES, URL_PAGES = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track"], "tionsh"
URL_TOPS = ["com", "net", "org"]
#: How many pages of that site are listed under each top level: its French ones, by number.
URL_NUMBERS = 50_000


def listed_urls(spark: SparkSession) -> DataFrame:
    """The production list: 15 sites, and 150,000 single pages."""
    sites = F.array(*[F.lit(f"http://{site}.example.{top}/") for site in URL_SITES for top in URL_TOPS])
    tops = F.explode(F.array(*map(F.lit, URL_TOPS)))
    pages = spark.range(URL_NUMBERS).select(tops.alias("top"), F.col("id").cast("string").alias("n"))
    return spark.range(1).select(F.explode(sites).alias("url")).union(pages.select(F.concat(F.lit(f"http://www.{URL_PAGES}.example."), "top", F.lit("/fr/"), "n")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' verdict on every page, and the list's where no rule fits."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, listed_urls(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.col("listed").isNotNull().alias("is_listed"))


OP3_SQL = f"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS rid, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, rid, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^#?]*[?]([^#]*)', 1) AS query FROM u),
rules AS (SELECT unnest([{", ".join(f"{{'h': '{h}', 'p': '{p}', 'v': '{v}'}}" for h, p, v in URL_RULES)}], recursive := true)),
ruled AS (
  SELECT rid, h || p AS rule, v FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h) + length(p) DESC) = 1),
sites AS (SELECT s || '.example.' || t AS site FROM (SELECT unnest({URL_SITES}) AS s), (SELECT unnest({URL_TOPS}) AS t)),
c AS (
  SELECT rid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)$', ''), '[.]+$', ''), '^www[.]', '') AS site, rtrim(path, '/') AS page,
         list_filter(string_split(coalesce(query, ''), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN ('ref', 'fbclid', 'gclid')) AS args FROM p),
method AS (
  SELECT rid, EXISTS (SELECT 1 FROM sites WHERE c.site = sites.site OR ends_with(c.site, '.' || sites.site))
    OR (site IN ({", ".join(f"'{URL_PAGES}.example.{t}'" for t in URL_TOPS)}) AND len(args) = 0 AND regexp_full_match(page, '/fr/(0|[1-9][0-9]{{0,4}})') AND try_cast(substr(page, 5) AS INT) < {URL_NUMBERS}) AS is_listed FROM c)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN is_listed THEN 'block' ELSE 'allow' END) AS verdict, is_listed
FROM p LEFT JOIN ruled USING (rid) JOIN method USING (rid)
"""


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document, on shingles of four words at 80 %."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 80)


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT x, b FROM reach JOIN both_ways ON y = a),
comp AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines under later copies of a three-line window."""
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS gone_at FROM later, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone_at), 0)::BIGINT AS n_removed,
       CASE WHEN gone_at IS NULL THEN sha256(text) ELSE sha256(coalesce(array_to_string(list_filter(l, lambda x, k: NOT list_contains(gone_at, k)), chr(10)), '')) END AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

#: Fixed value: what both turns of the added conversation say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the added one, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.digests(chat.parse_chats(chat.format_chats(rows.unionByName(extra))))


def _chat_sql() -> str:
    text, role = "text", "role"
    for plain, coded in chat.ESCAPES.items():
        literal = "chr(27)" if plain == chat.ESCAPE else f"'{plain}'"
        text, role = (f"replace({x}, {literal}, chr(27) || '{coded[1]}')" for x in (text, role))
    opens = " ".join(f"WHEN '{r}' THEN '{m[0]}'" for r, m in chat.MARKS.items())
    closes = " ".join(f"WHEN '{r}' THEN '{m[1]}'" for r, m in chat.MARKS.items())
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
m AS (SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (
  SELECT *, CASE WHEN prev = role THEN '{chat.TURN}' ELSE CASE role {opens} ELSE '{chat.OTHER[0]}' || {role} || '{chat.OTHER[1]}' END END || {text}
    || CASE WHEN next = role THEN '' ELSE CASE role {closes} ELSE '{chat.OTHER[2]}' END END AS piece
  FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the edit distance."""
    return decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without near copies of earlier paragraphs, and then of earlier passages.

    n_removed: paragraphs and passages that went, n_cut_words: the words in them, n_repeated: with those that stay and have
    copies elsewhere. A document that shares nothing has 0 in all three.
    """
    kept = stored(paragraphs.drop_repeated_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    kept = passages.drop_repeated_passages(kept)
    removed = F.size("gone") + F.col("n_passages")
    return kept.select(
        "doc_id", "n_paragraphs", removed.alias("n_removed"), (F.col("n_gone_words") + F.col("n_cut_words")).alias("n_cut_words"),
        (removed + F.size("copied") + F.col("n_copied_passages")).alias("n_repeated"), "gone", F.sha2("text", 256).alias("kept_sha256"),
    )


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document's ids, read back from the files."""
    path = scratch(spark)
    tokens.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, word_tokenizer())
    return tokens.digests(tokens.read_tokens(spark, path))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 200 bytes."""
    cut = suffix.cut_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Fixed values of op11's contract: every so many ids an anchor, every so many another label of so many, and the scale of components.
ANCHORS, WRONG, LABELS, SCALE = 50, 7, 10, 256


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every anchor."""
    rows = negatives.quantized(table(spark, sf_dir, "embeddings"), scale=SCALE)
    label = F.when(F.col("vec_id") % WRONG == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), f"vec_id % {ANCHORS} = 0")


OP11_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % {WRONG} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHORS} = 0),
p AS (
  SELECT aid, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY aid ORDER BY score DESC, other_id) AS n FROM s WHERE same QUALIFY n <= 5),
h AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.aid, p.n ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.aid = s.aid AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM h
"""

#: Fixed values of op12's contract: conversations of a hundred share the first ones' beginnings, of fewer turns than this.
TRIE_BLOCK, TRIE_TURNS = 100, 6


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, rebuilt with beginnings of the first one of their hundred."""
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TRIE_TURNS
    base = F.col("conv_id") - F.col("conv_id") % TRIE_BLOCK
    turns = prefixes.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefixes.prefix_trie(*prefixes.spliced(turns, base, taken, TRIE_TURNS - 1))


OP12_SQL = f"""
WITH crcs AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab),
hs AS (
  SELECT c, c - c % {TRIE_BLOCK} AS b,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8)), 4294967295::BIGINT) % {TRIE_TURNS} AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crcs),
t AS (
  SELECT conv_id AS c, m, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS p
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
r AS (
  SELECT hs.c, 0 AS half, p, m, n FROM hs JOIN t ON t.c = b WHERE p <= h
  UNION ALL SELECT hs.c, 1, p, m, n FROM hs JOIN t ON t.c = hs.c WHERE p > h),
d AS (SELECT c, n, row_number() OVER w AS depth, string_agg(m, '') OVER w AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY half, p ROWS UNBOUNDED PRECEDING)),
members AS (SELECT c, n, depth, k FROM d UNION ALL SELECT c, 0, 0, '' FROM hs),
size AS (SELECT c, max(depth) AS last FROM members GROUP BY c),
node AS (
  SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = last), '')) AS ends_sha256
  FROM members JOIN size USING (c) GROUP BY depth, k),
child AS (SELECT left(k, 32 * (depth - 1)::INT) AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (k)),
sums AS (
  SELECT left(k, 32 * up::INT) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT k, saved, n_children, unnest(range(0, depth + 1)) AS up FROM full_node) GROUP BY 1)
SELECT a.conv_id::BIGINT AS conv_id, a.depth::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM full_node a JOIN sums USING (k) LEFT JOIN node u ON a.depth > 0 AND u.k = left(a.k, 32 * (a.depth - 1)::INT)
"""


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document, on shingles of three words at 90 %."""
    return ngrams.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90)


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT x, b FROM reach JOIN both_ways ON y = a),
comp AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_url_filters": op3_url_filters,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_decontamination": op7_decontamination,
    "op8_paragraph_dedup": op8_paragraph_dedup,
    "op9_token_ids": op9_token_ids,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ngram_join": op13_ngram_join,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op2_mix_sources": OP2_SQL,
    "op3_url_filters": OP3_SQL,
    "op4_minhash_dedup": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_chat_format": _chat_sql(),
    "op11_hard_negatives": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_ngram_join": OP13_SQL,
}
