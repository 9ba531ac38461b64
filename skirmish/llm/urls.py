"""URL filters: a few rules by longest match, then a blocked Bloom filter over listed canonical URLs and an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import stored

#: A filter block: eight 64-bit words, one bit of each set per key.
LANES = 8
#: Keys per block for a false-positive rate near 1 in 1,000.
KEYS_PER_BLOCK = 32
#: Largest filter, in blocks of 72 bytes, that is broadcast: some 10 MB, a list of 4 million entries.
BROADCAST_BLOCKS = 131_072
#: A larger filter is joined by a shuffle, and the keys of one block are dealt to this many tasks.
SALTS = 32
#: Listed entries, of about 100 bytes, that occur in the pages and are broadcast for the exact join: some 10 MB.
BROADCAST_ENTRIES = 100_000

#: Query parameters that don't tell pages apart: the name, as a regular expression.
TRACKING = "utm_[^=]*|ref|fbclid|gclid"


def split_url(url: Column) -> dict[str, Column]:
    """``host``: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. ``path``: from there up to
    ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {"host": F.translate(host, upper, upper.lower()), "path": F.substr(rest, F.length(host) + 1)}


def site_of(host: Column) -> Column:
    """A host without user, default port, final dots and a leading www."""
    for pattern in (r"^.*@", r":(80|443)$", r"\.+$", r"^www\."):
        host = F.regexp_replace(host, pattern, "")
    return host


def canonical(url: Column) -> Column:
    """One spelling of a URL: the site, the path without final slashes (``/`` if nothing is left), and the query's
    parameters, sorted, without the TRACKING ones. Scheme and fragment are dropped. Null without a site."""
    parts = split_url(url)
    site, path = site_of(parts["host"]), F.regexp_replace(parts["path"], "/+$", "")
    before = F.substring_index(url, "#", 1)
    query = F.when(F.locate("?", before) > 0, F.substr(before, F.locate("?", before) + 1)).otherwise(F.lit(""))
    told = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^({TRACKING})(=|$)"))
    args = F.when(F.size(told) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(told), "&"))).otherwise(F.lit(""))
    return F.when(site != "", F.concat(site, F.when(path == "", F.lit("/")).otherwise(path), args))


def ruling(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, else null: a chain of conditions, longest rule first.

    rules: (host, path, verdict). A rule fits its host and all subdomains where the path starts with the rule's.
    Among rules of one length the longer host is first, then block.
    """
    order = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in order]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def keys_of(url: Column) -> Column:
    """What a page may be listed as: its canonical URL, or the root of its site or of a domain above."""
    one = canonical(url)
    labels = F.split(F.substring_index(one, "/", 1), r"\.")
    n = F.size(labels)
    roots = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(labels, i, n), "."), F.lit("/")))
    return F.when(one.isNotNull(), F.array_distinct(F.concat(F.array(one), roots)))


def lane_bit(key_hash: Column, lane: int) -> Column:
    """The bit of a lane: six of the 48 low bits of the key's hash."""
    position = F.shiftrightunsigned(key_hash, 6 * lane).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(blocks)).alias("block")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of the keys as a table: block number and its eight words."""
    h = F.xxhash64("key")
    keyed = listed.select(block_of("key", blocks), *[lane_bit(h, k).alias(f"b{k}") for k in range(LANES)])
    return keyed.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"b{k}") for k in range(LANES)])


def listed_pages(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``listed`` (the longest entry) of the pages that are listed.

    pages: page_id, url. listed: ``url``; an entry without a path (``http://a.org`` or ``http://a.org/``) stands for all
    pages of its site and of the domains below, any other for the pages of its canonical URL. A page's few keys go
    through the filter before any shuffle; what may be listed is held against the list by an exact hash join on the
    distinct keys, so a key of very many pages is one row in it.
    """
    entries = stored(listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct())
    blocks = entries.count() // KEYS_PER_BLOCK + 1
    keys = pages.where("url IS NOT NULL").select("page_id", "url", F.explode(keys_of(F.col("url"))).alias("key"))
    keys = keys.select("page_id", "url", "key", block_of("key", blocks))
    h, hit = F.xxhash64("key"), F.lit(True)
    for k in range(LANES):
        hit = hit & (F.col(f"b{k}").bitwiseAND(lane_bit(h, k)) != 0)
    sift = bloom(entries, blocks)
    if blocks <= BROADCAST_BLOCKS:
        near = keys.join(F.broadcast(sift), "block")
    else:
        salted = keys.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
        near = salted.join(sift.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["block", "salt"])
    near = stored(near.where(hit).select("page_id", "url", "key"))
    true = stored(entries.join(near.select("key").distinct(), "key", "left_semi"))
    true = F.broadcast(true) if true.count() <= BROADCAST_ENTRIES else true
    return near.join(true, "key").groupBy("page_id", "url").agg(F.max_by("key", F.struct(F.length("key"), "key")).alias("listed"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Every page with ``host``, ``path``, ``rule`` (the one that fits, else null), ``listed`` and ``verdict``.

    The longest fitting rule (see ruling()) decides; where none fits, a page that listed_pages() finds is blocked and any
    other allowed. ``listed`` is the entry of the list, as host and path, also where a rule has decided.

    A null URL, or one without ``://``, has an empty host and path, and is allowed. Repeated rows get equal verdicts,
    and a repeated id with another URL its own. A null id is an id. Columns of pages named like the five new ones are
    replaced. Null entries, and those without a site, list nothing; no rules and no entries: all pages are allowed. An
    empty table gives an empty table. A URL may be of any length.
    """
    found = listed_pages(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), listed)
    found = found.select(F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.col("listed").alias("_listed"))
    df = pages.withColumns(split_url(F.col(url)))
    df = df.join(found, F.col(page_id).eqNullSafe(F.col("_page")) & (F.col(url) == F.col("_url")), "left")
    df = df.withColumn("_rule", ruling(rules, F.col("host"), F.col("path")))
    method = F.when(F.col("_listed").isNotNull(), "block").otherwise("allow")
    df = df.withColumns({"rule": F.col("_rule.rule"), "listed": F.col("_listed"), "verdict": F.coalesce("_rule.verdict", method)})
    return df.drop("_page", "_url", "_listed", "_rule")
