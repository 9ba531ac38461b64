"""A stored full-text index, and a query language over it: AND, OR, NOT, phrases, prefixes and NEAR, ranked by BM25."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.functions.stems import accents, stem
from skirmish.stages import shared_folder, stored

_SPLIT = r"[^\p{L}\p{N}]+"
_PLAIN = str.maketrans(*accents())


def tokens(text: Column) -> Column:
    """The runs of letters and digits, lower-cased, with their accents: they are taken off each distinct one, not off the text."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


def _numbered(names: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct names, and the number of each name's."""
    own: dict[str, int] = {}
    at = np.array([own.setdefault(x, len(own)) for x in names], dtype=np.int64)
    return list(own), at


def _spoken(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of each word of all rows its row, its place there and its term's number; and the terms, which are without accents."""
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    terms, number = _numbered([t.translate(_PLAIN) for t in coded.dictionary.to_pylist()])
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - (np.cumsum(size) - size)[row], number[coded.indices.to_numpy()], terms


def _postings(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, term, terms = _spoken(batch.column("_w"))
            if not len(row):
                continue
            stems, number = _numbered([stem(t) for t in terms])
            both = row * len(stems) + number[term]
            order = np.argsort(both, kind="stable")
            both = both[order]
            ends = np.append(np.flatnonzero(np.diff(both, prepend=-1)), len(both))
            row, own = np.divmod(both[ends[:-1]], len(stems))
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order], pa.int32()))
            size = pc.list_value_length(batch.column("_w")).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(stems).take(pa.array(own)), batch.column(key).take(pa.array(row)), pa.array(np.diff(ends)), places, size], ["term", key, "tf", "places", "len"])

    return run


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, _, term, terms = _spoken(batch.column("_w"))
        stems, number = _numbered([stem(t) for t in terms])
        known = batch.column("_known").to_numpy(zero_copy_only=False)[row]
        met = np.unique(row[known] * max(len(stems), 1) + number[term[known]]) % max(len(stems), 1)
        _, first = np.unique(number, return_index=True)
        # the documents of a stem are told with the first of its forms
        docs = np.zeros(len(terms), dtype=np.int64)
        docs[first] = np.bincount(met, minlength=len(stems))
        n = np.bincount(term, minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array([stems[k] for k in number], pa.string()), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(docs)], ["stem", "term", "n", "docs"])


def stem_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``stem``, ``n``, how often it stands in all texts, ``docs``, in how many documents, and ``forms``, how many terms it is of.

    A task counts its own batches, so that what is shuffled are their distinct terms. Texts of a null key are of no document.
    """
    counts = _gathered(docs, key, text).select(F.col(key).isNotNull().alias("_known"), tokens(F.col("_t")).alias("_w")).mapInArrow(_forms, "stem string, term string, n long, docs long")
    counts = counts.groupBy("stem", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts.groupBy("stem").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.count("*").alias("forms"))


@dataclass(frozen=True)
class Index:
    """postings: term, key, tf, places (from 0), len (tokens of the document). corpus: one row, docs and mean_len."""

    postings: DataFrame
    corpus: DataFrame
    key: str


def build(docs: DataFrame, key: str, text: str, path: str | None = None) -> Index:
    """The index of docs, written to path, or to the shared folder.

    Terms are tokens() without accents, in their stems. A document's postings are made by the task that reads it, and the
    stemmer sees each distinct term of a batch once. Postings are sorted and dealt by ranges of (term, key), so that a query
    reads the row groups of its terms or prefixes only, and a term that is everywhere fills several files. Null and empty
    texts, and ones without tokens, have no postings. Rows that repeat a key are one document, whose texts follow in any
    order; rows of a null key are left out.
    """
    path = path or shared_folder(docs.sparkSession)
    said = _gathered(docs.where(F.col(key).isNotNull()), key, text)
    kind = T.StructType().add("term", "string").add(key, said.schema[key].dataType).add("tf", "long").add("places", T.ArrayType(T.IntegerType())).add("len", T.IntegerType())
    own = stored(said.select(key, tokens(F.col("_t")).alias("_w")).mapInArrow(_postings(key), kind))
    own.repartitionByRange("term", key).sortWithinPartitions("term", key).write.parquet(f"{path}/postings")
    # one term of a document stands at its beginning
    own.where(F.get("places", F.lit(0)) == 0).agg(F.count("*").alias("docs"), F.avg("len").alias("mean_len")).coalesce(1).write.parquet(f"{path}/corpus")
    return load(docs.sparkSession, path, key)


def _gathered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and ``_t``, the text that isn't null, or the texts, of each key; rows of a null key stay as they are."""
    own = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"))
    if not _repeats(own, key):
        return own
    known = own.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.collect_list("_t"), "\n").alias("_t"))
    return known.union(own.where(F.col(key).isNull()))


def _repeats(docs: DataFrame, key: str) -> bool:
    return docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def load(spark: SparkSession, path: str, key: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus"), key)


# ---- the query language --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phrase:
    """Terms one after the other; the last may be a prefix; first: only at the document's beginning."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    within: int


@dataclass(frozen=True)
class Op:
    kind: str
    parts: tuple


_TOKEN = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<mark>[()+*^,])|(?P<word>[^\s"()+*^,]+))')


def parse(query: str) -> Phrase | Near | Op | None:
    """The query as a tree; None if it has no terms.

    Words are terms; a string in quotes, or one that the tokenizer splits, is a phrase; ``a + b`` joins phrases, ``a *`` is a
    prefix, ``^ a`` stands at the beginning, ``NEAR(a "b c", 5)`` has at most so many tokens (10) between its outer phrases.
    ``a b`` is both, closer than NOT, which is closer than AND, which is closer than OR; parentheses group.
    """
    found = [(m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(query)]
    if sum(len(m[0]) for m in _TOKEN.finditer(query)) != len(query.rstrip()):
        raise ValueError(f"query not understood: {query}")
    at = 0

    def peek(k: int = 0) -> tuple[str, str]:
        return found[at + k] if at + k < len(found) else ("end", "")

    def take(*wanted: str) -> bool:
        nonlocal at
        if peek() in {("mark", w) for w in wanted} | {("word", w) for w in wanted if w.isupper()}:
            at += 1
            return True
        return False

    def expect(mark: str) -> None:
        if not take(mark):
            raise ValueError(f"query not understood, {mark} expected: {query}")

    def phrase() -> Phrase:
        nonlocal at
        first, terms = take("^"), []
        while True:
            kind, text = peek()
            if kind not in ("string", "word") or text in ("AND", "OR", "NOT"):
                raise ValueError(f"query not understood, a word expected: {query}")
            at += 1
            plain = text[1:-1].replace('""', '"') if kind == "string" else text
            terms += [stem(t) for t in re.split(r"[\W_]+", plain.lower().translate(_PLAIN)) if t]
            if not take("+"):
                return Phrase(tuple(terms), take("*"), first)

    def unit():
        if take("("):
            inner = either()
            expect(")")
            return inner
        if peek() == ("word", "NEAR") and peek(1) == ("mark", "("):
            take("NEAR")
            take("(")
            phrases, within = [], 10
            while not take(")"):
                if take(","):
                    within = int(peek()[1])
                    nonlocal at
                    at += 1
                    expect(")")
                    break
                phrases.append(phrase())
            return Near(tuple(p for p in phrases if p.terms), within)
        return phrase()

    def several():
        parts = [unit()]
        while peek()[0] != "end" and peek() not in {("mark", ")"), ("word", "AND"), ("word", "OR"), ("word", "NOT")}:
            parts.append(unit())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def without():
        left = several()
        while take("NOT"):
            left = Op("not", (left, several()))
        return left

    def every():
        parts = [without()]
        while take("AND"):
            parts.append(without())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def either():
        parts = [every()]
        while take("OR"):
            parts.append(every())
        return parts[0] if len(parts) == 1 else Op("or", tuple(parts))

    if not found:
        return None
    tree = either()
    if peek()[0] != "end":
        raise ValueError(f"query not understood near {peek()[1]}: {query}")
    return tree


def phrases(tree, positive: bool = True) -> list[Phrase]:
    """The distinct phrases of a tree, in order; with positive without those behind a NOT."""
    if isinstance(tree, Phrase):
        own = [tree] if tree.terms else []
    elif isinstance(tree, Near):
        own = list(tree.phrases)
    else:
        parts = tree.parts[:1] if positive and tree.kind == "not" else tree.parts
        own = [p for part in parts for p in phrases(part, positive)]
    return list(dict.fromkeys(own))


def _shifted(places: Column, by: int) -> Column:
    return places if by == 0 else F.transform(places, lambda x: x - by)


def _begins_soon(places: Column, start: Column, length: int, within: int) -> Column:
    """Whether a phrase begins at start or later, at most so many tokens after the end of one of that length there."""
    return F.exists(places, lambda t: (t >= start) & (t - start - length <= within))


def _starts(phrase: Phrase, places: dict[tuple[str, bool], Column]) -> Column:
    """Where a phrase stands in a document."""
    own = [places[t, phrase.prefix and k == len(phrase.terms) - 1] for k, t in enumerate(phrase.terms)]
    out = reduce(F.array_intersect, [_shifted(p, k) for k, p in enumerate(own)])
    return F.filter(out, lambda x: x == 0) if phrase.first else out


def _first(phrase: Phrase, others: list[Phrase], within: int, starts: dict[Phrase, Column]) -> Column:
    return F.exists(starts[phrase], lambda s: reduce(lambda a, b: a & b, [_begins_soon(starts[q], s, len(phrase.terms), within) for q in others], F.lit(True)))


def _holds(tree, starts: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return F.size(starts[tree]) > 0 if tree.terms else F.lit(True)
    if isinstance(tree, Near):
        # one of the phrases comes first, and all others begin soon enough after its end
        fits = F.lit(not tree.phrases)
        for p in tree.phrases:
            fits = fits | _first(p, [q for q in tree.phrases if q != p], tree.within, starts)
        return fits
    parts = [_holds(p, starts) for p in tree.parts]
    if tree.kind == "not":
        return parts[0] & ~parts[1]
    return reduce(lambda a, b: a & b if tree.kind == "and" else a | b, parts)


def _leaves(tree, starts: dict[Phrase, Column], under: Column) -> list[tuple[Phrase, Column]]:
    """The phrases that count, one by one, and whether all that they are a part of, but for ORs, holds."""
    if isinstance(tree, Phrase):
        return [(tree, under)] if tree.terms else []
    if not isinstance(tree, Op) or tree.kind != "or":
        under = under & _holds(tree, starts)
    parts = tree.phrases if isinstance(tree, Near) else tree.parts[:1] if tree.kind == "not" else tree.parts
    return [leaf for part in parts for leaf in _leaves(part, starts, under)]


def _hits(index: Index, tree) -> tuple[DataFrame, list[Phrase], list[int]]:
    """Of every document with any of the query's terms: ``_len``, whether it ``_holds``, how often each phrase stands there,
    ``_n0``, ..., and how often each leaf of the tree counts, ``_c0``, ...; the phrases, and the number of each leaf's phrase."""
    asked = phrases(tree, positive=False)
    wanted = dict.fromkeys((t, p.prefix and k == len(p.terms) - 1) for p in asked for k, t in enumerate(p.terms))
    term = F.col("term")
    fits = {w: term.startswith(w[0]) if w[1] else term == w[0] for w in wanted}
    rows = index.postings.where(reduce(lambda a, b: a | b, fits.values(), F.lit(False)))
    gathered = rows.groupBy(index.key).agg(F.first("len").alias("_len"), *[F.flatten(F.collect_list(F.when(c, F.col("places")))).alias(f"_p{k}") for k, c in enumerate(fits.values())])
    places = {w: F.col(f"_p{k}") for k, w in enumerate(wanted)}
    found = gathered.select(index.key, "_len", *[_starts(p, places).alias(f"_s{k}") for k, p in enumerate(asked)])
    starts = {p: F.col(f"_s{k}") for k, p in enumerate(asked)}
    scored, leaves = phrases(tree), _leaves(tree, starts, F.lit(True))
    often = {p: F.size(starts[p]).cast("long") for p in scored}
    counts = [F.when(under, often[p]).otherwise(0).alias(f"_c{k}") for k, (p, under) in enumerate(leaves)]
    return found.select(index.key, "_len", _holds(tree, starts).alias("_holds"), *[often[p].alias(f"_n{k}") for k, p in enumerate(scored)], *counts), scored, [scored.index(p) for p, _ in leaves]


def match(index: Index, query: str) -> DataFrame:
    """key, and ``hits``, how often the query's phrases stand in the document, of all documents that the query fits.

    One plan: the postings of the query's terms, read by the index's order, gathered by document, and an expression over
    their places. A query without terms fits nothing. What NOT leaves out doesn't count.
    """
    tree = parse(query)
    if tree is None or not phrases(tree):
        return index.postings.limit(0).select(index.key, F.col("tf").cast("long").alias("hits"))
    rows, scored, _ = _hits(index, tree)
    return rows.where("_holds").select(index.key, reduce(lambda a, b: a + b, [F.col(f"_n{k}") for k in range(len(scored))]).alias("hits"))


def ranked(index: Index, query: str, top: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and ``score`` of the best documents that the query fits, by BM25 over its phrases; ties by key.

    A phrase counts like a term: how often it stands in the document, and in how many documents of all; only where what it
    is a part of holds, so an OR's other side may count or not. What joins the rows is one row of the corpus and one of counts.
    """
    tree = parse(query)
    if tree is None or not phrases(tree):
        return index.postings.limit(0).select(index.key, F.col("tf").cast("double").alias("score"))
    rows, scored, leaves = _hits(index, tree)
    rows = stored(rows)
    counts = rows.agg(*[F.count_if(F.col(f"_n{k}") > 0).alias(f"_df{k}") for k in range(len(scored))])
    known = rows.where("_holds").join(F.broadcast(index.corpus), how="cross").join(F.broadcast(counts), how="cross")
    score = F.lit(0.0)
    for c, k in enumerate(leaves):
        idf = F.log((F.col("docs") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5))
        tf = F.col(f"_c{c}")
        score = score + F.greatest(idf, F.lit(1e-6)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("mean_len")))
    out = known.select(index.key, score.alias("score"))
    return out if top is None else out.orderBy(F.desc("score"), index.key).limit(top)
