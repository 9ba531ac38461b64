"""Name and text expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# What the game's control glyphs 0 to 31 stand for.
GLYPHS = "=?=??\u2022???? ???\u2022\u2022[]0123456789\u2022==="


def to_ascii(name: Column) -> Column:
    """A game name in plain characters: coloured ones (128 to 255) lose their colour, control glyphs get their meaning.

    Characters beyond 255 are no game characters and stay.
    """
    source = "".join(map(chr, [*range(32), *range(128, 256)]))
    target = "".join([*GLYPHS, *(GLYPHS[c] if c < 32 else chr(c) for c in range(128))])
    return F.trim(F.translate(name, source, target))


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def edge_trim(name: Column) -> Column:
    """Lower-cased, without what isn't a Latin letter or digit at either end."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "^[^a-zA-Z0-9]+", ""), "[^a-zA-Z0-9]+$", ""))


def leet_to_letters(name: Column) -> Column:
    return F.translate(name, "013457$", "oieasts")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def list_of(text: Column) -> Column:
    """A comma list's trimmed, lower-cased, non-empty parts."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Shared distinct bigrams, doubled, over all; 0 if there are none."""
    x, y = bigrams(a), bigrams(b)
    n = F.size(x) + F.size(y)
    return F.when(n > 0, 2.0 * F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Jaro-Winkler similarity with a prefix weight of 0.1 at any Jaro value; run it after blocking only."""
    for a, b in batches:
        yield pd.Series([_jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def shortened(parts: Column, n: int) -> Column:
    """The first n parts, and how many more there are."""
    more = F.size(parts) - n
    return F.concat(F.array_join(F.slice(parts, 1, n), " "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(F.lit("")))
