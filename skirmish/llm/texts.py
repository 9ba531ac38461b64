"""Words of a whole Arrow column of texts at a time, as places and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step handles; a longer text is one step.
CHUNK = 1 << 20

_SPACE = np.zeros(256, np.bool_)
_SPACE[[32, *range(9, 14)]] = True
#: A number for each byte; A-Z have those of a-z.
_VALUES = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(8).integers(0, 2, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]
#: The same twice more, with A-Z apart.
_EXACT = [np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (9, 10)]
_BASE = 0xD6E8FEB86659FD93


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0, 1, ... n - 1, modulo 2^64."""
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


@lru_cache(maxsize=2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, n), powers(pow(_BASE, -1, 2**64), n)


def runs(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of some chunk bytes together, as a slice, their UTF-8 one after the other, and where each text ends. A null
    text is empty."""
    whole = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, 8 * whole.offset) if len(whole) else np.zeros(1, np.int64)
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(whole):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def word_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a run of texts begin and end, in bytes, and how many each text has. Words are what stands
    between ASCII white space."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, np.bool_)
    edge[0] = True
    edge[ends] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return starts, stops, np.diff(np.searchsorted(starts, ends), prepend=0)


def word_prints(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word as it is."""
    return tuple(word_hashes(data, starts, stops, values) for values in _EXACT)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: a polynomial of its bytes' numbers, from running sums."""
    grow, shrink = _tables(1 << max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * grow[: len(data)], out=sums[1:])
    h = (sums[stops] - sums[starts]) * shrink[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def hashed_words(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows with the hashes of their words and how many each row has."""
    for own, data, ends in runs(column):
        starts, stops, count = word_places(data, ends)
        yield own, word_hashes(data, starts, stops), count
