"""Words of UTF-8 text as 64-bit numbers, computed in numpy for a whole Arrow batch at a time.

A word is a maximal run of bytes of a given set. Its number is a sum of mixed (place, byte) values,
mixed again, so equal words have equal numbers and two different words share one with a chance of
about 2**-64. Nothing is cut: a text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of each number over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _lowered() -> np.ndarray:
    table = np.arange(256)
    table[65:91] += 32
    return table


_LOWER = _lowered()
_BYTE = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * _STEP)
#: Everything but ASCII white space.
SOLID = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
#: ASCII letters and all bytes of other characters.
LETTERS = np.array([65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])


@dataclass
class Words:
    """``first[i]:first[i + 1]`` are the words of text ``i``, ``starts`` and ``lengths`` their bytes; ``prefixes`` the
    numbers of the words' first bytes, by their count."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    prefixes: dict[int, np.ndarray]


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, bounds) of groups of texts of about ``size`` bytes; NULL is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if bounds[-1] else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + size, "right")) - 1)
        yield start, end, data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start]
        start = end


def words(data: np.ndarray, bounds: np.ndarray, members: np.ndarray = SOLID, prefixes: tuple[int, ...] = ()) -> Words:
    """The words of the texts that lie one after another in ``data``, A-Z as a-z."""
    inside = members[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    begins[edges] = inside[edges]
    return runs(data, bounds, inside, begins, prefixes)


def runs(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, begins: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """The runs of bytes ``inside`` that start where ``begins`` says, numbered as words."""
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, bounds)
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return Words(none, first, starts, np.zeros(0, np.int64), {k: none for k in prefixes})
    data, inside, offset = data[starts[0] :], inside[starts[0] :], starts - starts[0]
    place = np.arange(len(data)) - np.repeat(offset, np.diff(offset, append=len(data)))
    value = _BYTE[data] + place.astype(np.uint64) * _STEP
    value ^= value >> np.uint64(32)
    value *= _M1
    value ^= value >> np.uint64(29)
    value[~inside] = 0
    sums = np.add.reduceat(value, offset)
    lengths = np.add.reduceat(inside.astype(np.int64), offset)
    heads = {}
    for k in sorted(prefixes, reverse=True):
        value[place >= k] = 0
        heads[k] = mix(np.add.reduceat(value, offset) + np.uint64(k))
    return Words(mix(sums), first, starts, lengths, heads)


def shingles(found: Words, text: int, width: int = 3) -> np.ndarray:
    """The distinct shingles of ``width`` words of one text, sorted; all its words as one shingle if
    it has fewer."""
    hashes = found.hashes[found.first[text] : found.first[text + 1]]
    if not len(hashes):
        return hashes
    width_here = min(width, len(hashes))
    total = np.zeros(len(hashes) - width_here + 1, np.uint64)
    for k in range(width_here):
        total = mix(total + hashes[k : len(hashes) - width_here + 1 + k] * np.uint64(2 * k + 3))
    if width_here < width:
        total = mix(total + np.uint64(width_here))
    return np.unique(total)
