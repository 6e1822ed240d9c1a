"""Batches of whole texts as NumPy arrays of words, n-grams and 64-bit hashes.

Texts stay UTF-8 bytes in the buffer Arrow delivered them in. A substring's hash is a
difference of prefix sums of a polynomial modulo 2^64, so hashing every word of a
batch takes a few array operations whatever the words' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


#: What a byte adds to a polynomial.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    known = _powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        known = _powers[name] = np.cumprod(steps)
    return known[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse."""
    return _power("up", _BASE, n), _power("down", _INVERSE, n)


@dataclass
class Slice:
    """Consecutive rows of a batch: their bytes, and where each text starts and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a string column, null as empty, in slices of at most ``limit`` bytes
    or one text."""
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, where, content = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        low, high = offsets[first], offsets[last]
        yield Slice(first, data[low:high], offsets[first : last + 1] - low)
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, everything else as it is."""
    return _LOWER[data]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes, which end with their text."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and each text's range of the words ``[^\\x20\\x09-\\x0D]+``."""
    starts, ends = runs(~_SEPARATOR[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def substring_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every substring; starts ascend.

    Long inputs are worked on in blocks of substrings, so memory is bounded by
    ``SLICE_BYTES`` and the longest substring.
    """
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = int(np.searchsorted(ends, low + 2 * SLICE_BYTES, "right"))
        last = min(max(last, first + 1), len(starts))
        high = int(ends[first:last].max())
        prefix = np.zeros(high - low + 1, np.uint64)
        up, down = powers(high - low + 1)
        np.cumsum(BYTE_VALUES[data[low:high]] * up[:-1], out=prefix[1:])
        begin, end = starts[first:last] - low, ends[first:last] - low
        hashes = (prefix[end] - prefix[begin]) * down[begin]
        out[first:last] = mix(hashes + (end - begin).astype(np.uint64))
        first = last
    return out


def ngrams(
    hashes: np.ndarray, ranges: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of ``n`` words within one text."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = owners(ranges)[:count]
    first = np.flatnonzero(np.arange(n, count + n) <= ranges[text + 1])
    out = np.zeros(len(first), np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[first + k]
    return mix(out), text[first], first


def owners(ranges: np.ndarray) -> np.ndarray:
    """For every item, the text whose range holds it."""
    return np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))


def distinct(text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, value) pairs in order, and how often each occurs."""
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    where = np.flatnonzero(new)
    return text[where], values[where], np.diff(np.append(where, len(text)))


def totals(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """The sum of each range of values; 0 for an empty one."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values, np.int64))
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[ranges[1:]] - sums[ranges[:-1]]
