"""Vectorised words and shingles for use inside Spark tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its value is a
64-bit polynomial of its bytes with seeded random coefficients, finally mixed.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Coefficients of values that are independent of the others.
_OTHER = np.random.Generator(np.random.PCG64(77_20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(4095, _BASE, np.uint64)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in data (uint8)."""
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    return edge[::2], edge[1::2]


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False, other: bool = False) -> np.ndarray:
    """One 64-bit value a word; equal words have equal values. other: values that are independent of these."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = _OTHER if other else _FOLDED if fold_case else _BYTE
    lengths = ends - starts
    first = np.repeat(starts, lengths)
    at = np.arange(len(first)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = _POWERS[at & 4095]
    far = at >> 12
    if far.any():
        step = np.uint64(pow(_BASE, 4096, 2**64))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(far.max()), step, np.uint64)]))
        power = power * powers[far]
    terms = table[data[first + at]] * power
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(_BASE if other else 1))


def values_of(text: str | None, fold_case: bool = False, other: bool = False) -> np.ndarray:
    """The word values of one text; empty for null."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_spans(data)
    out = []
    for i in range(0, len(starts), 200_000):  # bounds the working memory of a very long text
        out.append(word_values(data, starts[i : i + 200_000], ends[i : i + 200_000], fold_case, other))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def many_values(texts: list[str | None], fold_case: bool = False, chunk: int = 1 << 21, other: bool = False):
    """Yield (index of the text, its word values), computed for many short texts at once."""
    i = 0
    while i < len(texts):
        parts, size, j = [], 0, i
        while j < len(texts) and (size == 0 or size < chunk):
            parts.append((texts[j] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            j += 1
        if j == i + 1:
            yield i, values_of(texts[i], fold_case, other)
        else:
            data = np.frombuffer(b" ".join(parts), np.uint8)
            starts, ends = word_spans(data)
            values = word_values(data, starts, ends, fold_case, other)
            edges = np.cumsum([len(p) + 1 for p in parts])
            cuts = np.searchsorted(starts, edges)
            last = 0
            for k, cut in enumerate(cuts):
                yield i + k, values[last:cut]
                last = cut
        i = j


def shingles_in_order(values: np.ndarray, width: int) -> np.ndarray:
    """The value of each run of `width` words, or of the whole of a shorter text."""
    n = len(values)
    if n == 0:
        return values
    size = min(n, width)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[k : n - size + 1 + k])
    return out


def shingles(values: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle values."""
    return np.unique(shingles_in_order(values, width))
