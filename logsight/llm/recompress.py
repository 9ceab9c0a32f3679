"""Recompression of word sequences, vectorised over many documents.

Rounds shorten the sequence of symbols: a run round names each run of one
symbol, a pair round names each (left, right) pair, where a bit of a symbol's
name makes it left or right. A name is a 64-bit hash of what it stands for, so
the same run or pair gets the same name in every task of the cluster and no
dictionary has to be exchanged: a round needs no shuffle, and the rounds of a
document follow each other in one task. Only symbols of at most `limit` words
take part in a round.

Whether a border between two words survives a round depends on the two symbols
beside it, hence on at most `limit` more words to either side. After all rounds
a border is decided by `reach` words on either side: equal texts have equal
borders, and equal symbols between them, but for `reach` words at their ends.
Symbols other than long runs have at most `longest` words, so every stretch of
`longest` words inside holds a border or lies in one long run. A place is taken
as a border too if the words before it, `reach` or `longest` if that is less,
are all equal. That is decided by `reach` words as well, and leaves no stretch
in a run without a border.

A passage is named by its symbols alone. At each level the borders that lie
`reach` of that level or more inside are sure; the symbols between the first
sure border of one level and that of the next are popped, on the right
likewise, and the symbols between the sure borders of the highest level that
has any are the core. Equal passages pop the same symbols and have the same
core, wherever they stand, and the popped symbols and the core spell the whole
passage, so equal names mean equal passages as far as no two symbols share a
name. Over a large corpus some do; whoever decides by names takes those of a
second recompression, of independent word values, beside them.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from logsight.llm.words import mix

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@functools.cache
def rounds_for(window: int) -> tuple[tuple[tuple[str, int], ...], int, int]:
    """(rounds, reach, longest) with 2 * reach + longest <= window."""
    rounds: list[tuple[str, int]] = []
    reach, longest = 0, 1
    for kind, limit in [("run", 1), ("pair", 1), ("pair", 1), ("pair", 2), ("pair", 3), ("pair", 4), ("pair", 4), *(("pair", k) for k in range(6, 400))]:
        after = max(longest, 2 * limit)
        if 2 * (reach + limit) + after > window:
            break
        rounds.append((kind, limit))
        reach, longest = reach + limit, after
    return tuple(rounds), reach, window - 2 * reach


@dataclass
class Symbols:
    """The symbols after each round, from the words on: where they start (with the end of all), and their names."""

    n: int
    starts: list[np.ndarray]
    names: list[np.ndarray]
    reaches: list[int]

    @functools.cached_property
    def before(self) -> list[np.ndarray]:
        """For each level and position, the number of borders before it."""
        out = []
        for starts in self.starts:
            flags = np.zeros(self.n + 2, np.int32)
            flags[starts + 1] = 1
            out.append(np.cumsum(flags, dtype=np.int32))
        return out

    @functools.lru_cache(2)  # noqa: B019 - a value lives as long as its batch
    def sums(self, second: bool) -> list[np.ndarray]:
        base = _B2 if second else _B1
        out = []
        for names in self.names:
            up, _ = _powers(base, 1 << max(10, int(self.n + 1).bit_length()))
            own = mix(names ^ np.uint64(0xA0761D6478BD642F)) if second else names
            out.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)])]))
        return out

    def __hash__(self) -> int:
        return id(self)


def symbols(values: np.ndarray, docs: np.ndarray, window: int) -> Symbols:
    """All rounds over a concatenation of documents; docs: the document's number of each word."""
    n = len(values)
    start, name, reach = np.arange(n), values.copy(), 0
    out = Symbols(n, [np.append(start, n)], [name], [0])
    for number, (kind, limit) in enumerate(rounds_for(window)[0]):
        size = np.diff(np.append(start, n))
        ready = size <= limit
        both = ready[:-1] & ready[1:] & (docs[start[:-1]] == docs[start[1:]])
        if kind == "run":
            glued = both & (name[:-1] == name[1:])
            keep = np.append(np.ones(min(1, n), bool), ~glued)
            count = np.diff(np.append(np.flatnonzero(keep), len(start)))
            name = np.where(count > 1, mix(name[keep] + count.astype(np.uint64) * np.uint64(_B1)), name[keep])
        else:
            side = (mix(name + np.uint64(number + 1)) & np.uint64(1)).astype(bool)
            glued = both & ~side[:-1] & side[1:]
            first = np.flatnonzero(glued)
            name = name.copy()
            name[first] = mix(name[first] * np.uint64(_B1) + name[first + 1])
            keep = np.append(np.ones(min(1, n), bool), ~glued)
            name = name[keep]
        start = start[keep]
        reach += limit
        out.starts.append(np.append(start, n))
        out.names.append(name)
        out.reaches.append(reach)
    return out


def borders(found: Symbols, values: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Positions of the borders after all rounds that have `reach` words of their document on both sides."""
    _, reach, longest = rounds_for(window)
    n = len(values)
    at_border = np.zeros(n, bool)
    at_border[found.starts[-1][:-1]] = True
    if reach and n:
        # places in a run, by the words before them alone
        back = min(reach, longest)
        fresh = np.append(True, (values[1:] != values[:-1]) | (docs[1:] != docs[:-1]))
        began = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        at_border[1:] |= np.arange(1, n) - began[:-1] >= back
    # a border needs `reach` words of the same document on either side
    inside = np.zeros(n, bool)
    if n >= 2 * reach and reach:
        at = np.arange(reach, n - reach + 1)
        same = docs[at - reach] == docs[at + reach - 1]
        inside[at[same & (at < n)]] = True
    elif not reach:
        inside[:] = True
    return np.flatnonzero(at_border & inside)


@functools.cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.full(size, base, np.uint64)
    back = np.full(size, pow(base, -1, 2**64), np.uint64)
    step[0] = back[0] = 1
    return np.cumprod(step), np.cumprod(back)


def passage_names(found: Symbols, starts: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """64-bit names of the passages of `width` words at the given starts, from their symbols; two independent ones by `second`."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), 1 << 16):  # bounds the working memory
        out[i : i + (1 << 16)] = _passage_names(found, starts[i : i + (1 << 16)], width, second)
    return out


def _passage_names(found: Symbols, starts: np.ndarray, width: int, second: bool) -> np.ndarray:
    base = np.uint64(_B2 if second else _B1)
    _, down = _powers(int(base), 1 << max(10, int(found.n + 1).bit_length()))
    sums = found.sums(second)

    def span(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A name for the symbols from number a to b of a level."""
        return mix((sums[level][b] - sums[level][a]) * down[a] + (b - a).astype(np.uint64))

    ends = starts + width
    name = np.zeros(len(starts), np.uint64)
    active = np.arange(len(starts))
    a, b = found.before[0][starts], found.before[0][ends]  # numbers of the first and the last sure border
    for level in range(1, len(found.starts)):
        reach, own, lower = found.reaches[level], found.starts[level], found.before[level - 1]
        left = found.before[level][np.minimum(starts[active] + reach, found.n)]
        right = found.before[level][np.maximum(ends[active] - reach, 0) + 1] - 1
        on = (left <= right) & (2 * reach <= width)
        # no sure border: what is left on the level below is the core
        name[active[~on]] = mix(name[active[~on]] * base + span(level - 1, a[~on], b[~on]))
        active, a, b, left, right = active[on], a[on], b[on], left[on], right[on]
        low, high = lower[own[left]], lower[own[right]]
        name[active] = mix(mix(name[active] * base + span(level - 1, a, low)) * base + span(level - 1, high, b))
        a, b = left, right
    name[active] = mix(name[active] * base + span(len(found.starts) - 1, a, b))
    return name


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for every i (shorter at the end), by doubling."""
    out, span = x, 1
    while span < width:
        step = min(span, width - span)
        out = np.append(best(out[:-step], out[step:]), out[-step:]) if len(out) > step else out
        span += step
    return out


def window_anchors(found: Symbols, values: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """For each position the anchor key of the window that starts there; equal windows have equal keys.

    The key is the least of the keys of the borders in the window's middle, a
    border's key being the name of the symbols within `reach` words on either
    side. All of that lies in the window, so it depends on the window alone.
    Positions whose window leaves its document hold a value to be ignored.
    """
    _, reach, longest = rounds_for(window)
    at = borders(found, values, docs, window)
    keys = np.full(len(values), np.iinfo(np.uint64).max)
    keys[at] = passage_names(found, at - reach, 2 * reach) if reach else values[at]
    least = _slide(keys, longest, np.minimum)
    return np.append(least[reach:], np.full(min(reach, len(least)), np.iinfo(np.uint64).max))
