"""Suffix arrays by induced sorting and permuted common prefixes, in NumPy, to a bounded depth.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller ones by naming their substrings and solving the string
of names recursively, and induces the larger and then the smaller suffixes from them bucket by bucket. Suffixes that
agree in the first ``depth`` symbols stay in an arbitrary order, which is all that matches of that length need: inducing
keeps an order that is right to a depth.
"""

from __future__ import annotations

import numpy as np


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the text ends below every symbol."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    rise = np.zeros(n, np.int8)
    rise[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    rise[-1] = -1
    at = np.where(rise != 0, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _names(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys."""
    order = np.argsort(keys)
    k = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
    return out


def _rank_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names to a depth, by doubling: the bottom of the recursion."""
    width, n = 1, len(names)
    rank = _names(names)
    while width < depth and rank.max(initial=0) < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        rank = _names(rank * (n + 1) + ahead)
        width *= 2
    return rank


def _sort_leftmost(text: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The leftmost-smaller positions in the order of their suffixes (to the depth).

    Their substrings reach to the next such position inclusive. They are named by their symbols, four at a time, and
    the names form a string whose suffixes are ranked recursively.
    """
    n, m = len(text), len(lms)
    lengths = np.diff(np.append(lms, n)) + 1  # the last one reaches to the end
    wide = np.concatenate((text.astype(np.int64) + 1, np.zeros(8, np.int64)))  # 0 is the end
    name = np.zeros(m, np.int64)
    for k in range(0, min(int(lengths.max(initial=0)), depth + 4), 4):
        live = np.flatnonzero(lengths > k)
        if not len(live):
            break
        key = np.zeros(m, np.int64)
        for j in range(4):
            inside = lengths[live] > k + j
            key[live] = key[live] * 512 + np.where(inside, wide[np.minimum(lms[live] + k + j, n + 7)], 511)
        # a substring that has ended is larger than its extensions: its last symbol starts a smaller suffix
        rest = np.setdiff1d(np.arange(m), live, assume_unique=True)
        key[rest] = (1 << 36) - 1
        name = _names(key) if k == 0 else _names(name * (m + 1) + _names(key))
    rank = _rank_names(name, depth)
    return lms[np.argsort(rank, kind="stable")]


def _deal(positions: np.ndarray, text: np.ndarray, wanted: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append the predecessors of wanted type to the buckets of their symbols, in order."""
    before = positions[positions > 0] - 1
    before = before[wanted[before]]
    if not len(before):
        return
    symbols = text[before]
    order = np.argsort(symbols, kind="stable")
    before, symbols = before[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for part in np.split(before, cuts):
        into[int(text[part[0]])].append(part)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes of a byte string in their order to ``depth`` symbols."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = smaller_types(text)
    larger = ~smaller
    lms = np.flatnonzero(smaller[1:] & larger[:-1]) + 1
    order = _sort_leftmost(text, lms, depth)
    buckets = 256
    of_symbol = np.searchsorted(text[order], np.arange(buckets + 1)) if len(order) else np.zeros(buckets + 1, np.int64)
    up: list[list[np.ndarray]] = [[] for _ in range(buckets)]
    _deal(np.array([n]), text, larger, up)  # the suffix behind the end comes first
    for c in range(buckets):
        k = 0
        while k < len(up[c]):  # grows while it is read: runs of one symbol
            _deal(up[c][k], text, larger, up)
            k += 1
        if of_symbol[c] < of_symbol[c + 1]:
            _deal(order[of_symbol[c] : of_symbol[c + 1]], text, larger, up)
    empty = np.zeros(0, np.int64)
    large = [np.concatenate(x) if x else empty for x in up]
    down: list[list[np.ndarray]] = [[] for _ in range(buckets)]  # from the right
    for c in range(buckets - 1, -1, -1):
        k = 0
        while k < len(down[c]):
            _deal(down[c][k], text, smaller, down)
            k += 1
        if len(large[c]):
            _deal(large[c][::-1], text, smaller, down)
    return np.concatenate([x for c in range(buckets) for x in (large[c], np.concatenate(down[c])[::-1] if down[c] else empty)])


def permuted_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each position in ``order`` (by position of the text; others 0) the length, up to ``depth``, of the prefix
    shared with the suffix before it in the order."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    words = np.ndarray((n + depth + 8,), dtype=">u8", buffer=padded, strides=(1,))
    at, before = order[1:], order[:-1]
    shared = np.full(len(at), depth)
    live = np.arange(len(at))
    for k in range(0, depth, 8):
        differ = words[at[live] + k] ^ words[before[live] + k]
        stop = np.flatnonzero(differ)
        lead = 7 - (np.floor(np.log2(differ[stop].astype(np.float64))).astype(np.int64) // 8)
        exact = differ[stop]
        lead = np.where(exact >> np.minimum(8 * (8 - lead), 63).astype(np.uint64) != 0, lead - 1, lead)  # log2 rounded up
        shared[live[stop]] = np.minimum(k + lead, depth)
        live = np.delete(live, stop)
    room = n - np.maximum(at, before)
    plcp = np.zeros(n, np.int64)
    plcp[at] = np.minimum(shared, room)
    return plcp
