"""Suffix array of one shard by induced sorting, and its permuted common prefixes.

All steps work on whole numpy arrays; only the buckets of a symbol are visited in turn.
"""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that follows it; the last one counts as smaller."""
    step = np.sign(np.diff(text.astype(np.int32)))
    places = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    # Equal neighbours have the type of the next place where symbols differ.
    decided = np.minimum.accumulate(np.where(step != 0, places, len(text))[::-1])[::-1]
    smaller = np.ones(len(text), dtype=bool)
    inside = decided < len(text)
    smaller[:-1][inside] = step[decided[inside]] > 0
    smaller[:-1][~inside] = False
    return smaller


class _Buckets:
    """Positions handed to the bucket of their symbol, in the order of arrival."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.text, self.parts = text, [[] for _ in range(symbols)]

    def add(self, places: np.ndarray) -> None:
        if not len(places):
            return
        symbols = self.text[places]
        order = np.argsort(symbols, kind="stable")
        symbols, places = symbols[order], places[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for start, part in zip((0, *cuts), np.split(places, cuts)):
            self.parts[symbols[start]].append(part)

    def take(self, symbol: int) -> np.ndarray:
        parts = self.parts[symbol]
        return parts[0] if len(parts) == 1 else (
            np.concatenate(parts) if parts else np.empty(0, np.int32))


def induce(text: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in theirs.

    Forwards, every suffix puts the larger one that starts before it into its symbol's
    bucket; then backwards the smaller ones. What arrives in the bucket that is being
    read is read in a next round.
    """
    seeds = _Buckets(text, symbols)
    seeds.add(leftmost)
    larger, larger_done = _Buckets(text, symbols), []
    for symbol in range(symbols):
        queue, parts = larger.take(symbol), []
        while len(queue):
            parts.append(queue)
            before = queue[queue > 0] - 1
            at = text[before]
            larger.add(before[at > symbol])
            queue = before[at == symbol]
        larger_done.append(np.concatenate(parts) if parts else queue)
        source = seeds.take(symbol)
        source = source[source > 0] - 1
        larger.add(source)
    smaller, result = _Buckets(text, symbols), []
    smaller.parts[0].append(np.array([len(text) - 1], dtype=np.int32))
    for symbol in range(symbols - 1, -1, -1):
        queue, parts = smaller.take(symbol), []
        while len(queue):
            parts.append(queue)
            before = queue[queue > 0] - 1
            at = text[before]
            smaller.add(before[at < symbol])
            queue = before[at == symbol]
        source = larger_done[symbol][::-1]
        before = source[source > 0] - 1
        smaller.add(before[text[before] < symbol])
        result.append(np.concatenate([larger_done[symbol], *[p[::-1] for p in parts[::-1]]]))
    return np.concatenate(result[::-1])


def name_substrings(text: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names, growing in order, of the substrings from one start to the next; per start."""
    following = np.empty(len(text), dtype=np.int32)
    following[starts] = np.append(starts[1:], len(text) - 1)
    a, b = ordered[:-1], ordered[1:]
    length = following[a] - a
    same = length == following[b] - b
    open_, k = np.flatnonzero(same), 0
    while len(open_):
        equal = text[a[open_] + k] == text[b[open_] + k]
        same[open_[~equal]] = False
        open_ = open_[equal]
        open_ = open_[length[open_] > k]
        k += 1
    names = np.empty(len(text), dtype=np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return names[starts]


def sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names.

    Neighbouring names are joined to longer names, level by level, until all differ.
    """
    rank, width = names, 1
    order = np.argsort(rank, kind="stable")
    while rank.max(initial=0) + 1 < len(rank):
        behind = np.zeros(len(rank), dtype=np.int64)
        behind[:-width] = rank[width:] + 1
        pair = (rank << 32) | behind
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        rank = np.empty(len(rank), dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        width *= 2
    return order


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes of `text` in order.

    text: whole numbers below `symbols`; the last one is 0 and stands nowhere else.
    """
    if len(text) == 1:
        return np.zeros(1, dtype=np.int32)
    smaller = suffix_types(text)
    leftmost = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    is_leftmost = np.zeros(len(text), dtype=bool)
    is_leftmost[leftmost] = True
    rough = induce(text, leftmost, symbols)
    ordered = rough[is_leftmost[rough]]
    names = name_substrings(text, leftmost, ordered)
    return induce(text, leftmost[sort_names(names)], symbols)


def permuted_prefixes(text: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, common): per position, the suffix before it in order and their common prefix.

    Where the symbols in front of both are equal too, the common prefix is that of the
    position in front less one; only the other positions are compared, four symbols at a time, up
    to the 0 at the end, which stands nowhere else.
    """
    n = len(text)
    before = np.empty(n, dtype=np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    before[suffixes[0]] = -1
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = text
    words = np.zeros(n + 4, dtype=np.uint64)
    for k in range(4):  # four symbols of up to 16 bits
        words |= padded[k:k + len(words)] << np.uint64(16 * k)
    place = np.arange(n)
    known = before >= 0
    fresh = known.copy()
    chained = np.flatnonzero(known[1:] & (before[1:] > 0)) + 1
    fresh[chained] = text[chained - 1] != text[before[chained] - 1]
    at = np.flatnonzero(fresh)
    common = np.zeros(n, dtype=np.int64)
    open_, length = at, np.zeros(len(at), dtype=np.int64)
    index = np.arange(len(at))
    k = 0
    while len(open_):
        x = words[open_ + k] ^ words[before[open_] + k]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        length[index[differ]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) // 16)
        open_, index = open_[~differ], index[~differ]
        k += 4
    common[at] = length
    # Carry the value on, less one for every step.
    anchor = np.maximum.accumulate(np.where(fresh | ~known, place, 0))
    return before, np.where(known, np.maximum(common[anchor] - (place - anchor), 0), 0)
