"""Suffix array of one shard by induced sorting, and its permuted longest common prefixes.

Numpy and lists only: a helper that runs inside a task on one shard of a few megabytes.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of whole numbers from 0 on, in linear time: suffixes are classified, the leftmost-smaller ones
    sorted (by recursion on their names where names repeat), and all others induced from them in two passes."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    # the end counts as smaller than everything: one sentinel, 0, behind
    return np.array(_induced(np.append(text.astype(np.int64) + 1, 0)), np.int64)[1:]


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; in a run of equal symbols all are as the last."""
    n = len(s)
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    if n > 1:
        differs = np.flatnonzero(np.append(s[:-1] != s[1:], True))
        run = np.searchsorted(differs, np.arange(n))
        at = differs[run]
        inner = at < n - 1
        smaller[inner] = s[at[inner]] < s[at[inner] + 1]
    return smaller


def _induced(s: np.ndarray) -> list[int]:
    n = len(s)
    if n == 1:
        return [0]
    smaller = _types(s)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1  # the last one is the sentinel
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    symbols, small = s.tolist(), smaller.tolist()
    order = np.array(_pass(symbols, small, ends, counts, leftmost.tolist()), np.int64)
    at = order[1:][smaller[order[1:]] & ~smaller[order[1:] - 1]]
    at = np.append(n - 1, at[at != n - 1])
    # equal substrings between leftmost-smaller positions get equal names
    m = len(leftmost)
    index = np.full(n, -1, np.int64)
    index[leftmost] = np.arange(m)
    stops = np.append(leftmost[1:], n - 1)[index[at]]
    new = np.append(True, ~_equal(s, at[:-1], stops[:-1], at[1:], stops[1:]))
    if not new.all():
        names = np.zeros(m, np.int64)
        names[index[at]] = np.cumsum(new) - 1  # the sentinel's is 0, and no other
        at = leftmost[np.array(_induced(names), np.int64)]
    return _pass(symbols, small, ends, counts, at.tolist())


def _equal(s: np.ndarray, a: np.ndarray, a_stop: np.ndarray, b: np.ndarray, b_stop: np.ndarray) -> np.ndarray:
    """Whether s[a..a_stop] and s[b..b_stop], both ends included, are equal."""
    same = (a_stop - a) == (b_stop - b)
    left, step = np.flatnonzero(same), 0
    while len(left):
        left = left[a[left] + step <= a_stop[left]]
        bad = s[a[left] + step] != s[b[left] + step]
        same[left[bad]] = False
        left, step = left[~bad], step + 1
    return same


def _pass(s: list[int], small: list[bool], ends: np.ndarray, counts: np.ndarray, left: list[int]) -> list[int]:
    """All suffixes, induced from the leftmost-smaller ones in the order given."""
    order = [-1] * len(s)
    tails = ends.tolist()
    for i in reversed(left):
        c = s[i]
        tails[c] -= 1
        order[tails[c]] = i
    heads = (ends - counts).tolist()
    for i in order:  # the list grows ahead of the loop
        if i > 0:
            j = i - 1
            if not small[j]:
                c = s[j]
                order[heads[c]] = j
                heads[c] += 1
    tails = ends.tolist()
    for i in reversed(order):
        if i > 0:
            j = i - 1
            if small[j]:
                c = s[j]
                tails[c] -= 1
                order[tails[c]] = j
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For each position, what its suffix shares with the one before it in the order, exact up to ``most``.

    Where the symbols before both differ (and at ``starts``) the prefix is compared; everywhere else it is that of
    the position before, less one.  No two of ``starts`` and the end of the text are farther apart than ``most`` may hide.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    fixed = (before <= 0) | (at == 0)
    fixed[1:] |= text[at[1:] - 1] != text[np.maximum(before[1:], 1) - 1]
    fixed[starts] = True
    own = np.flatnonzero(fixed & (before >= 0))
    length = np.zeros(len(own), np.int64)
    a, b, left = own, before[own], np.arange(len(own))
    padded = np.append(text.astype(np.int64), -1)
    while len(left):
        same = (padded[np.minimum(a[left] + length[left], n)] == padded[np.minimum(b[left] + length[left], n)]) & (
            np.maximum(a[left], b[left]) + length[left] < n
        )
        length[left[same]] += 1
        left = left[same & (length[left] < most)]
    reach = np.full(n, -1, np.int64)
    reach[own] = length + own
    reach[before < 0] = np.flatnonzero(before < 0)
    return np.maximum(np.maximum.accumulate(reach) - at, 0)
