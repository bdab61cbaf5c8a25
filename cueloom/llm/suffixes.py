"""Suffix sorting on numpy arrays, shared by the operators that build suffix arrays in tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: key(starts, level): the level-th fixed-size piece of each suffix, as numbers that sort alike.
Key = Callable[[np.ndarray, int], np.ndarray]


def sort_suffixes(starts: np.ndarray, key: Key, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` ordered by their pieces, and which of them equal the one before in all levels.

    Later pieces are read only for suffixes that earlier ones leave tied; full ties keep the
    order of ``starts``.
    """
    if not len(starts):
        return starts, np.zeros(0, bool)
    piece = key(starts, 0)
    order = np.argsort(piece, kind="stable")
    starts, piece = starts[order], piece[order]
    tied = np.zeros(len(starts), bool)
    tied[1:] = piece[1:] == piece[:-1]
    for level in range(1, levels):
        among = tied.copy()
        among[:-1] |= tied[1:]
        at = np.flatnonzero(among)
        if not len(at):
            break
        group = np.cumsum(~tied)[at]
        piece = key(starts[at], level)
        order = np.lexsort((piece, group))
        starts[at], piece = starts[at][order], piece[order]
        tied[at[1:]] = (piece[1:] == piece[:-1]) & (group[1:] == group[:-1])
        tied[at[0]] = False
    return starts, tied


def search(order: np.ndarray, key: Key, n: int, levels: int, wanted: Key, upper: bool) -> np.ndarray:
    """For each of ``n`` wanted keys (wanted(rows, level): pieces of some of them), the number of
    suffixes of ``order`` that are smaller than it (upper: not larger), by binary search. Later
    pieces are read only where earlier ones are equal."""
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        right = np.full(len(open_), upper)
        undecided = np.arange(len(open_))
        for level in range(levels):
            have, need = key(order[mid[undecided]], level), wanted(open_[undecided], level)
            right[undecided[have < need]] = True
            right[undecided[have > need]] = False
            undecided = undecided[have == need]
            if not len(undecided):
                break
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
