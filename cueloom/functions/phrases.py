"""Replacing many phrases in one pass over a text."""

from __future__ import annotations

import re
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import ahocorasick


def fold(text: str) -> str:
    """``text`` with one character for each of its own, equal for letters that differ in case only."""
    return "".join([_folded(c) for c in text]) if not text.isascii() else text.lower()


def _folded(c: str) -> str:
    upper = c.upper()
    low = (upper if len(upper) == 1 else c).lower()
    return low if len(low) == 1 else c


class Phrases:
    """Phrases (key, value) in the order in which they are to be replaced: longer keys first, equally
    long ones by code point; of equal keys the smallest value comes first.

    One automaton over all keys tells which of them a text holds at all. They are replaced in their
    order, each wherever it stands as whole words, in any case, in what the ones before left; only
    where something was replaced is the text searched again, for later keys that it holds now.
    """

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.pairs = sorted(pairs, key=lambda p: (-len(p[0]), p[0], p[1]))
        places: dict[str, list[int]] = {}
        for k, (key, _) in enumerate(self.pairs):
            if key:
                places.setdefault(fold(key), []).append(k)
        self.automaton = ahocorasick.Automaton()
        for key, at in places.items():
            self.automaton.add_word(key, at)
        if places:
            self.automaton.make_automaton()
        self.known = bool(places)
        self.patterns: dict[int, re.Pattern[str]] = {}

    def found(self, text: str, after: int = -1) -> list[int]:
        """Places in the order of the keys behind ``after`` that the text holds, as a heap."""
        out = list({k for _, at in self.automaton.iter(fold(text)) for k in at if k > after}) if self.known else []
        heapify(out)
        return out

    def replace(self, text: str | None) -> tuple[str, int]:
        """The text and the number of replacements; null is empty."""
        text, n = text or "", 0
        open_ = self.found(text)
        while open_:
            k = heappop(open_)
            key, value = self.pairs[k]
            if k not in self.patterns:
                self.patterns[k] = re.compile(rf"\b{re.escape(key)}\b", re.IGNORECASE)
            text, times = self.patterns[k].subn(lambda _, v=value: v, text)
            n += times
            if times:
                known = set(open_)
                for j in self.found(text, k):
                    if j not in known:
                        heappush(open_, j)
        return text, n
