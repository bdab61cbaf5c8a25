"""Periodic runs of words: maximal stretches that repeat one sequence of words again and again.

A run's period has a Lyndon root: under one of the two opposite orders of the words, each of its
occurrences is the longest Lyndon word that begins there. Both Lyndon arrays come from the first
phase of a suffix sorter that works by groups: suffixes begin in one group per word, groups are taken
from the highest down, and what stands in front of a stretch of members is moved into a new group
just above its own, with its prefix extended by the stretch. When a group is taken, the prefixes of
its members are their longest Lyndon words. A root that is followed by itself is then extended to
both sides as far as words one period apart agree (longest common extensions), which gives the run.

Texts are first cut at words that no run can hold: in a run of length L every word stands again at a
distance of at most L / LEAST_EXPONENT, so a word whose nearest copy is farther away than that share of
the stretch between two cuts is a cut too. The two Lyndon arrays are built of what is left, and nothing
else of a text can be part of a run. Every document is worked on by itself, where it is read; nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import quoted

#: Least words of a run, and how often its period has to fit into it.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
RUN = "array<struct<start:long,length:long,period:long>>"


@dataclass(frozen=True)
class Run:
    """``length`` words from word ``start`` on, of which those ``period`` apart are equal."""

    start: int
    length: int
    period: int


def lyndon_array(ids: list[int]) -> list[int]:
    """Of every position the length of the longest Lyndon word that begins there, by the grouping
    phase. The end of ``ids`` is smaller than any number."""
    n = len(ids)
    letters = sorted(set(ids))
    group = {x: k for k, x in enumerate(letters)}
    own = [group[x] for x in ids]  # the group of each position
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(own):
        members[g].append(i)
    below = [k - 1 for k in range(len(letters))]  # the next lower group; -1: none
    above = [k + 1 for k in range(len(letters))]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours that are not taken yet
    lengths = [0] * n
    g = len(letters) - 1
    while g >= 0:
        moved: dict[int, list[int]] = {}  # how many members follow -> what stands in front of them
        for head in members[g]:
            if own[head] != g or (before[head] >= 0 and own[before[head]] == g):
                continue
            lead, at, count = before[head], head, 0
            while at < n and own[at] == g:
                lengths[at] = after[at] - at
                at = after[at]
                count += 1
            if at < n:
                before[at] = lead
            if lead >= 0:
                after[lead] = at
                moved.setdefault(count, []).append(lead)
        members[g] = []
        # The more members follow, the higher the group; later ones come between it and the old one.
        for count in sorted(moved, reverse=True):
            new: dict[int, int] = {}
            for lead in moved[count]:
                old = own[lead]
                if old not in new:
                    new[old] = len(members)
                    members.append([])
                    below.append(old)
                    above.append(above[old])
                    below[above[old]] = above[old] = new[old]
                own[lead] = new[old]
                members[new[old]].append(lead)
        g = below[g]
    return lengths


def _agreed(a: np.ndarray, i: int, j: int) -> int:
    """How many numbers from place i on equal those from place j on (i < j)."""
    done, step = 0, 32
    while j + done < len(a):
        x, y = a[j + done : j + done + step], a[i + done : i + done + step]
        differ = x != y[: len(x)]
        if differ.any():
            return done + int(differ.argmax())
        done += len(x)
        step *= 2
    return done


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches that are left when words which no run can hold are cut out."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    gap = np.where(ids[order[1:]] == ids[order[:-1]], np.diff(order), n)
    nearest = np.full(n, n)
    nearest[order[1:]] = gap
    nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gap)
    kept = nearest < n
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        size = np.zeros(n, np.int64)
        size[kept] = np.repeat(end - start, end - start)
        now = kept & (size >= LEAST_WORDS) & (nearest * LEAST_EXPONENT <= size)
        if now.sum() == kept.sum():
            return list(zip(start.tolist(), end.tolist(), strict=True))
        kept = now


def runs_of(ids: np.ndarray) -> list[Run]:
    """All runs of a row of numbers, by start and period."""
    found: set[tuple[int, int, int]] = set()
    for lo, hi in stretches(ids):
        part = ids[lo:hi]
        for lengths in (lyndon_array(part.tolist()), lyndon_array((-part).tolist())):
            q = np.array(lengths)
            at = np.flatnonzero(np.arange(len(q)) + 2 * q <= len(q))
            reach: dict[int, int] = {}  # of each period, the end of the last run with it
            for i in at[q[at + q[at]] == q[at]].tolist():
                p = lengths[i]
                if i + 2 * p <= reach.get(p, 0):
                    continue
                ahead = _agreed(part, i, i + p)
                if ahead < p:
                    continue
                back = _agreed(part[::-1], len(part) - i - p, len(part) - i)
                reach[p] = i + p + ahead
                if p + ahead + back >= max(LEAST_WORDS, LEAST_EXPONENT * p):
                    found.add((lo + i - back, p, p + ahead + back))
    return [Run(start, length, p) for start, p, length in sorted(found)]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            words = (text.as_py() or b"").split()
            seen: dict[bytes, int] = {}
            runs = runs_of(np.array([seen.setdefault(w, len(seen)) for w in words], np.int64))
            gone = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                gone[r.start + r.period] += 1
                gone[r.start + r.length] -= 1
            left = np.cumsum(gone[:-1]) == 0
            rows.append((len(words), [vars(r) for r in runs], b" ".join([w for w, k in zip(words, left.tolist(), strict=True) if k] if runs else words).decode()))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        kinds = (pa.int64(), pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row. Words stand between ASCII spaces.

    runs holds every run of LEAST_WORDS words or more whose least period fits LEAST_EXPONENT times or
    more into it, by start and period, words counted from 0. collapsed is the text's words, one space
    between them, without those that some run contains after its first period. Null and empty texts
    have no words and no runs; repeated rows are judged alike, and other columns are left out.
    """
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("binary").alias("body"))
    return rows.mapInArrow(_search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUN}, collapsed string")
