"""Running values along an episode, also where one episode is too long for one task.

An operator states its running sums, maxima and last values once, against a ``Scan``. Over episodes of
ordinary length a scan is windows that share one exchange. The rows of an episode with a position of
``SEGMENT`` or more are dealt by (keys, segment of positions) instead: values run within each segment,
one row for each segment carries the totals, and what the segments before have left is joined back.
So no task holds more than one segment's positions, and the results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.sources.scratch import materialize

#: Positions of a segment.
SEGMENT = 1 << 20
#: Long episodes up to which their keys are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 100_000


class Running(NamedTuple):
    """kind: sum, max or last (the last value that is not null)."""

    kind: str
    value: Column

    def over(self, window) -> Column:
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(window)
        return (F.sum if self.kind == "sum" else F.max)(self.value).over(window)

    def total(self, order: Column, backward: bool) -> Column:
        if self.kind == "last":
            return (F.min_by if backward else F.max_by)(self.value, F.when(self.value.isNotNull(), order))
        return (F.sum if self.kind == "sum" else F.max)(self.value)

    def joined(self, before: Column, own: Column) -> Column:
        if self.kind == "sum":
            return F.when(before.isNull(), own).otherwise(before + F.coalesce(own, before - before))
        return F.coalesce(own, before) if self.kind == "last" else F.greatest(before, own)


def last_row(*columns: str) -> Running:
    """The columns of the row before (exclusive forward scan) or behind (exclusive backward scan)."""
    return Running("last", F.struct(*columns))


class Scan:
    """Rows in the order of one column within their keys."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: str = "pos"):
        self.df, self.keys, self.order = df, list(keys), order

    def with_columns(self, new: dict[str, Column]) -> Scan:
        return self._of(self.df.withColumns(new))

    def running(self, values: dict[str, Running], inclusive: bool = True, backward: bool = False) -> Scan:
        """Adds ``values`` over all rows before (``backward``: behind) a row, with itself unless not
        ``inclusive``; null where there are none."""
        window = self._window(self.keys, backward, inclusive)
        return self._of(self.df.withColumns({n: v.over(window) for n, v in values.items()}))

    def _of(self, df: DataFrame) -> Scan:
        return type(self)(df, self.keys, self.order)

    def _window(self, keys: Sequence[str], backward: bool, inclusive: bool):
        by = F.col(self.order).desc_nulls_last() if backward else F.col(self.order).asc_nulls_first()
        return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


class SegmentedScan(Scan):
    """The same over segments and carried totals. What a step reads twice is written once."""

    def running(self, values: dict[str, Running], inclusive: bool = True, backward: bool = False) -> Scan:
        seg, order = "__segment", F.col(self.order)
        df = self.df.withColumn(seg, F.coalesce(F.floor(order / SEGMENT), F.lit(-1)).cast("long"))
        df = materialize(df, "segments")
        keys = [*self.keys, seg]
        totals = df.groupBy(*keys).agg(*[v.total(order, backward).alias(n) for n, v in values.items()])
        along = Window.partitionBy(*self.keys).orderBy(F.col(seg).desc() if backward else F.col(seg).asc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(*keys, *[Running(v.kind, F.col(n)).over(along).alias(f"__carried_{n}") for n, v in values.items()])
        window = self._window(keys, backward, inclusive)
        own = df.withColumns({n: v.over(window) for n, v in values.items()}).join(carried, keys, "left")
        done = own.withColumns({n: v.joined(F.col(f"__carried_{n}"), F.col(n)) for n, v in values.items()})
        return self._of(done.drop(seg, *[f"__carried_{n}" for n in values]))


def long_episodes(df: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame | None:
    """The keys with a position of ``SEGMENT`` or more, or None where there are none. Rows with a null
    key are no episode of their own right and never long."""
    known = [F.col(k).isNotNull() for k in keys]
    found = df.where(F.col(order) >= SEGMENT)
    for k in known:
        found = found.where(k)
    found = materialize(found.select(*keys).distinct(), "long-episodes")
    n = found.limit(BROADCAST_KEYS + 1).count()
    return None if n == 0 else F.broadcast(found) if n <= BROADCAST_KEYS else found


def scanned(df: DataFrame, keys: Sequence[str], steps: Callable[[Scan], Scan], order: str = "pos", long: DataFrame | None = None) -> DataFrame:
    """``df`` after ``steps``; the rows of the ``long`` episodes (see ``long_episodes``) by segments."""
    if long is None:
        return steps(Scan(df, keys, order)).df
    short = steps(Scan(df.join(long, list(keys), "left_anti"), keys, order)).df
    return short.unionByName(steps(SegmentedScan(df.join(long, list(keys), "left_semi"), keys, order)).df)
