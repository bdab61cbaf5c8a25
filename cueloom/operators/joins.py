"""Interval and nearest-neighbour joins without nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("show", "episode")


#: Levels of the interval hierarchy: a cell of level k is 16 ** k units long. Spans shorter than a cell
#: of the lowest level count as that long, and so do longer ones than of the highest.
LOWEST, HIGHEST = -8, 15
#: Nearest onsets are looked for in stretches of time of so many radii.
RADII = 256


def _level(lo: Column, hi: Column) -> Column:
    """The lowest level whose cells are as long as the span."""
    steps = F.ceil(F.log(F.greatest((hi - lo).cast("double"), F.lit(16.0**LOWEST))) / F.log(F.lit(16.0)))
    return F.least(F.greatest(steps, F.lit(LOWEST)), F.lit(HIGHEST)).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(16.0), level)).cast("long")


def _in_cells(df: DataFrame, lo: Column, hi: Column, others: Column, side: str) -> DataFrame:
    """A row for each cell in which a span may meet spans of the other side, whose levels are
    ``others``: cells of its own level where the other side has shorter or equal spans, and those of
    every longer level there is. A span lies in two cells of a level, or one."""
    level, others_ = _level(lo, hi), F.col("__others")
    levels = F.filter(others_, lambda x: x > level)
    levels = F.when(F.exists(others_, lambda x: x <= level), F.concat(F.array(level), levels)).otherwise(levels)
    out = df.withColumn("__others", others).withColumn("__level", F.explode(levels)).drop("__others").withColumn(f"__{side}_own", level).withColumn(f"__{side}_first", _cell(lo, F.col("__level")))
    return out.withColumn("__cell", F.explode(F.sequence(f"__{side}_first", F.greatest(_cell(hi, F.col("__level")), F.col(f"__{side}_first")))))


def _levels(df: DataFrame, lo: Column, hi: Column) -> Column:
    return df.select(_level(lo, hi).alias("x")).agg(F.sort_array(F.collect_set("x"))).scalar()


def in_cells(left: DataFrame, left_span: tuple[str, str], right: DataFrame, right_span: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Both sides' spans with a row for each cell in which they may meet, __level and __cell. A pair is to be taken in
    one of them only (``meet_in``)."""
    (l0, l1), (r0, r1) = [[F.col(c) for c in span] for span in (left_span, right_span)]
    return _in_cells(left, l0, l1, _levels(right, r0, r1), "l"), _in_cells(right, r0, r1, _levels(left, l0, l1), "r")


def meet_in(level: Column, cell: Column, left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """Two spans share more than a point, and this is the cell in which the pair counts."""
    (l0, l1), (r0, r1) = left, right
    return (l1 > r0) & (l0 < r1) & (level == F.greatest(_level(l0, l1), _level(r0, r1))) & (cell == F.greatest(_cell(l0, level), _cell(r0, level)))


def range_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: Sequence[str] = KEYS, how: str = "inner", slack: float = 0) -> DataFrame:
    """Rows with equal keys whose spans, the right one wider by ``slack`` at both ends, share more
    than a point. ``how``: inner, left, semi or anti. Columns other than the keys must differ.

    Spans live in a hierarchy of time cells: each on the level whose cells are as long as it is, so in
    one or two of them. A pair meets on the level of its longer span, in the first cell that both
    have, by an equality join on (keys, level, cell). Only levels that the other side has make rows,
    so a span of any length makes two rows a level at most. A semi or anti join makes no pairs: in
    each cell, rows are swept in order of time with the farthest end so far.

    Null keys or ends join nothing; a left or anti join keeps such left rows. Equal left rows each
    count by themselves.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(how)
    (l0, l1), (r0, r1) = left_span, right_span
    lo, hi = F.col(r0) - slack, F.col(r1) + slack
    if how == "left":
        met = range_join(left, right, left_span, right_span, keys, "inner", slack)
        alone = range_join(left, right, left_span, right_span, keys, "anti", slack)
        return met.unionByName(alone, allowMissingColumns=True)
    r = right.where(lo < hi)
    li = left.where(F.col(l0) < F.col(l1))
    l_levels, r_levels = _levels(li, F.col(l0), F.col(l1)), _levels(r, lo, hi)
    on = [*keys, "__level", "__cell"]
    if how == "inner":
        a = _in_cells(li, F.col(l0), F.col(l1), r_levels, "l")
        b = _in_cells(r, lo, hi, l_levels, "r")
        met = a.join(b, on).where((F.col("__level") == F.greatest("__l_own", "__r_own")) & (F.col("__cell") == F.greatest("__l_first", "__r_first")))
        return met.where(F.least(F.col(l1), hi) > F.greatest(F.col(l0), lo)).select(*left.columns, *[c for c in right.columns if c not in keys])
    # Copies of a row are told apart by how often the row stands: they match alike. A semi join counts them as it goes.
    rows = left if how == "semi" else left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("__copies"))
    whole = F.struct(*left.columns)
    a = _in_cells(rows.where(F.col(l0) < F.col(l1)), F.col(l0), F.col(l1), r_levels, "l").select(*on, F.col(l1).cast("double").alias("__t"), F.col(l0).cast("double").alias("__from"), F.lit(None).cast("double").alias("__to"), whole.alias("__row"))
    b = _in_cells(r, lo, hi, l_levels, "r").select(*on, lo.cast("double").alias("__t"), F.lit(None).cast("double").alias("__from"), hi.cast("double").alias("__to"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    # A left end comes before a right start of the same time: spans that touch share a point only.
    sweep = Window.partitionBy(*on).orderBy("__t", F.col("__row").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    swept = a.unionByName(b).withColumn("__reach", F.max("__to").over(sweep))
    if how == "semi":
        in_each = F.count(F.lit(1)) / F.size(F.collect_set(F.struct("__level", "__cell")))
        hit = swept.where("__row is not null").groupBy("__row").agg(F.max(F.coalesce(F.col("__reach") > F.col("__from"), F.lit(False))).alias("__hit"), in_each.cast("int").alias("__copies"))
        return hit.where("__hit").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
    hit = swept.where("__row is not null and __reach > __from").select("__row.*").distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__h_{c}")) for c in left.columns]
    kept = rows.join(hit.select(*[F.col(c).alias(f"__h_{c}") for c in left.columns]), same, f"left_{how}")
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*left.columns)


def nearest_onset(cards: DataFrame, cues: DataFrame, card: str = "start", cue: str = "start", card_no: str = "card_no", cue_no: str = "cue_no",
                  keys: Sequence[str] = KEYS, radius: float = 5.0) -> DataFrame:
    """(keys, card_no, cue_no, delta): the nearest cue start within ``radius`` of each card start.

    A tie goes to the earlier cue. Of equal cue starts, the last one before the card and the first
    one at or after it are the candidates. Cards without a cue in reach are left out. Two sorts of
    each key's stretches of RADII radii, and no pairs; a cue near the border of two stretches stands in
    both.
    """
    return nearest_starts(cards, cues, card, cue, card_no, cue_no, keys, radius).drop("t")


def nearest_starts(cards: DataFrame, cues: DataFrame, card: str = "start", cue: str = "start", card_no: str = "card_no", cue_no: str = "cue_no",
                   keys: Sequence[str] = KEYS, radius: float = 5.0) -> DataFrame:
    """``nearest_onset`` with the card's own start as t."""
    no = F.lit(None).cast("long")
    stretch = lambda t: F.floor(t / (RADII * radius)).cast("long")
    around = F.explode(F.array_distinct(F.array(stretch(F.col(cue) - radius), stretch(F.col(cue) + radius))))
    both = (cards.where(F.col(card).isNotNull()).select(*keys, stretch(F.col(card)).alias("part"), F.col(card).alias("t"), F.lit(0).alias("kind"), F.col(card_no).cast("long").alias("card_no"), no.alias("cue_no"))
            .unionByName(cues.where(F.col(cue).isNotNull()).select(*keys, around.alias("part"), F.col(cue).alias("t"), F.lit(1).alias("kind"), no.alias("card_no"), F.col(cue_no).cast("long").alias("cue_no"))))
    mark = F.when(F.col("kind") == 1, F.struct("t", "cue_no"))
    order = [F.col("t"), F.col("kind"), F.coalesce("cue_no", "card_no")]
    nearest = lambda by: F.last(mark, ignorenulls=True).over(Window.partitionBy(*keys, "part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    seen = both.withColumns({"before": nearest(order), "after": nearest([c.desc() for c in order])}).where("kind = 0")
    option = lambda c: F.when(F.abs(F.col(c)["t"] - F.col("t")) <= radius, F.struct(
        F.abs(F.col(c)["t"] - F.col("t")).alias("away"), F.col(c)["t"].alias("t"), F.col(c)["cue_no"].alias("cue_no")))
    best = seen.withColumn("best", F.least(option("before"), option("after"))).where("best is not null")
    return best.select(*keys, "card_no", F.col("best.cue_no").alias("cue_no"), (F.col("best.t") - F.col("t")).alias("delta"), "t")


def collect_text(joined: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, alias: str, sep: str = " ", cap: int | None = None) -> DataFrame:
    """The texts of each key in the given order, joined, and cut at ``cap`` characters."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    out: Column = F.array_join(F.transform(rows, lambda r: r["__text"]), sep)
    return joined.groupBy(*keys).agg((F.substring(out, 1, cap) if cap else out).alias(alias))
