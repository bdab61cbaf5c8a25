"""Mixing sources to target weights by Pfair scheduling.

Time is a row of slots, one block each. Block k (from 0) of a source with weight w may not come
before slot floor(k / w) and has to be placed by slot ceil((k + 1) / w); in every slot, the
earliest deadline among the released blocks wins. With weights that sum to 1 every block meets its
window, so after t slots a source has more than w t - 1 and fewer than w t + 1 blocks.

Weights are taken as exact fractions, that is as whole shares of a period that is their sum, so the
pattern of a period repeats for ever and no deviation adds up. The driver works this pattern out with
a queue of the sources and holds some slots of it at a time: parts of a long one are written as a
table. Its length follows from the weights' decimals (ten million slots for seven) and not from the
rows, beyond whose blocks it is not carried on. Blocks find their slots in it with DataFrame
arithmetic. A given period rounds the weights to its shares, and that rounding adds up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce
from itertools import islice
from math import gcd, lcm
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import materialize, quoted, ranked, replace_columns, scratch_path

#: Slots of op9's period; a weight is rounded to a multiple of its inverse.
PERIOD = 1_000
#: Slots of a pattern that the driver holds at a time.
_PART = 1 << 16
PATTERN = "w_source string, w_null boolean, w_k long, w_release long, w_deadline long, w_slot long"
#: Sources, or slots of a pattern, up to which their table is sent to every task.
_SMALL = 100_000
#: Rows of a block.
BLOCK_ROWS = 16


def shares_of(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Weights as whole shares of ``period`` by largest remainders; every positive weight gets one."""
    good = {s: float(w) for s, w in weights.items() if w and w > 0}
    if len(good) > period:
        raise ValueError("more sources than slots in a period")
    total = sum(good.values())
    exact = {s: w / total * period for s, w in good.items()}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    by_need = sorted(exact, key=lambda s: (shares[s] - exact[s], str(s)))
    while sum(shares.values()) != period:
        step = 1 if sum(shares.values()) < period else -1
        for s in by_need if step > 0 else reversed(by_need):
            if sum(shares.values()) != period and shares[s] + step > 0:
                shares[s] += step
    return shares


def exact_shares(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """The least whole numbers in the proportion of the positive weights, each as it is written in
    decimals."""
    good = {s: Fraction(str(w)) for s, w in weights.items() if w and w > 0}
    scale = lcm(*[w.denominator for w in good.values()])
    whole = {s: int(w * scale) for s, w in good.items()}
    common = gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def pattern(shares: Mapping[str | None, int], slots: int | None = None) -> Iterator[tuple[str | None, int, int, int, int]]:
    """One period, or its first ``slots``: (source, block within the period, release, deadline,
    slot), a row for each slot.

    Ties of the deadline go to the block whose successor is due first, then by name.
    """
    period = sum(shares.values())
    names = list(shares)
    waiting, ready = [(0, i, 0) for i in range(len(names))], []  # (release, source, block)
    for slot in range(period if slots is None else min(slots, period)):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            share = shares[names[i]]
            heapq.heappush(ready, (-(-(k + 1) * period // share), (k + 2) * period / share, str(names[i]), i, k))
        deadline, _, _, i, k = heapq.heappop(ready)
        share = shares[names[i]]
        yield names[i], k, k * period // share, deadline, slot
        if k + 1 < share:
            heapq.heappush(waiting, ((k + 1) * period // share, i, k + 1))


def _pattern_table(spark: SparkSession, shares: Mapping[str | None, int], slots: int) -> DataFrame:
    rows = ((s, s is None, k, r, d, t) for s, k, r, d, t in pattern(shares, slots))
    parts = (spark.createDataFrame(part, PATTERN) for part in iter(lambda: list(islice(rows, _PART)), []))
    if slots <= _PART:
        return next(parts, spark.createDataFrame([], PATTERN))
    path = scratch_path(spark, "pattern")
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(PATTERN).parquet(path)


def mix(docs: DataFrame, weights: Mapping[str | None, float], source: str = "source", order: tuple[str, ...] = ("doc_id",),
        period: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row's place in the mixture: adds block, release, deadline, slot and place (row within
    the block); input columns of these names give way.

    Rows of a source form blocks of ``block_rows`` in the given order (null ids first). Rows with
    equal source and order columns share one place. While every source has blocks left, any run of whole slots
    from the start deviates from the weights by less than one block; a source that has run out
    leaves its slots empty, so the others keep their proportions and no row is lost. Sources
    without a positive weight, null among them unless it is given one, follow after all others by
    source, in blocks with null release and deadline. An empty table stays empty.

    Weights are exact unless a ``period`` is given; then they are rounded to its slots, and the
    deviation grows from period to period.
    """
    spark = docs.sparkSession
    names = [source, *order]
    if len(set(names)) != len(names):
        raise ValueError("the source may not be part of the order")
    weighted = any(w and w > 0 for w in weights.values())
    shares = (exact_shares(weights) if period is None else shares_of(weights, period)) if weighted else {}
    period = sum(shares.values())
    at = ranked(docs.select(*[F.col(quoted(c)) for c in names]).distinct(), [F.col(quoted(c)) for c in names], "__rank")
    first = materialize(at.groupBy(source).agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("__n")), "mixed-sources")
    share = spark.createDataFrame([(s, s is None, n) for s, n in shares.items()], "s_source string, s_null boolean, share long")
    sent = lambda df, n: F.broadcast(df) if n <= _SMALL else df
    first = first.join(sent(share, len(shares)), F.col(quoted(source)).eqNullSafe(F.col("s_source")), "left").drop("s_source", "s_null")
    last_slot = F.ceil(F.ceil(F.col("__n") / block_rows) * F.lit(period) / F.col("share"))
    slots = min(period, int(first.agg(F.max(last_slot)).first()[0] or 0))
    table = _pattern_table(spark, shares, slots)
    first = first.withColumnRenamed(source, "__source")
    at = at.join(first, F.col(quoted(source)).eqNullSafe(F.col("__source"))).withColumn("__i", F.col("__rank") - F.col("__first"))
    at = at.withColumns({"block": F.floor(F.col("__i") / block_rows).cast("long"), "place": (F.col("__i") % block_rows).cast("int")})
    at = at.withColumn("__k", F.col("block") % F.col("share"))
    at = at.join(sent(table, slots), F.col(quoted(source)).eqNullSafe(F.col("w_source")) & (F.col("__k") == F.col("w_k")), "left")
    turn = (F.floor(F.col("block") / F.col("share")) * period).cast("long")
    last = at.agg(F.max(turn + period)).first()[0] or 0
    slot = F.coalesce(turn + F.col("w_slot"), F.lit(last) + F.floor(F.col("__rank") / block_rows)).cast("long")
    placed = at.select(*[F.col(quoted(c)).alias(f"__k{i}") for i, c in enumerate(names)], F.struct(
        "block", (turn + F.col("w_release")).alias("release"), (turn + F.col("w_deadline")).alias("deadline"), slot.alias("slot"), "place").alias("__at"))
    same = [F.col(quoted(c)).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)]
    out = docs.join(placed, reduce(and_, same), "left")
    return replace_columns(out.drop(*[f"__k{i}" for i in range(len(names))]), {c: F.col(f"__at.{c}") for c in ("block", "release", "deadline", "slot", "place")}).drop("__at")
