"""Minimax contiguous shards over atomic groups.

Rows with equal texts form one atomic group. The groups stand in one order, and the order is cut
into contiguous shards so that the largest shard is as small as any such cut allows: a binary
search for the least capacity with which a greedy pass gets by with the wanted number of shards.

The search never sees all groups at once. It works on bounds of the greedy cuts that a summary of
at most ``cells`` cells gives, and refines only the cells that can hold a cut, until every cell
that matters is one group; then the capacity is exact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.common import materialize, quoted, ranked, replace_columns

#: Cells of one summary that the driver holds; three numbers each.
CELLS = 65_536


def text_group(text: Column) -> Column:
    """The atomic group of a row: the digest of its text; all null texts form one group."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; 1 for null."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


#: What the search asks of the groups: for each (lo, hi], some of the group ends (running sums) in
#: it, the last one of them included, and whether these are all.
Ends = Callable[[list[tuple[int, int]], int], Iterable[tuple[int, int, set[int], bool]]]


def least_capacity(ends_in: Ends, shards: int, total: int, largest: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """The least capacity with which ``shards`` contiguous parts hold everything, and where the
    greedy parts end."""
    known: list[int] = sorted({0, total})
    whole: list[tuple[int, int]] = []  # spans of which all ends are known

    def below(x: int) -> int:
        return known[bisect_right(known, x) - 1]

    def exact(x: int) -> bool:
        i = bisect_right(known, x) - 1
        return known[i] == x or i + 1 == len(known) or any(a <= known[i] and known[i + 1] <= b for a, b in whole)

    def reach(capacity: int, sure: bool) -> tuple[list[int], list[int]]:
        """Ends of the greedy parts if every cut falls on a known end (sure: no cut lies further
        right than claimed) or, else, on the last place that the capacity allows."""
        at, ends, asked = 0, [], []
        while at < total and len(ends) < shards:
            x = min(at + capacity, total)
            asked.append(x)
            at = below(x) if sure or exact(x) else x
            ends.append(at)
            if ends[-2:] == [at, at]:
                break
        return ends, asked

    low, high = max(largest, -(-total // shards)), total
    if total == 0:
        return 0, []
    while True:
        lo, hi = low, high
        while lo < hi:  # the least capacity that surely suffices
            mid = (lo + hi) // 2
            if (reach(mid, True)[0] or [0])[-1] >= total:
                hi = mid
            else:
                lo = mid + 1
        high = lo
        lo, hi = low, high
        while lo < hi:  # every smaller one surely fails
            mid = (lo + hi) // 2
            if (reach(mid, False)[0] or [0])[-1] >= total:
                hi = mid
            else:
                lo = mid + 1
        low = lo
        if low == high:
            return high, reach(high, True)[0]
        spans, first, last = [], reach(low, True)[1], reach(high, False)[1]
        for k in range(max(len(first), len(last))):
            a = below(first[min(k, len(first) - 1)] if first else 0)
            b = last[min(k, len(last) - 1)] if last else total
            b = known[min(bisect_right(known, b), len(known) - 1)]
            if a < b and not any(c <= a and b <= d for c, d in whole):
                spans.append((a, b))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        for a, b, ends, complete in ends_in(merged or [(0, total)], max(2, cells // max(1, len(merged)))):
            known = sorted({*known, *ends})
            if complete:
                whole.append((a, b))


def shard_groups(groups: DataFrame, shards: int, order: list[str], size: str, cells: int = CELLS) -> DataFrame:
    """Cut ``groups`` (one row each, ``size`` > 0) in the given order; adds start (sum of the
    sizes before the group) and shard (0 to shards - 1; trailing shards may stay empty)."""
    spark = groups.sparkSession
    part = "__range"
    kept = materialize(groups.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "groups")
    sums = sorted((r[part], r["s"], r["m"]) for r in kept.groupBy(part).agg(F.sum(size).alias("s"), F.max(size).alias("m")).collect())
    firsts, total = [], 0
    for p, s, _ in sums:
        firsts.append((p, total))
        total += s
    largest = max([m for _, _, m in sums], default=0)
    run = F.sum(size).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = (kept.join(F.broadcast(spark.createDataFrame(firsts or [(0, 0)], f"{part} int, __first long")), part)
              .withColumn("end", (run + F.col("__first")).cast("long")).withColumn("start", F.col("end") - F.col(size)).drop(part, "__first"))
    placed = materialize(placed, "group-ends")

    def ends_in(spans, cells):
        """One job for all spans: the last end in each of ``cells`` equal cells of a span."""
        cell, which = F.lit(None).cast("long"), F.lit(None).cast("int")
        for k, (a, b) in reversed(list(enumerate(spans))):
            inside = (F.col("end") > a) & (F.col("end") <= b)
            width = max(1, -(-(b - a) // cells))
            cell = F.when(inside, F.floor((F.col("end") - F.lit(a + 1)) / F.lit(width)).cast("long")).otherwise(cell)
            which = F.when(inside, F.lit(k)).otherwise(which)
        rows = (placed.select("end", which.alias("k"), cell.alias("cell")).where("k is not null")
                .groupBy("k", "cell").agg(F.max("end").alias("last"), F.min("end").alias("first"), F.count(F.lit(1)).alias("n")).collect())
        for k, (a, b) in enumerate(spans):
            own = [r for r in rows if r["k"] == k]
            yield a, b, {e for r in own for e in (r["first"], r["last"])}, all(r["n"] <= 2 for r in own)

    _, cuts = least_capacity(ends_in, shards, total, largest, cells)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts[:-1]]) if len(cuts) > 1 else F.array().cast("array<long>")
    return placed.withColumn("shard", F.size(F.filter(bounds, lambda c: c < F.col("end"))).cast("int")).drop("end")


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text",
                    order: list[str] | None = None, cells: int = CELLS) -> DataFrame:
    """Give every row a shard by the law ``bytes``: sizes as near to equal as contiguous cuts
    between whole groups of equal texts allow.

    Adds shard and group_start (the sum of sizes before the row's group); input columns of these
    names give way. Groups stand by their smallest key in ``order`` (the id by default), ties by
    the text's digest. A group larger than the mean shard stays whole, so its shard is larger. A
    null text counts as size 1, null ids come first, repeated rows are separate members of one
    group. An empty table stays empty.
    """
    cols = order or [doc_id]
    group = text_group(F.col(quoted(text)))
    groups = (docs.select(group.alias("__group"), text_size(F.col(quoted(text))).alias("__size"), *[F.col(quoted(c)).alias(f"__k{i}") for i, c in enumerate(cols)])
              .groupBy("__group").agg(F.sum("__size").alias("bytes"), F.min(F.struct(*[f"__k{i}" for i in range(len(cols))])).alias("lead")))
    cut = shard_groups(groups, shards, ["lead", "__group"], "bytes", cells).select("__group", F.col("shard").alias("__shard"), F.col("start").alias("__start"))
    out = docs.withColumn("__group", group).join(cut, "__group").drop("__group")
    return replace_columns(out, {"shard": F.col("__shard"), "group_start": F.col("__start")}).drop("__shard", "__start")


def number_slots(rows: DataFrame, order: list[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap; ``rows`` (narrow, with shard and
    group_start) stand by group_start and then ``order``."""
    placed = ranked(rows, [F.col("group_start"), *[F.col(quoted(c)) for c in order]], "__place")
    first = placed.groupBy("shard").agg(F.min("__place").alias("__from"))
    return placed.join(F.broadcast(first), "shard").withColumn(slot, F.col("__place") - F.col("__from")).drop("__place", "__from")
