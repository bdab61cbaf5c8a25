"""Positions in an order, worked out without one big task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.sources.scratch import materialize


def ranked(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with a gapless 0-based position ``name`` in the given order, without one big task.

    Rows are dealt by range of the whole order, so a hot leading key is split as long as the
    later ones differ; rows that are equal in all of them may stand in any order among
    themselves. The driver sees one count per range. Keep ``df`` narrow: it is written once.
    """
    spark = df.sparkSession
    part = "__range"
    kept = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranked")
    counts = sorted((r[part], r["n"]) for r in kept.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    first = spark.createDataFrame(starts or [(0, 0)], f"{part} int, __first long")
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1 + F.col("__first")
    return kept.join(F.broadcast(first), part).withColumn(name, place.cast("long")).drop(part, "__first")


def rank_within(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with a gapless 1-based position ``name`` among the rows of equal ``keys`` (null is a key
    like any other), however many rows a key has."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    at = ranked(df, [*keys, *order], "__at")
    first = at.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.min("__at").alias("__from"))
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    return at.join(first, reduce(and_, same)).withColumn(name, F.col("__at") - F.col("__from") + 1).drop("__at", "__from", *[f"__key{i}" for i in range(len(keys))])
