"""Connected components by alternating large-star and small-star steps.

Each step regroups the links of a node around its smallest neighbour; the number of rounds grows
with the logarithm of the longest path. Every round is one written table, and the driver only sees
two sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link: root is the component's smallest node.

    ``links`` holds two columns of one orderable type; null ends and loops are void, repeated
    links and either direction count once. The minimum of a hot node is pre-aggregated, written and
    joined back as a plain shuffled join, whose large partitions adaptive execution splits.
    """
    at = materialize(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct(), "links")
    before = None
    while True:
        both = at.union(at.select(F.col("u").alias("v"), F.col("v").alias("u")))  # u is a neighbour of v
        # The minima are written before they are joined, so that a hot node's links can be split.
        least = materialize(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m")), "least")
        large = (both.join(least, "v")
                 .where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        large = materialize(large, "large-star")
        least = materialize(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = (large.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
                 .where("v <> u").distinct())
        at = materialize(small, "small-star")
        now = at.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return at.select(F.col("v").alias("node"), F.col("u").alias("root")).union(at.select(F.col("u"), F.col("u")).distinct())
        before = now
