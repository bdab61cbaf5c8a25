"""All queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueloom.plans import caption_queries, io_queries, library_queries

QUERIES = {**caption_queries.QUERIES, **library_queries.QUERIES, **io_queries.QUERIES}
ORACLES = {**caption_queries.ORACLES, **library_queries.ORACLES, **io_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timing report of every document's spans against its shifted cues."""
    return caption_queries.timing_report(spark, sf_dir)
