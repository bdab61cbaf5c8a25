"""Gating of cards: repeats, low confidence, quality counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators.joins import KEYS


#: Texts whose n-grams one task counts, on average.
DEALT = 2048


def gate(cards: DataFrame, blocklist: list[str] | None = None) -> DataFrame:
    """Adds drop_reason and flag."""
    return cards.withColumns({"drop_reason": T.drop_reason(F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob"), blocklist),
                              "flag": T.flag_reason(F.col("no_speech_prob"), F.col("avg_logprob"))})


def collapse_runs(cards: DataFrame, min_run: int = 4, keys: Sequence[str] = KEYS, order: str = "card_no") -> DataFrame:
    """``min_run`` or more consecutive cards with equal normal text become the first of them, with
    the last one's end."""
    w = Window.partitionBy(*keys).orderBy(order)
    norm = T.norm_text(F.col("text"))
    out = cards.withColumn("__norm", norm)
    out = out.withColumn("__new", F.coalesce((~F.col("__norm").eqNullSafe(F.lag("__norm").over(w))).cast("int"), F.lit(1)))
    out = out.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "__run")
    out = out.withColumns({"__n": F.count(F.lit(1)).over(run), "__at": F.row_number().over(run.orderBy(order)),
                           "__last": F.last("end").over(run.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    kept = out.where((F.col("__n") < min_run) | (F.col("__at") == 1))
    return kept.withColumn("end", F.when(F.col("__n") >= min_run, F.col("__last")).otherwise(F.col("end"))).drop("__norm", "__new", "__run", "__n", "__at", "__last")


def max_ngram_share(cards: DataFrame, k: int, ident: Sequence[str] = (*KEYS, "card_no"), text: str = "text") -> DataFrame:
    """(ident, tokens, top): tokens of each text and the count of its most frequent k-gram, by
    grouping; for texts too long for arrays of n-grams. Rows are dealt by ``ident`` before they are taken
    apart, so texts are shuffled, and no n-grams."""
    n = max(int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions")), cards.count() // DEALT)
    tokens = cards.select(*ident, text).repartition(n, *ident).select(*ident, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0)).alias("__t"))
    grams = tokens.where(F.size("__t") >= k).select(*ident, F.size("__t").alias("tokens"), F.explode(F.sequence(F.lit(1), F.size("__t") - k + 1)).alias("__i"), "__t")
    counted = grams.groupBy(*ident, "tokens", F.array_join(F.slice("__t", F.col("__i"), F.lit(k)), " ").alias("__gram")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*ident, "tokens").agg(F.max("n").alias("top"))


def caption_qc(cards: DataFrame, keys: Sequence[str] = KEYS, unit: float = 1.0, low_lp=-0.8, high_nsp=0.6) -> DataFrame:
    """Counts for each episode: cards, flagged, low confidence, too fast, layout violations, longest
    duration. ``unit``: times are this many to a second."""
    dur = F.col("end") - F.col("start")
    shown = F.length(F.replace("text", F.lit("\n"), F.lit(" ")))
    lines = F.split("text", "\n")
    bad = (dur > 7.001 * unit) | (F.size(lines) > 2) | F.exists(lines, lambda x: F.length(x) > 42)
    count = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    return cards.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cards"), count(F.col("flag").isNotNull()).alias("flagged"), count((F.col("avg_logprob") < low_lp) | (F.col("no_speech_prob") > high_nsp)).alias("low_conf"),
        F.max(dur).alias("max_dur"), count(shown * unit > 17 * dur).alias("over_cps"), count(bad).alias("violations"), F.sum("avg_logprob").alias("lp_sum"))


def run_summary(qc: DataFrame, glossaries: DataFrame, show: str = "show") -> DataFrame:
    """Sums over each show's episodes, and a fingerprint of its glossary text (show, body)."""
    sums = qc.groupBy(show).agg(F.count(F.lit(1)).alias("episodes"), F.sum("cards").alias("cards"), F.sum("flagged").alias("flagged"), F.sum("violations").alias("violations"))
    print_ = glossaries.select(show, F.substring(F.sha2(F.coalesce("body", F.lit("")), 256), 1, 12).alias("fingerprint"))
    return sums.join(print_, show, "left")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
