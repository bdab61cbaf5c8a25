"""Repair of low-confidence cards: targets, requests, acceptance, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators.joins import KEYS
from cueloom.sources.answers import Answers
from cueloom.sources.scratch import scratch_path

CARD = (*KEYS, "card_no")


def repair_targets(cards: DataFrame, suspects: DataFrame, lp=-0.4, nsp=0.5, word_p=0.25) -> DataFrame:
    """Spoken cards (a missing no_speech_prob counts as 1) that are unsure, hold an unsure word
    (word_probs) or are suspect (CARD, suspect)."""
    out = cards.join(suspects.select(*CARD, "suspect"), list(CARD), "left")
    unsure = (F.coalesce("avg_logprob", F.lit(0)) < lp) | F.coalesce(F.exists("word_probs", lambda p: p < word_p), F.lit(False)) | F.coalesce("suspect", F.lit(False))
    return out.where(F.col("no_speech_prob").isNotNull() & (F.col("no_speech_prob") <= nsp) & unsure)


def limit_targets(targets: DataFrame, n: int = 15) -> DataFrame:
    """The first n targets in order of card."""
    return targets.orderBy(*CARD).limit(n)


def context_lines(cards: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds prev and next, the neighbours' texts, empty at the ends."""
    w = Window.partitionBy(*keys).orderBy("card_no")
    return cards.withColumns({"prev": F.coalesce(F.lag("text").over(w), F.lit("")), "next": F.coalesce(F.lead("text").over(w), F.lit(""))})


def repair_requests(targets: DataFrame, refs: DataFrame, context: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(CARD, text, ref, prompt) of targets with a reference text, and the others, which are skipped.
    refs: (CARD, ref); context: (CARD, prev, next); terms: (show, names: one string)."""
    out = targets.join(refs.select(*CARD, "ref"), list(CARD), "left").join(context.select(*CARD, "prev", "next"), list(CARD), "left").join(terms.select("show", "names"), "show", "left")
    has = F.coalesce("ref", F.lit("")) != ""
    prompt = T.build_repair_prompt(F.col("text"), F.col("ref"), F.coalesce("names", F.lit("")), F.col("prev"), F.col("next"))
    return out.where(has).select(*CARD, "text", "ref", prompt.alias("prompt")), out.where(~has).select(*CARD, "text")


def score_requests(requests: DataFrame, model: Callable[[], Callable[[str], str]], name: str, store: str | None = None, workers: int = 4) -> DataFrame:
    """(CARD, model, output, error): a text-to-text model over the prompts. ``model`` is called once
    in each task and returns the function for one prompt; a failure of it gives an empty output and
    an error text and stops nothing.

    Equal prompts are asked once. An answer is kept in ``store`` (a folder that all executors share;
    one of this run without it) as soon as it is there, so a task that is repeated, and a later run with
    the same store, ask only what has no answer yet; failures are not kept. A task asks ``workers``
    prompts at a time and holds one batch of them.
    """
    folder = store or scratch_path(requests.sparkSession, "answers")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, kept = None, Answers(folder, name)

        def one(prompt: str) -> tuple[str, str | None]:
            nonlocal ask
            found = kept.get(prompt)
            if found is not None:
                return found, None
            try:
                ask = ask or model()
                output = ask(prompt) or ""
            except Exception as e:  # noqa: BLE001  a bad reply is data here
                return "", f"{type(e).__name__}: {e}"
            kept.put(prompt, output)
            return output, None

        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                got = list(pool.map(one, frame["prompt"]))
                yield frame.assign(output=[g[0] for g in got], error=[g[1] for g in got])

    asked = requests.where("prompt is not null").select("prompt").distinct().mapInPandas(run, "prompt string, output string, error string")
    return requests.join(asked, "prompt").select(*CARD, F.lit(name).alias("model"), "output", "error")


def accept_repair(cards: DataFrame, replies: DataFrame) -> DataFrame:
    """Cards with repaired and status. replies: (CARD, output, second), corrected already; a
    second model's answer, if there is one, stands without a check of its length."""
    out = cards.join(replies.select(*CARD, F.col("output").alias("__o"), F.col("second").alias("__s")), list(CARD), "left")
    a, b = F.length("__o"), F.greatest(F.length("text"), F.lit(1))
    good = (F.coalesce("__o", F.lit("")) != "") & (F.lower("__o") != F.lower("text")) & (a * 10 >= b * 4) & (a * 10 <= b * 25)
    chosen = F.when(good, F.when((F.coalesce("__s", F.lit("")) != "") & (F.lower("__s") != F.lower("text")), F.col("__s")).otherwise(F.col("__o")))
    status = F.when(F.col("__o").isNull(), "untouched").when(good, "repaired").otherwise("kept")
    return out.withColumns({"repaired": F.coalesce(chosen, F.col("text")), "status": status}).drop("__o", "__s")


def apply_repairs(cards: DataFrame, accepted: DataFrame) -> DataFrame:
    """Cards with the accepted texts (CARD, repaired) in place."""
    return cards.join(accepted.select(*CARD, F.col("repaired").alias("__r")), list(CARD), "left").withColumn("text", F.coalesce("__r", "text")).drop("__r")


def repair_summary(audit: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """audit: (keys, status, latency_ms) -> counts, latency sum and nearest-rank 95th percentile, which
    is read off the counts of each latency."""
    by = audit.groupBy(*keys, "latency_ms").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "repaired").cast("int")).alias("repaired"), F.sum((F.col("status") == "skipped_no_ref").cast("int")).alias("skipped_no_ref"))
    known = F.when(F.col("latency_ms").isNotNull(), F.col("n")).otherwise(F.lit(0))
    whole = Window.partitionBy(*keys)
    by = by.withColumns({"__up_to": F.sum(known).over(whole.orderBy(F.col("latency_ms").asc_nulls_first())), "__of": F.sum(known).over(whole)})
    place = F.least(F.col("__of") - 1, F.bround(0.95 * (F.col("__of") - 1)).cast("long")) + 1
    p95 = F.min(F.when(F.col("__up_to") >= place, F.col("latency_ms")))
    return by.groupBy(*keys).agg(F.sum("n").alias("targets"), F.sum("repaired").alias("repaired"), F.sum("skipped_no_ref").alias("skipped_no_ref"), F.sum(F.col("latency_ms") * F.col("n")).alias("latency_sum"), p95.alias("latency_p95"))


def compare_models(scored: DataFrame, models: list[str]) -> DataFrame:
    """A row for each card, a column for each model's output."""
    return scored.groupBy(*CARD).pivot("model", models).agg(F.first("output"))


def model_latency(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency_sum"))
