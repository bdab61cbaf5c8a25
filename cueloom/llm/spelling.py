"""Spelling variants: words that differ by one letter, found with a dictionary of trie-node pairs.

Every prefix of a word is a node of a trie and every suffix one of the trie of reversed words, and
nodes have numbers. A word with its letter i left out is the pair (node of the i letters before, node
of the letters after); a word that is whole at i is the pair (node before, node after) as well. So

* words that skip different letters at one place and have equal pairs differ by a replaced letter,
* a word that skips a letter and a word that is whole at that place with an equal pair differ by an
  inserted one.

Equal pairs of numbers are an exact test, whatever the words' lengths. All words that skip a letter
under one pair differ in that letter alone, so they are at most as many as there are letters, and one
window over a pair says for each of its words how many others there are and which is the most
frequent: no pairs of words are ever made.

Nodes are numbered where the words lie in order: a node is new where a word has a longer prefix than
it shares with the word before. Ranges of words are numbered each by itself; only nodes on the way to
a range's first word can have begun in an earlier range, and the driver links these, with two words a
range to look at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.common import lower_ascii, materialize, quoted

#: Letters of words. Only A-Z are lower-cased.
WORD = r"[A-Za-zÀ-ÿ]+"
#: Letters and occurrences of a word that takes part.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: How many times as frequent as a word its form is.
FORM_RATIO = 10
#: The root of either trie, and bits of a node's number within its range.
ROOT, RANGE_BITS = -1, 40


def words_of(text: Column) -> Column:
    """The words of a text, repeats included, in order; null has none."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_counts(words: DataFrame, word: str = "word", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that take part, from one row for each occurrence."""
    kept = words.select(F.col(quoted(word)).alias("word")).where(F.length("word") >= least_letters)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in order -> (place, nodes): their places and the nodes of their prefixes, numbered within
    the range. The first word's nodes are 0, 1, ..."""
    last, nodes, new, place = "", [], 0, 0
    for batch in batches:
        rows = []
        for word in batch.column("word").to_pylist():
            n = min(len(last), len(word))
            if last[:n] != word[:n]:
                n = next(k for k in range(n) if last[k] != word[k])
            nodes = [*nodes[:n], *range(new, new + len(word) - n)]
            new += len(word) - n
            last = word
            rows.append(nodes)
        places = pa.array(np.arange(place, place + len(rows)))
        place += len(rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, places, pa.array(rows, pa.list_(pa.int64()))], names=[*batch.schema.names, "place", "nodes"])


def with_nodes(words: DataFrame, name: str) -> DataFrame:
    """``words`` (word, ..., each word once) with ``name``, the numbers of the nodes of its prefixes by
    length from 1 on, and place, a number that grows with the word's code points."""
    part = "__range"
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    held = ordered.mapInArrow(_number, f"{kind}, place long, nodes array<long>").withColumn(part, F.spark_partition_id())
    held = materialize(held, "trie")
    ends = held.groupBy(part).agg(F.min_by(F.struct("word", "nodes"), "place").alias("first"), F.max_by(F.struct("word", "nodes"), "place").alias("last"))
    links, before, known = [(-1, [0])], "", []
    for r in sorted(ends.collect(), key=lambda r: r[part]):
        word, base = r["first"]["word"], r[part] << RANGE_BITS
        n = next((k for k, (a, b) in enumerate(zip(before, word, strict=False)) if a != b), min(len(before), len(word)))
        links.append((r[part], known[:n]))
        # A node on the way to the first word that began earlier has the number from there.
        before = r["last"]["word"]
        known = [known[x] if x < n else base + x for x in r["last"]["nodes"]]
    linked = held.sparkSession.createDataFrame(links, f"{part} int, __known array<long>")
    base = F.shiftleft(F.col(part).cast("long"), RANGE_BITS)
    number = F.transform("nodes", lambda x: F.coalesce(F.get("__known", x.cast("int")), base + x))
    return held.join(F.broadcast(linked), part).select(*words.columns, (base + F.col("place")).alias("place"), number.alias(name))


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every row of ``counted`` (word, n; each word once).

    n_near counts the other words that differ by exactly one inserted, deleted or replaced code
    point. form is the most frequent of these (of equal ones the first in code-point order) if it is
    FORM_RATIO times as frequent as the word or more, else null. Null words take no part; an empty
    table stays empty.
    """
    counted = materialize(counted.select("word", "n").where("word is not null"), "words")
    ahead = with_nodes(counted, "before")
    back = with_nodes(counted.select(F.reverse("word").alias("word")), "after").select(F.reverse("word").alias("word"), "after")
    words = materialize(ahead.join(back, "word").withColumn("letters", F.split("word", "")), "tries")
    m = F.length("word")
    node = lambda nodes, n: F.when(n == 0, F.lit(ROOT).cast("long")).otherwise(F.get(nodes, n - 1))
    letter = lambda i: F.get("letters", i)
    # skip: the letter i is left out. Leaving out any of some equal neighbours gives one word, which
    # counts at the first of them (lone).
    skip = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(
        node(F.col("before"), i).alias("p"), node(F.col("after"), m - i - 1).alias("s"), F.lit(True).alias("skip"), ((i == 0) | (letter(i) != letter(i - 1))).alias("lone")))
    whole = F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(
        node(F.col("before"), i).alias("p"), node(F.col("after"), m - i).alias("s"), F.lit(False).alias("skip"), F.lit(False).alias("lone")))
    pairs = words.where(m > 0).select("place", "n", F.explode(F.concat(skip, whole)).alias("x")).select("place", "n", "x.*")
    pair = Window.partitionBy("p", "s")
    me = F.struct(F.col("n").alias("n"), (-F.col("place")).alias("place"))
    at = pairs.withColumns({
        "skipping": F.sum(F.col("skip").cast("long")).over(pair), "lonely": F.sum(F.col("lone").cast("long")).over(pair),
        "entire": F.max(F.when(~F.col("skip"), me)).over(pair), "first_lone": F.max(F.when(F.col("lone"), me)).over(pair), "first": F.max(F.when(F.col("skip"), me)).over(pair),
        "second": F.lead(F.when(F.col("skip"), me)).over(pair.orderBy(F.col("skip").desc(), F.col("n").desc(), "place"))})
    other = F.when(F.col("first.place") == -F.col("place"), F.col("second")).otherwise(F.col("first"))
    best = F.when(F.col("skip"), F.array_max(F.array(other, F.when(F.col("lone"), F.col("entire"))))).otherwise(F.col("first_lone"))
    many = F.when(F.col("skip"), F.col("skipping") - 1 + (F.col("lone") & F.col("entire").isNotNull()).cast("long")).otherwise(F.col("lonely"))
    near = at.select("place", "n", many.alias("n_near"), best.alias("best")).where("n_near > 0").groupBy("place", "n").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    near = materialize(near.select("place", "n", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.place")).alias("best_place")), "near")
    names = words.select(F.col("place").alias("best_place"), F.col("word").alias("form"))
    forms = near.where(F.col("best_n") >= FORM_RATIO * F.col("n")).join(names, "best_place").select("place", "form", F.col("best_n").alias("form_n"))
    out = words.select("place", "word", "n").join(near.select("place", "n_near"), "place", "left").join(forms, "place", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n")


def group_variants(counted: DataFrame) -> DataFrame:
    """``near_words`` with root: where the way from a word over its form, the form's form and so on
    ends; a word without a form is its own root. A form is FORM_RATIO times as frequent as what leads
    to it, so the way has as many steps as that fits into the largest count, and every round doubles
    the steps taken."""
    near = materialize(near_words(counted), "near-words")
    steps = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        steps = materialize(steps, "forms")
        beyond = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = steps.join(beyond, "root", "left")
        if not further.where("beyond is not null").take(1):
            break
        steps = further.select("word", F.coalesce("beyond", "root").alias("root"))
    return near.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
