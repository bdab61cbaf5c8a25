"""The most similar names of strings, found with upper bounds.

Two strings of which one has m letters, the other n, and that have c letters in common, each counted as
often as it stands in both, have a ratio of at most 2 c / (m + n). A block of names has its letters
counted once; bounds of all strings for all of them are one matrix product. Names that reach the cutoff
have their pairs of neighbouring letters counted, which gives a second, closer bound. What is left is
scored in order of the bounds, and as soon as a bound is below the k-th best score so far, none of the
rest can be among the k best.

The strings asked for are a query set against all names of their show, in blocks: blocks of both sides
meet in groups of bounded size, each yields its own k best, and these are ranked at the end. So no show
is one task, however many names it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from difflib import SequenceMatcher
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.sources.scratch import materialize

#: Names, and strings, of a block; classes of letters that are counted apart (letters that share a class
#: only make a bound larger).
NAMES, STRINGS, CLASSES = 4096, 65_536, 64
#: Letters of a class that have a mark of their own; bits for pairs of letters; strings in one product.
MARKS, BITS, ROWS = 8, 512, 256
#: Parts into which the strings of a group are dealt further.
PARTS = 8


def letter_counts(texts: Sequence[str]) -> np.ndarray:
    """How often letters of each class stand in each of the texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.repeat(np.arange(len(texts)), lengths) * CLASSES + codes % CLASSES
    return np.bincount(at, minlength=len(texts) * CLASSES).reshape(-1, CLASSES).astype(np.int32)


class Block:
    """Texts of one side of a group: their lengths, their letters as single marks (class, how manieth of
    its class), and their pairs of neighbouring letters as bits."""

    def __init__(self, texts: Sequence[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        counts = letter_counts(texts)
        self.letters = (counts[:, :, None] > np.arange(MARKS)).reshape(len(texts), -1)
        self.more = np.maximum(counts - MARKS, 0).sum(1)
        # Pairs, one before the first letter and one behind the last included; equal ones are told apart.
        codes = np.frombuffer("".join([f"\x02{t}\x03" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(texts)), self.lengths + 2)
        inside = row[1:] == row[:-1]
        pair, of = ((codes[:-1] << np.uint64(32)) | codes[1:])[inside], row[1:][inside]
        order = np.lexsort((pair, of))
        pair, of = pair[order], of[order]
        first = np.concatenate([[True], (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])])
        nth = (np.arange(len(pair)) - np.maximum.accumulate(np.where(first, np.arange(len(pair)), 0))).astype(np.uint64)
        bit = ((pair * np.uint64(0x9E3779B97F4A7C15) + nth * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(BITS)
        flat = np.zeros((len(texts), BITS), bool)
        flat[of, bit.astype(np.int64)] = True
        self.pairs = np.packbits(flat, axis=1).view(np.uint64)
        self.shared = self.lengths + 1 - flat.sum(1)

    def part(self, lo: int, hi: int) -> Block:
        out = copy(self)
        out.lengths, out.letters, out.more, out.pairs, out.shared = (x[lo:hi] for x in (self.lengths, self.letters, self.more, self.pairs, self.shared))
        return out


def candidates(asked: Block, names: Block, cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, row of names, bound) of the pairs whose bound reaches the row's cutoff, the highest
    bounds of each row first.

    Letters in common are one matrix product. Of those that are left, pairs of letters are counted: a
    ratio from c letters in order leaves u = m + n - 2 c of them over, so they stand in at most u + 1
    pieces, and pieces have at least c + 1 - u pairs in common, ends included.
    """
    used = np.flatnonzero(names.letters.any(0))
    common = asked.letters[:, used].astype(np.float32) @ names.letters[:, used].astype(np.float32).T
    if asked.more.any() and names.more.any():
        common += np.minimum(asked.more[:, None], names.more)
    total = asked.lengths[:, None] + names.lengths
    i, j = np.nonzero(2.0 * common >= cutoffs[:, None] * total * (1 - 1e-6))
    both = np.bitwise_count(asked.pairs[i] & names.pairs[j]).sum(1, dtype=np.int64) + np.minimum(asked.shared[i], names.shared[j])
    total = total[i, j]
    bound = 2.0 * np.minimum(common[i, j].astype(np.int64), (both + total - 1) // 3) / total
    kept = bound >= cutoffs[i]
    i, j, bound = i[kept], j[kept], bound[kept]
    order = np.lexsort((-bound, i))
    return i[order], j[order], bound[order]


def best_of(text: str, cutoff: float, k: int | None, names: Sequence[str], places: Sequence[int], bounds: Sequence[float]) -> list[tuple[float, int]]:
    """(score, place) of the k best (all, without k) of the ``names`` at ``places``, which stand in the order
    of their bounds, that reach the cutoff; of equal scores the larger name is the better one."""
    matcher, found = SequenceMatcher(None, "", text), []
    for at, bound in zip(places, bounds, strict=True):
        if k is not None and len(found) == k and bound < found[0][0]:
            break
        matcher.set_seq1(names[at])
        entry = (matcher.ratio(), names[at], at)
        if entry[0] < cutoff:
            continue
        if k is None or len(found) < k:
            heappush(found, entry)
        elif entry > found[0]:
            heapreplace(found, entry)
    return [(score, at) for score, _, at in found]


def search_all(texts: Sequence[str], cutoffs: Sequence[float], k: int | None, names: Sequence[str]) -> list[tuple[str, str, float]]:
    """(text, name, score) of the k best ``names`` of each text."""
    # Strings of like lengths go together, and a cutoff c leaves names of c / (2 - c) to (2 - c) / c times theirs.
    names, rows = sorted(names, key=len), []
    held, asked = Block(names), sorted(zip(texts, cutoffs, strict=True), key=lambda a: len(a[0]))
    for a in range(0, len(asked), ROWS):
        part, least = [t for t, _ in asked[a : a + ROWS]], np.array([c for _, c in asked[a : a + ROWS]], np.float64)
        c = min(max(least.min(), 1e-9), 1.0)
        lo, hi = np.searchsorted(held.lengths, [len(part[0]) * c / (2 - c) - 1, len(part[-1]) * (2 - c) / c + 1])
        i, j, bound = candidates(Block(part), held.part(int(lo), int(hi)), least)
        j += lo
        ends = np.searchsorted(i, np.arange(len(part) + 1))
        for r in np.unique(i).tolist():
            at = slice(ends[r], ends[r + 1])
            rows += [(part[r], names[p], score) for score, p in best_of(part[r], least[r], k, names, j[at].tolist(), bound[at].tolist())]
    return rows


def nearest_names(asked: DataFrame, names: DataFrame, k: int | None = None) -> DataFrame:
    """(show, text, name, score): of each row of ``asked`` (show, text, cutoff; each text once) the k most
    similar of the show's ``names`` (show, name; each once) with a score of the cutoff or more, all of them
    without k; the larger name wins a tie. Nulls and empty strings are like nothing."""
    asked = asked.select("show", "text", F.col("cutoff").cast("double").alias("cutoff")).where("show is not null and text <> ''")
    names = names.select("show", F.col("name").alias("text"), F.lit(None).cast("double").alias("cutoff")).where("show is not null and text <> ''")
    both = materialize(asked.withColumn("side", F.lit(1)).unionByName(names.withColumn("side", F.lit(0))), "names")
    sizes = both.groupBy("show").pivot("side", [0, 1]).agg(F.count(F.lit(1))).na.drop()
    sizes = sizes.select("show", F.ceil(F.col("0") / NAMES).cast("long").alias("b0"), F.ceil(F.col("1") / STRINGS).cast("long").alias("b1"))
    own = F.when(F.col("side") == 0, F.pmod(F.xxhash64("text"), F.col("b0"))).otherwise(F.pmod(F.xxhash64("text"), F.col("b1")))
    met = both.join(sizes, "show").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0")) - 1)))
    is_name = F.col("side") == 0
    dealt = met.select("show", F.when(is_name, F.col("own")).otherwise(F.col("with")).alias("b0"), F.when(is_name, F.col("with")).otherwise(F.col("own")).alias("b1"), "side", "text", "cutoff")
    # Strings of a group are dealt further, so that a small show's work is not one task.
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    dealt = dealt.where("side = 0").withColumn("part", parts).unionByName(dealt.where("side = 1").withColumn("part", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(PARTS)).cast("int")))

    def search(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        of = lambda s: group.filter(pa.array(side == s))
        held, wanted = of(0).column("text").to_pylist(), of(1)
        rows = []
        if held and wanted.num_rows:
            rows = search_all(wanted.column("text").to_pylist(), wanted.column("cutoff").to_pylist(), k, held)
        text, name, score = zip(*rows, strict=True) if rows else ((), (), ())
        show = group.column("show")[0].as_py() if group.num_rows else None
        return pa.table({"show": pa.array([show] * len(rows), pa.string()), "text": pa.array(text, pa.string()), "name": pa.array(name, pa.string()), "score": pa.array(score, pa.float64())})

    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["show", "b0", "b1", "part"]
    return dealt.repartition(n, *keys).groupBy(*keys).applyInArrow(search, "show string, text string, name string, score double")
