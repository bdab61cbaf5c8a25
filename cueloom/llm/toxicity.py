"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The presence of every hashed n-gram is counted over all labelled training rows of either class. The
log ratio of the two shares scales the n-gram's feature; a logistic regression on the scaled
features is then fitted to a bounded sample of these rows, weighted back to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import materialize, quoted

#: Characters of an n-gram, and bits of its hash.
SIZES, BITS = (3, 4, 5), 18
#: Rows of each class, about, that the regression is fitted to. The counts cover all rows.
SAMPLE_ROWS = 4_000
#: Features of each class, about, that these rows may have together, 4 bytes each on the driver: long
#: texts make the sample smaller.
SAMPLE_FEATURES = 16_000_000
#: Standard errors that a log-count ratio has to be away from zero; other features are left out.
LEAST_Z = 4.0
#: Ridge penalty, most rounds of the fit, and what a round has to gain for another one.
PENALTY, ROUNDS, LEAST_GAIN = 3e-4, 200, 1e-6
#: Label rows (16 bytes each) up to this number are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 500_000
_CHUNK = 1 << 18
_FIT_ROWS = 512
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def features(text: str | None, mark: np.ndarray) -> np.ndarray:
    """Sorted hashes of the n-grams that the lower-cased text has. ``mark``: 2 ** BITS flags, all
    unset, which are left so."""
    body = (text or "").lower()
    for lo in range(0, len(body), _CHUNK):
        c = np.frombuffer(body[lo : lo + _CHUNK + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = c
        for n in range(2, max(SIZES) + 1):
            h = h[:-1] * _STEP + c[n - 1 :]
            if n in SIZES:
                mark[((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(64 - BITS)] = True
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + sum of the weights of the n-grams that a text has)."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None, mark: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[features(text, mark)].sum()))))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = BROADCAST_LABELS) -> DataFrame:
    """(doc_id, body, toxic) of the rows that may be learned from. Of repeated labels the larger
    counts; null labels and ids are void."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(quoted(label)).alias("toxic")).where("__id is not null and toxic is not null").groupBy("__id").agg((F.max("toxic") > 0).alias("toxic"))
    known = materialize(known.where(~held_out(F.col("__id"))), "labels")
    if known.limit(limit + 1).count() <= limit:
        known = F.broadcast(known)
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("body")).where(~held_out(F.col("doc_id")))
    return rows.join(known, F.col("doc_id") == F.col("__id")).drop("__id")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, toxic, clean): rows of each class that have the n-gram; f = -1 counts all rows."""
    mark, counts, rows = np.zeros(1 << BITS, bool), np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for batch in batches:
        for text, toxic in zip(batch.column("body").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[int(toxic)][features(text, mark)] += 1
            rows[int(toxic)] += 1
    f = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1)), pa.array(np.append(counts[1][f], rows[1])), pa.array(np.append(counts[0][f], rows[0]))], names=["f", "toxic", "clean"])


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> Model:
    """Learn from ``rows`` (doc_id, body, toxic). Without rows of both classes every text scores
    the share of toxic rows, smoothed. The driver gets two counts for each of the 2 ** BITS
    hashes, and the sample's kept features."""
    totals = rows.mapInArrow(_count, "f long, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    n1, n0 = (int(totals.loc[totals.f == -1, c].sum()) for c in ("toxic", "clean"))
    none = Model(np.zeros(1 << BITS), float(np.log((n1 + 1) / (n0 + 1))))
    if not n1 or not n0:
        return none
    totals = totals[totals.f >= 0]
    p, q = totals.toxic.to_numpy() + 1.0, totals.clean.to_numpy() + 1.0
    ratio, error = np.log(p / (n1 + 2)) - np.log(q / (n0 + 2)), np.sqrt(1 / p - 1 / (n1 + 2) + 1 / q - 1 / (n0 + 2))
    scale = np.zeros(1 << BITS)
    good = np.abs(ratio) >= LEAST_Z * error
    scale[totals.f.to_numpy()[good]] = ratio[good]
    if not scale.any():
        return none
    shared = rows.sparkSession.sparkContext.broadcast(scale != 0)
    features_of = {True: int(totals.toxic.to_numpy()[good].sum()), False: int(totals.clean.to_numpy()[good].sum())}
    share = {k: min(1.0, sample_rows / n, sample_features / max(1, features_of[k])) for k, n in ((True, n1), (False, n0))}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = rows.where(chance < F.when(F.col("toxic"), share[True]).otherwise(share[False]))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, keep = np.zeros(1 << BITS, bool), shared.value
        for batch in batches:
            found = [features(t, mark) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([f[keep[f]].astype(np.int32).tobytes() for f in found], pa.binary())], names=["doc_id", "toxic", "f"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = sorted(((r["doc_id"], bool(r["toxic"]), bytes(r["f"])) for r in chosen.mapInArrow(sample, f"doc_id {kind}, toxic boolean, f binary").toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    if len({r[1] for r in got}) < 2:
        return none
    sets = [np.frombuffer(r[2], np.int32) for r in got]
    y = np.array([r[1] for r in got], float)
    del got, totals
    return _fit(sets, y, np.where(y == 1, 1 / share[True], 1 / share[False]), scale)


def _least(loss, at: np.ndarray, kept: int = 10) -> np.ndarray:
    """Where ``loss`` (value and slope) is least, by limited-memory quasi-Newton steps."""
    value, slope = loss(at)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ROUNDS):
        way, used = -slope, []
        for s, g, r in reversed(moves):
            used.append(r * (s @ way))
            way = way - used[-1] * g
        if moves:
            s, g, r = moves[-1]
            way = way / (r * (g @ g))
        for (s, g, r), a in zip(moves, reversed(used), strict=True):
            way = way + s * (a - r * (g @ way))
        down, step = float(slope @ way), 1.0 if moves else 1 / max(1e-12, float(np.linalg.norm(slope)))
        new, to = loss(at + step * way)
        while new > value + 1e-4 * step * down and step > 1e-10:
            step /= 2
            new, to = loss(at + step * way)
        if new >= value - LEAST_GAIN:
            break
        s, g = step * way, to - slope
        if s @ g > 1e-12:
            moves = [*moves[1 - kept :], (s, g, 1 / float(s @ g))]
        at, value, slope = at + s, new, to
    return at


def _fit(sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, scale: np.ndarray) -> Model:
    """Weighted ridge logistic regression."""
    used = np.concatenate(sets)
    names = np.flatnonzero(np.bincount(used, minlength=len(scale)))
    if not len(names):
        return Model(np.zeros(len(scale)), float(np.log((weight[y == 1].sum() + 1) / (weight[y == 0].sum() + 1))))
    del used
    place = np.zeros(len(scale), np.int32)
    place[names] = np.arange(len(names))
    weight = weight / weight.sum()
    # Blocks of rows, so that what a round makes besides stays small.
    blocks = []
    for lo in range(0, len(sets), _FIT_ROWS):
        part = sets[lo : lo + _FIT_ROWS]
        flat = np.concatenate(part)
        blocks.append((place[flat], scale[flat].astype(np.float32), np.repeat(np.arange(len(part), dtype=np.int32), [len(f) for f in part]), y[lo : lo + _FIT_ROWS], weight[lo : lo + _FIT_ROWS]))

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        v, total = at[:-1], PENALTY / 2 * float(at[:-1] @ at[:-1])
        slope = np.append(PENALTY * v, 0.0)
        for column, x, row, t, q in blocks:
            z = np.bincount(row, x * v[column], len(t)) + at[-1]
            off = q * (1 / (1 + np.exp(-z)) - t)
            total += float(q @ (np.logaddexp(0, z) - t * z))
            slope[:-1] += np.bincount(column, x * off[row], len(names))
            slope[-1] += off.sum()
        return total, slope

    best = _least(loss, np.append(np.zeros(len(names)), np.log(weight[y == 1].sum() / weight[y == 0].sum())))
    w, b = best[:-1], float(best[-1])
    full = np.zeros(len(scale))
    full[names] = w * scale[names]
    return Model(full, b)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts get the score of a text without n-grams,
    repeated rows score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, own = np.zeros(1 << BITS, bool), shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t.as_py(), mark) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("body"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
