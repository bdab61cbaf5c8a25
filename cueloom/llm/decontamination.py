"""Benchmark decontamination with training suffix arrays.

Each task turns its documents into word suffix arrays, one for each shard of bounded size, and
looks up every suffix of the benchmark items by binary search. That gives all places of each test
suffix's window in the shard; the words in such places are hit, and documents with too many of them
can be removed. How far a match goes on behind its window is found from its place: the training
suffix there is looked up among the sorted test suffixes, and its longest common prefix is with one of
its two neighbours.

The benchmark is the stated query set. It is read in blocks of bounded size; each block is
broadcast and meets all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.common import materialize, quoted
from cueloom.llm.suffixes import search, sort_suffixes

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: UTF-8 bytes of benchmark text in one broadcast block (an item is never split): some 60 MB of arrays.
BLOCK_BYTES = 8 << 20
#: UTF-8 bytes of the documents of one suffix array, and words of it where one document is longer.
SHARD_BYTES, SHARD_WORDS = 16 << 20, 4_000_000
#: Places whose matches are measured at a time.
_PLACES = 1 << 16

#: On lower-cased UTF-8: digits, letters and every byte of a character beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NO_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes, piece: int = 4 << 20) -> Iterator[list[bytes]]:
    """The words of a text, a bounded piece at a time."""
    at = 0
    while at < len(text):
        end = at + piece
        cut = _NO_WORD.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        yield _WORD.findall(text[at:end].lower())
        at = end


class TestSet:
    """The suffixes of one benchmark block, ready to be searched for."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        texts: list[np.ndarray] = []
        for name, text in items:
            parts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in part], np.int32) for part in words_of(text)]
            if sum(map(len, parts)):
                self.names.append(name)
                texts += [*parts, np.zeros(1, np.int32)]
        self.bits = max(1, len(self.vocabulary)).bit_length()
        self.per = 64 // self.bits
        self.flat = np.concatenate(texts) if texts else np.zeros(1, np.int32)
        end = self._stops(self.flat)
        item = np.cumsum(self.flat == 0) - (self.flat == 0)
        first = np.concatenate([[True], self.flat[:-1] == 0])
        at = np.arange(len(self.flat))
        begin = np.maximum.accumulate(np.where(first, at, 0))
        size = np.minimum(window, end - begin)
        starts = np.flatnonzero((self.flat > 0) & (at + size <= end))
        self.end, self.depth = end, max(1, -(-int((end - begin).max(initial=0)) // self.per))
        self.whole = max(1, -(-window // self.per))
        # Equal windows get one number; the numbers' places are any of theirs.
        order, tied = sort_suffixes(np.arange(len(starts)), lambda s, k: self._pack(self.flat, starts[s], starts[s] + size[starts[s]], k), self.whole)
        number = np.cumsum(~tied) - 1
        self.start = starts[order[~tied]]
        self.size = size[self.start]
        owners = np.unique(np.stack([number, item[starts[order]]], 1), axis=0) if len(order) else np.zeros((0, 2), np.int64)
        self.owner = owners[:, 1]
        self.owned = np.searchsorted(owners[:, 0], np.arange(len(self.start) + 1))
        self.suffixes, _ = sort_suffixes(np.flatnonzero(self.flat), self._suffix, self.depth)

    @staticmethod
    def _stops(ids: np.ndarray) -> np.ndarray:
        """Of each place, the next one that holds 0, or the end."""
        stop = np.where(ids == 0, np.arange(len(ids)), len(ids))
        return np.minimum.accumulate(stop[::-1])[::-1]

    def _pack(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray, level: int, pad: int = 0) -> np.ndarray:
        """The level-th words of what lies between start and end, as one number that sorts alike."""
        out = np.zeros(len(start), np.uint64)
        for j in range(self.per):
            at = start + level * self.per + j
            out = (out << np.uint64(self.bits)) | np.where(at < end, ids[np.minimum(at, len(ids) - 1)], pad).astype(np.uint64)
        return out

    def _suffix(self, at: np.ndarray, level: int) -> np.ndarray:
        return self._pack(self.flat, at, self.end[at], level)

    def ids(self, text: bytes) -> np.ndarray:
        """The words' numbers; 0 for a word that no item has."""
        get = self.vocabulary.get
        parts = [np.fromiter((get(w, 0) for w in part), np.int32, len(part)) for part in words_of(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def find(self, ids: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence in ``ids`` (0 ends a document) that begins in the
        shard from lo to hi."""
        stop = self._stops(ids)
        key = lambda at, level: self._pack(ids, at, stop[at], level)
        # Suffixes that begin with a word of no item can't match; all others form the array.
        array, _ = sort_suffixes(np.flatnonzero(ids[lo:hi]) + lo, key, self.whole)
        most = (1 << self.bits) - 1
        bound = lambda upper: search(array, key, len(self.start), self.whole, lambda w, level: self._pack(self.flat, self.start[w], self.start[w] + self.size[w], level, most * upper), bool(upper))
        first, last = bound(0), bound(1)
        count = np.maximum(last - first, 0)
        hit = np.flatnonzero(count)
        window = np.repeat(hit, count[hit])
        inner = np.arange(len(window)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        return array[np.repeat(first[hit], count[hit]) + inner], window

    def longest(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Words of the longest match of any test suffix at each place."""
        stop, out = self._stops(ids), np.zeros(len(places), np.int64)
        for lo in range(0, len(places), _PLACES):
            own = places[lo : lo + _PLACES]
            key = lambda rows, level, own=own: self._pack(ids, own[rows], stop[own[rows]], level)
            at = search(self.suffixes, self._suffix, len(own), self.depth, key, False)
            for beside in (at - 1, at):
                there = np.flatnonzero((beside >= 0) & (beside < len(self.suffixes)))
                out[lo + there] = np.maximum(out[lo + there], self._common(key, there, self.suffixes[beside[there]], stop[own[there]] - own[there]))
        return out

    def _common(self, key, rows: np.ndarray, suffixes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words that training suffixes of these lengths and test suffixes share from their start."""
        out, left = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for level in range(self.depth):
            differ = key(rows[left], level) ^ self._suffix(suffixes[left], level)
            same = np.zeros(len(left), np.int64)
            for j in range(self.per):
                same += differ >> np.uint64(self.bits * (self.per - 1 - j)) == 0
            out[left] += same
            left = left[same == self.per]
            if not len(left):
                break
        return np.minimum(out, np.minimum(length, self.end[suffixes] - suffixes))


def _scan(batches: Iterator[pa.RecordBatch], test: TestSet, text: str, schema: pa.Schema, shard_bytes: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def judged() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return _judge(rows, rows.column(text).cast(pa.large_binary()).to_pylist(), test, schema, shard_words)

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(text)])
        cuts = [*(np.flatnonzero(np.diff((sizes + size) // shard_bytes)) + 1), batch.num_rows]
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield judged()
                held = []
        size = int(sizes[-1] + size) % shard_bytes
    if held:
        yield judged()


def _judge(rows: pa.RecordBatch, texts: list[bytes | None], test: TestSet, schema: pa.Schema, shard_words: int) -> pa.RecordBatch:
    parts, ends = [], []
    for t in texts:
        ids = test.ids(t) if t else np.zeros(0, np.int32)
        parts += [ids, np.zeros(1, np.int32)]
        ends.append(len(ids))
    ids = np.concatenate(parts)
    start = np.cumsum([0, *[n + 1 for n in ends]])
    found = [test.find(ids, lo, lo + shard_words) for lo in range(0, len(ids), shard_words)]
    place, window = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place, kind="stable")
    place, window = place[order], window[order]
    edge = np.bincount(place, minlength=len(ids) + 1)[: len(ids) + 1] - np.bincount(place + test.size[window], minlength=len(ids) + 1)[: len(ids) + 1]
    covered = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=np.int8(0))
    begin, finish = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    old = {f.name for f in rows.schema}
    spans = rows.column("__spans").to_pylist() if "__spans" in old else [[] for _ in texts]
    items = rows.column("__items").to_pylist() if "__items" in old else [[] for _ in texts]
    most = np.array(rows.column("__longest").to_pylist() if "__longest" in old else [0] * len(texts), np.int64)
    own, doc = np.searchsorted(start, begin, side="right") - 1, np.searchsorted(start, place, side="right") - 1
    places = np.unique(place)
    np.maximum.at(most, np.searchsorted(start, places, side="right") - 1, test.longest(ids, places))
    for d in np.unique(own):
        a, b = np.searchsorted(own, (d, d + 1))
        new = [{"start": int(x - start[d]), "end": int(y - start[d])} for x, y in zip(begin[a:b], finish[a:b], strict=True)]
        spans[d] = _union([*spans[d], *new])
    for d in np.unique(doc):
        a, b = np.searchsorted(doc, (d, d + 1))
        owners = [test.owner[test.owned[u] : test.owned[u + 1]] for u in np.unique(window[a:b])]
        items[d] = sorted({*items[d], *[test.names[i] for i in np.unique(np.concatenate(owners))]})
    made = {"__words": pa.array(ends, pa.int64()), "__spans": pa.array(spans, schema.field("__spans").type), "__items": pa.array(items, schema.field("__items").type), "__longest": pa.array(most, pa.int64())}
    return pa.RecordBatch.from_arrays([made.get(f.name, rows.column(f.name) if f.name in old else None) for f in schema], schema=schema)


def _union(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True, shard_bytes: int = SHARD_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row of ``docs`` with what of the benchmark stands in it.

    Adds n_words, n_hit (words inside any occurrence of a window), items (ids, as strings, of the
    items with an occurring window), spans (maximal runs of hit words, from 0, end exclusive),
    longest_match (words of the longest verbatim match of a test suffix in this document, 0 without
    an occurring window) and contaminated (n_hit > 0 and 20 n_hit >= n_words); input
    columns of these names give way.

    Null and empty texts have no words. Items with equal ids count as one item, a null id is the
    empty string, items without words are void. Repeated rows are judged alike; an empty
    benchmark hits nothing. ``keep_text=False`` leaves the text out of the result.
    """
    spark = docs.sparkSession
    tests = benchmark.select(F.coalesce(F.col(quoted(item_id)).cast("string"), F.lit("")).alias("name"), F.col(quoted(item_text)).alias("body")).where("body is not null")
    total = tests.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    new = ("n_words", "n_hit", "items", "spans", "longest_match", "contaminated")
    out = docs.drop(*[c for c in docs.columns if c.lower() in new])
    for k in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("name", "body"), F.lit(blocks)) == k) if blocks > 1 else tests
        shared = spark.sparkContext.broadcast(TestSet(sorted((r["name"], r["body"].encode()) for r in part.toLocalIterator()), window))
        state = {"__words": T.LongType(), "__spans": SPAN, "__items": T.ArrayType(T.StringType()), "__longest": T.LongType()}
        last = k == blocks - 1
        fields = [f for f in out.schema.fields if f.name not in state and (f.name != text or keep_text or not last)]
        shape = T.StructType([*fields, *[T.StructField(n, t) for n, t in state.items()]])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, shape=shape) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            yield from _scan(batches, shared.value, text, to_arrow_schema(shape), shard_bytes, shard_words)

        out = out.mapInArrow(scan, shape)
        if not last:
            out = materialize(out, "decontamination")
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return (out.withColumns({"n_words": F.col("__words"), "n_hit": hit, "items": F.col("__items"), "spans": F.col("__spans"), "longest_match": F.col("__longest")})
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("__words", "__spans", "__items", "__longest"))


def items_digest(items: list[str]) -> str:
    """SHA-256 of the sorted, comma-joined item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
