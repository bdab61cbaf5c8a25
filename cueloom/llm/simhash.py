"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into segments, few enough that two fingerprints within the wanted distance
have one segment in which at most one bit differs. Each segment is indexed once for each of its
bits with that bit wiped out (a one-wildcard variant); fingerprints with an equal variant meet, and
the full distance is verified.

That is certain up to 2 x segments - 1 differing bits, so the number of segments follows from the
distance. With fewer, wider segments less fingerprints share a variant, and pairs beyond the
certain distance meet with the chance that some segment happens to differ by at most one bit;
``found_share`` gives it.

The general operator asks for a share of equal word shingles. Fingerprints within a wide distance
then only form families, and the texts of a family are compared by their shingles themselves, in
blocks of bounded size. What fingerprints miss is found by prefixes of the shingles in one order for
all texts, which texts with that share must have a shingle of in common, and is compared likewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import materialize, quoted, spread
from cueloom.llm.components import connected_components

SHINGLE_WORDS = 5
#: Share of equal shingles (the number in both over the number in either) of near-duplicates.
SIMILARITY = 0.8
#: The general operator's fingerprint, the differing bits within which two of them are candidates,
#: and its segments of 16 bits. At the least similarity 29 of the bits differ on average, with a
#: deviation of 5; up to 23 bits surely meet.
BITS, DISTANCE, SEGMENTS = 192, 38, 12
#: The first 64 bits are those of XXH64 with this seed; the next ones are mixed from them.
SEED = 42
#: Fingerprints of one variant that one task compares with each other at a time.
BUCKET = 32_768
#: Up to this many, a bucket's verified pairs are all reported; beyond, a spanning forest of them.
SMALL = 32
#: Texts and bytes of shingle hashes in one block of a family; every two blocks meet in a task.
BLOCK_TEXTS, BLOCK_BYTES = 256, 4 << 20
#: Texts whose family members are looked up (60 bytes each) that are broadcast; more are joined by
#: shuffle.
BROADCAST_TEXTS = 200_000
#: Ids of rows that go that are broadcast; more are joined by shuffle, with all texts.
BROADCAST_IDS = 1_000_000
#: One text in so many is looked at for frequent shingles, which come last in the order of prefixes: those
#: in so many texts of these, the most frequent ones up to a number that each task holds (8 bytes each).
HOT_SHARE, HOT_TEXTS, HOT_SHINGLES = 16, 2, 1 << 20
#: Up to this many texts with a prefix shingle in common make pairs; more are one family.
PAIRED = 64
#: Shingles whose hashes are held at a time.
_CHUNK = 1 << 16
#: Pairs of fingerprints that are compared in one step.
_PAIRS = 1 << 17
#: Shingles that one step of a block's comparison takes.
_COLUMNS = 4_096
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def cut(bits: int, segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments; none crosses a 64-bit word, each word has two at least."""
    words = bits // 64
    each = max(2, segments // words)
    at = [64 * i // each for i in range(each + 1)]
    return [(64 * w + a, b - a) for w in range(words) for a, b in zip(at, at[1:], strict=False)]


def needed_segments(distance: int) -> int:
    """The fewest segments of which one surely differs in at most one bit."""
    return distance // 2 + 1


def certain_segments(distance: int, bits: int) -> int:
    """``needed_segments``, raised to as many for each 64-bit word, since ``cut`` deals them evenly."""
    words = bits // 64
    return -(-needed_segments(distance) // words) * words


def linked_share(similarity: float, bits: int = BITS, distance: int = DISTANCE) -> float:
    """The chance that two texts with this share of equal shingles are within ``distance`` bits."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(distance + 1))


def found_share(similarity: float, bits: int = BITS, segments: int = SEGMENTS) -> float:
    """The chance that two texts with this share of equal shingles meet in some variant of so many
    segments, however many bits differ."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    miss = 1.0
    for _, w in cut(bits, segments):
        miss *= 1 - (1 - p) ** w - comb(w, 1) * p * (1 - p) ** (w - 1)
    return 1 - miss


def _hashes(words: list[bytes], shingle: int, lo: int, hi: int) -> np.ndarray:
    """XXH64 of the shingles lo to hi - 1; fewer words than a shingle are one."""
    runs = [words[lo + j : hi + j] for j in range(min(shingle, len(words)))]
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(b" ".join(x), SEED) for x in zip(*runs, strict=False)], np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS, bits: int = 64) -> np.ndarray:
    """The SimHash of the lower-cased text's word shingles, repeats included, as 64-bit words."""
    words = text.lower().split() if text else []
    out = np.zeros(bits // 64, np.uint64)
    if not words:
        return out
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros((len(out), 64), np.int64)
    for lo in range(0, n, _CHUNK):
        h = _hashes(words, shingle, lo, min(n, lo + _CHUNK))
        for k in range(len(out)):
            if k:  # the next words' hashes
                h = (h + _STEP) * _MIX
                h ^= h >> np.uint64(32)
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def shingles(text: bytes | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted; none without words."""
    words = text.lower().split() if text else []
    n = max(1, len(words) - shingle + 1) if words else 0
    found = np.zeros(0, np.uint64)
    for lo in range(0, n, _CHUNK):
        found = np.union1d(found, _hashes(words, shingle, lo, min(n, lo + _CHUNK)))
    return found


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, digest, f0, f1, ...) of every row; digest is the text's MD5 in hex (null: of no
    bytes), then come the fingerprint's 64-bit words as signed longs."""
    words = [f"f{k}" for k in range(bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, bits) for t in batch.column(2)], np.uint64).reshape(-1, len(words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(fps[:, k])) for k in range(len(words))]], names=["doc_id", "digest", *words])

    rows = _bodies(docs, doc_id, text)
    return rows.mapInArrow(run, ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest string", *[f"{w} long" for w in words]]))


def _bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b""))
    return docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.md5(body).alias("digest"), body.alias("body"))


def hex_of(*words: str) -> Column:
    """A fingerprint as lower-case hex digits, 16 for each word."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.col(w))), 16, "0") for w in words])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _reported_by(differ: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """The one variant by which a pair is reported: in the first segment with at most one
    differing bit, the wildcard at that bit, or at the segment's first bit if none differs."""
    out = np.full(len(differ), -1, np.int64)
    for first, width in reversed(parts):
        part = differ[:, first // 64] & np.uint64(((1 << width) - 1) << first % 64)
        ones = np.bitwise_count(part)
        out = np.where(ones == 0, first, np.where(ones == 1, first // 64 * 64 + np.bitwise_count(part - np.uint64(1)), out))
    return out


class _Buckets:
    """Compares the members of each bucket; what it reports connects all its verified pairs."""

    def __init__(self, bits: int, distance: int, segments: int):
        self.distance, self.parts, self.words = distance, cut(bits, segments), bits // 64

    def links(self, keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
        """keys: (bit and value, two blocks and side) of each row, sorted; returns pairs."""
        same = np.stack([keys[:, 0], keys[:, 1] >> 1], 1)
        begins = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(begins, len(keys)))
        size, out, bit = np.repeat(sizes, sizes), [], keys[:, 0] >> 32
        end = np.repeat(begins + sizes, sizes)
        across = keys[:, 1] >> 32 != (keys[:, 1] & 0xFFFFFFFF) >> 1
        at = np.flatnonzero((size > 1) & (size <= SMALL) & ~across)
        for step in range(1, SMALL):
            at = at[at + step < end[at]]
            if not len(at):
                break
            near = at[_apart(fps[at], fps[at + step]) <= self.distance]
            near = near[_reported_by(fps[near] ^ fps[near + step], self.parts) == bit[near]]
            out.append(np.concatenate([fps[near], fps[near + step]], 1))
        large = (sizes > SMALL) | (sizes > 1) & across[begins]
        for a, n in zip(begins[large], sizes[large], strict=True):
            out.append(self._forest(fps[a : a + n], int(np.searchsorted(keys[a : a + n, 1] & 1, 1)), int(bit[a])))
        return np.concatenate(out) if out else np.zeros((0, 2 * self.words), np.uint64)

    def _forest(self, fps: np.ndarray, split: int, variant: int) -> np.ndarray:
        """split < len(fps): only pairs across two blocks of a bucket, first and second side."""
        near = self._near(fps, split)
        split, fps = len(near) if split == len(fps) else int(np.searchsorted(near, split)), fps[near]
        n, seen, links = len(fps), np.zeros(len(fps), bool), [np.zeros((0, 2 * self.words), np.uint64)]
        for root in range(n):
            if seen[root]:
                continue
            seen[root], todo = True, [root]
            while todo:
                i = todo.pop()
                lo, hi = (0, n) if split == n else (split, n) if i < split else (0, split)
                at = np.flatnonzero(~seen[lo:hi] & (_apart(fps[lo:hi], fps[i]) <= self.distance)) + lo
                at = at[_reported_by(fps[at] ^ fps[i], self.parts) == variant]
                seen[at] = True
                todo += at.tolist()
                links.append(np.concatenate([np.repeat(fps[i : i + 1], len(at), 0), fps[at]], 1))
        return np.concatenate(links)

    def _near(self, fps: np.ndarray, split: int) -> np.ndarray:
        """The rows, in order, that have another within the distance; pairs as in ``_forest``."""
        n, near, words = len(fps), np.zeros(len(fps), bool), np.ascontiguousarray(fps.T)
        step, end = max(1, _PAIRS // n), min(n, split)
        for lo in range(0, end, step):
            hi, to = min(end, lo + step), lo if split == n else split
            apart = sum((np.bitwise_count(w[lo:hi, None] ^ w[None, to:]) for w in words[1:]), np.bitwise_count(words[0][lo:hi, None] ^ words[0][None, to:]))
            close = apart <= self.distance
            if split == n:
                np.fill_diagonal(close, False)
            i, j = np.nonzero(close)
            near[lo + i] = near[to + j] = True
        return np.flatnonzero(near)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by key; a bucket may go on in the next batch."""
        keys, fps = np.zeros((0, 2), np.int64), np.zeros((0, self.words), np.uint64)
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            blocks = rows[1] if len(rows) == self.words + 2 else np.zeros(len(rows[0]), np.int64)
            keys = np.concatenate([keys, np.stack([rows[0], blocks], 1)])
            fps = np.concatenate([fps, np.stack(rows[-self.words :], 1).view(np.uint64)])
            other = np.flatnonzero((keys[:, 0] != keys[-1, 0]) | (keys[:, 1] >> 1 != keys[-1, 1] >> 1)) if len(keys) else []
            if len(other):
                whole = other[-1] + 1
                yield self._batch(self.links(keys[:whole], fps[:whole]))
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield self._batch(self.links(keys, fps))

    def dealt_by(self, n: int, bucket: int) -> list[tuple[int, int, int, int]]:
        """(segment's first bit, its width, chunk's first bit, its size): chunks of the segments' bits such that of ``n``
        even fingerprints far fewer than ``bucket`` agree in a segment's other bits."""
        least = min(w for _, w in self.parts)
        k = next((k for k in range(2, least) if 4 * n <= bucket << least + least // -k), least)
        ends = [(a, w, w * i // k, w * (i + 1) // k) for a, w in self.parts for i in range(k)]
        return [(a, w, a + lo, hi - lo) for a, w, lo, hi in ends if hi > lo]

    def run_groups(self, batches: Iterator[pa.RecordBatch], chunks: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        """Batches (key, words) sorted by key, the number of one of ``chunks`` and a value; a group may go on in the
        next batch. The variants of the chunk's bits are compared one bit at a time."""
        first, width, at, size = np.array(chunks, np.int64).T
        rest: list[tuple[np.ndarray, np.ndarray]] = []

        def links() -> Iterator[pa.RecordBatch]:
            key, fps = (np.concatenate(c) for c in zip(*rest, strict=True))
            chunk = key >> 32
            value = (fps[np.arange(len(key)), first[chunk] // 64] >> (first[chunk] % 64).astype(np.uint64)).view(np.int64) & ((1 << width[chunk]) - 1)
            for step in range(size.max()):
                there = np.flatnonzero(step < size[chunk])
                if not len(there):
                    continue
                bit = at[chunk[there]] + step
                variant = (bit << 32) + (value[there] & ~(1 << bit - first[chunk[there]]))
                order = np.argsort(variant, kind="stable")
                found = self.links(np.stack([variant[order], np.zeros(len(order), np.int64)], 1), fps[there[order]])
                if len(found):
                    yield self._batch(found)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, *cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            fps = np.stack(cols, 1).view(np.uint64)
            whole = int(np.searchsorted(key, key[-1]))
            if whole or rest and rest[-1][0][-1] != key[0]:
                rest.append((key[:whole], fps[:whole]))
                yield from links()
                rest = []
            rest.append((key[whole:], fps[whole:]))
        if rest:
            yield from links()

    def _batch(self, links: np.ndarray) -> pa.RecordBatch:
        cols = [np.ascontiguousarray(links[:, k]).view(np.int64) for k in range(2 * self.words)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=self.names())

    def names(self) -> list[str]:
        return [f"{end}{k}" for end in "ab" for k in range(self.words)]


def fingerprint_links(fps: DataFrame, bits: int = BITS, distance: int = DISTANCE, segments: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), as hex digits, between the distinct fingerprints in ``fps`` (f0, f1, ...)
    that connect all those which meet and are within ``distance`` bits; each link is verified.
    All within the distance meet, unless fewer ``segments`` are asked for.

    What is shuffled is a row for each chunk of a segment's bits (two or more chunks a segment), dealt by the
    segment's other bits: the variants with a wildcard in that chunk all meet there, and are made and
    sorted within the task. Only groups of more than ``bucket`` fingerprints are dealt by variant. A
    variant shared by more than ``bucket`` of them is split into blocks, and every two of
    its blocks meet in a task of their own. Within a task, a large bucket yields a spanning forest
    of its pairs, never all pairs.
    """
    segments = segments or certain_segments(distance, bits)
    words, buckets = [f"f{k}" for k in range(bits // 64)], _Buckets(bits, distance, segments)
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = materialize(fps.select(*words).distinct(), "distinct-fingerprints")
    chunks = buckets.dealt_by(distinct.count(), bucket)
    shape = ", ".join(f"{n} long" for n in buckets.names())
    # A fingerprint makes a row for each chunk of bits; its variants, one for each bit, are made within the task.
    groups = _keyed(distinct.repartition(tasks, F.xxhash64(*words)).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))), chunks, words)
    large = materialize(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key"), "large-groups")
    n = large.limit(10_001).count()
    rest = groups.join(F.broadcast(large) if n <= 10_000 else large, "key", "left_anti") if n else groups
    found = rest.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: buckets.run_groups(batches, chunks), shape)
    if n:
        found = found.union(_large_groups(groups.join(F.broadcast(large) if n <= 10_000 else large, "key", "left_semi"), chunks, buckets, words, bucket).mapInArrow(buckets.run, shape))
    return found.select(hex_of(*buckets.names()[: len(words)]).alias("a"), hex_of(*buckets.names()[len(words) :]).alias("b"))


def _keyed(rows: DataFrame, chunks: list[tuple[int, int, int, int]], words: list[str]) -> DataFrame:
    """(key, words) of rows (bit, words): key is the number ``bit`` of one of ``chunks`` and the value of its segment
    with the chunk wiped out."""
    at = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bit") + 1)
    word = F.element_at(F.array(*words), at([first // 64 for first, *_ in chunks]).cast("int") + 1)
    mask = at([((1 << width) - 1) & ~(((1 << size) - 1) << bit - first) for first, width, bit, size in chunks])
    value = F.call_function("shiftrightunsigned", word, at([first % 64 for first, *_ in chunks]).cast("int")).bitwiseAND(mask)
    return rows.select((F.call_function("shiftleft", F.col("bit").cast("long"), F.lit(32)) + value).alias("key"), *words)


def _large_groups(groups: DataFrame, chunks: list[tuple[int, int, int, int]], buckets: _Buckets, words: list[str], bucket: int) -> DataFrame:
    """The rows of ``groups`` (key, words) dealt and sorted by variant, (key, block, words), for ``_Buckets.run``: those of a
    variant that more than ``bucket`` of them share by every two of its blocks."""
    single = [(first, width, bit, 1) for first, width in buckets.parts for bit in range(first, first + width)]
    number = F.call_function("shiftright", F.col("key"), F.lit(32)).cast("int") + 1
    at = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in chunks]), number)
    variants = _keyed(groups.select(F.explode(F.sequence(at(2), at(2) + at(3) - 1)).alias("bit"), *words), single, words)
    large = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key", F.ceil(F.col("n") / bucket).cast("long").alias("blocks"))
    large = materialize(large, "large-variants")
    n = large.limit(10_001).count()
    if not n:
        return variants.repartition("key").sortWithinPartitions("key")
    rows = variants.join(F.broadcast(large) if n <= 10_000 else large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(*words), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.call_function("shiftleft", F.least("own", "with"), F.lit(31)) + F.greatest("own", "with")
    variants = rows.select("key", (2 * pair + (F.col("own") > F.col("with")).cast("long")).alias("block"), *words)
    return variants.repartition("key", F.call_function("shiftright", F.col("block"), F.lit(1))).sortWithinPartitions("key", "block")


def similar(sets: list[np.ndarray], split: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places in ``sets`` (distinct sorted numbers each) that connect all pairs with at
    least this share of equal numbers; with ``split`` < len(sets) of those across it only. Two
    empty sets are equal."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    shared = often[number]
    row, column = np.repeat(np.arange(m), size)[shared], place[number[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left = slice(0, m) if split == m else slice(0, split)
    right = slice(0, m) if split == m else slice(split, m)
    common = np.zeros((m, m), np.int64)
    for lo in range(0, int(often.sum()), _COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + _COLUMNS))
        there = np.zeros((m, _COLUMNS), np.float32)
        there[row[a:b], column[a:b] - lo] = 1
        common[left, right] += (there[left] @ there[right].T).astype(np.int64)
    if split < m:
        common[right, left] = common[left, right].T
    either = size[:, None] + size[None] - common
    near = common >= similarity * either - 1e-9
    if split < m:
        near[:split, :split] = near[split:, split:] = False
    out, seen = [], np.zeros(m, bool)
    for root in range(m):
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            out += [(i, int(j)) for j in new]
            todo += new.tolist()
    return out


def _text_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(family, x, y, side, digest, found), sorted -> links (a, b) between digests."""
    at, digests, sets, split = None, [], [], 0

    def links() -> pa.RecordBatch:
        pairs = similar(sets, split if at[1] != at[2] else len(sets), similarity)
        return pa.RecordBatch.from_arrays([pa.array([digests[p[k]] for p in pairs], pa.string()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for *own, side, digest, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own != at:
                if len(sets) > 1:
                    yield links()
                at, digests, sets, split = own, [], [], 0
            digests.append(digest)
            sets.append(np.frombuffer(found, np.uint64))
            split += side == 0
    if len(sets) > 1:
        yield links()


def _asked_for(docs: DataFrame, asked: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``asked`` (digest, least, ...), which is a table, with their bodies."""
    few = asked.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    other = asked.withColumnsRenamed({"digest": "__digest"})
    return _bodies(docs, doc_id, text).join(F.broadcast(other) if few else other, (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("least")))


def _sets(docs: DataFrame, asked: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(family, digest, found) of the texts in ``asked`` (digest, least, family): their shingles' hashes."""
    met = _asked_for(docs, asked, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), shingle).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["family", "digest", "found"])

    return materialize(met.select("family", "digest", "body").mapInArrow(run, "family long, digest string, found binary"), "shingles")


def shingle_links(docs: DataFrame, families: DataFrame, doc_id: str, text: str, shingle: int, similarity: float,
                  block_texts: int = BLOCK_TEXTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between the digests in ``families`` (digest, least, family) that connect all
    pairs of a family with at least this share of equal shingles.

    A family larger than a block is dealt over blocks; every two of them meet in a task of their
    own, which yields a spanning forest of what it finds.
    """
    sizes = materialize(families.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("family"), "families")
    asked = materialize(families.join(sizes, "family").select("digest", "least", F.xxhash64("family").alias("family")), "family-members")
    sets = _sets(docs, asked, doc_id, text, shingle)
    blocks = sets.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_texts), F.ceil(F.sum(F.octet_length("found")) / block_bytes)).cast("int").alias("blocks")).where("blocks > 1")
    blocks = materialize(blocks, "family-blocks")
    n = blocks.limit(10_001).count()
    rows = sets.join(F.broadcast(blocks) if n <= 10_000 else blocks, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("family", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), (F.col("own") > F.col("with")).cast("int").alias("side"), "digest", "found")
    dealt = rows.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "side")
    return dealt.mapInArrow(lambda batches: _text_links(batches, similarity), "a string, b string").where("a <> b")


def prefix(found: np.ndarray, hot: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the sorted shingles ``found``, those in ``hot`` (sorted) last: as many as two texts
    with at least this share of equal shingles need to have one of them in common."""
    at = np.searchsorted(hot, found)
    often = np.zeros(len(found), bool)
    often[at < len(hot)] = hot[at[at < len(hot)]] == found[at < len(hot)]
    least = int(np.ceil(similarity * len(found) - 1e-6))
    return np.concatenate([found[~often], found[often]])[: len(found) - least + 1]


class _Prefixes:
    """Finds the texts that meet by a shingle of their prefixes."""

    #: a and b are texts; n and m their numbers of shingles, i and j the shingle's places in their prefixes. A star
    #: has b as its middle and zeros.
    ROW = "a long, b long, n int, m int, i int, j int"

    def __init__(self, similarity: float, paired: int):
        self.similarity, self.paired = similarity, paired

    def met(self, h: np.ndarray, own: np.ndarray, root: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows sorted by h and own, all of an h. Up to ``paired`` texts make pairs, more a star."""
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
        h, own, root, n, at = (c[first] for c in (h, own, root, n, at))
        begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(begins, len(h)))
        size, end, middle = np.repeat(sizes, sizes), np.repeat(begins + sizes, sizes), np.repeat(begins, sizes)
        apart = np.repeat(np.minimum.reduceat(root, begins) != np.maximum.reduceat(root, begins), sizes)
        star = np.flatnonzero(apart & (size > self.paired) & (own != own[middle]))
        if len(star):
            none = np.zeros(len(star), np.int32)
            yield self._batch(own[star], own[middle[star]], none, none, none, none)
        x = np.flatnonzero(apart & (size <= self.paired))
        for step in range(1, self.paired):
            x = x[x + step < end[x]]
            if not len(x):
                break
            y = x + step
            fits = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= self.similarity * np.maximum(n[x], n[y]) - 1e-6)
            a, b = x[fits], y[fits]
            if len(a):
                a, b = np.where(root[a] < root[b], a, b), np.where(root[a] < root[b], b, a)
                yield self._batch(own[a], own[b], n[a], n[b], at[a], at[b])

    def _batch(self, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n", "m", "i", "j"])

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by h; an h may go on in the next batch."""
        rest: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))
            if whole or rest and rest[-1][0][-1] != rows[0][0]:
                yield from self.met(*[np.concatenate(c) for c in zip(*rest, [c[:whole] for c in rows], strict=True)])
                rest = []
            rest.append([c[whole:] for c in rows])
        if rest:
            yield from self.met(*[np.concatenate(c) for c in zip(*rest, strict=True)])


def _pair_links(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, side, digest, body), sorted, a itself first -> links (a, b) of those like a."""
    own, of = None, np.zeros(0, np.uint64)
    for batch in batches:
        links = []
        for a, side, digest, body in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
            found = shingles(body.as_py(), shingle)
            if side == 0:
                own, of = a, found
                continue
            common = len(np.intersect1d(of, found, assume_unique=True))
            if own == a and common >= similarity * (len(of) + len(found) - common) - 1e-9:
                links.append((a, digest))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.string()) for k in (0, 1)], names=["a", "b"])


def prefix_links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between the digests of different classes that connect all pairs of these with at least
    this share of equal shingles. Each candidate pair is compared by itself, by a's task; texts of a
    group that is too large for pairs are compared as a family."""
    pairs, stars = prefix_candidates(docs, classes, doc_id, text, shingle, similarity)
    pairs = materialize(pairs, "prefix-pairs")
    known = classes.drop("root")
    # Texts go to their pairs as they are, in one exchange: as hashes, shingles take several times as much.
    sides = pairs.select("a", F.col("a").alias("digest"), F.lit(0).alias("side")).distinct().union(pairs.select("a", F.col("b").alias("digest"), F.lit(1).alias("side")))
    asked = materialize(known.join(sides, "digest").select("digest", "least", "a", "side"), "paired-texts")
    met = spread(_asked_for(docs, asked, doc_id, text).select("a", "side", "digest", "body"), "a").sortWithinPartitions("a", "side")
    links = met.mapInArrow(lambda batches: _pair_links(batches, shingle, similarity), "a string, b string")
    families = known.join(connected_components(stars), F.col("digest") == F.col("node")).select("digest", "least", F.col("root").alias("family"))
    return links.union(shingle_links(docs, families, doc_id, text, shingle, similarity))


def prefix_candidates(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, paired: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, stars), (a, b) each, between digests of ``classes`` (digest, least, root): all texts of different
    classes with at least this share of equal shingles are a pair, or connected by stars.

    The order of shingles may be any that is the same for all texts; a sample tells which of them are
    frequent, so that texts meet by rare ones as far as they have any.
    """
    paired = PAIRED if paired is None else paired
    bodies = _bodies(docs, doc_id, text).select(F.xxhash64("digest").alias("id"), "body")

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(1):
                found = shingles(body.as_py(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["h"])

    looked = bodies.where(F.pmod("id", F.lit(HOT_SHARE)) == 0).dropDuplicates(["id"]).mapInArrow(all_of, "h long")
    often = looked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_TEXTS).orderBy(F.desc("n"), "h").limit(HOT_SHINGLES).select("h")
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(often.toPandas()["h"].to_numpy(np.int64).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task's repeated texts
        for batch in batches:
            ids, sizes, of = [], [], []
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own in seen:
                    continue
                seen.add(own)
                found = shingles(body.as_py(), shingle)
                if len(found):
                    ids.append(own)
                    sizes.append(len(found))
                    of.append(prefix(found, hot.value, similarity).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(of, pa.list_(pa.int64()))], names=["id", "n", "hs"])

    # Texts and their classes are numbers here, and the class joins the text before this becomes a row for each
    # shingle: nothing else of that size is shuffled or written. A text that is alone has its own number as root.
    ids = classes.select(F.xxhash64("digest").alias("id"), F.xxhash64("root").alias("root"))
    rows = bodies.mapInArrow(run, "id long, n int, hs array<long>").join(ids, "id").select("id", "root", "n", F.posexplode("hs").alias("at", "h"))
    met = rows.select("h", "id", "root", "n", "at").repartition("h").sortWithinPartitions("h", "id").mapInArrow(_Prefixes(similarity, paired).run, _Prefixes.ROW)
    both = met.groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    # All shingles in common up to the last one of the prefixes are counted, so no more than what is behind
    # it in either text can be in common besides; where a large group is left out, it has the pair.
    most = F.col("c") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    enough = most >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6
    both = materialize(both.where((F.col("n") == 0) | enough).select("a", "b", (F.col("n") == 0).alias("star")), "prefix-met")
    name = lambda c: classes.select(F.xxhash64("digest").alias(c), F.col("digest").alias(f"__{c}"))
    named = both.join(name("a"), "a").join(name("b"), "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"), "star")
    return named.where("not star").select("a", "b"), named.where("star").select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, bits: int = BITS, distance: int = DISTANCE,
                    segments: int | None = SEGMENTS, bucket: int = BUCKET, similarity: float | None = SIMILARITY) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; linked rows, directly or through others,
    share the smallest doc_id of them.

    Texts are linked if their share of equal shingles is at least ``similarity``. Those whose
    fingerprints are in one family, that is within ``distance`` bits directly or through others, are
    compared first, then those that are not linked by now and have a shingle of their prefixes in
    common, as all with that share have. Without a similarity, fingerprints within the distance link by themselves. ``segments``: None
    for as many as let all pairs within the distance meet.

    Texts of fewer words than a shingle are one shingle; null and empty texts have the fingerprint
    zero and no shingles, and are linked with each other (without a similarity, like any other).
    Repeated rows keep their number. Null ids are kept but never give a component its id unless it
    has no other (then it is null).
    """
    words = [f"f{k}" for k in range(bits // 64)]
    fps = materialize(fingerprints(docs, doc_id, text, shingle, bits), "fingerprints")
    node = ["digest", *words] if similarity is not None else words
    own = materialize(fps.groupBy(*node).agg(F.min("doc_id").alias("least")).withColumn("fingerprint", hex_of(*words)), "classes")
    roots = connected_components(fingerprint_links(own, bits, distance, segments, bucket))
    name = "fingerprint"
    classes = own.join(roots, F.col("fingerprint") == F.col("node"), "left").select(*(["digest"] if similarity is not None else []), "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    if similarity is not None:
        name, classes = "digest", materialize(classes, "classes")
        links = shingle_links(docs, classes.select("digest", "least", F.col("root").alias("family")), doc_id, text, shingle, similarity)
        alone = classes.drop("root")
        of = lambda roots: materialize(alone.join(roots, F.col("digest") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "digest").alias("root")), "classes")
        classes = of(connected_components(links))
        missed = prefix_links(docs, classes, doc_id, text, shingle, similarity)
        classes = of(connected_components(classes.select(F.col("digest").alias("a"), F.col("root").alias("b")).union(missed)))
    classes = classes if similarity is not None else materialize(classes, "classes")
    # Written before it is joined, so that a large component's rows can be split between tasks.
    least = materialize(classes.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = classes.join(least, "root").select(name, "component_id")
    return fps.withColumn("fingerprint", hex_of(*words)).join(materialize(named, "named"), name).select("doc_id", "fingerprint", "component_id")


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest id.

    Rows with a null id are kept. Of rows that repeat an id, all that carry the group's smallest
    id stay, unless one of them is dropped for another text.
    """
    groups = near_duplicates(docs, doc_id, text, **how)
    dropped = materialize(groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__dropped")).distinct(), "dropped")
    # The texts themselves are only shuffled where the ids are too many for a task.
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped.hint("merge"), F.col(quoted(doc_id)) == F.col("__dropped"), "left_anti")
