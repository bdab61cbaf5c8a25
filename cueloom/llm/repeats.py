"""Exact repeats of 100 bytes or more, found with two-stage suffix arrays.

How texts come together: in every window of 100 bytes the smallest of its 32-byte pieces, by hash,
is the anchor. Equal windows have equal anchors in equal places, so it is enough to compare windows
whose anchors agree. Neighbouring windows with one anchor make one context, its bytes at most 168.

Equal contexts are collapsed before and after the shuffle: all but the earliest are repeats from
end to end. Anchors with more than one distinct context get the bytes of the earliest of each, and
a task builds the suffix array of many such contexts at a time: suffixes smaller than their
successors are sorted directly, all others are induced by scans of the buckets, and common prefixes
of neighbours of 100 bytes or more tell which windows are equal.

An anchor with very many distinct contexts is dealt over several arrays. Each leaves out the windows
that stand earlier in it; the bytes of the others are dealt out by their hash, and further arrays
compare them, with what is already known of a hash carried from one array to the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import materialize, quoted
from cueloom.llm.suffixes import sort_suffixes

#: Bytes of a repeat, and of an anchor.
LEAST, ANCHOR = 100, 32
#: Bytes that are hashed at a time, and bytes of contexts in one suffix array.
PIECE, ARRAY_BYTES = 1 << 20, 1 << 20
#: Distinct contexts of one anchor that one suffix array takes; those of other anchors are dealt over
#: several arrays.
MOST_CONTEXTS = 8_192

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_NULL_ID = -(1 << 63)
OCCURRENCE = "h long, c long, doc long, th long, start long, extra long"
FOUND = "doc long, th long, start long, end long, h long, shift int"
WINDOW = "h long, doc long, th long, start long, end long, body binary"


class _Powers:
    """Powers of the hash base and of its inverse modulo 2 ** 64."""

    def __init__(self, n: int):
        one = np.ones(1, np.uint64)
        self.up = np.cumprod(np.concatenate([one, np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([one, np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(32))


def contexts(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, powers: _Powers) -> tuple[np.ndarray, ...]:
    """(h, c, first window, last window, anchor) of every context of the texts that lie in
    ``data`` at ``begins``; places are those in ``data``."""
    n = len(data)
    windows = np.maximum(lengths - LEAST + 1, 0)
    if not windows.sum():
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers.up[:n], dtype=np.uint64)])
    grams = _mixed((sums[ANCHOR:] - sums[: n + 1 - ANCHOR]) * powers.down[: n + 1 - ANCHOR])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, width = LEAST - ANCHOR + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = np.repeat(begins, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(at) != 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    a, b, p = at[first], at[last], anchor[first]
    content = (sums[b + LEAST] - sums[a]) * powers.down[a]
    return grams[p], _mixed(content + ((p - a) * 256 + (b - a)).astype(np.uint64) * np.uint64(_BASE)), a, b, p


def _union(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the same document that touch become one; sorted by document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = doc * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate([[True], base[1:] + start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - base[last]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, body) -> contexts; of equal ones in a batch only the earliest goes on, and the
    bytes of the others leave as removed spans (extra < 0: minus the end)."""
    powers = _Powers(PIECE + LEAST)
    for batch in batches:
        doc, th = (batch.column(k).to_numpy() for k in (0, 1))
        texts = batch.column(2)
        found: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush(held: list[tuple[int, int, bytes]], found: list[tuple[np.ndarray, ...]]) -> None:
            if not held:
                return
            lengths = np.array([len(x[2]) for x in held], np.int64)
            begins = np.cumsum(lengths) - lengths
            h, c, a, b, p = contexts(np.frombuffer(b"".join(x[2] for x in held), np.uint8).astype(np.uint64), begins, lengths, powers)
            own = np.searchsorted(begins, a, side="right") - 1
            shift = np.array([x[1] for x in held], np.int64)[own] - begins[own]
            found.append((h, c, np.array([x[0] for x in held], np.int64)[own], a + shift, b - a, p - a))

        for row, text in enumerate(texts):
            body = text.as_py() or b""
            for lo in range(0, max(0, len(body) - LEAST + 1), PIECE - LEAST):
                part = body[lo : lo + PIECE - 1]
                if size + len(part) > PIECE:
                    flush(held, found)
                    held, size = [], 0
                held.append((row, lo, part))
                size += len(part)
        flush(held, found)
        if not found:
            continue
        h, c, row, a, more, back = (np.concatenate(x) for x in zip(*found, strict=True))
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((th, doc))] = np.arange(len(doc))
        order = np.lexsort((a, rank[row], c, h))
        h, c, row, a, more, back = (x[order] for x in (h, c, row, a, more, back))
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        again = ~new & ~((doc[row] == doc[row[lead]]) & (th[row] == th[row[lead]]) & (a == a[lead]))
        gone, start, end = _union(row[again], a[again], (a + more + LEAST)[again])
        yield _batch(OCCURRENCE, np.concatenate([h[new].view(np.int64), th[gone]]), np.concatenate([c[new].view(np.int64), end]),
                     doc[np.concatenate([row[new], gone])], th[np.concatenate([row[new], gone])], np.concatenate([a[new], start]), np.concatenate([(back << 8 | more)[new], -end]))


def _batch(shape: str, *cols: np.ndarray) -> pa.RecordBatch:
    names = [x.split()[0] for x in shape.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in cols], names=names)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by (h, c, doc, th, start) -> removed spans (h null), and the earliest of
    each context of an anchor that has two or more. What is held does not grow with an anchor."""
    lead = np.zeros(6, np.int64)  # the earliest occurrence of the current context
    alone = True  # whether it is the only context of its anchor so far, and not yet sent on
    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([np.zeros(batch.num_rows, np.int64) if c.null_count == len(c) else c.to_numpy() for c in batch.columns])
        passed = x[5] < 0
        spans = [(x[2, passed], x[3, passed], x[4, passed], -x[5, passed])]
        x = x[:, ~passed]
        asked = np.zeros((6, 0), np.int64)
        if x.shape[1]:
            all_ = np.concatenate([lead[:, None], x], 1) if begun else x
            new_h = np.concatenate([[True], all_[0, 1:] != all_[0, :-1]])
            new_c = new_h | np.concatenate([[True], all_[1, 1:] != all_[1, :-1]])
            at = np.maximum.accumulate(np.where(new_c, np.arange(all_.shape[1]), 0))
            again = ~new_c & (all_[2:5] != all_[2:5, at]).any(axis=0)
            spans.append((all_[2, again], all_[3, again], all_[4, again], all_[4, again] + (all_[5, again] & 255) + LEAST))
            heads = np.flatnonzero(new_c)
            same = all_[0, heads[1:]] == all_[0, heads[:-1]]
            send = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            only_head = ~np.concatenate([[False], same])
            if begun and not alone:
                send[0] = False  # it was sent on with an earlier batch
                only_head[0] = False
            asked = all_[:, heads[send]]
            alone = bool(only_head[-1])
            lead, begun = all_[:, heads[-1]].copy(), True
        s = [np.concatenate(y) for y in zip(*spans, strict=True)]
        n, m = len(s[0]), asked.shape[1]
        h = pa.array(np.concatenate([np.zeros(n, np.int64), asked[0]]), pa.int64(), mask=np.arange(n + m) < n)
        yield _batch(FOUND, np.concatenate([s[0], asked[2]]), np.concatenate([s[1], asked[3]]), np.concatenate([s[2], asked[4]]),
                     np.concatenate([s[3], asked[4] + (asked[5] & 255) + LEAST]), h, np.concatenate([np.zeros(n), asked[5] >> 8]).astype(np.int32))


def two_stage_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of several texts, and the next eight bytes of every place as one number.

    ``data`` holds the texts' bytes plus 1, each followed by a 0 at ``ends``. A text's suffixes end
    at its 0; equal ones stand in order of place.
    """
    n = len(data)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    padded = np.concatenate([data, np.zeros(8, data.dtype)]).astype(np.uint64)
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | np.where(k < to_end, padded[k : k + n], 0).astype(np.uint64)
    # A suffix is smaller than its successor if its byte is smaller than the next other byte.
    change = np.append(np.flatnonzero(data[1:] != data[:-1]) + 1, n)
    other = change[np.searchsorted(change, np.arange(n), side="right")] if n else change
    smaller = (np.append(data, 0)[np.minimum(other, n)] > data) | (data == 0)
    levels = -(-int(to_end.max(initial=0)) // 8) + 1
    direct, _ = sort_suffixes(np.flatnonzero(smaller & (data > 0)), lambda s, k: np.where(8 * k < to_end[s], eight[np.minimum(s + 8 * k, n - 1)], 0), levels)
    direct = np.concatenate([ends, direct])
    bounds = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []

    def induce(places: np.ndarray, c: int) -> np.ndarray:
        """Put the predecessors that are larger than these suffixes into their buckets, in this
        order; those of the same bucket are returned, since its scan reaches them next."""
        before = places[places > 0] - 1
        before = before[~smaller[before]]
        first = data[before]
        later = np.argsort(first, kind="stable")
        before, first = before[later], first[later]
        cut = np.append(np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])), len(first)) if len(first) else []
        same = before[:0]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if first[lo] == c:
                same = before[lo:hi]
            else:
                induced[first[lo]].append(before[lo:hi])
        return same

    for c in range(257):
        wave = np.concatenate(induced[c]) if induced[c] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        if c < 256 and bounds[c] < bounds[c + 1]:
            part = direct[bounds[c] : bounds[c + 1]]
            out.append(part)
            induce(part, c)
    return (np.concatenate(out) if out else direct), eight


def common_prefixes(array: np.ndarray, eight: np.ndarray, upto: int = LEAST) -> np.ndarray:
    """Of each suffix with the one before it in ``array``, up to ``upto`` bytes; all of them must
    be that long."""
    out = np.zeros(len(array), np.int64)
    left = np.arange(1, len(array))
    for k in range(0, upto, 8):
        differ = eight[array[left] + k] ^ eight[array[left - 1] + k]
        out[left] += np.where(differ == 0, 8, 7 - np.floor(np.log2(np.maximum(differ, np.uint64(1)).astype(np.float64))).astype(np.int64) // 8)
        left = left[differ == 0]
    return np.minimum(out, upto)


def _late(texts: list[bytes], doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, first byte) of the windows that stand earlier in another of the contexts."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(lengths) - 1
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    array, eight = two_stage_array(data, ends)
    own = np.searchsorted(ends, array)
    long = ends[own] - array >= LEAST
    array, own = array[long], own[long]
    run = np.cumsum(common_prefixes(array, eight) < LEAST)
    place = start[own] + array - (ends[own] - lengths[own] + 1)
    rank = np.empty(len(texts), np.int64)
    rank[np.lexsort((start, th, doc))] = np.arange(len(texts))
    order = np.lexsort((place, th[own], doc[own], run))
    run, own, place = run[order], own[order], place[order]
    lead = np.maximum.accumulate(np.where(np.concatenate([[True], run[1:] != run[:-1]]), np.arange(len(run)), 0)) if len(run) else run
    late = (doc[own] != doc[own[lead]]) | (th[own] != th[own[lead]]) | (place != place[lead])
    return own[late], place[late]


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc, th, start, body) sorted by h -> removed spans; a suffix array takes whole anchors."""
    held: list[pa.RecordBatch] = []

    def compare(rows: pa.Table) -> pa.RecordBatch:
        doc, th, start = (rows.column(k).to_numpy() for k in ("doc", "th", "start"))
        own, a = _late(rows.column("body").to_pylist(), doc, th, start)
        own, a, b = _union(own, a, a + LEAST)
        return _batch("doc long, th long, start long, end long", doc[own], th[own], a, b)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) >= ARRAY_BYTES:
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if cut:
                yield compare(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield compare(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts (h, doc, th, start, body) of hot anchors -> windows: removed spans (h null) of those
    that stand earlier in the same array, and the bytes of the others under their hash."""
    powers = _Powers(LEAST + 256)
    for batch in batches:
        bodies = batch.column("body").to_pylist()
        doc, th, start = (batch.column(k).to_numpy() for k in ("doc", "th", "start"))
        cuts = np.flatnonzero(np.diff(np.cumsum([len(b) for b in bodies]) // ARRAY_BYTES)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(bodies)], strict=True):
            own, place = _late(bodies[lo:hi], doc[lo:hi], th[lo:hi], start[lo:hi])
            gone = {}
            for k, p in zip(own.tolist(), place.tolist(), strict=True):
                gone.setdefault(lo + k, set()).add(p)
            own, a, b = _union(own, place, place + LEAST)
            none = pa.nulls(len(own), pa.int64())
            yield _batch(WINDOW, none, doc[lo + own], th[lo + own], a, b, pa.nulls(len(own), pa.binary()))
            for k in range(lo, hi):
                data = np.frombuffer(bodies[k], np.uint8).astype(np.uint64)
                n = len(data) - LEAST + 1
                left = np.array([i for i in range(n) if int(start[k]) + i not in gone.get(k, ())], np.int64)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers.up[: len(data)], dtype=np.uint64)])
                h = _mixed((sums[LEAST:] - sums[:n]) * powers.down[:n]).view(np.int64)[left]
                yield _batch(WINDOW, h, np.full(len(left), doc[k]), np.full(len(left), th[k]), start[k] + left, start[k] + left + LEAST, pa.array([bodies[k][i : i + LEAST] for i in left], pa.binary()))


def _window_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows (h, doc, th, start, body) sorted by all of these but the body -> removed spans.

    A suffix array takes so many rows; of the last hash in it, the earliest of each different window
    goes on into the next one."""
    held, size = [], 0

    def compare() -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        h, doc, th, start = (rows.column(k).to_numpy() for k in ("h", "doc", "th", "start"))
        own, _ = _late(rows.column("body").to_pylist(), doc, th, start)
        own = np.unique(own)
        late = np.zeros(len(h), bool)
        late[own] = True
        return _batch("doc long, th long, start long, end long", doc[own], th[own], start[own], start[own] + LEAST), rows.take(pa.array(np.flatnonzero(~late & (h == h[-1])))).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= ARRAY_BYTES:
            found, held = compare()
            size = 0
            yield found
    if size:
        yield compare()[0]


def _apply(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for body, spans in zip(batch.column("body"), batch.column("found").to_pylist(), strict=True):
            text = body.as_py() or b""
            s = np.array([(x["start"], x["end"]) for x in spans or ()], np.int64).reshape(-1, 2)
            _, a, b = _union(np.zeros(len(s), np.int64), s[:, 0], s[:, 1])
            whole, kept = hashlib.sha256(), []
            for lo, hi in zip([0, *b], [*a, len(text)], strict=True):
                whole.update(text[lo:hi])
                if keep:
                    kept.append(text[lo:hi])
            rows.append((len(text), int((b - a).sum()), [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)], whole.hexdigest(), b"".join(kept) if keep else None))
        old = [batch.column(k) for k, f in enumerate(batch.schema) if f.name not in ("body", "found")]
        names = [f.name for f in batch.schema if f.name not in ("body", "found")]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([*old, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[*names, "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_NULL_ID))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc, th, start, end): spans of bytes that a window of LEAST bytes covers which also starts
    earlier. doc is the id (null: the least long), th the text's XXH64; spans may overlap."""
    rows = docs.select(_key(F.col(quoted(doc_id))).alias("doc"), F.xxhash64(F.col(quoted(text)).cast("binary")).alias("th"), F.col(quoted(text)).cast("binary").alias("body")).where(F.octet_length("body") >= LEAST)
    occurrences = rows.mapInArrow(_occurrences, OCCURRENCE).repartition("h").sortWithinPartitions("h", "c", "doc", "th", "start")
    found = materialize(occurrences.mapInArrow(_collapse, FOUND), "contexts")
    asked = found.where("h is not null")
    hot = asked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_contexts).select("h", F.lit(True).alias("hot"))
    hot = materialize(hot, "hot-anchors")
    n_hot = hot.limit(10_001).count()
    asked = asked.join(F.broadcast(hot) if n_hot <= 10_000 else hot, "h", "left")
    cut = F.expr("substring(body, cast(start + 1 as int), cast(end - start as int))")
    bodies = asked.join(rows, ["doc", "th"]).select("h", "doc", "th", "start", cut.alias("body"), "hot")
    spans = found.where("h is null").select("doc", "th", "start", "end")
    plain = bodies.where("hot is null").drop("hot").repartition("h").sortWithinPartitions("h")
    spans = spans.unionByName(plain.mapInArrow(_arrays, "doc long, th long, start long, end long"))
    if n_hot:
        windows = materialize(bodies.where("hot").drop("hot").mapInArrow(_windows, WINDOW), "windows")
        spans = spans.unionByName(windows.where("h is null").select("doc", "th", "start", "end"))
        dealt = windows.where("h is not null").select("h", "doc", "th", "start", "body").repartition("h").sortWithinPartitions("h", "doc", "th", "start")
        spans = spans.unionByName(dealt.mapInArrow(_window_arrays, "doc long, th long, start long, end long"))
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = True, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept) of every row: its bytes without those
    that a string of LEAST bytes covers which also starts earlier, in a document with a smaller
    id or earlier in the same one. All is judged on the input, not on what is left.

    kept is binary, since a cut may split a character; ``keep=False`` leaves it null. A null id is
    smaller than all others; of rows that share an id, the one whose text has the smaller XXH64
    counts as earlier, and rows that repeat id and text are one document. Null and empty texts
    have no bytes.
    """
    spans = materialize(repeated_spans(docs, doc_id, text, most_contexts), "spans")
    by_doc = spans.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    body = F.col(quoted(text)).cast("binary")
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), body.alias("body"), _key(F.col(quoted(doc_id))).alias("doc"), F.xxhash64(body).alias("th"))
    joined = rows.join(by_doc, ["doc", "th"], "left").select("doc_id", "body", "found")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(lambda b: _apply(b, keep), f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
