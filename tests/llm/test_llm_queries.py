"""Registered queries that SQL can't express, on the smallest tables, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import llm_brute
from cueloom.llm import secrets, toxicity
from cueloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    con = duckdb.connect()
    return con.execute(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


def result(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


def test_op2(spark, docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = {}
    for d, t, _, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        hs = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        fps[d] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)) if hs else 0
    root = {d: d for d in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = result(spark, "op2_simhash")
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (format(f, "016x"), find(d)) for d, f in fps.items()}


def test_op5(spark, docs):
    seen, want = set(), {}
    for d, t, _, _ in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        want[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in result(spark, "op5_repeats").items()} == want


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op6(spark, folder):
    rows = duckdb.connect().execute(f"select doc_id, lang, source, text from '/root/testdata/{folder}/documents.parquet'").fetchall()
    base = {d: llm_brute.statistics(t) for d, _, _, t in rows}
    got = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, f"/root/testdata/{folder}").collect()}
    for d, n in base.items():
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*n, llm_brute.base_failed(n))
        assert not (r["base_failed"] and r["kept"])
    kept = llm_brute.verdicts([(d, lang, source, (*base[d][:2], *llm_brute.more_counts(t))) for d, lang, source, t in rows if not llm_brute.base_failed(base[d])])
    # The operator counts in bins of distances and stops at small gains, so a few rows may differ.
    assert sum(got[d]["kept"] != k for d, k in kept.items()) <= 0.005 * len(rows) and not all(kept.values())


def grams(text):
    """Hashes of the lower-cased text's n-grams."""
    body, out = [ord(c) for c in (text or "").lower()], set()
    for n in toxicity.SIZES:
        for i in range(len(body) - n + 1):
            h = 0
            for c in body[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
            out.add(((h ^ h >> 29) * 0xD6E8FEB86659FD93) % 2**64 >> 64 - toxicity.BITS)
    return out


def test_op7(spark, docs):
    """Counts, log-count ratios and scores are worked out anew, and the fit is a minimum."""
    con = duckdb.connect()
    toxic = dict(con.execute(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, *_ in docs}
    found = {d: grams(t) for d, t, _, _ in docs}
    train = [d for d in found if d in toxic and not held[d]]
    n = Counter(toxic[d] for d in train)
    count = {k: Counter(f for d in train if toxic[d] == k for f in found[d]) for k in (0, 1)}
    ratio = {}
    for f in {*count[0], *count[1]}:
        p, q = count[1][f] + 1, count[0][f] + 1
        r = math.log(p / (n[1] + 2)) - math.log(q / (n[0] + 2))
        if abs(r) >= toxicity.LEAST_Z * math.sqrt(1 / p - 1 / (n[1] + 2) + 1 / q - 1 / (n[0] + 2)):
            ratio[f] = r
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(toxicity.labelled_rows(frame, spark.read.parquet(f"{SF}/labels.parquet")))
    assert ratio and set(np.flatnonzero(model.weights)) <= set(ratio)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    want = {d: sigmoid(model.bias + sum(model.weights[f] for f in fs)) for d, fs in found.items()}
    got = result(spark, "op7_toxicity")
    for d, r in got.items():
        assert abs(r["score"] - want[d]) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == held[d]
    # The slope of the weighted loss with its ridge, in the scaled features' weights.
    off = {d: (want[d] - toxic[d]) / len(train) for d in train}
    slope = {f: toxicity.PENALTY * model.weights[f] / r + sum(off[d] * r for d in train if f in found[d]) for f, r in ratio.items()}
    assert max(map(abs, slope.values())) < 5e-3 and abs(sum(off.values())) < 5e-3


def test_op8(spark, docs):
    got = result(spark, "op8_sharding")
    size = {d: len((t or "").encode()) + 1 for d, t, _, _ in docs}
    assert {d: (r["size"], r["text_crc32"]) for d, r in got.items()} == {d: (size[d], zlib.crc32((t or "").encode())) for d, t, _, _ in docs}
    groups = {}
    for d, t, _, _ in docs:
        groups.setdefault(t, []).append(d)
    ordered = sorted((min(own), sum(size[d] for d in own), own) for own in groups.values())
    assert all(len({got[d]["shard"] for d in own}) == 1 for _, _, own in ordered)
    shard = [got[own[0]]["shard"] for _, _, own in ordered]
    assert shard == sorted(shard)

    def needed(capacity):
        parts, held = 1, 0
        for _, s, _ in ordered:
            parts, held = (parts, held + s) if held + s <= capacity else (parts + 1, s)
        return parts

    least = next(c for c in range(max(s for _, s, _ in ordered), sum(size.values()) + 1) if needed(c) <= 16)
    loads = Counter()
    for d, r in got.items():
        loads[r["shard"]] += size[d]
    assert max(loads.values()) == least and set(loads) <= set(range(16))
    for s in loads:
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))


def test_op10(spark, docs):
    """Spans and both chains in plain Python."""
    assign = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    base, values, ordinary = {}, Counter(), Counter()
    for d, t, _, _ in docs:
        t = t or ""
        found = [(m.start(), 0, m.end(), m[1]) for m in assign.finditer(t) if len(m[1]) >= 6]
        found += [(m.start(), k, m.end(), m[0]) for k, p, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)) for m in re.finditer(p, t) if len(m[0]) >= least]
        base[d] = sorted(found)
        if found:
            values.update(x[3] for x in found)
        else:
            ordinary.update(re.findall(r"[A-Za-z0-9+/_=-]{8,}", t))
    alphabet = secrets.ALPHABET

    def chain(tokens):
        pairs = Counter()
        for token, n in tokens.items():
            for a, b in zip(token, token[1:], strict=False):
                pairs[a, b] += n
        total = {a: sum(pairs[a, b] for b in alphabet) + 0.5 * len(alphabet) for a in alphabet}
        return lambda a, b: math.log((pairs[a, b] + 0.5) / total[a])

    random_, plain = chain(values), chain(ordinary)
    kinds = secrets.KINDS
    for d, r in result(spark, "op10_secrets").items():
        t = next(x[1] for x in docs if x[0] == d) or ""
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            if not any(s < m.end() and e > m.start() for s, _, e, _ in base[d]):
                ratio = sum(random_(a, b) - plain(a, b) for a, b in zip(m[0], m[0][1:], strict=False))
                more += [(m.start(), 3, m.end())] if ratio > 8 else []
        spans = sorted([*[x[:3] for x in base[d]], *more])
        assert r["spans"] == ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans if k < 3).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds[:3]] == [sum(x[1] == i for x in base[d]) for i in range(3)]


def test_queries_keep_all_rows(spark, docs):
    for name in ("op2_simhash", "op9_mixing"):
        assert QUERIES[name](spark, SF).select(F.count("*")).first()[0] == len(docs)
