"""Each operator against brute force, with nulls, empty and long texts, repeated rows, empty tables
and clashing columns."""

import base64
import gzip
import hashlib
import pickle
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import llm_brute
from cueloom.llm import (
    common, components, decontamination, mixing, quality, repeats, secrets, sharding, simhash, suffixes, toxicity, url_filter, warc,
)
from cueloom.llm.queries import QUERIES

rng = random.Random(7)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "ëta", "theta", "iota", "kappa"]


def words(n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


LONG = words(30_000)
TEXTS = [None, "", " ", "one two", words(40), words(40), words(200), LONG, "x" * 5_000, "tab\tand\nline\x0b" * 30]


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string{extra}")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s"), (None, TEXTS[5], None, None), (99, TEXTS[6], "de", None)]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


# ---- shared helpers ------------------------------------------------------------------------------
def test_scratch_dir_is_the_sessions(spark):
    assert common.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_ranked(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "a int, b int")
    got = sorted((r["n"], r["a"], r["b"]) for r in common.ranked(df, [F.col("a"), F.col("b")], "n").collect())
    assert [g[0] for g in got] == list(range(100)) and [g[1:] for g in got] == sorted((i % 3, i) for i in range(100))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        if a is not None and a != b and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 -------------------------------------------------------------------------------------------
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/fr/", "block"), ("Example.ORG", "/a", "block"), (None, "/", "block")]
URLS = ["http://www.Example.com/en/1", "https://example.com/en/x?q#f", "http://example.com/EN/", "ftp://a.b.net/fr/2", "http://net", "http://xnet/fr/", None, "no scheme", "http://", "http://a..com/x", "http://x.example.org/abc", "http://example.org?/a", "a://b://c.net/fr/", "http://www.Example.com/en/1"]


def judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    hits = [(len(h + p), h.lower() + p, v) for h, p, v in RULES if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    return (host, path, *(max(hits)[1:] if hits else (None, "allow")))


@pytest.mark.parametrize("limit", [1000, 0])
def test_url_filter(spark, limit):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id int, url string, Verdict string, `a.b` int")
    out = url_filter.filter_urls(pages, url_filter.rules_frame(spark, RULES), broadcast_rules=limit)
    assert sorted(out.columns) == ["a.b", "host", "page_id", "path", "rule", "url", "verdict"]
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()} == {i: judge(u) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("limit", [1000, 0])
def test_the_short_prefix_alone_joins(spark, limit, monkeypatch):
    """The plan joins on the prefix, and digests that share one are told apart."""
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    plan = url_filter.filter_urls(pages, url_filter.rules_frame(spark, RULES), broadcast_rules=limit)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert joins and all("short" in x and "digest" not in x for x in joins)
    monkeypatch.setattr(url_filter, "PREFIX_DIGITS", 0)  # all rules in one list
    out = url_filter.filter_urls(pages, url_filter.rules_frame(spark, RULES), broadcast_rules=limit)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()} == {i: judge(u) for i, u in enumerate(URLS)}


def test_url_filter_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string")
    assert url_filter.filter_urls(pages, url_filter.rules_frame(spark, [])).first()["verdict"] == "allow"
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark, RULES)).count() == 0


# ---- 2 -------------------------------------------------------------------------------------------
def brute_components(fps, distance):
    root = {f: f for f in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in fps:
        for b in fps:
            if a != b and bin(int(a, 16) ^ int(b, 16)).count("1") <= distance:
                root[find(a)] = find(b)
    return {f: frozenset(g for g in fps if find(g) == find(f)) for f in fps}


@pytest.mark.parametrize("bucket", [4096, 2])
def test_links_connect_all_within_distance(spark, bucket):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(6))) for b in base for _ in range(12)]
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in {*base, *near, 0}], "f0 long")
    links = simhash.fingerprint_links(fps, 64, 4, simhash.needed_segments(4), bucket).collect()
    assert all(bin(int(x["a"], 16) ^ int(x["b"], 16)).count("1") <= 4 for x in links)
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    want = brute_components([format(x, "016x") for x in {*base, *near, 0}], 4)
    assert all((got.get(a, a) == got.get(b, b)) == (b in want[a]) for a in want for b in want)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = [tuple(r) for r in simhash.near_duplicates(odd, shingle=4, bits=64, distance=4, segments=3, similarity=None).collect()]
    assert len(got) == odd.count()
    assert {r[2] for r in got if r[1] == "0" * 16} == {0} and (None, 5) in {(r[0], r[2]) for r in got}
    assert simhash.near_duplicates(none).count() == 0


def test_representatives(spark):
    text = words(300)
    changed = text.replace(text.split()[150], "other")
    docs = documents(spark, [(3, text, "en", "s"), (1, changed, "en", "s"), (2, text, "en", "s"), (4, words(300), "en", "s"), (None, text, "en", "s")])
    assert sorted(str(r["doc_id"]) for r in simhash.keep_representatives(docs).collect()) == ["1", "4", "None"]


def plain_fingerprint(text, shingle, bits=64):
    """The contract's fingerprint, bit by bit."""
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", w) if x]
    hs = [xxhash.xxh64(b" ".join(w[i : i + shingle]), seed=42).intdigest() for i in range(max(1, len(w) - shingle + 1))] if w else []
    return format(sum(1 << k for k in range(bits) if 2 * sum(h >> k & 1 for h in hs) > len(hs)), "016x") if hs else "0" * 16


def test_fingerprint_against_plain_counting(spark, odd):
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(odd, shingle=4, bits=64, distance=4, segments=3, similarity=None).where("doc_id is not null").collect()}
    assert got == {i: plain_fingerprint(t or "", 4) for i, t in [*enumerate(TEXTS), (99, TEXTS[6])]}


def shingle_set(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def copies(seed, groups, each, edits):
    """Texts of about 200 words; every group's are edited copies of one base."""
    r, out = random.Random(seed), []
    for g in range(groups):
        base = [f"{r.choice(WORDS)}{r.randrange(500)}" for _ in range(200)]
        for _ in range(each):
            t = list(base)
            for p in r.sample(range(200), r.randrange(edits)):
                t[p] = f"new{r.random()}"
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("blocks", [{}, {"block_texts": 8}, {"block_bytes": 20_000}])
def test_near_duplicates_against_shingles(spark, monkeypatch, blocks):
    for name, value in blocks.items():
        monkeypatch.setattr(simhash.shingle_links, "__defaults__", tuple(value if n == name else d for n, d in (("block_texts", simhash.BLOCK_TEXTS), ("block_bytes", simhash.BLOCK_BYTES))))
    texts = copies(1, 25, 12, 9) + ["", "a b", "A b", "c d"]
    rows = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows).collect()}
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if share(sets[i], sets[j]) >= 0.8]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    assert all(find(i) == find(c) for i, c in got.items())  # nothing else is linked
    assert sum(got[i] == got[j] for i, j in pairs) > 0.95 * len(pairs) > 100


@pytest.mark.parametrize(("paired", "hot"), [(64, 3), (0, 3), (64, 1)])
def test_pairs_that_fingerprints_miss_are_linked(spark, monkeypatch, paired, hot):
    for name, value in (("PAIRED", paired), ("HOT_TEXTS", hot), ("HOT_SHARE", 2)):
        monkeypatch.setattr(simhash, name, value)
    r, texts = random.Random(11), []
    while len(texts) < 12:
        words = [f"w{r.random()}" for _ in range(49)]
        cut_at = r.randrange(5, 45)
        a, b = words, words[:cut_at] + ["other"] + words[cut_at + 1 :]
        prints = [simhash.fingerprint(" ".join(x).encode(), bits=simhash.BITS) for x in (a, b)]
        if share(*(shingle_set(" ".join(x)) for x in (a, b))) >= 0.8 and int(np.bitwise_count(prints[0] ^ prints[1]).sum()) > simhash.DISTANCE:
            texts += [" ".join(a), " ".join(b)]
    texts += ["", "a b", f"{texts[0]} and more words than would leave it alike to the first of them by far, as far as it goes"]
    rows = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(rows).collect()}
    assert got == {i: i - i % 2 if i < 12 else i for i in range(len(texts))}


def test_similar_against_sets():
    r = random.Random(5)
    sets = [np.unique(np.array([r.randrange(60) for _ in range(r.randrange(1, 60))], np.uint64)) for _ in range(40)] + [np.zeros(0, np.uint64)] * 2
    for split in (len(sets), 17):
        near = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and (split == len(sets) or (i < split) != (j < split)) and share(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.5}
        pairs = simhash.similar(sets, split, 0.5)
        root = list(range(len(sets)))
        find = lambda x: x if root[x] == x else find(root[x])
        for i, j in pairs:
            assert (i, j) in near
            root[find(i)] = find(j)
        assert all(find(i) == find(j) for i, j in near)


def test_shares():
    assert simhash.found_share(0.9) > 0.99 and simhash.found_share(0.8) > 0.97
    assert simhash.linked_share(0.8) > 0.95 and simhash.linked_share(0.5) < 0.02


def test_wide_fingerprints_meet(spark):
    """All pairs within the certain distance meet, whatever the bucket size."""
    r = random.Random(4)
    base = [r.getrandbits(192) for _ in range(8)]
    near = [b ^ sum(1 << k for k in r.sample(range(192), r.randrange(24))) for b in base for _ in range(10)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    all_ = sorted({*base, *near})
    fps = spark.createDataFrame([tuple(signed(x >> 64 * k & (1 << 64) - 1) for k in range(3)) for x in all_], "f0 long, f1 long, f2 long")
    name = {"".join(format(x >> 64 * k & (1 << 64) - 1, "016x") for k in range(3)): x for x in all_}
    for bucket in (4096, 3):
        links = simhash.fingerprint_links(fps, 192, 23, 12, bucket).collect()
        got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
        for a, x in name.items():
            for b, y in name.items():
                if (x ^ y).bit_count() <= 23:
                    assert got.get(a, a) == got.get(b, b)


# ---- 3 -------------------------------------------------------------------------------------------
def brute_contamination(docs, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def brute_longest(text, items):
    """Words of the longest run of an item's words in the text, if a window of the item is there."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    w, most = split(text), 0
    for v in (split(t) for t in items):
        for i in range(len(w)):
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                most = max(most, n if n >= min(13, len(v)) else 0)
    return most


@pytest.mark.parametrize(("block", "shard_bytes", "shard_words"), [(8 << 20, 16 << 20, 4_000_000), (400, 2_000, 50)])
def test_contamination(spark, block, shard_bytes, shard_words):
    items = [(1, words(30)), (2, words(14)), (3, "Short item"), (4, None), (None, words(13)), (5, ""), (6, words(30) + "é"), (1, words(20))]
    plant = [t for _, t in items if t]
    docs = [(i, f"{words(rng.randrange(60))} {rng.choice(plant)} {words(rng.randrange(60))}. {rng.choice(plant).upper()}") for i in range(40)]
    # a copy of a window alone beside longer ones
    docs += [(100, None), (101, ""), (102, words(300)), (103, plant[0][: len(plant[0]) // 2]), (1, docs[1][1]), (None, plant[0]), (104, "x " + " ".join(plant[0].split()[4:17]) + " y")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, N_Hit string")
    got = decontamination.find_contamination(frame, spark.createDataFrame(items, "item_id int, text string"), block_bytes=block, shard_bytes=shard_bytes, shard_words=shard_words).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got], key=str) == brute_contamination(docs, items)
    longest = {r["doc_id"]: r["longest_match"] for r in got}
    assert longest[104] == 13 and longest[None] == 30 and longest[102] == longest[100] == 0
    assert all(longest[d] == brute_longest(t, plant) for d, t in docs[:12])


def test_contamination_in_small_shards():
    items = [(str(i), words(20).encode()) for i in range(5)]
    test = decontamination.TestSet(items)
    text = b" ".join([items[0][1], words(50).encode(), items[1][1]] * 3)
    ids = np.concatenate([test.ids(text), [0]]).astype(np.int32)
    whole = sorted(zip(*[x.tolist() for x in test.find(ids)], strict=True))
    parts = [p for lo in range(0, len(ids), 25) for p in zip(*[x.tolist() for x in test.find(ids, lo, lo + 25)], strict=True)]
    assert sorted(parts) == whole and test.longest(ids, np.unique([p for p, _ in whole])).max() == 20


def test_a_block_of_items_stays_small():
    """What is broadcast of a block: a few times its text."""
    r = random.Random(2)
    text = [" ".join(f"w{r.randrange(50_000)}" for _ in range(150)).encode() for _ in range(1_000)]
    test = decontamination.TestSet([(str(i), t) for i, t in enumerate(text)])
    assert len(pickle.dumps(test)) < 10 * sum(map(len, text))


def test_contamination_of_nothing(spark, odd, none):
    items = spark.createDataFrame([], "item_id int, text string")
    assert {r["n_hit"] for r in decontamination.find_contamination(odd, items).collect()} == {0}
    assert decontamination.find_contamination(none, items).count() == 0


# ---- 4 -------------------------------------------------------------------------------------------
def captured(rows):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row."""
    latest = {}
    for i, _, h in rows:
        latest[h or ""] = max(latest.get(h or "", -(1 << 63)), -(1 << 63) if i is None else i)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    return sorted(((i, len((h or "").encode()), digest(h), *(("response", None) if i == latest[h or ""] else ("revisit", latest[h or ""]))) for i, _, h in rows), key=str)


@pytest.mark.parametrize("archive_bytes,range_rows,member_bytes", [(500, 3, warc.MEMBER_BYTES), (1 << 20, 1000, 1000)])
def test_archives(spark, tmp_path, archive_bytes, range_rows, member_bytes):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 50, "WARC/1.1\r\n\r\n" * 3, "<p>a</p>", "big" * 100_000, "".join(chr(32 + rng.randrange(90)) for _ in range(5_000))]
    rows = [(i, f"http://h{i % 3}.example.com/p?{i}", h) for i, h in enumerate(html)] + [(None, None, "<p>a</p>"), (50, "http://x\n.org", "q"), (50, "http://x\n.org", "q"), (10**13, "http://far.org/", "far"), (-5, "http://far.org/", "before")]
    path = f"file://{tmp_path}/archives"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"offset": F.lit("x"), "Digest": F.lit(1)})
    warc.write_archives(pages, path, archive_bytes, member_bytes)
    got = warc.capture_histories(spark, path, range_rows).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == captured(rows)
    order = [(r["urlkey"], r["timestamp"]) for r in got]
    assert order == sorted(order)
    # Any reader of gzip gets the records, all together or one from its place.
    for r in got:
        packed = (tmp_path / "archives" / r["archive"]).read_bytes()
        record = gzip.decompress(packed[r["offset"] : r["offset"] + r["length"]])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record in gzip.decompress(packed)
        assert f"urn:cueloom:capture:{'' if r['page_id'] is None else r['page_id']}>".encode() in record


def test_capture_times_are_utc(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        warc.write_archives(spark.createDataFrame([(0, "http://a.b/", "x"), (86_399, "http://a.b/", "y")], "page_id long, url string, html string"), path := f"file://{tmp_path}/a")
        assert [r["timestamp"] for r in warc.capture_histories(spark, path).collect()] == ["20200101000000", "20200101235959"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


SPILLING = """
import random, sys
from pyspark.sql import SparkSession
from cueloom.llm import warc
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.shuffle.spill.numElementsForceSpillThreshold", "20").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
rng = random.Random(1)
rows = [(i, f"http://h{i % 3}.net/", "".join(map(chr, rng.choices(range(32, 1000), k=3_000)))) for i in range(200)]
warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{sys.argv[1]}/a", 40_000, 1_000)
got = warc.capture_histories(spark, f"{sys.argv[1]}/a").collect()
assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(i, len(t.encode())) for i, _, t in rows]
print("whole")
"""


def test_archives_when_the_sinks_sort_spills(tmp_path):
    """Records of several members stay whole however the sink orders its rows."""
    out = subprocess.run([sys.executable, "-c", SPILLING, f"file://{tmp_path}"], capture_output=True, text=True, timeout=300)
    assert "whole" in out.stdout, out.stderr[-2000:]


def test_archives_of_nothing(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path := f"file://{tmp_path}/a")
    assert warc.capture_histories(spark, path).count() == 0


def test_cut_archives_are_told():
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert next(warc.read_records(memoryview(gzip.compress(record))))[3] == b"hello"
    for bad in (gzip.compress(record)[:-9], gzip.compress(record[:-6]), gzip.compress(b"no" + record)):
        with pytest.raises(ValueError):
            list(warc.read_records(memoryview(bad)))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(9))) for _ in range(k)]
    got = [runs[r][i] for r, i in warc.LoserTree(runs)]
    assert got == sorted(x for run in runs for x in run)


# ---- 5 -------------------------------------------------------------------------------------------
def brute_repeats(rows):
    seen, out = set(), []
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [8192, 1])
def test_repeats(spark, most):
    passages = [words(30), words(60), "the " * 100, "é" * 120, "z" * 150]
    rows = [(i, words(rng.randrange(50)) + rng.choice(passages) + words(rng.randrange(50)) + rng.choice(passages)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, passages[0][:99]), (104, passages[0][:100])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.remove_repeats(docs, most_contexts=most).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == brute_repeats(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_windows_are_carried_between_arrays():
    """Rows of one hash over many batches and arrays: all but the earliest of each window go."""
    r = random.Random(3)
    texts = [bytes(r.randrange(97, 100) for _ in range(100)) for _ in range(3)]
    rows = sorted((1, d, 0, 5 * k, r.choice(texts)) for d in range(400) for k in range(10))
    kinds = [("h", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("body", pa.binary())]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
    size, repeats.ARRAY_BYTES = repeats.ARRAY_BYTES, 20_000
    try:
        found = pa.Table.from_batches(repeats._window_arrays(batch(rows[i : i + 37]) for i in range(0, len(rows), 37)))
    finally:
        repeats.ARRAY_BYTES = size
    first = {}
    for _, d, _, p, t in rows:
        first.setdefault(t, (d, p))
    assert sorted(zip(found["doc"].to_pylist(), found["start"].to_pylist(), strict=True)) == sorted((d, p) for _, d, _, p, t in rows if first[t] != (d, p))


def test_repeats_of_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.remove_repeats(odd).collect()}
    # the null id comes first, so its copy in 5 goes; the two equal rows 4 are one document
    assert got[5, len(TEXTS[5].encode())] == len(TEXTS[5].encode()) and got[None, len(TEXTS[5].encode())] == 0
    assert got[4, len(TEXTS[4].encode())] == 0 and got[99, len(TEXTS[6].encode())] > 0
    assert repeats.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_two_stage_array(seed):
    r = np.random.default_rng(seed)
    texts = [bytes(r.integers(97, 97 + r.integers(1, 4), r.integers(0, 60)).astype(np.uint8)) for _ in range(r.integers(1, 5))]
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    ends = np.flatnonzero(data == 0)
    array, _ = repeats.two_stage_array(data, ends)
    suffix = lambda i: bytes(data[i : ends[np.searchsorted(ends, i)] + 1])
    assert array.tolist() == sorted(range(len(data)), key=lambda i: (suffix(i), i))


def test_sort_suffixes_levels():
    values = np.array([[1, 2], [1, 1], [0, 9], [1, 2]])
    order, tied = suffixes.sort_suffixes(np.arange(4), lambda s, k: values[s, k].astype(np.uint64), 2)
    assert order.tolist() == [2, 1, 0, 3] and tied.tolist() == [False, False, False, True]


# ---- 6 -------------------------------------------------------------------------------------------
def test_statistics(spark):
    texts = [*TEXTS, "a b c d e f g h " * 5, "x\ny\nx\n\n \n x", "#*$%&|<> é", words(30) + " " + words(9) * 2, "a " * 100]
    out = quality.base_statistics(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).withColumn("n_WORDS", F.lit("x")))
    for r in out.collect():
        assert tuple(r[c] for c in quality.STATISTICS) == llm_brute.statistics(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == llm_brute.more_counts(texts[r["doc_id"]])


def test_outliers_go_and_clean_rows_stay(spark):
    rows = [(i, words(rng.randrange(30, 300)), "en", "s") for i in range(300)] + [(1000 + i, " ".join("#$%" + w for w in words(60).split()), "en", "s") for i in range(20)]
    rows += [(2000, None, None, None), (2001, words(50), None, "tiny"), (2002, "few words", "en", "s")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(quality.base_statistics(documents(spark, rows)).drop("text")).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(20))
    assert not kept[2000] and kept[2001] and not kept[2002]


@pytest.mark.parametrize(("sources", "broadcast"), [(1, 100_000), (20, 0), (400, 100_000)])
def test_verdicts_against_plain_estimates(spark, monkeypatch, sources, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", broadcast)
    # 1: one large group; 20: small sources of one large language; 400: sources of a single row
    r = random.Random(11)
    clean = lambda i: " ".join(("#" if r.random() < 0.05 else "") + "w" * r.randrange(3, 9) + str(r.randrange(10**6)) for _ in range(60 + i % 50))
    texts = [clean(i) for i in range(380)] + [" ".join("#$%" + "w" * r.randrange(3, 9) for _ in range(60)) for _ in range(20)]
    rows = [(i, t, "en" if sources < 400 else f"l{i % 20}", f"s{i % sources}") for i, t in enumerate(texts)]
    kept = {v["doc_id"]: v["kept"] for v in quality.judge(quality.base_statistics(documents(spark, rows))).where("not base_failed").collect()}
    base = {i: llm_brute.statistics(t) for i, t, _, _ in rows}
    want = llm_brute.verdicts([(i, lang, source, (*base[i][:2], *llm_brute.more_counts(t))) for i, t, lang, source in rows if not llm_brute.base_failed(base[i])])
    assert kept.keys() == want.keys() and sum(kept[i] != want[i] for i in want) <= 0.01 * len(want)
    assert set(kept) >= set(range(380, 400)) and not any(kept[i] for i in range(380, 400)) and all(kept[i] for i in range(380))


def test_a_text_is_judged_by_its_own_group(spark):
    """No fixed limits: the same text is usual in one language and an outlier of the other."""
    r = random.Random(3)
    few, many = ["w" * r.randrange(1, 7) + str(k) for k in range(150)], ["w" * r.randrange(9, 16) + str(k) for k in range(150)]
    say = lambda own, rare: " ".join(r.choice(own) + (r.choice(",.!") if r.random() < 0.2 else "") + ("A" if r.random() < rare else "") for _ in range(r.randrange(60, 200)))
    a, b = [say(few, 0.1) for _ in range(300)], [say(many, 0.3) for _ in range(300)]
    rows = [(i, t, "a", "s") for i, t in enumerate(a)] + [(1000 + i, t, "b", "s") for i, t in enumerate(b)]
    rows += [(2000, a[0], "b", "s"), (2001, b[0], "a", "s")]
    kept = {v["doc_id"]: v["kept"] for v in quality.judge(quality.base_statistics(documents(spark, rows))).collect()}
    assert sum(kept[i] for i in kept if i < 2000) >= 594 and kept[0] and kept[1000]
    assert not kept[2000] and not kept[2001]


def test_quality_of_nothing(spark, none):
    assert quality.judge(quality.base_statistics(none)).count() == 0


def test_covariance_is_that_of_numpy(spark):
    x = np.random.default_rng(1).normal(size=(500, 5)) @ np.triu(np.random.default_rng(2).normal(size=(5, 5)) + 2 * np.eye(5))
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, x0 double, x1 double, x2 double, x3 double, x4 double")
    r = quality._root(quality._estimate(rows, ["g"]), "cov").first()
    white = np.zeros((5, 5))
    white[np.tril_indices(5)] = r["root"]
    low = np.linalg.inv(white)
    assert np.allclose(low @ low.T, np.cov(x.T, bias=True)) and np.allclose(r["center"], x.mean(0)) and np.isclose(r["spread"], np.log(np.diag(low)).sum())


# ---- 7 -------------------------------------------------------------------------------------------
def test_toxicity(spark):
    bad = ["wretch", "vermin", "scoundrel"]
    rows = [(i, words(60) + (" " + rng.choice(bad) + " " + words(5) if i % 4 == 0 else ""), "en", "s") for i in range(800)]
    docs = documents(spark, rows + [(None, None, "en", "s"), (9001, "", "en", "s"), (9002, LONG, "en", "s")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(None, 1), (3, None), (8, 1)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled_rows(docs, labels))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = {r["doc_id"] for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()} - {None, 9001, 9002}
    assert len(held) > 100 and np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[9001] == got[None] and got[9002] < 0.5


def test_toxicity_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled_rows(odd, labels))
    assert {r["score"] for r in toxicity.score(odd, model).collect()} == {0.5}
    assert toxicity.score(none, model).count() == 0


def test_features_of_a_long_text_do_not_depend_on_the_chunk(monkeypatch):
    mark = np.zeros(1 << toxicity.BITS, bool)
    whole = toxicity.features(LONG, mark)
    monkeypatch.setattr(toxicity, "_CHUNK", 1000)
    assert (toxicity.features(LONG, mark) == whole).all() and not mark.any()


# ---- 8 -------------------------------------------------------------------------------------------
def need(sizes, capacity):
    n, held = 1, 0
    for s in sizes:
        if held + s > capacity:
            n, held = n + 1, 0
        held += s
    return n


@pytest.mark.parametrize("cells", [65_536, 40])
def test_shards_are_minimax(spark, cells):
    rows = [(i, words(rng.randrange(1, 80)), "en", "s") for i in range(300)]
    rows += [(400 + i, rows[7][1], "en", "s") for i in range(20)] + [(500, None, "en", "s"), (501, "", "en", "s"), (502, None, "en", "s")]
    got = sharding.shard_documents(documents(spark, rows), 7, cells=cells).collect()
    first, size = {}, {}
    for i, t, *_ in rows:
        first[t] = min(first.get(t, i), i)
        size[t] = size.get(t, 0) + len((t or "").encode()) + 1
    sizes = [size[t] for t in sorted(first, key=first.get)]
    least = next(c for c in range(max(sizes), sum(sizes) + 1) if need(sizes, c) <= 7)
    by, group = {}, {}
    for r in got:
        by[r["shard"]] = by.get(r["shard"], 0) + len((r["text"] or "").encode()) + 1
        assert group.setdefault(r["text"], r["shard"]) == r["shard"]
    assert max(by.values()) == least and len(got) == len(rows)


def test_slots_have_no_gap(spark, odd, none):
    rows = sharding.shard_documents(odd, 3).select("doc_id", "shard", "group_start")
    by = {}
    for r in sharding.number_slots(rows, ["doc_id"]).collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(none).count() == 0


# ---- 9 -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(5))
def test_pattern_deviates_by_less_than_a_block(seed):
    r = random.Random(seed)
    shares = mixing.shares_of({f"s{i}": r.random() ** 3 + 0.001 for i in range(r.randrange(1, 30))}, 500)
    assert sum(shares.values()) == 500
    count = dict.fromkeys(shares, 0)
    for source, k, release, deadline, slot in mixing.pattern(shares):
        assert release <= slot < deadline and k == count[source]
        count[source] += 1
        assert all(abs(count[s] - shares[s] * (slot + 1) / 500) < 1 for s in shares)


def test_a_long_pattern_is_written_in_parts(spark, monkeypatch):
    docs = documents(spark, [(i, "x", "en", f"s{i % 5}") for i in range(900)])
    weights = {"s0": 0.1234567, "s1": 0.2345678, "s2": 0.3, "s3": 0.2, "s4": 0.1419755}
    want = sorted(map(tuple, mixing.mix(docs, weights, block_rows=1).select("doc_id", "slot", "release", "deadline").collect()))
    monkeypatch.setattr(mixing, "_PART", 100)
    assert sorted(map(tuple, mixing.mix(docs, weights, block_rows=1).select("doc_id", "slot", "release", "deadline").collect())) == want
    assert all(release <= slot < deadline for _, slot, release, deadline in want)


def test_mix_keeps_all_rows(spark, odd, none):
    weights = {"s": 3.0, "t": 1.0}
    docs = odd.unionByName(documents(spark, [(200 + i, "x", "en", "t") for i in range(40)])).withColumn("SLOT", F.lit("x"))
    got = mixing.mix(docs, weights, block_rows=2, period=4).collect()
    assert len(got) == docs.count()
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert all(len(v) == 1 for v in slots.values()) and max(r["slot"] for r in got if r["source"]) < min(r["slot"] for r in got if not r["source"])
    assert mixing.mix(none, weights).count() == 0 and mixing.mix(odd, {}).count() == odd.count()


def test_exact_weights_never_drift(spark):
    weights = {f"s{i}": w for i, w in enumerate([4.0, 3.0, 2.0] + [1.0] * 17)}
    docs = spark.range(26 * 100).selectExpr("id as doc_id", "concat('s', case when id % 26 < 4 then 0 when id % 26 < 7 then 1 when id % 26 < 9 then 2 else id % 26 - 6 end) as source")
    got = sorted((r["slot"], r["source"]) for r in mixing.mix(docs, weights, block_rows=1).collect())
    assert [slot for slot, _ in got] == list(range(2600))
    done = dict.fromkeys(weights, 0)
    for slot, source in got:
        done[source] += 1
        assert all(abs(n - weights[s] / 26 * (slot + 1)) < 1 for s, n in done.items())


def test_more_sources_than_thousand(spark, tmp_path):
    docs = spark.range(3_000).selectExpr("id as doc_id", "concat('s', id % 1500) as source")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = QUERIES["op9_mixing"](spark, f"file://{tmp_path}").collect()
    assert len(got) == 3_000 and {r["place"] for r in got} == {0, 1} and len({r["slot"] for r in got}) == 1_500
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_weights_of_a_long_period(spark):
    weights = {"a": 0.1234567890123, "b": 0.31415926535, "c": 1e-9}
    docs = spark.range(300).selectExpr("id as doc_id", "case when id = 0 then 'c' when id % 4 = 0 then 'a' else 'b' end as source").where("source <> 'c'")
    got = mixing.mix(docs, weights, block_rows=1).collect()
    assert len(got) == 299 and len({r["slot"] for r in got}) == 299 and all(r["release"] <= r["slot"] < r["deadline"] for r in got)


# ---- 10 ------------------------------------------------------------------------------------------
def brute_spans(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(s, e, secrets.KINDS[k]) for s, k, e in sorted(found)]


SECRETS = ["token=abc", "PassWord: 'abc+/9='", 'token: "token":abcdefgh', "api_key = secret=abcdefgh", "apikey:short", "AKIA" + "Z9" * 9, "AKIA12AKIA" + "Q" * 17, "0123456789abcdef" * 3, "é token=éabcdefg x\u0001y\u0002 secret:123456", "token=aaaaaa " * 700, "ſecret=abcdefgh", "toKen=abcdefgh"]


def test_spans(spark, odd, none):
    texts = [*TEXTS, *SECRETS, words(10).join(SECRETS)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).withColumn("Spans", F.lit(1))
    for r in secrets.scan(docs, [0.0] * len(secrets.ALPHABET) ** 2).collect():
        assert [(s["start"], s["end"], s["kind"]) for s in r["spans"]] == brute_spans(texts[r["doc_id"]])
    assert secrets.scan(none, secrets.train(secrets.samples_from(none))).count() == 0


def test_markov_finds_a_bare_random_string(spark):
    r = random.Random(5)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    samples = [("".join(r.choices(chars, k=32)), True, 1) for _ in range(300)] + [(re.sub("[^a-z]", "", words(6)), False, 1) for _ in range(300)]
    model = secrets.train(spark.createDataFrame(samples, "token string, random boolean, n long"))
    texts = ["see " + "".join(r.choices(chars, k=40)), "see " + re.sub("[^a-z]", "", words(8))]
    out = {x["doc_id"]: [s["kind"] for s in x["spans"]] for x in secrets.scan(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), model).collect()}
    assert out == {0: ["markov"], 1: []}


@pytest.mark.parametrize(("bits", "segments", "n", "most"), [(192, 12, 2_000_000, 24), (192, 12, 10**8, 96), (64, 3, 10**8, 12)])
def test_fingerprints_are_dealt_by_few_rows(bits, segments, n, most):
    """A fingerprint makes far fewer rows than it has bits; each bit is the wildcard of one of them."""
    buckets = simhash._Buckets(bits, 4, segments)
    chunks = buckets.dealt_by(n, simhash.BUCKET)
    assert len(chunks) <= most
    assert sorted(b for _, _, at, size in chunks for b in range(at, at + size)) == list(range(bits))
    assert all(first <= at and at + size <= first + width and n >> width - size <= simhash.BUCKET for first, width, at, size in chunks)
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 62, (40, bits // 64)).astype(np.uint64).repeat(5, 0) ^ (np.uint64(1) << rng.integers(0, 60, (200, bits // 64)).astype(np.uint64)), axis=0)
    keys = [(c << 32 | (int(f[a // 64]) >> a % 64 & (1 << w) - 1 & ~(((1 << z) - 1) << b - a)), *f.view(np.int64).tolist()) for f in fps for c, (a, w, b, z) in enumerate(chunks)]
    rows = pa.table(list(zip(*sorted(keys), strict=True)), names=["key", *[f"f{k}" for k in range(bits // 64)]])
    found = [tuple(r.values()) for b in buckets.run_groups(iter(rows.to_batches(max_chunksize=64)), chunks) for r in b.to_pylist()]
    root = {x: x for x in map(tuple, fps.view(np.int64).tolist())}
    find = lambda x: x if root[x] == x else find(root[x])
    for r in found:
        root[find(r[: bits // 64])] = find(r[bits // 64 :])
    near = [(a, b) for a in root for b in root if a < b and sum((x ^ y & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True)) <= 4]
    assert near and all(find(a) == find(b) for a, b in near)


def test_keeping_representatives_shuffles_no_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i // 2} " * 30) for i in range(8)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs, *_: docs.select("doc_id", F.expr("doc_id - doc_id % 2").alias("component_id")))
    for ids in (simhash.BROADCAST_IDS, 2):
        monkeypatch.setattr(simhash, "BROADCAST_IDS", ids)
        kept = simhash.keep_representatives(docs)
        assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6]
        assert ("SortMergeJoin" in kept._jdf.queryExecution().executedPlan().toString()) == (ids == 2)


@pytest.mark.parametrize("paired", [64, 3])
def test_prefix_candidates_write_no_row_a_shingle(spark, monkeypatch, paired):
    """All pairs of 0.8 or more are found, with pairs alone and with stars, and what is written does not grow
    with the shingles that texts have in common."""
    rng = np.random.default_rng(7)
    base = [[f"w{w}" for w in rng.integers(0, 5000, 300)] for _ in range(4)]
    texts = [" ".join(w if k != 40 * j + 7 else f"x{j}" for k, w in enumerate(b)) for b in base for j in range(6)] + ["", "one", "one two three"]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:5]])), "doc_id long, text string")
    written, write = [], simhash.materialize

    def materialize(df, name):
        written.append(write(df, name))
        return written[-1]

    classes = simhash._bodies(docs, "doc_id", "text").groupBy("digest").agg(F.min("doc_id").alias("least")).withColumn("root", F.col("digest")).localCheckpoint()
    monkeypatch.setattr(simhash, "materialize", materialize)
    pairs, stars = simhash.prefix_candidates(docs, classes, "doc_id", "text", 5, 0.8, paired)
    at = {r["digest"]: r["least"] for r in classes.collect()}
    root = {i: i for i in at.values()}
    find = lambda x: x if root[x] == x else find(root[x])
    for r in stars.collect():
        root[find(at[r["a"]])] = find(at[r["b"]])
    met = {frozenset((at[r["a"]], at[r["b"]])) for r in pairs.collect()}
    sets = {i: set(simhash.shingles(texts[i].encode(), 5).tolist()) for i in root}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(near) == 60 and all({*p} in met or find(p[0]) == find(p[1]) for p in near)
    assert sum(df.count() for df in written) <= 2 * len(near)


def test_prefix_links_write_no_shingles(spark, monkeypatch):
    """Texts of different classes that meet in pairs are all linked where they are alike, and only so; no table
    of their shingles is written."""
    rng = np.random.default_rng(11)
    base = [[f"w{w}" for w in rng.integers(0, 5000, 200)] for _ in range(3)]
    texts = [" ".join(w if k >= 12 * j else f"x{j}" for k, w in enumerate(b)) for b in base for j in range(6)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:4], "", None])), "doc_id long, text string")
    written, write = [], simhash.materialize

    def materialize(df, name):
        written.append(write(df, name))
        return written[-1]

    classes = simhash._bodies(docs, "doc_id", "text").groupBy("digest").agg(F.min("doc_id").alias("least")).withColumn("root", F.col("digest")).localCheckpoint()
    monkeypatch.setattr(simhash, "materialize", materialize)
    links = simhash.prefix_links(docs, classes, "doc_id", "text", 5, 0.8).collect()
    at = {r["digest"]: r["least"] for r in classes.collect()}
    sets = [set(simhash.shingles(t.encode(), 5).tolist()) for t in texts]
    near = {(a, b) for a in range(18) for b in range(a + 1, 18) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert near and {tuple(sorted((at[r["a"]], at[r["b"]]))) for r in links} == near
    assert sum(df.count() for df in written if "found" in df.columns) == 0
