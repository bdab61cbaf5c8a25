"""Spelling variants, periodic runs and languages against plain Python, and odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cueloom.llm import language, runs, spelling
from cueloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def lyndon(ids):
    is_lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    return [max(j - i for j in range(i + 1, len(ids) + 1) if is_lyndon(ids[i:j])) for i in range(len(ids))]


def plain_runs(ids):
    found = []
    for q in range(1, len(ids) // 2 + 1):
        i = 0
        while i + q < len(ids):
            start = i
            while i + q < len(ids) and ids[i] == ids[i + q]:
                i += 1
            size = i - start + q
            least = all(any(ids[k] != ids[k + p] for k in range(start, start + size - p)) for p in range(1, q))
            if size >= max(6, 4 * q) and least:
                found.append((start, size, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def samples():
    rng = random.Random(5)
    for _ in range(600):
        ids = [rng.randrange(rng.choice((1, 2, 3, 6))) for _ in range(rng.randrange(40))]
        if ids and rng.random() < 0.6:
            a, p = rng.randrange(len(ids)), rng.randrange(1, 6)
            ids = [x if i < a else ids[min(a + (i - a) % p, len(ids) - 1)] for i, x in enumerate(ids)]
        yield ids


def test_lyndon_arrays_of_the_grouping_phase():
    for ids in samples():
        assert runs.lyndon_array(ids) == lyndon(ids)
        assert runs.lyndon_array([-x for x in ids]) == lyndon([-x for x in ids])


def test_runs():
    for ids in samples():
        assert [(r.start, r.length, r.period) for r in runs.runs_of(np.array(ids, np.int64))] == plain_runs(ids)


def test_runs_of_odd_rows(spark):
    long = " ".join(["x y"] * 50_000)
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n ", "c"), (4, "a b c " * 4, "d"), (4, "a b c " * 4, "d"), (None, "q " * 6, "e"), (5, "b\x0bb\x0cb b\rb\tb", "f"), (6, long, "g"), (7, "one two", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = sorted(runs.find_runs(docs).collect(), key=str)
    by = {r["doc_id"]: r for r in got}
    found = lambda d: [tuple(x) for x in by[d]["runs"]]
    assert len(got) == len(rows) and [r for r in got if r["doc_id"] == 4][0] == [r for r in got if r["doc_id"] == 4][1]
    assert [found(d) for d in (1, 2, 3, 7)] == [[], [], [], []] and by[1]["collapsed"] == "" and by[7]["collapsed"] == "one two"
    assert found(4) == [(0, 12, 3)] and by[4]["collapsed"] == "a b c"
    assert found(None) == [(0, 6, 1)] and by[None]["collapsed"] == "q" and found(5) == [(0, 6, 1)]
    assert found(6) == [(0, 100_000, 2)] and by[6]["collapsed"] == "x y" and by[6]["n_words"] == 100_000
    assert runs.find_runs(docs.limit(0)).collect() == []


def near(word, words):
    letters = sorted({c for w in words for c in w})
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for c in letters for k in (0, 1)}
    return (out - {word}) & set(words)


def plain_variants(counts):
    form = {}
    for w, n in counts.items():
        best = min(near(w, counts), key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near(w, counts)), counts.get(form[w])) for w, n in counts.items()}


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("ranges", [1, 13])
def test_variants(spark, ranges):
    """Also with words dealt over many ranges, whose first prefixes began in earlier ones."""
    rng = random.Random(ranges)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))): rng.choice((1, 2, 20, 20, 300, 4000)) for _ in range(700)}
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(list(counts.items()), "word string, n long")
        assert rows_of(spelling.group_variants(df)) == plain_variants(counts)
        nodes = spelling.with_nodes(df, "nodes").collect()
        number = {r["word"][:k]: x for r in nodes for k, x in enumerate(r["nodes"], 1)}
        assert all(number[r["word"][: k + 1]] == x for r in nodes for k, x in enumerate(r["nodes"])) and len(set(number.values())) == len(number)
        assert [r["word"] for r in sorted(nodes, key=lambda r: r["place"])] == sorted(counts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_variants_of_odd_rows(spark):
    rows = [(None, 5), ("", 3), ("a" * 5_000, 2), ("a" * 4_999 + "b", 40), ("a" * 4_999, 7)]
    df = spark.createDataFrame(rows, "word string, n long").withColumn("place", F.lit("p")).withColumn("form", F.lit(0))
    counts = {w: n for w, n in rows if w is not None}
    assert rows_of(spelling.group_variants(df)) == {("", None, "", 3, 0, None), ("a" * 5_000, "a" * 4_999 + "b", "a" * 4_999 + "b", 2, 2, 40), ("a" * 4_999, None, "a" * 4_999, 7, 2, None), ("a" * 4_999 + "b", None, "a" * 4_999 + "b", 40, 2, None)}
    assert len(counts) == 4 and spelling.group_variants(df.limit(0)).collect() == []
    texts = spark.createDataFrame([(None,), ("",), ("Ünter straße×2 ABCDEFGÀ",), ("abcdefgÀ ünter",)], "text string")
    words = texts.select(F.explode(spelling.words_of(F.col("text"))).alias("word"))
    assert sorted(r["word"] for r in words.collect()) == sorted(["Ünter", "straße×", "abcdefgÀ", "abcdefgÀ", "ünter"])
    assert [tuple(r) for r in spelling.word_counts(words).collect()] == [("abcdefgÀ", 2)]


def test_language(spark):
    """Sizes are added up anew with the learned dictionaries, which no held-out row may touch."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    learned = {k: [(r["text"] or "").translate(low) for r in rows if r["lang"] == k and not held[r["doc_id"]]] for k in model}
    assert sorted(model) == sorted({r["lang"] for r in rows}) and list(model) == sorted(model, key=lambda k: -sum(len(t.encode()) for t in learned[k]))
    for k, content in model.items():
        everything = sum(len(t.encode()) for t in learned[k])
        assert min(language.DICTIONARY_BYTES, everything) // 2 < len(content) <= 1.02 * min(language.DICTIONARY_BYTES, everything)
        for piece in (content[:200].decode(errors="ignore"), content[-200:].decode(errors="ignore")):
            assert any(piece[2:60] in t for t in learned[k])
    pack = {k: zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for k, v in model.items()}
    got = {r["doc_id"]: r for r in QUERIES["op13_language"](spark, SF).collect()}
    right = []
    for r in rows:
        g, body = got[r["doc_id"]], (r["text"] or "").translate(low).encode()
        assert g["held_out"] == held[r["doc_id"]] and 0 <= g["score"] <= 1
        n = {k: sum(len(p.compress(body[i : i + language.BLOCK])) for i in range(0, len(body), language.BLOCK)) for k, p in pack.items()}
        assert g["lang_pred"] == ("und" if not re.search(r"[^\W\d_]", r["text"] or "") else min(n, key=lambda k: (n[k], list(model).index(k))))
        right += [g["lang_pred"] == r["lang"]] if held[r["doc_id"]] else []
    assert sum(right) >= 0.97 * len(right)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 30, "en"), (2, "der hund und die katze " * 30, "de"), (3, None, "en"), (4, "", "de"), (5, "12 !", "en"), (6, "no label", None), (6, "no label", None), (None, "the dog and the cat", "en"), (7, "und die katze " * 40_000, "de")],
                                 "doc_id long, text string, lang string").withColumn("margin", F.lit("x")).withColumn("score", F.lit(7))
    model = language.train(docs)
    assert list(model) == ["de", "en"]
    got = {(r["doc_id"], r["lang"], r["accepted"]) for r in language.identify(docs, model).collect()}
    assert got >= {(1, "en", True), (2, "de", True), (3, "und", False), (4, "und", False), (5, "und", False), (None, "en", True), (7, "de", True)} and language.identify(docs, model).count() == 9
    assert language.train(docs.limit(0)) == {} and language.identify(docs.limit(0), model).collect() == []
    none = language.identify(docs, {}).collect()
    assert {(r["lang"], r["score"], r["accepted"]) for r in none} == {("und", 0.0, False)} and len(none) == 9
    one = {r["doc_id"]: (r["lang"], r["margin"]) for r in language.identify(docs, {"en": b"the cat"}).collect()}
    assert one[2] == ("en", 1.0) and one[4] == ("und", 0.0)
