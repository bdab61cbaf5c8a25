"""What has to hold for long episodes, long spans, many phrases and endless streams."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.functions.phrases import Phrases, fold
from cueloom.operators import glossary, joins, nearest, reflow, scan, timing
from cueloom.plans import adaptors, caption_queries
from cueloom.plans.registry import QUERIES
from cueloom.streaming.streams import space_saving, stream_mine

KEYS = "show string, episode long"


# ---- scans by segments ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def long_words(spark):
    """Two episodes of many segments, a short one, and rows without keys; times with holes."""
    r, rows = random.Random(8), []
    for show, episode, n in (("s", 1, 700), ("s", 2, 5), ("t", 1, 300), (None, 1, 40), ("u", None, 30)):
        t = 0
        for pos in sorted(r.sample(range(3 * n), n)):
            t += r.choice([100, 400, 600, 900])
            start, end = (None if r.random() < 0.2 else t), (None if r.random() < 0.2 else t + r.choice([-50, 80, 300]))
            rows.append((show, episode, pos, r.choice(["word", "end.", "clause,", "long" * 4]), start, end, 0.9, pos // 29 if r.random() < 0.98 else None))
    return spark.createDataFrame(rows, f"{KEYS}, pos long, text string, start long, end long, prob double, seg long").cache()


def chain(words, long):
    out = reflow.fill_timestamps(words, long=long)
    out = reflow.dejitter(out, 500, long=long)
    return reflow.split_sentences(reflow.split_spans(out, 500, long=long), long=long)


def test_segments_give_what_whole_episodes_give(spark, long_words, monkeypatch):
    want = chain(long_words, None)
    whole = sorted(map(tuple, want.collect()), key=str)
    monkeypatch.setattr(scan, "SEGMENT", 64)
    long = scan.long_episodes(long_words, joins.KEYS)
    assert sorted(map(tuple, long.collect())) == [("s", 1), ("t", 1)]
    got = chain(long_words, long)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == whole
    monkeypatch.setattr(scan, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, chain(long_words, scan.long_episodes(long_words, joins.KEYS)).select(want.columns).collect()), key=str) == whole


def test_reflow_of_a_long_episode(spark, long_words, monkeypatch):
    segments = spark.createDataFrame([], f"{KEYS}, seg long, start long, end long, no_speech_prob double")
    cards = lambda: sorted(map(tuple, reflow.reflow(long_words.where("episode is not null"), segments, gap=500, max_dur=7000, min_dur=830, cps=0.017, min_gap=83).collect()), key=str)
    want = cards()
    monkeypatch.setattr(scan, "SEGMENT", 64)
    assert cards() == want and len(want) > 50


def test_no_segment_of_a_scan_is_long(spark, monkeypatch):
    """Rows of one window partition are those of one segment, however long the episode is."""
    monkeypatch.setattr(scan, "SEGMENT", 1000)
    words = spark.range(50_000).select(F.lit("s").alias("show"), F.lit(1).cast("long").alias("episode"), F.col("id").alias("pos"), (F.col("id") * 400).alias("start"), (F.col("id") * 400 + 300).alias("end"))
    out = scan.SegmentedScan(words, joins.KEYS).running({"n": scan.Running("sum", F.lit(1))})
    assert out.df.agg(F.max("n"), F.sum("n")).first() == (50_000, 50_000 * 50_001 // 2)
    plan = out.df._jdf.queryExecution().toString()
    assert all("__segment" in line for line in re.findall(r"(?<=windowspecdefinition\()[^)]*", plan) if "pos" in line)


# ---- spans of any length -------------------------------------------------------------------------
def test_a_span_makes_few_rows(spark):
    right = spark.createDataFrame([("s", 1, float(k), k + 0.4) for k in range(0, 4000, 2)] + [("s", 1, 0.0, 4000.0), ("s", 1, 0.5, 0.5)], f"{KEYS}, b0 double, b1 double")
    left = spark.createDataFrame([("s", 1, 0, 0.0, 4000.0), ("s", 1, 1, 100.1, 100.2), ("s", 1, 2, 3999.0, 1e9), ("s", 1, 3, 7.0, 7.5)], f"{KEYS}, i int, a0 double, a1 double")
    levels = F.array(*[F.lit(k) for k in range(joins.LOWEST, joins.HIGHEST + 1)])
    most = joins._in_cells(left, F.col("a0"), F.col("a1"), levels, "l").groupBy("i", "__level").count().agg(F.max("count")).first()[0]
    assert most <= 2
    join = lambda how: joins.range_join(left, right, ("a0", "a1"), ("b0", "b1"), how=how)
    counts = {r["i"]: r["count"] for r in join("inner").groupBy("i").count().collect()}
    assert counts == {0: 2001, 1: 2, 2: 1, 3: 1} and {r["i"] for r in join("semi").collect()} == {0, 1, 2, 3} and join("anti").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_hot_moments_are_swept(spark, seed):
    """Very many spans at one time, touching ends among them."""
    r = random.Random(seed)
    span = lambda: (s := r.randrange(40), s + r.choice([0, 0, 1, 1, 2, 30]))
    a, b = [(i, *span()) for i in range(150)], [span() for _ in range(25)]
    left = spark.createDataFrame([("s", 1, *x) for x in a], f"{KEYS}, i int, a0 long, a1 long")
    right = spark.createDataFrame([("s", 1, *x) for x in b], f"{KEYS}, b0 long, b1 long")
    want = {i for i, s, e in a if any(min(e, v) > max(s, u) for u, v in b)}
    semi = joins.range_join(left, right, ("a0", "a1"), ("b0", "b1"), how="semi")
    assert sorted(x["i"] for x in semi.collect()) == sorted(want)
    assert sorted(x["i"] for x in joins.range_join(left, right, ("a0", "a1"), ("b0", "b1"), how="anti").collect()) == sorted({i for i, *_ in a} - want)


def test_onsets_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(joins, "RADII", 2)
    r = random.Random(1)
    cues = sorted(r.randrange(0, 900) / 2 for _ in range(120))
    onsets = [r.randrange(0, 1000) / 2 for _ in range(150)]
    c = spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(onsets)], f"{KEYS}, card_no long, start double")
    q = spark.createDataFrame([("s", 1, j, t) for j, t in enumerate(cues)], f"{KEYS}, cue_no long, start double")
    got = {x["card_no"]: x["delta"] for x in joins.nearest_onset(c, q).collect()}
    near = {i: min(cues, key=lambda u: (abs(u - t), u)) - t for i, t in enumerate(onsets)}
    assert got == {i: d for i, d in near.items() if abs(d) <= 5}


# ---- line fits -----------------------------------------------------------------------------------
def all_lines(x, y, band):
    best = (0, -1, -1)
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            if x[i] != x[j]:
                b = (y[j] - y[i]) / (x[j] - x[i])
                n = int((np.abs(y - (y[i] + b * (x - x[i]))) <= band).sum())
                if n > best[0]:
                    best = (n, i, j)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_sweep_is_every_line(seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 40, 45).astype(float)
    y = np.where(r.random(45) < 0.6, 0.5 + 0.01 * x + r.normal(0, 0.1, 45), r.normal(0, 5, 45))
    assert timing._consensus(x, y, 0.3) == all_lines(x, y, 0.3)


def test_long_episodes_swept_and_sampled(spark):
    r, rows = random.Random(6), []
    for episode in range(3):
        for i in range(900):
            odd = r.random() < 0.2
            rows.append(("s", episode, i, i * 2.0, 0.25 + 0.0005 * i * 2.0 + (r.uniform(-5, 5) if odd else r.uniform(-0.05, 0.05))))
    pairs = spark.createDataFrame(rows, f"{KEYS}, x_order long, x double, y double")
    swept, sampled = ({f["episode"]: f for f in timing.ransac_fit(pairs, cap=cap).collect()} for cap in (1000, 60))
    for e in range(3):
        a, b = swept[e], sampled[e]
        assert a["matched"] == b["matched"] == 900 and a["inliers"] >= b["inliers"] > 700
        assert abs(a["offset_a"] - b["offset_a"]) < 0.01 and abs(a["drift_b"] - 0.0005) < 1e-5 and abs(b["drift_b"] - 0.0005) < 1e-5
        assert 0 < a["residual_iqr"] < 0.1 and not a["look_for_drift"]


# ---- phrases -------------------------------------------------------------------------------------
def in_turn(text, pairs):
    n = 0
    for key, value in sorted(pairs, key=lambda p: (-len(p[0]), p[0], p[1])):
        text, k = re.compile(rf"\b{re.escape(key)}\b", re.I).subn(lambda _, v=value: v, text)
        n += k
    return text, n


@pytest.mark.parametrize("seed", range(4))
def test_phrases_are_replaced_in_turn(spark, seed):
    """Also where a replacement makes a later phrase appear, in any case and alphabet."""
    r = random.Random(seed)
    word = lambda: r.choice(["of", "the", "Sea", "ſea", "STRASSE", "straße", "été", "a.b", "x-y", "İz", "no", "$1", "(q)"])
    pairs = [(" ".join(word() for _ in range(r.randrange(1, 4))), " ".join(word() for _ in range(r.randrange(0, 3)))) for _ in range(60)]
    texts = [None, "", *[" ".join(r.choice([str.upper, str.lower, str.title, str])(word()) + r.choice(["", ",", "!"]) for _ in range(40)) for _ in range(60)]]
    want = [in_turn(t or "", pairs) for t in texts]
    assert [Phrases(pairs).replace(t) for t in texts] == want
    df = spark.createDataFrame([(s, i, t) for i, t in enumerate(texts) for s in ("s", "other", None)], "show string, n long, text string").withColumnRenamed("n", "i")
    fixes = spark.createDataFrame([(s, kind, k, v) for k, v in pairs for s, kind in (("s", "phrase"), ("x", "phrase"), ("s", "token"))] + [(None, "phrase", "of", "!"), ("s", "phrase", None, "x"), ("s", "phrase", "of", None)], "show string, kind string, key string, value string")
    for limit in (100_000, 0):
        got = {(x["show"], x["i"]): (x["text"], x["n"]) for x in glossary.phrase_fixes(df, fixes, limit=limit).collect()}
        assert got == {(s, i): w if s == "s" else (texts[i] or "", 0) for i, w in enumerate(want) for s in ("s", "other", None)}


def test_folding_keeps_the_length():
    text = "".join(map(chr, [*range(32, 0x2200), *range(0x1E00, 0x2000)]))
    assert len(fold(text)) == len(text) and fold("ſK µς") == fold("SK Μσ")


def test_thousands_of_phrases(spark):
    pairs = [(f"term {i} of", f"T{i}") for i in range(10_000)]
    fixes = spark.createDataFrame([("s", "phrase", *p) for p in pairs], "show string, kind string, key string, value string")
    df = spark.range(2000).select(F.lit("s").alias("show"), "id", F.format_string("a TERM %d of it, term %d off", "id", "id").alias("text"))
    got = {x["id"]: (x["text"], x["n"]) for x in glossary.phrase_fixes(df, fixes).collect()}
    assert got == {i: (f"a T{i} it, term {i} off", 1) for i in range(2000)}


# ---- the most similar titles ---------------------------------------------------------------------
@pytest.mark.parametrize("block", [7, 4096])
def test_best_titles_are_those_of_a_nested_loop(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "NAMES", block)
    monkeypatch.setattr(nearest, "STRINGS", block)
    r = random.Random(9)
    name = lambda: " ".join("".join(r.choice("aeinorst") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 3)))
    titles = sorted({name().title() for _ in range(250)})
    terms = sorted({name() for _ in range(40)} | {t[1:] + "s" for t in titles[::9]} | {"", "a"})
    got = glossary.wiki_candidates(spark.createDataFrame([("s", t) for t in terms] + [("none", "x")], "show string, term string"), spark.createDataFrame([("s", i, t) for i, t in enumerate(titles)], "show string, ord int, title string")).collect()
    for t in terms:
        scores = sorted(((SequenceMatcher(None, x.lower(), t.lower()).ratio(), x.lower()) for x in titles), reverse=True)
        want = [(s, x) for s, x in scores if s >= 0.62][:6]
        assert [(x["score"], x["title"].lower()) for x in sorted(got, key=lambda x: x["rank"]) if x["term"] == t] == want


# ---- counting without an end ---------------------------------------------------------------------
def test_counts_have_a_bound_and_miss_nothing_frequent():
    r, true, counts = random.Random(2), {}, {}
    for _ in range(60):
        batch = {}
        for _ in range(500):
            t = f"t{int(r.paretovariate(0.6))}" if r.random() < 0.7 else f"x{r.randrange(10**6)}"
            batch[t] = batch.get(t, 0) + 1
            true[t] = true.get(t, 0) + 1
        space_saving(counts, [(t, n, False) for t, n in sorted(batch.items())], 200)
        assert len(counts) <= 200
    total = sum(true.values())
    assert all(n - error <= true[t] <= n and error <= total / 200 for t, (n, error, _) in counts.items())
    assert {t for t, n in true.items() if n > total / 200} <= set(counts)


def test_mining_stream_keeps_its_bound(spark, tmp_path):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = lambda: "Q" + "".join(r.choice(letters) for _ in range(7))
    for k in range(4):
        texts = [("s", f"we met {rare()} and {rare()} near Harbour with {'Captain' if r.random() < 0.5 else rare()}.") for _ in range(150)]
        spark.createDataFrame(texts, "show string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("show string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = []
    q = stream_mine(src, 30, capacity=40, buckets=2).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    q = q.foreachBatch(lambda df, _: found.append({x["term"]: (x["n"], x["error"]) for x in df.collect()})).start()
    q.awaitTermination()
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 2
    last = {k: v for batch in found for k, v in batch.items()}
    assert last["Harbour"][0] - last["Harbour"][1] <= 600 <= last["Harbour"][0] and "Captain" in last


def test_mining_stream_is_exact_without_a_capacity(spark, tmp_path):
    """More terms than the 16 x 20,000 that a capacity of 20,000 would hold, in two batches."""
    letters = "abcdefghijklmnopqrst"
    name = lambda k: "Q" + "".join(letters[k // 20**i % 20] for i in range(5))
    for part in range(2):
        rows = spark.range(100).select(F.lit("s").alias("show"), F.udf(lambda i: "we met " + " and ".join(name(4000 * i + j) for j in range(4000)) + " there.", "string")("id").alias("text"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("show string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_mine(src, 2).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    q.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").agg(F.count(F.lit(1)), F.countDistinct("term"), F.min("n"), F.max("n"), F.max("error")).first()
    assert tuple(got) == (400_000, 400_000, 2, 2, 0)


def test_transcripts_take_no_exchange_and_little_room(spark, tmp_path):
    """They are made from each document's row, and take less than twice the room of the text."""
    from pathlib import Path

    from cueloom.plans.io_queries import _transcripts

    text = " ".join(f"word{i % 97}" for i in range(20_000))
    spark.createDataFrame([(i, f"{i} {text}") for i in range(8)] + [(8, None), (9, ""), (10, " a\n b ")], "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    path = Path(_transcripts(spark, str(tmp_path)).removeprefix("file://"))
    assert sum(f.stat().st_size for f in path.glob("part-*")) < 16 * len(text)
    rows = {r["episode"]: r["segments"] for r in spark.read.json(f"file://{path}").collect()}
    assert sorted(rows) == [*range(8), 9, 10] and len(rows[0]) == 2858
    assert [w["word"] for w in rows[10][0]["words"]] == ["a", "b"] and rows[10][0]["end"] == 0.7 and rows[9][0]["words"][0]["word"] == ""


# ---- shuffles ------------------------------------------------------------------------------------
def exchanges(df):
    """What the plan shuffles by, but for repartitions by hand."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Exchange (?:hash|range|single)partitioning\(([^\n]*)", plan, re.I) if "REPARTITION_BY" not in x]


@pytest.mark.parametrize("name", ["split_sentences", "split_overflow", "card_confidence", "time_cards"])
def test_words_are_not_shuffled(spark, name):
    """Documents are dealt before they become words (F14, F16, F26, F28)."""
    assert exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) == []


def test_ngrams_are_not_shuffled(spark):
    """Texts are dealt before they become n-grams (F21)."""
    assert exchanges(QUERIES["max_ngram_share"](spark, "/root/testdata/sf0.001")) == []


def test_no_word_is_lost_where_times_are_missing(spark):
    """A piece whose length in time is not known is judged by its characters (F4, F14)."""
    rows = [("s", 1, 0, "one", None, 5, 0, 0), ("s", 1, 1, "two", 6, None, 0, 0), ("s", 1, 2, "x" * 50, None, None, 0, 1), ("s", 1, 3, "y" * 50, 7, None, 0, 1)]
    words = spark.createDataFrame(rows, f"{KEYS}, pos long, text string, start long, end long, span_id long, piece_id long")
    got = sorted(map(tuple, reflow.split_overflow(words, 84, 7000).select("pos", "group_id").collect()))
    assert got == [(0, 0), (1, 0), (2, 0), (3, 1)]


# ---- close names ---------------------------------------------------------------------------------
def test_bounds_of_two_letters_leave_few_pairs_and_lose_none():
    """Anagrams share all letters and few pairs of them: they need not be scored (F3, F5, F20, F25)."""
    r = random.Random(5)
    parts = ["en", "sch", "a", "ing", "er", "ß", "t", "on", "aa"]
    some = lambda n: sorted({"".join(r.choice(parts) for _ in range(r.randint(1, 7))) for _ in range(n)})
    names, texts = [*some(150), "a" * 30], [*some(200), "a" * 28, "x"]
    for k, cutoff in ((1, 0.78), (6, 0.62), (None, 0.5), (1, 0.0)):
        got = nearest.search_all(texts, [cutoff] * len(texts), k, names)
        want = []
        for t in texts:
            scores = sorted([(SequenceMatcher(None, n, t).ratio(), n) for n in names], reverse=True)
            want += [(t, n, s) for s, n in scores if s >= cutoff][:k] if k is None else [(t, n, s) for s, n in [x for x in scores if x[0] >= cutoff][:k]]
        assert sorted(got) == sorted(want)
    word = "abcdefghijkl"
    mixed = ["".join(r.sample(word, 12)) for _ in range(1000)]
    i, _, _ = nearest.candidates(nearest.Block([word]), nearest.Block([*mixed, word[:-1] + "m"]), np.array([0.78]))
    assert len(i) < 20


def noisy_points(seed, n):
    """A line with a quarter of its points elsewhere."""
    rng = np.random.default_rng(seed)
    x = np.arange(n) * 3.5
    return x, np.where(rng.random(n) < 0.25, rng.uniform(-4, 4, n), 0.2 + 0.0005 * x + rng.uniform(-0.2, 0.2, n))


def test_fits_pass_no_arrays_of_points_to_python(spark):
    """Ordinary episodes reach Python as points, so its memory does not grow with the episodes in a batch."""
    rows = [("s", e, k, *map(float, p)) for e in range(40) for k, p in enumerate(zip(*noisy_points(e, 30 + 5 * e), strict=True))]
    fit = timing.ransac_fit(spark.createDataFrame(rows, "show string, episode long, x_order long, x double, y double"))
    plan = fit._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "collect_list" not in plan.lower()
    got = {r["episode"]: r for r in fit.collect()}
    for e in (0, 5, 39):
        x, y = noisy_points(e, 30 + 5 * e)
        n, i, j = timing._consensus(x, y, 0.3 + 1e-9) if len(x) <= 60 else timing._sampled(x, y, 0.3 + 1e-9, 200)
        b = (y[j] - y[i]) / (x[j] - x[i])
        use = np.abs(y - (y[i] - b * x[i] + b * x)) <= 0.3 + 1e-9
        assert got[e]["inliers"] == n == use.sum() and np.allclose([got[e]["drift_b"], got[e]["offset_a"]], np.polyfit(x[use], y[use], 1))


def test_fits_of_longer_episodes_are_the_same(spark, monkeypatch):
    """Those that no task may hold, by blocks and ranks."""
    rows = [("s", e, k, *map(float, p)) for e in range(6) for k, p in enumerate(zip(*noisy_points(e, 100 + 100 * e), strict=True))]
    pairs = spark.createDataFrame(rows, "show string, episode long, x_order long, x double, y double")
    whole = sorted(timing.ransac_fit(pairs).collect())
    monkeypatch.setattr(timing, "WHOLE", 250)
    for a, b in zip(whole, sorted(timing.ransac_fit(pairs).collect()), strict=True):
        assert a[:2] == b[:2] and a["inliers"] == b["inliers"] > 60 and np.allclose(a[2:8], b[2:8])


def test_all_lines_of_longer_episodes_are_tried(spark, monkeypatch):
    """Without a cap no length makes a sample of the lines, and ties go to the first line."""
    points = {e: noisy_points(e, 90 + 110 * e) for e in range(3)}
    few = (np.arange(100) * 2.0, np.where(np.arange(100) % 10 == 0, 5.0, np.arange(100) % 7 * 100.0))  # a tenth on a line
    points[3] = few
    rows = [("s", e, k, *map(float, p)) for e, xy in points.items() for k, p in enumerate(zip(*xy, strict=True))]
    pairs = spark.createDataFrame(rows, "show string, episode long, x_order long, x double, y double")
    whole = sorted(timing.ransac_fit(pairs, cap=None).collect())
    for name, value in (("WHOLE", 80), ("BLOCK", 16), ("ENDS", (32, 64))):
        monkeypatch.setattr(timing, name, value)
    for a, b in zip(whole, sorted(timing.ransac_fit(pairs, cap=None).collect()), strict=True):
        x, y = points[a["episode"]]
        n, i, j = all_lines(x, y, 0.3 + 1e-9)
        slope = (y[j] - y[i]) / (x[j] - x[i])
        assert a["inliers"] == b["inliers"] == (np.abs(y - (y[i] - slope * x[i] + slope * x)) <= 0.3 + 1e-9).sum()
        assert a[:2] == b[:2] and np.allclose([v or 0 for v in a[2:8]], [v or 0 for v in b[2:8]])


def test_no_episode_of_ransac_fit_long_is_sampled(spark, monkeypatch):
    asked = []
    fit = timing.ransac_fit
    monkeypatch.setattr(timing, "ransac_fit", lambda *a, **k: asked.append(k["cap"]) or fit(*a, **k))
    caption_queries.ransac_fit_long(spark, "/root/testdata/sf0.001")
    assert asked == [None]


def test_words_of_cards_meet_without_broadcast(spark, tmp_path):
    """A table of cards is a small file, and its rows for cells are not: nothing goes through the driver, each word
    is in a list before the exchange, and the lists are those of a nested loop."""
    rng = np.random.default_rng(9)
    spans = [(["s", "t"][k % 2], k % 3, k, float(a), float(a + d)) for k, (a, d) in enumerate(zip(rng.uniform(0, 900, 400), rng.choice([0.0, 0.3, 2.5, 40.0, 700.0], 400), strict=True))]
    cards = [*spans[:80], spans[3], (None, 1, 7, 0.0, 9.0), ("s", 0, 999, 5000.0, 5001.0)]
    words = [(*w, w[2] % 10 / 10) for w in spans[80:]]
    spark.createDataFrame(cards, "show string, episode int, card_no int, start double, end double").write.parquet(str(tmp_path / "cards"))
    spark.createDataFrame(words, "show string, episode int, pos int, start double, end double, prob double").write.parquet(str(tmp_path / "words"))
    out = reflow.card_word_probs(spark.read.parquet(str(tmp_path / "cards")), spark.read.parquet(str(tmp_path / "words")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    met = lambda c: [w[5] for w in words if w[:2] == c[:2] and min(c[4], w[4]) > max(c[3], w[3]) and c[3] < c[4] and w[3] < w[4]]
    twice = lambda c: [p for p in met(c) for _ in range(cards.count(c))]
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str((*c, twice(c))) for c in cards)


def test_reflow_shuffles_documents_and_cards_alone(spark):
    """From the documents to the cards no word is shuffled: one exchange of documents for words and for segments each,
    one of cards for their times and numbers."""
    plan = caption_queries.reflow_cards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    dealt = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]
    assert sum(x.startswith("doc_id") for x in dealt) == 2 and len(dealt) == 3 and "SortMergeJoin" not in plan


def test_timing_report_writes_no_words(spark, monkeypatch):
    written, write = {}, caption_queries.materialize

    def materialize(df, name):
        written[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange")
        return write(df, name)

    monkeypatch.setattr(caption_queries, "materialize", materialize)
    monkeypatch.setattr(timing, "timing_report", lambda cards, cues, **_: cards.limit(0).select(*[F.lit(0).alias(c) for c in ("show", "episode", "status", "cards", "on_cue", "cue_count", "cues_covered", "inliers", "offset_a")]))
    caption_queries.timing_report(spark, "/root/testdata/sf0.001")
    assert written == {"long-cards": 1}


def test_semi_interval_join_shuffles_cells_and_hits_alone(spark):
    """Rows go to their cells and come together again, copies with them; they are not joined back."""
    left = spark.createDataFrame([("s", 1, 5), ("s", 1, 5), ("s", 0, 400), ("s", 900, 905), ("s", 7, 7)], "show string, a0 long, a1 long")
    right = spark.createDataFrame([("s", 3, 4), ("s", 2, 300), ("s", 905, 910)], "show string, b0 long, b1 long")
    out = joins.range_join(left, right, ("a0", "a1"), ("b0", "b1"), ["show"], "semi")
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) <= 2
    assert sorted(map(tuple, out.collect())) == [("s", 0, 400), ("s", 1, 5), ("s", 1, 5)]


def test_bins_of_slopes_skip_most_sweeps(monkeypatch):
    x, y = noisy_points(3, 600)
    sweeps, sort = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, side="left": sweeps.append(len(a)) or sort(a, v, side=side))
    found = timing._consensus(x, y, 0.3)
    assert found == all_lines(x, y, 0.3)
    assert sum(n > len(timing._STEPS) for n in sweeps) < 600


def test_few_documents_meet_in_a_task(spark):
    """However many documents there are, the words of some 512 of them are one task's."""
    dealt = adaptors.by_episode(spark.range(8192).withColumnRenamed("id", "doc_id"))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8192 and max(sizes) < 700


def test_cards_are_made_where_their_words_lie(spark, monkeypatch):
    """card_word_probs shuffles documents for its cards, and no words."""
    plans, write = {}, caption_queries.materialize

    def materialize(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(caption_queries, "materialize", materialize)
    assert caption_queries.card_word_probs(spark, "/root/testdata/sf0.001").count()
    assert sorted(plans) == ["long-cards", "words"]
    assert all(plan.count("Exchange") == 1 for plan in plans.values())
