"""Small literal cases, brute force, plans, and streams against batch."""

import random
import re
from difflib import SequenceMatcher, get_close_matches

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.functions.similarity import metaphone_code
from cueloom.operators import gate, glossary, joins, library, ranks, reflow, repair, timing, tracks
from cueloom.operators import nearest as names_nearest
from cueloom.plans import adaptors
from cueloom.plans.library_queries import shouting_model
from cueloom.plans.registry import QUERIES
from cueloom.sources import readers, writers
from cueloom.streaming import streams

KEYS = "show string, episode long"


def words(spark, rows):
    """rows: (text, start, end[, seg])."""
    return spark.createDataFrame([("s", 1, i, r[0], r[1], r[2], 0.9, r[3] if len(r) > 3 else 0) for i, r in enumerate(rows)], f"{KEYS}, pos long, text string, start double, end double, prob double, seg long")


def run_of(texts, start=0.0, dur=0.3, gaps=None):
    out, t = [], start
    for i, x in enumerate(texts):
        out.append((x, t, t + dur))
        t += dur + (gaps or {}).get(i, 0.0)
    return out


def segments(spark, rows):
    return spark.createDataFrame([("s", 1, i, *r) for i, r in enumerate(rows)], f"{KEYS}, seg long, start double, end double, no_speech_prob double")


def cards(spark, rows, cols="text string, start double, end double"):
    return spark.createDataFrame([("s", 1, i, *r) for i, r in enumerate(rows)], f"{KEYS}, card_no long, {cols}")


# ---- reflow ----------------------------------------------------------------------------------------
def groups(spark, rows, max_dur=7.0):
    w = reflow.split_overflow(reflow.split_sentences(reflow.split_spans(words(spark, rows))), 84, max_dur)
    got = {}
    for r in w.orderBy("pos").collect():
        got.setdefault((r["span_id"], r["piece_id"], r["group_id"]), []).append(r["text"])
    return [len(v) for _, v in sorted(got.items())]


def test_a_gap_of_the_limit_itself_does_not_split(spark):
    assert groups(spark, [("north", 10.0, 10.25), ("wind", 10.75, 11.0), ("blows", 11.625, 12.0), ("south", 12.125, 12.5)]) == [2, 2]


def test_largest_pause_cuts_an_overflow(spark):
    assert groups(spark, run_of(["lantern"] * 9 + ["quickly"] * 6, gaps={3: 0.125, 8: 0.25})) == [9, 6]


def test_clause_mark_cuts_without_a_pause(spark):
    assert groups(spark, run_of(["harbours"] * 5 + ["rivers,"] + ["meadows"] * 5)) == [6, 5]


def test_middle_cuts_otherwise(spark):
    assert groups(spark, run_of(["mountain"] * 10)) == [5, 5]


def test_long_duration_overflows(spark):
    assert groups(spark, run_of(["so"] * 10, dur=0.875)) == [5, 5]


def test_a_single_long_word_stays(spark):
    assert groups(spark, [("x" * 200, 0.0, 9.0)]) == [1]


def test_two_sentences(spark):
    got = reflow.reflow(words(spark, run_of(["Hi", "there.", "You", "there?"])), segments(spark, [(0.0, 5.0, 0.2)])).orderBy("card_no").collect()
    assert [(r["text"], r["card_no"]) for r in got] == [("Hi there.", 1), ("You there?", 2)] and got[0]["no_speech_prob"] == 0.2


def test_missing_times_are_filled(spark):
    rows = [("one", None, None), ("two", None, 1.5), ("three", 2.0, 2.5), ("four", None, 2.25), ("five", 1.75, None), ("six", None, None)]
    got = [(r["start"], r["end"]) for r in reflow.fill_timestamps(words(spark, rows)).orderBy("pos").collect()]
    assert got == [(0.0, 0.0), (0.0, 1.5), (2.0, 2.5), (2.5, 2.5), (1.75, 1.75), (1.75, 1.75)]


def test_leading_words_far_before_their_segment(spark):
    w = words(spark, [("We", 2.0, 2.5), ("sail", 2.5, 3.0), ("tonight.", 61.0, 61.75)])
    got = reflow.reflow(w, segments(spark, [(60.5, 62.0, 0.25)])).collect()
    assert [(r["text"], r["no_speech_prob"]) for r in got] == [("We sail tonight.", 0.25)] and got[0]["start"] >= 58


def test_no_words_no_cards(spark):
    assert reflow.reflow(words(spark, []), segments(spark, [])).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "bb.", "ccc,", "dddd"]), st.integers(0, 20), st.integers(1, 10)), min_size=1, max_size=40))
def test_cards_never_overlap(spark, steps):
    t, rows = 0.0, []
    for x, gap, dur in steps:
        rows.append((x, t + gap / 10, t + gap / 10 + dur / 10))
        t = rows[-1][2]
    got = reflow.reflow(words(spark, rows), segments(spark, [])).orderBy("card_no").collect()
    assert all(a["end"] <= b["start"] or b["start"] - a["start"] < 0.17 for a, b in zip(got, got[1:], strict=False))
    assert " ".join(r["text"].replace("\n", " ") for r in got) == " ".join(x for x, *_ in rows)


# ---- gate ------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("text", "want"), [("la la la la la la", True), ("go on go on go on", True), ("no no no", False), ("a b c d e f", False), ("help me now help me now help me now ok", True), ("", False), (None, False), ("one two three one two four five six", False)])
def test_repetition(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.is_repetition(F.col("t"))).first()[0] is want


def test_drop_reasons(spark):
    rows = [("Thanks for watching!", 0.0, 0.0), ("la la la la la la", 0.99, -3.0), ("mmm", 0.97, -2.5), ("mmm", 0.95, -2.5), ("hi", 0.6, -0.7), ("hi", 0.6, -0.6), ("hi", None, None)]
    got = gate.gate(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, no_speech_prob double, avg_logprob double")).orderBy("i").collect()
    assert [r["drop_reason"] for r in got] == ["blocklist", "repetition", "music", None, None, None, None]
    assert [r["flag"] for r in got][3:] == ["low_conf", "low_conf", "maybe_silence", None]


def test_runs_of_four_collapse(spark):
    rows = [("Help me!", float(i), i + 0.5) for i in range(5)] + [("ok", 5.0, 5.5)] + [("no", 6.0 + i, 6.5 + i) for i in range(3)]
    got = gate.collapse_runs(cards(spark, rows)).orderBy("card_no").collect()
    assert [(r["text"], r["start"], r["end"]) for r in got] == [("Help me!", 0.0, 4.5), ("ok", 5.0, 5.5), ("no", 6.0, 6.5), ("no", 7.0, 7.5), ("no", 8.0, 8.5)]


# ---- joins and timing --------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(3))
def test_range_join_is_the_nested_loop(spark, seed):
    r = random.Random(seed)
    spans = lambda n: [(i, s := r.randrange(0, 600) / 10, s + r.randrange(0, 400) / 10) for i in range(n)]
    a, b = spans(40), spans(40)
    left = spark.createDataFrame([("s", 1, *x) for x in a], f"{KEYS}, i int, a0 double, a1 double")
    right = spark.createDataFrame([("s", 1, *x) for x in b], f"{KEYS}, j int, b0 double, b1 double")
    want = {(i, j) for i, s, e in a for j, u, v in b if min(e, v + 0.3) > max(s, u - 0.3)}
    join = lambda how: joins.range_join(left, right, ("a0", "a1"), ("b0", "b1"), how=how, slack=0.3)
    inner = [(x["i"], x["j"]) for x in join("inner").collect()]
    assert len(inner) == len(set(inner)) and set(inner) == want
    assert {x["i"] for x in join("semi").collect()} == {i for i, _ in want}
    assert {x["i"] for x in join("anti").collect()} == {i for i, *_ in a} - {i for i, _ in want}
    assert {(x["i"], x["j"]) for x in join("left").collect()} == want | {(i, None) for i, *_ in a if i not in {k for k, _ in want}}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_no_nested_loops_in_the_plans(spark):
    c = cards(spark, [("a", 0.0, 1.0)])
    q = spark.createDataFrame([("s", 1, 0, 0.0, 1.0)], f"{KEYS}, cue_no long, start double, end double")
    for df in (timing.timing_report(c.withColumns({"no_speech_prob": F.lit(0.0), "avg_logprob": F.lit(0.0), "flag": F.lit(None).cast("string")}), q), joins.nearest_onset(c, q)):
        assert not re.search("NestedLoop|Cartesian", plan_of(df))


def nearest(card, cues, radius=5.0):
    best = None
    before = [j for j, q in enumerate(cues) if q < card][-1:]
    after = [j for j, q in enumerate(cues) if q >= card][:1]
    for j in before + after:
        if abs(cues[j] - card) <= radius and (best is None or abs(cues[j] - card) < abs(cues[best] - card)):
            best = j
    return best


@pytest.mark.parametrize("seed", range(3))
def test_nearest_onset(spark, seed):
    r = random.Random(seed)
    cues = sorted(r.randrange(0, 200) / 2 for _ in range(60))
    onsets = [r.randrange(0, 260) / 2 for _ in range(80)] + [10.0]
    c = cards(spark, [("x", s, s + 1) for s in onsets])
    q = spark.createDataFrame([("s", 1, j, s) for j, s in enumerate(cues)], f"{KEYS}, cue_no long, start double")
    got = {x["card_no"]: x["cue_no"] for x in joins.nearest_onset(c, q).collect()}
    assert got == {i: nearest(s, cues) for i, s in enumerate(onsets) if nearest(s, cues) is not None}


def pairs_frame(spark, pts):
    return spark.createDataFrame([("s", 1, i, x, y) for i, (x, y) in enumerate(pts)], f"{KEYS}, x_order long, x double, y double")


def test_fit_finds_the_line_among_outliers(spark):
    pts = [(10.0 * i, 0.3 + 0.001 * 10 * i) for i in range(30)] + [(300.0 + 7 * i, 4.0 - i) for i in range(8)]
    r = timing.ransac_fit(pairs_frame(spark, pts)).first()
    assert r["inliers"] == 30 and abs(r["offset_a"] - 0.3) < 1e-6 and abs(r["drift_b"] - 0.001) < 1e-8 and not r["look_for_drift"]


def test_fit_of_many_pairs_is_sampled(spark):
    pts = [(float(i), 0.2 + (5.0 if i % 9 == 0 else 0.0)) for i in range(300)]
    r = timing.ransac_fit(pairs_frame(spark, pts)).first()
    assert abs(r["offset_a"] - 0.2) < 1e-6 and r["inliers"] == 300 - 34


@pytest.mark.parametrize(("pts", "inliers"), [([(1.0, 0.0)], 0), ([(1.0, 0.0), (1.0, 0.5)], 0), ([(float(i), 0.1) for i in range(5)], 5)])
def test_fit_of_few_pairs_is_null(spark, pts, inliers):
    r = timing.ransac_fit(pairs_frame(spark, pts)).first()
    assert r["offset_a"] is None and r["drift_b"] is None and r["inliers"] == inliers


def test_quartiles_are_exclusive(spark):
    got = spark.sql("select array(9.0d, 1.0d, 4.0d, 2.0d) v union all select array(1.0d)").select(timing.residual_iqr(F.col("v")).alias("q")).collect()
    assert [r["q"] for r in got] == [7.75 - 1.25, None]


def test_report_rates(spark):
    rows = [("on-cue", None)] * 5 + [("in-gap", "in_gap_silent")] * 5 + [("in-gap", "in_gap_speech")] * 2 + [("in-gap", "in_gap_vad_error")]
    c = spark.createDataFrame([("s", 1, i, k, v, 0.1, -0.1, None) for i, (k, v) in enumerate(rows)], f"{KEYS}, card_no long, classification string, verdict string, no_speech_prob double, avg_logprob double, flag string")
    none = spark.createDataFrame([], f"{KEYS}, cue_count long, cues_covered long")
    r = timing.episode_report(c, none).first()
    assert abs(r["false_in_gap_rate"] - 2 / 13) < 1e-12 and r["pct_cues_covered"] is None and r["in_gap"] == 8
    assert timing.episode_report(c.where("verdict = 'in_gap_vad_error'"), none).first()["false_in_gap_rate"] is None


# ---- glossary ----------------------------------------------------------------------------------------
TERMS = [("s", "name", 0, "Spandam"), ("s", "name", 1, "Alabasta"), ("s", "name", 2, "Arlong"), ("s", "phrase", 0, "Enies Lobby")]
FIXES = [("s", "token", "spondum", "Spandam"), ("s", "phrase", "eddie's lobby", "Enies Lobby"), ("s", "phrase", "lobby", "L$1")]


def corrected(spark, text):
    f = glossary.correct_names(spark.createDataFrame([("s", 1, text)], "show string, i int, text string"), spark.createDataFrame(TERMS, "show string, kind string, ord int, term string"),
                               spark.createDataFrame(FIXES, "show string, kind string, key string, value string"), spark.createDataFrame([("along",), ("then",), ("bound",)], "word string"), ["i"])
    r = f.first()
    return r["text"], r["n"]


@pytest.mark.parametrize(("text", "want"), [
    ("then Spondum, the chief", ("then Spandam, the chief", 1)), ("it was Spandm", ("it was Spandm", 0)), ("bound for Arabasta now", ("bound for Alabasta now", 1)),
    ("go along with it", ("go along with it", 0)), ("at  Eddie's Lobby!", ("at Enies L$1!", 2)), ("Spandam said", ("Spandam said", 0))])
def test_corrections(spark, text, want):
    assert corrected(spark, text) == want


def test_fuzzy_names_is_the_closest_match(spark):
    r = random.Random(2)
    names = ["Zorolino", "Nami", "Usoppa", "Sanjiro", "Choppers", "Robina", "Frankylin"]
    tokens = ["".join(r.sample(n, len(n))) if k % 4 == 0 else n[:2] + n[3:] + r.choice("aeiou") for k, n in enumerate(names * 4)]
    df = spark.createDataFrame([("s", t) for t in tokens], "show string, text string")
    got = {x["core"]: x["name"] for x in glossary.fuzzy_names(glossary.distinct_tokens(df), spark.createDataFrame([("s", i, n) for i, n in enumerate(names)], "show string, ord int, name string")).collect()}
    one = lambda a, b: abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(len(a) + 1))
    for t in tokens:
        cut = 0.95 if len(t) <= 5 else 0.9 if len(t) <= 7 else 0.84
        best = get_close_matches(t.title(), names, 1, cut) if len(t) >= 4 else []
        want = best[0] if best and best[0].lower() != t.lower() and not one(t.lower(), best[0].lower()) else None
        assert got.get(t) == want


@pytest.mark.parametrize("cutoff", [0.62, 0.78, 0.84, 0.95])
def test_name_pairs_are_those_of_a_nested_loop(spark, monkeypatch, cutoff):
    r = random.Random(3)
    word = lambda most: "".join(r.choice("aabcdeeén 1") for _ in range(r.randint(0, most)))
    names = ["", "a", "ab", *[word(14) for _ in range(60)]]
    tokens = ["", "a", "b", "ba", *[word(14) for _ in range(30)], *[n[1:] + "e" for n in names[3:40]], *[n[:2] + n[3:] for n in names[3:40]]]
    names, tokens = sorted(set(names)), sorted(set(tokens))
    left = spark.createDataFrame([(s, t) for s in ("s", "t") for t in tokens] + [("s", None)], "show string, low string")
    right = spark.createDataFrame([("s", n) for n in names] + [("t", names[5]), ("s", None)], "show string, name string")
    monkeypatch.setattr(names_nearest, "NAMES", 16)
    monkeypatch.setattr(names_nearest, "STRINGS", 10)
    got = names_nearest.nearest_names(left.select("show", F.col("low").alias("text"), F.lit(cutoff).alias("cutoff")), right).collect()
    close = lambda n, t: bool(n and t) and SequenceMatcher(None, n, t).ratio() >= cutoff
    want = [("s", t, n) for n in names for t in tokens if close(n, t)] + [("t", t, names[5]) for t in tokens if close(names[5], t)]
    assert sorted((x["show"], x["text"], x["name"]) for x in got) == sorted(want)


def test_ranks_within_a_show(spark):
    df = spark.createDataFrame([("a", k) for k in range(50, 0, -1)] + [(None, 7), (None, 3)], "show string, term long")
    got = {(r["show"], r["term"]): r["n"] for r in ranks.rank_within(df, "show", ["term"], "n").collect()}
    assert got == {**{("a", k): k for k in range(1, 51)}, (None, 3): 1, (None, 7): 2}
    assert ranks.rank_within(df.limit(0), "show", ["term"], "n").collect() == []


def test_top_names_are_cut_before_the_exchange(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    terms = spark.createDataFrame([("s", k, f"t{k}") for k in range(40)], "show string, ord long, term string")
    out = glossary.top_names(terms, terms.select("show", "term", (F.col("ord") % 7).alias("n")), 3)
    with redirect_stdout(StringIO()) as plan:
        out.explain()
    assert plan.getvalue().count("WindowGroupLimit") >= 2
    assert out.first()["prompt"] == "t6, t13, t20"


def test_metaphone():
    assert [metaphone_code(w) for w in ("Spandam", "spondum", "Knight", "phone", "Thumb", "school", "church", "")] == ["SPNTM", "SPNTM", "NT", "FN", "0M", "SKL", "XRX", ""]


def test_mining(spark):
    texts = spark.createDataFrame([("s", "I saw Luffy today. Zoro drew. He met Luffy!\nThen Luffy ran")], "show string, text string")
    empty = spark.createDataFrame([], "show string, term string")
    deny = spark.createDataFrame([("then",)], "word string")
    assert [(r["term"], r["n"]) for r in glossary.mine_names(texts, deny, empty, 3).collect()] == [("Luffy", 3)]
    assert {r["term"] for r in glossary.mine_names(texts, deny, empty, 1).collect()} == {"Luffy"}


def test_suspects(spark):
    df = spark.createDataFrame([("s", 1, "we met Krieg there"), ("s", 2, "the spandem fell"), ("s", 3, "plain little things")], "show string, i int, text string")
    terms = spark.createDataFrame(TERMS, "show string, kind string, ord int, term string")
    got = glossary.name_suspect(df, terms, spark.createDataFrame([("there",), ("plain",), ("little",), ("things",)], "word string"), ["i"])
    assert {r["i"]: r["suspect"] for r in got.collect()} == {1: True, 2: True, 3: False}


# ---- repair, tracks, library ---------------------------------------------------------------------------
def test_targets(spark):
    rows = [("a", 0.1, -0.5, None, 0), ("b", 0.6, -0.9, None, 0), ("c", None, -0.9, None, 0), ("hi there", 0.1, -0.05, [0.95, 0.1], 0), ("d", 0.1, -0.05, [0.3], 0), ("e", 0.1, -0.05, None, 1)]
    c = cards(spark, [r[:4] for r in rows], "text string, no_speech_prob double, avg_logprob double, word_probs array<double>")
    s = spark.createDataFrame([("s", 1, i, bool(r[4])) for i, r in enumerate(rows)], f"{KEYS}, card_no long, suspect boolean")
    assert sorted(r["text"] for r in repair.repair_targets(c, s).collect()) == ["a", "e", "hi there"]


def test_a_failing_model_stops_nothing(spark):
    def model():
        def ask(prompt):
            if "bad" in prompt:
                raise RuntimeError("no")
            return prompt[::-1]

        return ask

    req = cards(spark, [("good",), ("bad",)], "prompt string")
    got = {r["card_no"]: (r["output"], r["error"]) for r in repair.score_requests(req, model, "m").collect()}
    assert got == {0: ("doog", None), 1: ("", "RuntimeError: no")}


def test_capitals_are_those_of_the_sql():
    import duckdb

    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and c != 10]
    rows = pa.table({"i": range(len(letters)), "c": letters})  # noqa: F841  DuckDB reads it by its name
    want = [r[0] for r in duckdb.connect().execute("select upper(c) from rows order by i").fetchall()]
    assert [shouting_model()(f"Line: {c}") for c in letters] == want
    assert shouting_model()("Names: x\nLine: daß") == "DAẞ"


@pytest.mark.parametrize(("style", "text", "comment", "talk", "sign"), [
    ("Default", "hi", False, True, False), ("Default", r"{\an8}Top", False, False, False), ("Other", r"{\an8}Top", False, False, True), ("Other", r"{\an2}low", False, True, False), ("Song Translation", r"{\k20}la", False, False, False),
    ("Romaji", "la", False, False, True), ("Other", " ", False, False, False), ("Other", "x", True, False, False), ("Other", r"{\p1}m 0 0", False, True, True), ("Warning", "x", False, False, False)])
def test_event_kinds(spark, style, text, comment, talk, sign):
    ev = spark.createDataFrame([(style, text, re.sub(r"\{.*?\}", "", text), comment)], "style string, text string, plaintext string, is_comment boolean")
    assert (tracks.dialogue_events(ev).count() == 1, tracks.keep_sign_events(ev).count() == 1) == (talk, sign)


def test_order_from_a_start_season(spark):
    paths = [f"/x/S{s:02d}E01.mkv" for s in (1, 18, 20, 21, 36)] + ["/x/special.mkv"]
    got = library.order_files(spark.createDataFrame([("Show", p) for p in paths], "show string, path string"), {"Show": 20}).orderBy("rank").collect()
    assert [r["path"] for r in got] == [f"/x/S{s:02d}E01.mkv" for s in (20, 21, 36, 1, 18)] + ["/x/special.mkv"]


# ---- files and streams ---------------------------------------------------------------------------------
def test_conf_files(spark, tmp_path):
    for name, body in (("a", '[{"start": 1, "end": "2.5", "text": "x"}, {"start": 3, "end": 2}, 7, {"start": "no", "end": 2}]'), ("b", "{}"), ("c", "[oops")):
        (tmp_path / f"{name}.dubtitles.conf.json").write_text(body)
    status, rows = readers.read_conf(spark, f"file://{tmp_path}", spark.createDataFrame([(x,) for x in "abcd"], "episode string"))
    assert {r["episode"]: r["status"] for r in status.collect()} == {"a": "ok", "b": "bad-conf", "c": "bad-conf", "d": "no-conf"}
    assert [(r["start"], r["end"], r["text"]) for r in rows.collect()] == [(1.0, 2.5, "x")]


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\r\n00:00:01,500 --> 00:00:02,000\r\nHi\r\nyou\r\n\r\n2\r\n00:01:00,000 --> 00:01:01,000\r\n<i>x</i>\r\n")
    (tmp_path / "b.ass").write_text("[Script Info]\nPlayResX: 10\n[Events]\nFormat: x\nDialogue: 1,0:00:01.50,0:00:02.00,Signs,,0,0,0,,{\\an8}A, b\\Nc\nComment: 0,0:00:03.00,0:00:04.00,D,,0,0,0,,no\n")
    (tmp_path / "c.txt").write_text("nothing here")
    got = sorted(((r["file"], r["start_ms"], r["end_ms"], r["style"], r["plaintext"], r["is_comment"]) for r in readers.read_subtitles(spark, f"file://{tmp_path}").collect()))
    assert got == [("a.srt", 1500, 2000, "Default", "Hi\nyou", False), ("a.srt", 60000, 61000, "Default", "<i>x</i>", False), ("b.ass", 1500, 2000, "Signs", "A, b\nc", False), ("b.ass", 3000, 4000, "D", "no", True)]


def test_publish_swaps_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    for n in (1, 2):
        writers.publish(spark.range(n), path)
        assert writers.read_published(spark, path).count() == n


def drain(spark, stream, tmp_path, name):
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-s").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/{name}")


def landed(spark, tmp_path, parts, schema):
    """One micro-batch for each part, in their order; ts follows start."""
    add = lambda x: x.withColumn("ts", F.timestamp_seconds(F.col("start") + 3600))
    for part in parts:
        add(spark.createDataFrame(part, schema)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(add(spark.createDataFrame(parts[0], schema)).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_stream_spans_are_the_batch_spans(spark, tmp_path):
    """Words come in no order; those of the last ten minutes are waited for, and later ones go."""
    r = random.Random(4)
    t, rows = 0.0, []
    for i in range(2000):
        t += r.choice([0.1, 0.5, 0.6])
        rows.append(("s", 1, i, t, t + 0.2))
        t += 0.2
    arrival = sorted(rows, key=lambda x: x[3] + r.random() * 500)
    parts = [arrival[k : k + 500] for k in range(0, 2000, 500)]
    far = ("s", 2, 0, 1e7, 1e7 + 1)  # moves the watermark on, which closes the last span
    schema = f"{KEYS}, pos long, start double, end double"
    src = landed(spark, tmp_path, [*parts, [far], [("s", 1, 5, 3.0, 3.2), ("s", 3, 0, 2e7, 2e7 + 1)]], schema)
    got = [(x["first_pos"], x["last_pos"], x["words"]) for x in drain(spark, streams.stream_spans(src), tmp_path, "out").where("episode = 1").orderBy("first_pos").collect()]
    batch = reflow.split_spans(spark.createDataFrame(rows, schema)).groupBy("span_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("a").collect()
    assert got == [(x["a"], x["b"], x["n"]) for x in batch]


def test_stream_collapse(spark, tmp_path):
    rows = [("s", 1, i, float(i), i + 0.5, x) for i, x in enumerate(["Hi!", "hi", "HI.", "hi", "no", "no", "yes"])]
    schema = f"{KEYS}, card_no long, start double, end double, text string"
    src = landed(spark, tmp_path, [rows[1::2], rows[::2], [("s", 2, 0, 1e7, 1e7 + 1, "x")]], schema)
    out = drain(spark, streams.stream_collapse(src), tmp_path, "out").where("episode = 1")
    assert [(r["card_no"], r["end"], r["n"]) for r in out.orderBy("card_no").collect()] == [(0, 3.5, 4), (4, 5.5, 2), (6, 6.5, 1)]


SF = "/root/testdata/sf0.001"


def same(got, want):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(got) == key(want) and want.count()


def test_drained_spans_are_those_of_the_whole_table(spark):
    w = adaptors.v_words(spark, SF)
    spans = reflow.split_spans(w, 500).groupBy("show", "episode", "span_id").agg(F.min("pos"), F.max("pos"), F.min("start") / 1000, F.max("end") / 1000, F.count(F.lit(1)))
    same(QUERIES["stream_spans"](spark, SF), spans.drop("span_id"))


def test_drained_runs_are_those_of_the_whole_table(spark):
    c = adaptors.v_repeat_cards(spark, SF)
    out = QUERIES["stream_collapse"](spark, SF)
    assert out.agg(F.sum("n")).first()[0] == c.count()
    # runs of four or more are what the batch operator makes of the table; shorter ones stay as they are
    short = out.where("n < 4").select("show", "episode", F.explode(F.expr("sequence(card_no, card_no + n - 1)")).alias("card_no"), "text")
    long = out.where("n >= 4").select("show", "episode", "card_no", "text", (F.col("end") * 1000).cast("long").alias("end"))
    batch = gate.collapse_runs(c).select("show", "episode", "card_no", "text", "end")
    same(short.withColumn("end", F.col("card_no") * 1000 + 900).union(long), batch)


def test_drained_sessions_are_those_of_the_whole_table(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("show"), F.col("ts").cast("timestamp").alias("ts"))
    batch = e.groupBy(F.session_window("ts", "1 hour"), "show").agg(F.count(F.lit(1)).alias("cards"))
    same(QUERIES["stream_sessions"](spark, SF), batch.select("show", F.unix_timestamp("session_window.start"), "cards"))


# ---- equal and open rows in interval joins, published versions, styles ---------------------------
def test_range_join_keeps_equal_and_open_rows(spark):
    left = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 1, 0.0, 5.0), ("a", 2, 3.0, None), ("a", 3, 90.0, 95.0), ("a", 4, None, 4.0)], "k string, n int, s double, e double")
    right = spark.createDataFrame([("a", 1.0, 2.0, "x"), ("a", 3.0, 30.0, "y")], "k string, rs double, re double, t string")
    join = lambda how: sorted((r["n"], *([r["t"]] if how in ("left", "inner") else [])) for r in joins.range_join(left, right, ("s", "e"), ("rs", "re"), ["k"], how).collect())
    assert join("inner") == [(1, "x"), (1, "x"), (1, "y"), (1, "y")]
    assert [(n, t or "") for n, t in sorted(joins.range_join(left, right, ("s", "e"), ("rs", "re"), ["k"], "left").select("n", "t").collect(), key=str)] == [(1, "x"), (1, "x"), (1, "y"), (1, "y"), (2, ""), (3, ""), (4, "")]
    assert join("semi") == [(1,), (1,)] and join("anti") == [(2,), (3,), (4,)]


def test_published_versions_follow_each_other(spark, tmp_path):
    from cueloom.sources import writers

    path = f"file://{tmp_path}/report"
    for n in (5, 3):
        writers.publish(spark.range(n), path)
        assert writers.read_published(spark, path).count() == n
    with pytest.raises(ValueError):
        writers.read_published(spark, f"file://{tmp_path}/other")


def test_styles_follow_their_format_line(spark, tmp_path):
    from cueloom.sources import readers

    (tmp_path / "a.ass").write_text("[Script Info]\nTitle: x\n\n[V4+ Styles]\nFormat: Fontname, Name, Fontsize, Bold\nStyle: Arial, Main ,42,0\nStyle: Gothic,Signs,30.5,1\n\n[Events]\nFormat: Layer\nDialogue: 0,0:00:01.00,0:00:02.00,Main,,0,0,0,,hi\n")
    (tmp_path / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\none\n\ntwo\n\n2\n00:00:03,000 --> 00:00:04,000\nthree\n")
    got = [tuple(r) for r in readers.read_styles(spark, f"file://{tmp_path}").select("file", "ord", "style", "fontname", "fontsize").orderBy("ord").collect()]
    assert got == [("a.ass", 0, "Main", "Arial", 42.0), ("a.ass", 1, "Signs", "Gothic", 30.5)]
    events = sorted((r["file"], r["ev_no"], r["text"]) for r in readers.read_subtitles(spark, f"file://{tmp_path}").where("file = 'b.srt'").collect())
    assert events == [("b.srt", 1, "one\n\ntwo"), ("b.srt", 2, "three")]
