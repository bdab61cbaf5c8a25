"""Page lists, published versions and kept answers."""

import json
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from cueloom.operators import repair
from cueloom.sources import readers, writers
from cueloom.sources.answers import Answers

KEYS = "show string, episode long"


# ---- page lists ----------------------------------------------------------------------------------
def page(show, token, follow, titles, at=100.0, api="a"):
    return {"show": show, "api": api, "fetched_at": at, "request": {"apcontinue": token} if token else None, "continue": {"apcontinue": follow} if follow else None, "query": {"allpages": [{"pageid": 1, "title": t} for t in titles]}}


def chain(show, n, **more):
    return [page(show, f"t{k}" if k else None, f"t{k + 1}" if k < n - 1 else None, [f"{show} {k}"], **more) for k in range(n)]


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    rows = chain("whole", 37) + chain("long", 60) + chain("single", 1) + chain("old", 3, at=1.0) + chain("moved", 2, api="b")
    rows += chain("gap", 9)[:4] + chain("gap", 9)[5:] + chain("headless", 5)[1:] + [page("twice", None, "x", ["old"], 50.0), page("twice", None, None, ["new"], 60.0)]
    rows += [page("circle", None, "a", ["0"]), page("circle", "a", "b", ["1"]), page("circle", "b", "a", ["2"]), page("aside", None, None, ["0"]), page("aside", "p", "q", ["1"]), page("aside", "q", "p", ["2"])]
    path = tmp_path_factory.mktemp("pages")
    (path / "p.json").write_text("\n".join([*map(json.dumps, rows), "{broken", "{}"]))
    return readers.read_wiki_titles(spark, f"file://{path}", 150.0, ttl_s=100, max_pages=40, apis=spark.createDataFrame([("moved", "a"), ("whole", "a")], "show string, api string"))


def test_status_of_page_lists(lists):
    got = {r["show"]: (r["status"], r["pages"]) for r in lists[0].collect()}
    assert got == {"whole": ("ok", 37), "long": ("cut", 40), "single": ("ok", 1), "old": ("stale", 3), "moved": ("stale", 2), "gap": ("broken", 4), "headless": ("broken", 0), "twice": ("ok", 1), "circle": got["circle"], "aside": ("ok", 1)}
    assert got["circle"][0] in ("broken", "cut")


def test_titles_stand_in_the_order_of_the_chain(lists):
    got = {}
    for r in lists[1].collect():
        got.setdefault(r["show"], []).append((r["page_no"], r["title"]))
    assert sorted(got["whole"]) == [(k, f"whole {k}") for k in range(37)] and sorted(got["long"]) == [(k, f"long {k}") for k in range(40)]
    assert sorted(got["gap"]) == [(k, f"gap {k}") for k in range(4)] and got["twice"] == [(0, "new")] and got["aside"] == [(0, "0")]
    assert not set(got) & {"old", "moved", "headless"}


def test_no_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text("{}\n")
    status, titles = readers.read_wiki_titles(spark, f"file://{tmp_path}", 1.0)
    assert status.count() == 0 and titles.count() == 0


# ---- versions ------------------------------------------------------------------------------------
def test_two_writers_at_once_leave_two_versions(spark, tmp_path, monkeypatch):
    """Both ask for the same number: one gets it, the other the next."""
    path, met = f"file://{tmp_path}/report", threading.Barrier(2)
    create = writers._create

    def together(*args):
        if args[1].endswith(f"{1:012d}"):
            met.wait(60)
        return create(*args)

    monkeypatch.setattr(writers, "_create", together)
    threads = [threading.Thread(target=writers.publish, args=(spark.range(n), path)) for n in (3, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    named = sorted(p.name for p in (tmp_path / "report/CURRENT").iterdir() if not p.name.startswith("."))
    assert named == [f"{1:012d}", f"{2:012d}"]
    assert {(tmp_path / "report/CURRENT" / n).read_text() for n in named} == {p.name for p in (tmp_path / "report").iterdir() if p.name.startswith("v-")}
    assert writers.read_published(spark, path).count() in (3, 5)


# ---- answers -------------------------------------------------------------------------------------
def asking(log, fails=""):
    def model():
        def ask(prompt):
            if prompt == fails:
                raise RuntimeError("no")
            with open(log, "a") as f:
                f.write(prompt + "\n")
            return prompt[::-1]

        return ask

    return model


def test_equal_prompts_are_asked_once(spark, tmp_path):
    log, store = tmp_path / "log", f"file://{tmp_path}/store"
    req = spark.createDataFrame([("s", 1, i, f"prompt {i % 7}") for i in range(70)] + [("s", 2, 0, None)], f"{KEYS}, card_no long, prompt string")
    for _ in range(2):
        got = repair.score_requests(req, asking(log, "prompt 3"), "m", store).collect()
        assert {(r["card_no"], r["output"], r["error"]) for r in got} == {(i, "" if i % 7 == 3 else f"prompt {i % 7}"[::-1], "RuntimeError: no" if i % 7 == 3 else None) for i in range(70)}
    assert sorted(log.read_text().split("\n")[:-1]) == [f"prompt {k}" for k in (0, 1, 2, 4, 5, 6)]
    assert Answers(store, "m").get("prompt 1") == "1 tpmorp" and Answers(store, "other").get("prompt 1") is None


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from cueloom.operators import repair
folder = sys.argv[1]
spark = SparkSession.builder.master("local[1,3]").config("spark.ui.enabled", "false").config("spark.python.worker.reuse", "false").config("spark.checkpoint.dir", f"file://{folder}/scratch").getOrCreate()

def model():
    def ask(prompt):
        with open(f"{folder}/log", "a") as f:
            f.write(prompt + "\\\\n")
        if prompt == "prompt 7" and not os.path.exists(f"{folder}/killed"):
            open(f"{folder}/killed", "w").close()
            os._exit(1)
        return prompt[::-1]
    return ask

req = spark.createDataFrame([("s", 1, i, f"prompt {i}") for i in range(15)], "show string, episode long, card_no long, prompt string").coalesce(1)
got = repair.score_requests(req, model, "m", f"file://{folder}/store", workers=1).collect()
assert {r["card_no"]: r["output"] for r in got} == {i: f"prompt {i}"[::-1] for i in range(15)}
print("answered")
"""


def test_a_killed_task_asks_nothing_twice(tmp_path):
    """The worker dies while it asks for one prompt; only this one is asked again."""
    out = subprocess.run([sys.executable, "-c", KILLED.replace("\\\\n", "\\n"), str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert "answered" in out.stdout, out.stderr[-2000:]
    asked = (tmp_path / "log").read_text().split("\n")[:-1]
    assert sorted(asked) == sorted([f"prompt {i}" for i in range(15)] + ["prompt 7"])


def test_percentile_of_latencies(spark):
    rows = [("s", 1, "repaired", v) for v in range(1, 101)] + [("s", 2, "kept", None), ("s", 3, "skipped_no_ref", 7)]
    got = {r["episode"]: tuple(r)[2:] for r in repair.repair_summary(spark.createDataFrame(rows, f"{KEYS}, status string, latency_ms long")).collect()}
    assert got == {1: (100, 100, 0, 5050, 95), 2: (1, 0, 0, None, None), 3: (1, 0, 1, 7, 7)}
    assert spark.range(1).select(F.bround(F.lit(0.95 * 99))).first()[0] == 94


def test_packed_files_read_as_loose_ones(spark, tmp_path):
    """The same rows from a pack, which has no file for each episode."""
    rows = [("s", e, k, 1000 * k, 1000 * k + 900, f"line {k}\n\nof {e}\n") for e in range(40) for k in range(3)]
    cards = spark.createDataFrame(rows, "show string, episode long, card_no long, start_ms long, end_ms long, text string")
    got = []
    for packed in (False, True):
        path = f"file://{tmp_path}/srt-{packed}"
        writers.write_srt(cards, path, cards.where("episode < 10").select("show", "episode").distinct(), packed=packed)
        episode = F.regexp_extract("path", "/show=s/episode=([^/]+)/", 1).cast("long")
        events = readers.read_subtitles(spark, path, packed).select(episode, "ev_no", "start_ms", "end_ms", "text", "plaintext")
        tracks = readers.read_tracks(spark, path, packed).select(episode, "kind", "events", "styles", "status")
        status, conf = readers.read_conf(spark, path, cards.select(F.col("episode").cast("string")).distinct(), packed)
        got.append([sorted(map(tuple, df.collect())) for df in (events, tracks, status, conf)])
    assert got[0] == got[1] and len(got[1][0]) == 90 and len(got[1][1]) == 30
    assert len([f for f in (tmp_path / "srt-True").rglob("*") if f.suffix == ".parquet"]) < 30


@pytest.mark.parametrize("name", ["read_conf", "write_srt", "read_subtitles", "read_styles", "read_tracks", "write_merged_track"])
def test_queries_make_no_file_an_episode(spark, tmp_path, monkeypatch, name):
    from cueloom.plans import io_queries

    monkeypatch.setattr(io_queries, "folder", lambda spark, n: f"file://{tmp_path}/{n}")
    assert io_queries.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    assert sum(f.is_file() and f.suffix in (".txt", ".parquet") for f in tmp_path.rglob("*")) < 40
