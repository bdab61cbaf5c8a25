"""The stages in a row on the smallest tables, and each against what it has to do."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import llm_brute
from cueloom.llm import decontamination

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        path = f"file://{tmp_path_factory.mktemp('stage')}/out"
        result.write.parquet(path)
        out.append((name, docs, result.columns, spark.read.parquet(path)))
        docs = out[-1][3]
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(steps):
    assert [c for _, _, c, _ in steps[:-1]] == [COLUMNS] * 4 and steps[-1][2] == [*COLUMNS, "shard"]


def test_quality_stage(steps):
    """Against the base rules and exact estimates; bins may move a row at the edge."""
    _, before, _, after = steps[0]
    rows = [(r, llm_brute.statistics(r["text"])) for r in before.collect()]
    passed = [(r["doc_id"], r["lang"], r["source"], (*n[:2], *llm_brute.more_counts(r["text"]))) for r, n in rows if not llm_brute.base_failed(n)]
    want = {i for i, kept in llm_brute.verdicts(passed).items() if kept}
    assert len(want ^ ids(after)) <= 0.01 * len(rows)
    assert 0 < len(want) < len(passed) < len(rows)  # either rule has its part


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_dedup_stage(steps):
    """Against the shingles themselves: what goes is linked to what stays, and of the documents that
    are linked at least nine tenths of those that should go do."""
    _, before, _, after = steps[1]
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in before.select("doc_id", "text").collect()}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    gone, due = ids(before) - ids(after), {i for i in sets if find(i) != i}
    assert gone <= due and len(gone) >= 0.9 * len(due) > 0


def test_decontamination_stage(spark, steps):
    _, before, _, after = steps[2]
    found = decontamination.find_contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(before) - ids(after) == ids(found.where("contaminated"))


def test_mixing_keeps_all(steps):
    assert ids(steps[3][1]) == ids(steps[3][3])


def test_shards_are_contiguous_in_the_stored_order(steps):
    _, before, _, after = steps[4]
    order = before.select("doc_id", "text", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    shard = {r["doc_id"]: r["shard"] for r in after.collect()}
    first = {}
    for k, r in enumerate(order):
        first.setdefault(r["text"], k)
    seen = [shard[r["doc_id"]] for r in sorted(order, key=lambda r: first[r["text"]])]
    assert seen == sorted(seen) and max(seen) == 15


def test_run(spark, steps):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(steps[-1][3])


TAKEN = ["n_words", "kept", "items", "spans", "slot", "place", "block", "group_start", "base_failed", "__counts", "component_id", "contaminated", "release"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns named as the operators'."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    more = spark.createDataFrame([(900, None, "en", "s", 1), (901, "", None, None, None), (None, long, "en", None, 2), (902, long, None, "s", None), (902, long, None, "s", None), (None, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.unionByName(more)
    return docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in TAKEN}).withColumn("shard", F.lit("old"))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_every_column(spark, odd, name, stage):
    odd.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/odd-{name.replace(' ', '-')}")
    docs = spark.read.parquet(path)
    out = stage(spark, docs, SF)
    last = name == "sharding"
    kept = [c for c in docs.columns if not (last and c == "shard")]
    assert out.columns == [*kept, "shard"] if last else out.columns == docs.columns
    before, after = [[tuple(r) for r in df.select(kept).collect()] for df in (docs, out)]
    assert all(before.count(r) >= after.count(r) > 0 for r in set(after))
    if name in ("mixing", "sharding"):
        assert sorted(before, key=str) == sorted(after, key=str)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0
