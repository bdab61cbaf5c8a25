"""Library listings: what needs work, in what order, what is linked or new."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators.ranks import rank_within, ranked

# Fixed values.
SKIP_NAME = r"(?i)\bNCED\b|\bNCOP\b|\bNCBD\b|-\s*scene\b|creditless"
SIDECARS = {"ass": ".eng.dubtitles.ass", "srt": ".eng.dubtitles.srt"}


def stem_of(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def scan_library(files: DataFrame, extras: Sequence[str] = tuple(T.EXTRA_DIRS), skip: str = SKIP_NAME, exts: Sequence[str] = T.VIDEO_EXTS) -> DataFrame:
    """Video files of a listing (path, ...) outside the extra folders and not named as clips; adds
    stem and ext."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    dirs = F.split(F.lower(F.col("path")), "/")
    inside = F.arrays_overlap(F.slice(dirs, 1, F.size(dirs) - 1), F.array(*[F.lit(x) for x in extras]))
    return files.where(ext.isin(*exts) & ~inside & ~F.substring_index("path", "/", -1).rlike(skip)).withColumns({"stem": stem_of(F.col("path")), "ext": ext})


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime) of all files below ``path``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def skip_extras(files: DataFrame, extras: DataFrame) -> DataFrame:
    """Files with no directory among ``extras`` (word)."""
    dirs = F.split(F.lower(F.col("path")), "/")
    hit = files.select("path", F.explode(F.slice(dirs, 1, F.size(dirs) - 1)).alias("word")).join(F.broadcast(extras.select(F.lower("word").alias("word")).distinct()), "word").select("path").distinct()
    return files.join(hit, "path", "left_anti")


def sidecars_of(listing: DataFrame) -> DataFrame:
    """(stem, has_ass, has_srt, has_fail) from all paths of a listing."""
    out = listing.withColumn("__k", F.when(F.endswith("path", F.lit(SIDECARS["ass"])), "ass").when(F.endswith("path", F.lit(SIDECARS["srt"])), "srt").when(F.endswith("path", F.lit(".dubtitles.fail")), "fail")).where("__k is not null")
    stem = F.regexp_replace("path", r"(\.eng\.dubtitles\.(ass|srt)|\.dubtitles\.fail)$", "")
    has = lambda k: F.max((F.col("__k") == k).cast("int")).cast("boolean").alias(f"has_{k}")
    return out.groupBy(stem.alias("stem")).agg(has("ass"), has("srt"), has("fail"))


def sub_source(sidecars: DataFrame) -> DataFrame:
    """(stem, source): the ass before the srt, null without either."""
    out = F.when(F.col("has_ass"), F.concat("stem", F.lit(SIDECARS["ass"]))).when(F.col("has_srt"), F.concat("stem", F.lit(SIDECARS["srt"])))
    return sidecars.select("stem", out.alias("source"))


def stamp_valid(files: DataFrame, stamps: DataFrame, tol: float = 1.0) -> DataFrame:
    """Files (stem, size, mtime) with stamped: a muxed stamp of this size and, within ``tol``, time."""
    s = stamps.select("stem", F.col("size").alias("__s"), F.col("mtime").alias("__m"), F.col("muxed").alias("__x"))
    ok = F.col("__x") & (F.col("size") == F.col("__s")) & (F.abs(F.col("mtime") - F.col("__m")) < tol)
    return files.join(s, "stem", "left").withColumn("stamped", F.coalesce(ok, F.lit(False))).drop("__s", "__m", "__x")


def needs_work(files: DataFrame, sidecars: DataFrame, probe: DataFrame, skip_if_srt: bool = True) -> DataFrame:
    """Files (stem, stamped) with status. sidecars: (stem, has_ass, has_srt, has_fail); probe:
    (stem, has_named, has_eng)."""
    out = files.join(sidecars, "stem", "left").join(probe, "stem", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    status = F.when(yes("stamped"), "already-muxed").when(yes("has_ass"), "already-ass")
    if skip_if_srt:
        status = status.when(yes("has_srt"), "already-srt")
    status = status.when(yes("has_named"), "already-muxed").when(yes("has_fail"), "skip-prior-crash").when(~yes("has_eng"), "no-eng-dub").otherwise("todo")
    return out.withColumn("status", status)


def mux_status(files: DataFrame) -> DataFrame:
    """Files (source, stamped, has_named, free, size) with status."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    status = F.when(F.col("source").isNull(), "no-sub").when(yes("stamped") | yes("has_named"), "already-muxed").when(~has_room(F.col("free"), F.col("size")), "skip-no-room").otherwise("plan")
    return files.withColumn("status", status)


def has_room(free: Column, size: Column, percent: int = 110, margin_gb: int = 5) -> Column:
    return free * 100 >= size * percent + F.lit(margin_gb * (1 << 30)).cast("long") * 100


def dry_run_counts(files: DataFrame) -> DataFrame:
    """(generate, repair, mux): files without a caption file, with one but no merged track, and with
    a merged track."""
    n = lambda c: F.sum(c.cast("int"))
    ass, srt = F.coalesce("has_ass", F.lit(False)), F.coalesce("has_srt", F.lit(False))
    return files.agg(n(~ass & ~srt).alias("generate"), n(~ass & srt).alias("repair"), n(ass).alias("mux"))


def order_files(files: DataFrame, starts: Mapping[str, int] | DataFrame) -> DataFrame:
    """Files (show, path) with rank: tagged seasons from the show's start on first, then season,
    episode, path; by path alone where the start is not positive."""
    if not isinstance(starts, DataFrame):
        starts = files.sparkSession.createDataFrame(list(starts.items()) or [("", 0)], "show string, start int")
    se = T.season_episode(F.col("path"))
    out = files.join(starts.select("show", F.col("start").alias("__start")), "show", "left").withColumns({"__s": se["season"], "__e": se["episode"], "__start": F.coalesce("__start", F.lit(0))})
    on = F.col("__start") > 0
    tier = F.when(on, F.when((F.col("__s") >= F.col("__start")) & (F.col("__s") < 1_000_000), 0).otherwise(1)).otherwise(0)
    out = out.withColumns({"__tier": tier, "__s": F.when(on, F.col("__s")).otherwise(0), "__e": F.when(on, F.col("__e")).otherwise(0)})
    ranks = rank_within(out, "show", ["__tier", "__s", "__e", "path"], "rank")
    return ranks.withColumn("rank", F.col("rank").cast("int")).drop("__start", "__tier", "__s", "__e")


def read_starts(lines: DataFrame) -> DataFrame:
    """Lines Show:NN (split at the last colon, a bad number is 0) -> (show, start)."""
    v = F.trim("value")
    return lines.where((v != "") & ~F.startswith(v, F.lit("#"))).select(F.regexp_extract(v, r"^(.*):[^:]*$", 1).alias("show"), F.coalesce(F.trim(F.substring_index(v, ":", -1)).try_cast("int"), F.lit(0)).alias("start"))


def show_priority(order: DataFrame, shows: DataFrame) -> DataFrame:
    """Listed shows (show, ord) with rank and status; a listed show without files is skip-missing."""
    there = shows.select("show").distinct().withColumn("__there", F.lit(True))
    listed = ranked(order.select("show", "ord"), ["ord", "show"], "__at")
    return listed.join(there, "show", "left").select("show", (F.col("__at") + 1).cast("int").alias("rank"), F.when(F.col("__there"), "ok").otherwise("skip-missing").alias("status"))


def hardlink_groups(files: DataFrame) -> DataFrame:
    """(path, partners): how many other paths share the inode, device and size."""
    w = Window.partitionBy("ino", "dev", "size")
    return files.withColumn("partners", F.count(F.lit(1)).over(w) - 1).where("partners > 0").select("path", "partners")


def stem_to_video(files: DataFrame) -> DataFrame:
    """(stem, path): the stem's video, mkv before mp4 before m4v."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rank = F.array_position(F.array(*[F.lit(e) for e in T.VIDEO_EXTS]), ext)
    return files.where(rank > 0).groupBy(stem_of(F.col("path")).alias("stem")).agg(F.min_by("path", F.struct(rank, F.col("path"))).alias("path"))


def new_since(before: DataFrame, after: DataFrame) -> DataFrame:
    """Stems that are done now and were not."""
    return after.select("stem").distinct().join(before.select("stem").distinct(), "stem", "left_anti")
