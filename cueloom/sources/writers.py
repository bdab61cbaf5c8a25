"""Sinks: caption files, merged tracks, audits, reports, error logs.

Where a target has to change at once, a finished folder is written beside it and only then named by the
next numbered file below ``CURRENT``; readers follow the file with the highest number.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.functions.text import fmt_srt_ms
from cueloom.operators.joins import KEYS


def render_srt(cards: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, body): each episode's cards (card_no, start_ms, end_ms, text) as one SRT text."""
    rows = F.sort_array(F.collect_list(F.struct("card_no", "start_ms", "end_ms", "text")))
    out = cards.groupBy(*keys).agg(rows.alias("__r"))
    one = lambda r, i: F.concat((i + 1).cast("string"), F.lit("\n"), fmt_srt_ms(r["start_ms"]), F.lit(" --> "), fmt_srt_ms(r["end_ms"]), F.lit("\n"), r["text"], F.lit("\n\n"))
    return out.select(*keys, F.array_join(F.transform("__r", one), "").alias("body"))


def write_bodies(bodies: DataFrame, path: str, keys: Sequence[str] = KEYS, packed: bool = False) -> None:
    """A text file for each row (keys, body), below folders of its keys. A file costs its file system far more
    than its few bytes do, so that many are ``packed``: rows (path, value) of Parquet files, whole texts
    under the paths that they would have; readers take either."""
    if packed:
        level = lambda k: F.concat(F.lit(f"/{k}="), F.replace(F.col(k).cast("string"), F.lit("/"), F.lit("%2F")))
        bodies.select(F.concat(*[level(k) for k in keys], F.lit("/body.txt")).alias("path"), F.col("body").alias("value")).write.mode("append").parquet(path)
    else:
        bodies.write.partitionBy(*keys).option("lineSep", "\n").mode("append").text(path)


def write_srt(cards: DataFrame, path: str, existing: DataFrame | None = None, keys: Sequence[str] = KEYS, packed: bool = False) -> None:
    """Text files below show=/episode= folders, or ``packed``; episodes in ``existing`` (keys) are left alone."""
    todo = cards.join(existing, list(keys), "left_anti") if existing is not None else cards
    write_bodies(render_srt(todo, keys), path, keys, packed)


def render_track(events: DataFrame, styles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, body): each episode's merged events (ord, layer, start_ms, end_ms, style, text) and
    styles (style, fontname, fontsize) as one script."""
    cs = lambda c: F.format_string("%d:%02d:%02d.%02d", F.floor(F.col(c) / 3_600_000), F.floor(F.col(c) / 60_000) % 60, F.floor(F.col(c) / 1000) % 60, F.floor(F.col(c) / 10) % 100)
    line = F.concat(F.lit("Dialogue: "), F.col("layer").cast("string"), F.lit(","), cs("start_ms"), F.lit(","), cs("end_ms"), F.lit(","), F.col("style"), F.lit(",,0,0,0,,"), F.replace(F.col("text"), F.lit("\n"), F.lit("\\N")))
    ordered = lambda by, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, c.alias("l")))), lambda r: r["l"]), "\n")
    ev = events.groupBy(*keys).agg(ordered("ord", line).alias("__e"))
    st = styles.groupBy(*keys).agg(ordered("style", F.concat_ws(",", F.concat(F.lit("Style: "), "style"), "fontname", F.col("fontsize").cast("string"))).alias("__s"))
    head = F.lit("[Script Info]\nScaledBorderAndShadow: yes\n\n[V4+ Styles]\n")
    return ev.join(st, list(keys), "left").select(*keys, F.concat(head, F.coalesce("__s", F.lit("")), F.lit("\n\n[Events]\n"), "__e", F.lit("\n")).alias("body"))


def write_merged_track(events: DataFrame, styles: DataFrame, path: str, keys: Sequence[str] = KEYS, packed: bool = False) -> None:
    write_bodies(render_track(events, styles, keys), path, keys, packed)


def write_audit(audit: DataFrame, path: str, ref_chars: int = 80) -> None:
    """CSV with a header: keys, orig, repaired, ref (cut), latency_ms, below show= folders."""
    audit.withColumn("ref", F.substring("ref", 1, ref_chars)).write.partitionBy("show").option("header", True).option("escape", '"').mode("append").csv(path)


def report_json(report: DataFrame, rollup: DataFrame) -> DataFrame:
    """(show, body): a JSON object for each show with its aggregate and its episodes."""
    episode = F.struct(*[c for c in report.columns if c != "show"])
    shows = report.groupBy("show").agg(F.array_sort(F.collect_list(episode)).alias("episodes"))
    total = rollup.where("show is not null").select("show", F.struct(*[c for c in rollup.columns if c != "show"]).alias("aggregate"))
    return shows.join(total, "show", "left").select("show", F.to_json(F.struct(F.lit(2).alias("schema_version"), "show", "aggregate", "episodes")).alias("body"))


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file that is not there yet; False where it is. The file system decides between writers."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = files.create(target, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def _published(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the last version below ``path``."""
    try:
        named = spark.read.text(f"{path}/CURRENT", wholetext=True).select(F.col("_metadata.file_name").cast("long").alias("number"), F.trim("value").alias("version"))
        last = named.where("number is not null and version <> ''").orderBy(F.desc("number")).first()
    except AnalysisException:  # nothing was published yet
        return None
    return (last["number"], last["version"]) if last else None


def publish(df: DataFrame, path: str) -> str:
    """Write ``df`` as a new version below ``path`` and give it the next number; all or nothing, since
    readers see the earlier version until then. Of writers that ask for one number at once, one gets
    it and the others try the next, so no version is lost. Returns the version's folder."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    number = (_published(spark, path) or (0, ""))[0] + 1
    while not _create(spark, f"{path}/CURRENT/{number:012d}", version):
        number += 1
    return f"{path}/{version}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    last = _published(spark, path)
    if last is None:
        raise ValueError(f"nothing is published below {path}")
    return spark.read.parquet(f"{path}/{last[1]}")


def write_report(report: DataFrame, rollup: DataFrame, path: str) -> str:
    return publish(report_json(report, rollup), path)


def write_error_log(failed: DataFrame, path: str) -> None:
    """Append failed items (path, exc_type, msg, time); the others go their own way."""
    failed.select("path", "exc_type", "msg", "time").write.mode("append").json(path)


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) of a step that leaves an error text or null."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
