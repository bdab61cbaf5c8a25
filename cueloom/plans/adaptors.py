"""Timed-text views over the given tables, in whole milliseconds: once for Spark, once as SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["show", "episode"]
#: Documents whose words one task holds, on average.
DEALT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a, b):
    return F.floor(a / b).cast("long")


def word_list(text: Column) -> Column:
    """The words of a document, as ``v_words`` has them."""
    return F.split(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")), " ")


def by_episode(docs: DataFrame) -> DataFrame:
    """Documents dealt by doc_id, some ``DEALT`` to a task: their words lie together before there are any,
    so no step that works within an episode shuffles words."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // DEALT)
    return docs.repartition(n, "doc_id")


def v_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_list(F.col("text"))
    docs = by_episode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    w = docs.select(F.lit("all").alias("show"), F.col("doc_id").alias("episode"), F.posexplode(words).alias("pos", "text"))
    start = F.col("pos") * 400 + 700 * _div(F.col("pos"), 7)
    return w.select("show", "episode", F.col("pos").cast("long").alias("pos"), "text", start.cast("long").alias("start"), (start + 300).cast("long").alias("end"),
                    _div(F.col("pos"), 7).alias("seg"), ((F.col("pos") * 37 + F.col("episode") * 11) % 100).cast("long").alias("prob"))


def v_segments(words: DataFrame) -> DataFrame:
    return words.groupBy(*KEYS, "seg").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("no_speech_prob", (F.col("episode") * 7 + F.col("seg") * 3) % 100)


def v_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.lit("all").alias("show"), F.col("conv_id").alias("episode"), F.col("turn").alias("card_no"), "text", (F.col("turn") * 3000).alias("start"),
                    (F.col("turn") * 3000 + 2500).alias("end"), (-((F.col("conv_id") * 13 + F.col("turn") * 7) % 300)).alias("avg_logprob"), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 100).alias("no_speech_prob"))


def v_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where((F.col("conv_id") + F.col("turn")) % 3 != 0)
    start = F.col("turn") * 3000 + 200 + 3 * F.col("turn")
    return c.select(F.lit("all").alias("show"), F.col("conv_id").alias("episode"), F.col("turn").alias("cue_no"), start.alias("start"), (start + 1500).alias("end"), "text")


def v_long_cards(words: DataFrame) -> DataFrame:
    """One card for each span of v_words (a span is a segment there)."""
    return words.groupBy(*KEYS, F.col("seg").alias("card_no")).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def v_long_cues(words: DataFrame) -> DataFrame:
    return cues_of(v_long_cards(words))


def cues_of(cards: DataFrame) -> DataFrame:
    """v_long_cues from v_long_cards."""
    shift = 150 + _div(F.col("card_no"), 10)
    return cards.where("card_no % 4 <> 0").select(*KEYS, F.col("card_no").alias("cue_no"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))


def v_repeat_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = table(spark, sf_dir, "events").select(F.lit("all").alias("show"), F.col("user_id").alias("episode"), n.alias("card_no"), F.col("event_type").alias("text"))
    return e.withColumns({"start": F.col("card_no") * 1000, "end": F.col("card_no") * 1000 + 900})


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(F.lit("all").alias("show"), F.lit(0).cast("long").alias("episode"), F.col("user_id").alias("card_no"), n.alias("frame_no"), (F.col("value") > 60).alias("voiced"))


def v_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 5
    tag = F.when(k % 17 == 0, F.lit("special")).otherwise(F.format_string("S%02dE%02d", k % 12 + 1, k % 24 + 1))
    path = F.format_string("/lib/Show %d/Season %02d/Show %d - %s - %d.mkv", c, k % 12 + 1, c, tag, k)
    return table(spark, sf_dir, "orders").select(F.format_string("Show %d", c).alias("show"), k.alias("file_no"), path.alias("path"), F.col("o_orderstatus").alias("status_letter"),
                                                 (k * 1000 + F.col("o_custkey")).alias("size"), (k * 7 % 100_000).alias("mtime"))


def v_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's tracks: letter O is audio, F a subtitle; A eng, N jpn, R fre; track 1 is default."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("track_id")).agg(F.min("l_linestatus").alias("s"), F.min("l_returnflag").alias("r"))
    return g.select("file", "track_id", F.when(F.col("s") == "O", "audio").otherwise("subtitles").alias("type"), F.when(F.col("r") == "A", "eng").when(F.col("r") == "N", "jpn").otherwise("fre").alias("language"),
                    F.when((F.col("track_id") % 3 == 0), "Signs & Songs").when(F.col("track_id") % 5 == 0, "Dubtitles").otherwise("Full").alias("name"), (F.col("track_id") == 1).alias("is_default"),
                    F.when(F.col("track_id") % 2 == 0, "ass").otherwise("subrip").alias("codec"))


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle events from conversations: style and tags follow the numbers."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    tag = F.when(n % 7 == 1, r"{\an8}").when(n % 7 == 2, r"{\k20}").when(n % 7 == 3, r"{\pos(1,2)}").when(n % 7 == 4, r"{\an2}").otherwise("")
    style = F.when(n % 5 == 0, "Default").when(n % 5 == 1, "Signs").when(n % 5 == 2, "Song Translation").when(n % 5 == 3, "Romaji").otherwise("Other")
    plain = F.when(n % 11 == 0, F.lit(" ")).otherwise(F.col("text"))
    return c.select(F.lit("all").alias("show"), F.col("conv_id").alias("episode"), (F.col("turn") % 2).alias("track"), F.col("turn").alias("ev_no"), (F.col("turn") % 3).alias("layer"),
                    (F.floor(F.col("turn") / 2) * 3000).cast("long").alias("start_ms"), (F.floor(F.col("turn") / 2) * 3000 + 2000).cast("long").alias("end_ms"), style.alias("style"),
                    F.concat(tag, plain).alias("text"), plain.alias("plaintext"), (n % 13 == 0).alias("is_comment"))


VIEWS = {
    "v_words": r"""SELECT 'all' AS show, doc_id AS episode, pos, text, pos * 400 + 700 * (pos // 7) AS start, pos * 400 + 700 * (pos // 7) + 300 AS "end", pos // 7 AS seg, (pos * 37 + doc_id * 11) % 100 AS prob
FROM (SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' ') AS w FROM documents))""",
    "v_segments": """SELECT show, episode, seg, min(start) AS start, max("end") AS "end", (episode * 7 + seg * 3) % 100 AS no_speech_prob FROM v_words GROUP BY ALL""",
    "v_cards": """SELECT 'all' AS show, conv_id AS episode, turn AS card_no, text, turn * 3000 AS start, turn * 3000 + 2500 AS "end", -((conv_id * 13 + turn * 7) % 300) AS avg_logprob, (conv_id * 7 + turn * 3) % 100 AS no_speech_prob FROM conversations""",
    "v_cues": """SELECT 'all' AS show, conv_id AS episode, turn AS cue_no, turn * 3000 + 200 + 3 * turn AS start, turn * 3000 + 1700 + 3 * turn AS "end", text FROM conversations WHERE (conv_id + turn) % 3 <> 0""",
    "v_long_cards": """SELECT show, episode, seg AS card_no, min(start) AS start, max("end") AS "end" FROM v_words GROUP BY ALL""",
    "v_long_cues": """SELECT show, episode, card_no AS cue_no, start + 150 + card_no // 10 AS start, "end" + 150 + card_no // 10 AS "end" FROM v_long_cards WHERE card_no % 4 <> 0""",
    "v_repeat_cards": """SELECT 'all' AS show, user_id AS episode, n AS card_no, event_type AS text, n * 1000 AS start, n * 1000 + 900 AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""",
    "v_frames": """SELECT 'all' AS show, 0 AS episode, user_id AS card_no, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no, value > 60 AS voiced FROM events""",
    "v_files": """SELECT 'Show ' || c AS show, k AS file_no, '/lib/Show ' || c || '/Season ' || printf('%02d', k % 12 + 1) || '/Show ' || c || ' - ' || CASE WHEN k % 17 = 0 THEN 'special' ELSE printf('S%02dE%02d', k % 12 + 1, k % 24 + 1) END || ' - ' || k || '.mkv' AS path,
s AS status_letter, k * 1000 + u AS size, k * 7 % 100000 AS mtime FROM (SELECT o_orderkey AS k, o_custkey AS u, o_custkey % 5 AS c, o_orderstatus AS s FROM orders)""",
    "v_tracks": """SELECT file, track_id, CASE WHEN s = 'O' THEN 'audio' ELSE 'subtitles' END AS type, CASE r WHEN 'A' THEN 'eng' WHEN 'N' THEN 'jpn' ELSE 'fre' END AS language,
CASE WHEN track_id % 3 = 0 THEN 'Signs & Songs' WHEN track_id % 5 = 0 THEN 'Dubtitles' ELSE 'Full' END AS name, track_id = 1 AS is_default, CASE WHEN track_id % 2 = 0 THEN 'ass' ELSE 'subrip' END AS codec
FROM (SELECT l_orderkey AS file, l_linenumber AS track_id, min(l_linestatus) AS s, min(l_returnflag) AS r FROM lineitem GROUP BY ALL)""",
    "v_events": r"""SELECT 'all' AS show, conv_id AS episode, turn % 2 AS track, turn AS ev_no, turn % 3 AS layer, (turn // 2) * 3000 AS start_ms, (turn // 2) * 3000 + 2000 AS end_ms,
CASE n % 5 WHEN 0 THEN 'Default' WHEN 1 THEN 'Signs' WHEN 2 THEN 'Song Translation' WHEN 3 THEN 'Romaji' ELSE 'Other' END AS style,
CASE n % 7 WHEN 1 THEN '{\an8}' WHEN 2 THEN '{\k20}' WHEN 3 THEN '{\pos(1,2)}' WHEN 4 THEN '{\an2}' ELSE '' END || plain AS text, plain AS plaintext, n % 13 = 0 AS is_comment
FROM (SELECT *, conv_id + turn AS n, CASE WHEN (conv_id + turn) % 11 = 0 THEN ' ' ELSE text END AS plain FROM conversations)""",
}
_NEEDS = {"v_segments": ["v_words"], "v_long_cards": ["v_words"], "v_long_cues": ["v_words", "v_long_cards"]}


def sql(body: str, *views: str, **more: str) -> str:
    """``body`` behind the named views (and what these need) and further named queries."""
    names: list[str] = []
    for v in views:
        names += [n for n in (*_NEEDS.get(v, ()), v) if n not in names]
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    text = f"WITH {', '.join(parts)} {body}" if parts else body
    return re.sub(r"(?<![\"'])\bshow\b(?![\"'])", '"show"', text)  # a reserved word
