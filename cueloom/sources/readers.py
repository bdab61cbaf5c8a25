"""Readers: transcripts, confidence files, subtitles, glossaries, word lists, page indexes.

Each reads a folder of landed files through Spark's own sources; a file that cannot be read as its
kind gives no rows or a status, never an error.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions.text import EXTRA_DIRS
from cueloom.sources.scratch import materialize

TRANSCRIPT = """show string, episode long, segments array<struct<start:double,end:double,no_speech_prob:double,avg_logprob:double,text:string,
words:array<struct<word:string,start:double,end:double,probability:double>>>>"""
CONF_ROW = "start string, end string, text string, avg_logprob double, no_speech_prob double, flag string, word_probs array<double>"
GLOSSARY = "show string, names array<string>, phrases array<string>, hard_fixes map<string,string>, initial_prompt string, verified array<string>, flagged map<string,string>"
PAGES = "query struct<allpages:array<struct<pageid:long,title:string>>>, continue struct<apcontinue:string>, request struct<apcontinue:string>, api string, fetched_at double, show string"


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(words, segments) of transcript JSON, one object to a line. A null or zero probability is 1;
    a segment without words is one word with its mean probability."""
    raw = spark.read.schema(TRANSCRIPT).json(path).select("show", "episode", F.posexplode("segments").alias("seg", "s"))
    raw = raw.withColumn("seg", F.col("seg").cast("long"))
    segments = raw.select("show", "episode", "seg", "s.start", "s.end", "s.no_speech_prob")
    whole = F.array(F.struct(F.col("s.text").alias("word"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.least(F.lit(1.0), F.exp("s.avg_logprob")).alias("probability")))
    words = raw.select("show", "episode", "seg", F.posexplode(F.when(F.size(F.coalesce("s.words", F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>"))) > 0, F.col("s.words")).otherwise(whole)).alias("at", "w"))
    pos = F.row_number().over(Window.partitionBy("show", "episode").orderBy("seg", "at")).cast("long") - 1
    return words.select("show", "episode", pos.alias("pos"), F.col("w.word").alias("text"), "w.start", "w.end", F.coalesce(F.nullif("w.probability", F.lit(0.0)), F.lit(1.0)).alias("prob"), "seg"), segments


def text_files(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(path, file, value): every text file below ``path``, or in its pack (``write_bodies``), whole."""
    if packed:
        return spark.read.schema("path string, value string").parquet(path).select("path", F.regexp_extract("path", "[^/]*$", 0).alias("file"), "value")
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")


def read_conf(spark: SparkSession, path: str, episodes: DataFrame, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(status, cards) of files <episode>.dubtitles.conf.json, or of those in folders
    episode=<episode>, each a JSON list. Status is no-conf, bad-conf or ok; rows without a valid span
    are left out."""
    named = F.coalesce(*[F.nullif(F.regexp_extract("path", p, 1), F.lit("")) for p in (r"/([^/]*)\.dubtitles\.conf\.json$", "/episode=([^/]*)/[^/]*$")])
    files = text_files(spark, path, packed).select(named.alias("episode"), F.trim("value").alias("body"))
    # Element by element, so that one that is no object spoils no other.
    parsed = files.withColumn("rows", F.when(F.startswith("body", F.lit("[")), F.from_json("body", "array<string>")))
    status = episodes.join(parsed.select("episode", F.lit(True).alias("__there"), "rows"), "episode", "left")
    status = status.select("episode", F.when(F.col("__there").isNull(), "no-conf").when(F.col("rows").isNull(), "bad-conf").otherwise("ok").alias("status"))
    cards = parsed.select("episode", F.posexplode("rows").alias("card_no", "r")).where("startswith(r, '{')").withColumn("r", F.from_json("r", CONF_ROW))
    cards = cards.select("episode", "card_no", F.col("r.start").try_cast("double").alias("start"), F.col("r.end").try_cast("double").alias("end"), "r.text", "r.avg_logprob", "r.no_speech_prob", "r.flag", "r.word_probs")
    return status, cards.where("start >= 0 and end > start")


def _ass_ms(t: Column) -> Column:
    part = lambda i: F.regexp_extract(t, r"^(\d+):(\d+):(\d+)[.,](\d+)$", i).try_cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + F.rpad(F.regexp_extract(t, r"[.,](\d+)$", 1), 3, "0").try_cast("long")


def plain_text(text: Column) -> Column:
    """Without {...} tags; \\N and \\n are line ends, \\h a space."""
    bare = F.regexp_replace(text, r"\{[^}]*\}", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\\[Nn]", "\n"), r"\\h", " ")


def _subtitle_files(spark: SparkSession, path: str, packed: bool) -> DataFrame:
    return text_files(spark, path, packed).select("path", "file", F.regexp_replace("value", "\r\n?", "\n").alias("body"), F.contains("value", F.lit("[Events]")).alias("is_ass"))


def read_subtitles(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(path, file, ev_no, layer, start_ms, end_ms, style, text, plaintext, is_comment) of SRT and ASS
    files below ``path``; what is neither has no events. In SRT a cue ends where the next one's number
    and times begin, so its text may hold blank lines."""
    files = _subtitle_files(spark, path, packed)
    lines = files.where("is_ass").select("path", "file", F.posexplode(F.split("body", "\n")).alias("ev_no", "line")).where(F.col("line").rlike("^(Dialogue|Comment):"))
    f = F.split(F.regexp_replace("line", r"^(Dialogue|Comment):\s*", ""), ",", 10)
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    ass = lines.select("path", "file", F.col("ev_no").cast("long").alias("ev_no"), at(0).try_cast("long").alias("layer"), _ass_ms(at(1)).alias("start_ms"), _ass_ms(at(2)).alias("end_ms"), at(3).alias("style"), F.get(f, F.lit(9)).alias("text"), F.startswith("line", F.lit("Comment")).alias("is_comment"))
    blocks = files.where("not is_ass").select("path", "file", F.posexplode(F.split("body", r"(?m)^[ \t]*\d+[ \t]*\n(?=[ \t]*\d+:\d+:\d+[.,]\d+\s*-->)")).alias("ev_no", "b"))
    code = r"(?s)(\d+:\d+:\d+[.,]\d+)\s*-->\s*(\d+:\d+:\d+[.,]\d+)[^\n]*\n?(.*)$"
    got = lambda i: F.regexp_extract("b", code, i)
    srt = blocks.where(F.col("b").rlike(r"\d+:\d+:\d+[.,]\d+\s*-->")).select("path", "file", F.col("ev_no").cast("long").alias("ev_no"), F.lit(0).cast("long").alias("layer"), _ass_ms(got(1)).alias("start_ms"), _ass_ms(got(2)).alias("end_ms"), F.lit("Default").alias("style"), F.regexp_replace(got(3), r"\s+$", "").alias("text"), F.lit(False).alias("is_comment"))
    both = ass.unionByName(srt).where("start_ms is not null and end_ms is not null")
    return both.withColumn("plaintext", plain_text(F.col("text")))


def read_styles(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(path, file, ord, style, fontname, fontsize) of the style lines of ASS files below ``path``, in
    their order; the file's own Format line says where name, font and size stand, without one they come
    first."""
    lines = _subtitle_files(spark, path, packed).where("is_ass").select("path", "file", F.split("body", "\n").alias("l"))
    section = F.element_at(F.split(F.element_at(F.split(F.array_join("l", "\n"), r"(?m)^\[V4\+? Styles\+?\][ \t]*$", 2), -1), r"(?m)^\[Events\]", 2), 1)
    cells = lambda c, head: F.transform(F.split(F.regexp_replace(c, f"^{head}:\\s*", ""), ","), lambda x: F.trim(x))
    rows = lines.withColumn("l", F.split(section, "\n"))
    head = F.get(F.filter("l", lambda x: F.startswith(x, F.lit("Format:"))), F.lit(0))
    names = F.coalesce(F.transform(cells(head, "Format"), lambda x: F.lower(x)), F.array(F.lit("name"), F.lit("fontname"), F.lit("fontsize")))
    each = rows.select("path", "file", names.alias("names"), F.posexplode(F.filter("l", lambda x: F.startswith(x, F.lit("Style:")))).alias("ord", "s")).withColumn("c", cells(F.col("s"), "Style"))
    of = lambda name: F.get("c", F.array_position("names", name).cast("int") - 1)
    return each.select("path", "file", "ord", of("name").alias("style"), of("fontname").alias("fontname"), of("fontsize").try_cast("double").alias("fontsize"))


def read_tracks(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(path, file, kind, play_res_x, play_res_y, wrap_style, styles, events, status) of every file below
    ``path``, a track each. kind is ass, srt or null; the canvas is what the script's info says, the
    first of repeated lines. status: ok, no-events for a script or cue file without any event that can
    be read, and bad-file for what is neither."""
    files = _subtitle_files(spark, path, packed)
    info = lambda name: F.nullif(F.regexp_extract("body", rf"(?mi)^{name}[ \t]*:[ \t]*(\S+)[ \t]*$", 1), F.lit("")).try_cast("long")
    cues = F.regexp_count("body", F.lit(r"(?m)^[ \t]*\d+:\d+:\d+[.,]\d+\s*-->\s*\d+:\d+:\d+[.,]\d+"))
    kind = F.when(F.col("is_ass"), "ass").when(cues > 0, "srt")
    tracks = files.select("path", "file", kind.alias("kind"), *[F.when(F.col("is_ass"), info(n)).alias(c) for n, c in (("PlayResX", "play_res_x"), ("PlayResY", "play_res_y"), ("WrapStyle", "wrap_style"))])
    events = read_subtitles(spark, path, packed).groupBy("path").agg(F.count(F.lit(1)).alias("events"))
    styles = read_styles(spark, path, packed).groupBy("path").agg(F.count(F.lit(1)).alias("styles"))
    out = tracks.join(styles, "path", "left").join(events, "path", "left").na.fill(0, ["styles", "events"])
    status = F.when(F.col("kind").isNull(), "bad-file").when(F.col("events") == 0, "no-events").otherwise("ok")
    return out.select("path", "file", "kind", "play_res_x", "play_res_y", "wrap_style", "styles", "events", status.alias("status"))


def read_glossaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, fixes) of glossary JSON files; a file that is no object counts as empty."""
    raw = spark.read.schema(GLOSSARY).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("show is not null")
    term = lambda c, kind: raw.select("show", F.lit(kind).alias("kind"), F.posexplode(c).alias("ord", "term"))
    fixes = raw.select("show", F.explode("hard_fixes").alias("key", "value")).withColumn("key", F.lower("key"))
    return term("names", "name").unionByName(term("phrases", "phrase")), fixes.select("show", F.when(F.contains("key", F.lit(" ")), "phrase").otherwise("token").alias("kind"), "key", "value")


def read_wordlist(spark: SparkSession, path: str | None, fallback: list[str] | None = None, drop_apostrophe: bool = False) -> DataFrame:
    """(word): one distinct lower-case entry to a row, without blank lines and comments; the
    fallback's words where that leaves nothing."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")) if path else spark.createDataFrame([], "word string")
    words = words.where("word <> '' and not startswith(word, '#')")
    if drop_apostrophe:
        words = words.where("not contains(word, \"'\")")
    words = words.distinct()
    return words if words.take(1) else spark.createDataFrame([(w,) for w in fallback or EXTRA_DIRS], "word string")


def wordlist_union(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for other in lists[1:]:
        out = out.union(other)
    return out.distinct()


def page_numbers(pages: DataFrame) -> DataFrame:
    """``pages`` (show, api, token, follow, ...; a page once for each token) with page_no, the number of
    pages before it in its list, which begins with the page of no token; null for a page that no chain
    of ``follow`` tokens from the first page reaches.

    The lists are ranked by pointer jumping: every round doubles the distance to the page that is
    pointed at, so a list of n pages takes log2 n rounds, and a chain in a circle is one that has not
    ended by then.
    """
    key = ["show", "api"]
    before = pages.where("follow is not null").select(*key, F.col("follow").alias("token"), F.coalesce("token", F.lit("")).alias("at")).groupBy(*key, "token").agg(F.min("at").alias("at"))
    ends = pages.select(*key, F.coalesce("token", F.lit("")).alias("token"))
    at = ends.join(before, [*key, "token"], "left").withColumn("at", F.when(F.col("token") != "", F.col("at"))).withColumn("n", F.col("at").isNotNull().cast("long"))
    at, rounds = materialize(at, "page-links"), 0
    longest = at.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while 2**rounds <= longest:
        far = at.select(*key, F.col("token").alias("at"), F.col("at").alias("__at"), F.col("n").alias("__n"))
        open_, done = at.where("at is not null and at <> ''"), at.where("at is null or at = ''")
        if not open_.take(1):
            break
        moved = open_.join(far, [*key, "at"], "left").select(*key, "token", F.col("__at").alias("at"), (F.col("n") + F.col("__n")).alias("n"))
        at, rounds = materialize(moved.unionByName(done), "page-links"), rounds + 1
    numbers = at.select(*key, F.nullif("token", F.lit("")).alias("token"), F.when((F.col("token") == "") | (F.col("at") == ""), F.col("n")).alias("page_no"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*key, "token")]
    return pages.join(numbers.toDF("__show", "__api", "__token", "page_no"), reduce(and_, same)).drop("__show", "__api", "__token")


def read_wiki_titles(spark: SparkSession, path: str, now: float, ttl_s: float = 2_592_000, max_pages: int = 40, apis: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(status, titles) of landed page lists, whose pages name the token they were asked for with (none
    for the first) and the one that continues them.

    status (show, api, pages, status): stale if a page of the list is ``ttl_s`` old or ``apis`` (show,
    api) names another api for the show; broken if the list has no first page or the pages from there on
    end with a token whose page is not there; cut if it goes on beyond ``max_pages``; else ok. titles
    (show, api, page_no, title) are those of all lists but the stale ones, up to ``max_pages``. Of pages
    for one token the latest counts.
    """
    raw = spark.read.schema(PAGES).json(path).where("show is not null and api is not null")
    page = F.struct("fetched_at", F.nullif("continue.apcontinue", F.lit("")).alias("follow"), "query.allpages")
    latest = raw.groupBy("show", "api", F.nullif("request.apcontinue", F.lit("")).alias("token")).agg(F.max_by(page, "fetched_at").alias("p"))
    pages = materialize(page_numbers(materialize(latest.select("show", "api", "token", "p.*"), "pages")), "numbered-pages")
    used = pages.where(F.col("page_no") < max_pages)
    lists = pages.select("show", "api").distinct()
    last = used.groupBy("show", "api").agg(F.count(F.lit(1)).alias("pages"), F.max_by("follow", "page_no").alias("follow"), F.min("fetched_at").alias("oldest"))
    out = lists.join(last, ["show", "api"], "left")
    other = F.lit(False)
    if apis is not None:
        out = out.join(apis.select("show", F.col("api").alias("__api")), "show", "left")
        other = F.coalesce(F.col("__api") != F.col("api"), F.lit(False))
    state = (F.when(other | (F.lit(now) - F.col("oldest") >= ttl_s), "stale").when(F.col("pages").isNull(), "broken").when(F.col("follow").isNull(), "ok")
             .when(F.col("pages") >= max_pages, "cut").otherwise("broken"))
    status = out.select("show", "api", F.coalesce("pages", F.lit(0)).alias("pages"), state.alias("status"))
    titles = used.join(status.where("status <> 'stale'").select("show", "api"), ["show", "api"]).select("show", "api", "page_no", F.explode("allpages").alias("p"))
    return status, titles.select("show", "api", "page_no", F.col("p.title").alias("title"))
