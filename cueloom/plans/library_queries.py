"""Queries over scalar functions, listings, tracks, glossaries and repair, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators import glossary as G
from cueloom.operators import library as L
from cueloom.operators import repair as R
from cueloom.operators import tracks as K
from cueloom.operators.ranks import rank_within
from cueloom.plans import adaptors as A
from cueloom.plans import caption_queries as C
from cueloom.plans.adaptors import KEYS, sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


# ---- scalar functions ---------------------------------------------------------------------------
@query("SELECT event_id, printf('%02d:%02d:%02d,%03d', event_id * 977 // 3600000, event_id * 977 // 60000 % 60, event_id * 977 // 1000 % 60, event_id * 977 % 1000) AS stamp FROM events")
def fmt_srt_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.fmt_srt_ts((F.col("event_id") * 977).cast("decimal(20,3)") / 1000).alias("stamp"))


@query(sql("SELECT file_no, CASE WHEN starts_with(path, '/lib/Show 1') THEN '/out/S1' || substr(path, 12) ELSE path END AS moved FROM v_files", "v_files"))
def rebase_path(spark, sf_dir):
    return A.v_files(spark, sf_dir).select("file_no", T.rebase_path(F.col("path"), "/lib/Show 1", "/out/S1").alias("moved"))


@query(sql("SELECT file_no, CASE WHEN file_no % 17 = 0 THEN 1000000 ELSE file_no % 12 + 1 END AS season, CASE WHEN file_no % 17 = 0 THEN 0 ELSE file_no % 24 + 1 END AS episode FROM v_files", "v_files"))
def season_episode(spark, sf_dir):
    return A.v_files(spark, sf_dir).select("file_no", T.season_episode(F.col("path")).alias("t")).select("file_no", "t.season", "t.episode")


PARTS = """SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' (1999)' WHEN 1 THEN ' {tvdb-' || p_partkey || '}' ELSE '' END AS title, p_name FROM part"""


def titles(spark, sf_dir):
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, F.lit(" (1999)")).when(k % 3 == 1, F.concat(F.lit(" {tvdb-"), k.cast("string"), F.lit("}"))).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", tail).alias("title"), "p_name")


@query(sql("SELECT p_partkey, trim(p_name) AS cleaned FROM t", t=PARTS))
def clean_title(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", T.clean_title(F.col("title")).alias("cleaned"))


@query(sql("""SELECT p_partkey, array_to_string(list_transform(list_filter([regexp_replace(n, '[^a-z0-9]', '', 'g'), trim(regexp_replace(n, '[^a-z0-9]+', '-', 'g'), '-'), split_part(n, ' ', 1)], lambda x, i: x <> '' AND NOT list_contains([regexp_replace(n, '[^a-z0-9]', '', 'g'), trim(regexp_replace(n, '[^a-z0-9]+', '-', 'g'), '-'), split_part(n, ' ', 1)][1:i - 1], x)), lambda s: 'https://' || s || '.fandom.com/api.php'), ' ') AS apis
FROM (SELECT p_partkey, lower(trim(p_name)) AS n FROM part)"""))
def wiki_api_candidates(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", F.array_join(T.wiki_api_candidates(F.col("title")), " ").alias("apis"))


@query("SELECT page_id, rtrim(CASE WHEN regexp_extract(url, '^(https?://[^/]+)', 1) <> '' THEN regexp_extract(url, '^(https?://[^/]+)', 1) ELSE url END, '/') || '/api.php' AS api FROM pages")
def normalize_api(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_api(F.col("url")).alias("api"))


@query(f"SELECT p_partkey, 'https://x.org/api.php{T.ALLPAGES_QUERY}' || CASE WHEN p_partkey % 2 = 0 THEN '&apcontinue=' || replace(p_name, ' ', '%20') ELSE '' END AS url FROM part")
def allpages_url(spark, sf_dir):
    cont = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.allpages_url(F.lit("https://x.org/api.php"), cont).alias("url"))


@query(sql("SELECT file_no, CASE WHEN file_no % 2 = 0 THEN 'Season ' || printf('%02d', file_no % 12 + 1) ELSE show END AS key FROM v_files", "v_files"))
def show_key(spark, sf_dir):
    root = F.when(F.col("file_no") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/lib/"), F.col("show"), F.lit("/")))
    return A.v_files(spark, sf_dir).select("file_no", T.show_key(root).alias("key"))


@query("SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM conversations")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.norm_text(F.col("text")).alias("norm"))


@query(r"""SELECT tok, regexp_extract(tok, p, 1) AS pre, regexp_extract(tok, p, 2) AS core, regexp_extract(tok, p, 3) AS post FROM (SELECT DISTINCT unnest(string_split_regex(trim(text), '\s+')) AS tok, '^([^\pL\pN_'']*)([\pL\pN_''][\pL\pN_''-]*?)([^\pL\pN_'']*)$' AS p FROM conversations)""")
def token_parts(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.trim("text"), r"\s+")).alias("tok")).distinct()
    return t.withColumn("p", T.token_parts(F.col("tok"))).select("tok", "p.pre", "p.core", "p.post")


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 5 THEN 0.95 WHEN length(p_name) <= 7 THEN 0.90 ELSE 0.84 END::DOUBLE AS cutoff FROM part")
def fuzzy_cutoff(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.fuzzy_cutoff(F.length("p_name")).alias("cutoff"))


@query("""SELECT a.p_partkey, b.x, abs(length(p_name) - length(b.x)) = 1 AND len(list_filter(range(1, greatest(length(p_name), length(b.x)) + 1), lambda i: CASE WHEN length(p_name) > length(b.x) THEN substr(p_name, 1, i - 1) || substr(p_name, i + 1) = b.x ELSE substr(b.x, 1, i - 1) || substr(b.x, i + 1) = p_name END)) > 0 AS one
FROM part a, LATERAL (SELECT unnest([substr(p_name, 2), p_name || 's', p_name || 'st', 'x' || substr(p_name, 2)]) AS x) b""")
def one_indel(spark, sf_dir):
    n = F.col("p_name")
    rest = F.expr("substring(p_name, 2)")
    t = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(F.array(rest, F.concat(n, F.lit("s")), F.concat(n, F.lit("st")), F.concat(F.lit("x"), rest))).alias("x"))
    return t.select("p_partkey", "x", T.one_indel(n, F.col("x")).alias("one"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE 'name ' || conv_id END AS canonical, CASE turn % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'low' ELSE 'none' END AS confidence FROM conversations""")
def parse_adjudication(spark, sf_dir):
    t = F.col("turn") % 4
    level = F.when(t == 0, "HIGH").when(t == 1, "low").otherwise("maybe")
    reply = F.when(t == 3, F.lit("no idea }{")).otherwise(F.concat(F.lit('Sure: {"canonical": "name '), F.col("conv_id").cast("string"), F.lit('", "confidence": "'), level, F.lit('"} ok')))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_adjudication(reply).alias("a")).select("conv_id", "turn", "a.canonical", "a.confidence")


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g'), '^\s+|\s+$', '', 'g') AS line
FROM (SELECT conv_id, turn, string_split_regex(regexp_replace(' "' || text || '"  ', '^\s+|\s+$', '', 'g'), '\r\n|\r|\n')[1] AS l FROM conversations)""")
def first_line_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.first_line_clean(F.concat(F.lit(' "'), "text", F.lit('"  '))).alias("line"))


@query("SELECT user_id, sum(event_id % 50)::DOUBLE / 10 AS seconds FROM events GROUP BY user_id")
def silence_seconds(spark, sf_dir):
    line = F.concat(F.lit("[x] silence_end: 1 | silence_duration: "), F.format_string("%d.%d", F.floor(F.col("event_id") % 50 / 10), F.col("event_id") % 50 % 10))
    log = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.collect_list(line), "\n").alias("log"))
    return log.select("user_id", F.round(T.silence_seconds(F.col("log")), 3).alias("seconds"))


@query("SELECT doc_id, CAST(strlen(text) // 960 AS BIGINT) AS frames, upper(hex(substr(encode(text), 1, 0))) AS none FROM (SELECT doc_id, text FROM documents)".replace(", upper(hex(substr(encode(text), 1, 0))) AS none", ""))
def frame_pcm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.frames_of(F.col("text").cast("binary"))).cast("long").alias("frames"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS k, list_distinct(list(p_name ORDER BY l_linenumber, p_name)) AS d, list(p_name ORDER BY l_linenumber, p_name) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
u AS (SELECT k, list_filter(n, lambda x, i: NOT list_contains(n[1:i - 1], x)) AS t FROM l)
SELECT k AS l_orderkey, array_to_string(list_filter(t, lambda x, i: length(array_to_string(t[1:i], ', ')) <= 40), ', ') AS terms FROM u""")
def glossary_term_list(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    names = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("n"))
    return names.select("l_orderkey", T.glossary_term_list(F.transform("n", lambda x: x["p_name"]), 40).alias("terms"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN '{T.NAMED_PROMPT[0]}' || o_orderstatus || '{T.NAMED_PROMPT[1]}' ELSE '{T.NEUTRAL_PROMPT}' END AS prompt FROM orders")
def initial_prompt(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", T.initial_prompt(F.when(k == 0, F.col("o_orderpriority")).otherwise(""), F.when(k == 1, F.col("o_orderstatus"))).alias("prompt"))


@query("""SELECT conv_id, turn, 'Correct recognition errors in one caption line. Change only garbled words and misspelt names; else return it unchanged.' || chr(10) || 'Line: ' || text || chr(10) || CASE WHEN turn > 0 THEN 'Previous line: before' || chr(10) ELSE '' END || '<reference>ref</reference>' || chr(10) || 'Corrected line:' AS prompt FROM conversations""")
def build_repair_prompt(spark, sf_dir):
    before = F.when(F.col("turn") > 0, "before").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.build_repair_prompt(F.col("text"), F.lit("ref"), F.lit(""), before, F.lit("")).alias("prompt"))


@query("""SELECT p_partkey, 'Show: ' || p_brand || chr(10) || 'Term: ' || p_name || chr(10) || 'Candidates: ' || p_type || '; ' || p_brand || chr(10) || 'Answer with {"canonical": ..., "confidence": "high|low|none", "dub_note": ...}.' AS prompt FROM part""")
def build_verify_prompt(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.build_verify_prompt(F.col("p_name"), F.array("p_type", "p_brand"), F.col("p_brand")).alias("prompt"))


# ---- events and tracks --------------------------------------------------------------------------
EV = ["show", "episode", "track", "ev_no"]
TALK = r"""NOT is_comment AND trim(plaintext) <> '' AND NOT regexp_matches(text, '\\[kK][fo]?\d') AND NOT regexp_matches(text, '\\(pos|move)\(|\\an[134567 89]') AND NOT regexp_matches(style, '(?i)karaoke|translat|sign|song|caption|title|credit|note|lyric|romaji|kashi|insert|warning')"""
SIGN = r"""NOT is_comment AND trim(plaintext) <> '' AND NOT regexp_matches(style, '(?i)main|dialog|default|flashback|thought|secondary|monolog|narrat|warning|italics|translat|^alt')
AND (regexp_matches(text, '\\[kK][fo]?\d|\\p\d|\\clip|\\iclip|\\(pos|move)\(|\\an[134567 89]|\\t\(|\\fade?\(|\\move\(') OR regexp_matches(style, '(?i)karaoke|sign|song|caption|title|credit|note|lyric|romaji|kashi|insert'))"""


@query(sql(f"SELECT show, episode, track, ev_no FROM v_events WHERE {TALK}", "v_events"))
def dialogue_events(spark, sf_dir):
    return K.dialogue_events(A.v_events(spark, sf_dir)).select(*EV)


@query(sql(f"SELECT show, episode, track, ev_no FROM v_events WHERE {SIGN}", "v_events"))
def keep_sign_events(spark, sf_dir):
    return K.keep_sign_events(A.v_events(spark, sf_dir)).select(*EV)


@query("SELECT event_type, user_id, min(event_id) AS ev_no FROM events GROUP BY ALL")
def dedup_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("all").alias("show"), F.col("user_id").alias("episode"), F.lit(0).alias("track"), F.col("event_id").alias("ev_no"), F.lit(0).alias("start_ms"), F.lit(0).alias("end_ms"), F.col("event_type").alias("style"), F.lit(" x ").alias("plaintext"))
    return K.dedup_events(e).select(F.col("style").alias("event_type"), F.col("episode").alias("user_id"), "ev_no")


@query(sql(f"SELECT show, episode, row_number() OVER (PARTITION BY show, episode ORDER BY start_ms, end_ms, trim(plaintext)) - 1 AS cue_no, start_ms / 1000 AS start, end_ms / 1000 AS \"end\", trim(plaintext) AS text FROM v_events WHERE {TALK}", "v_events"))
def cue_intervals(spark, sf_dir):
    return K.cue_intervals(A.v_events(spark, sf_dir))


DENSITY = f"SELECT show, episode, track, sum(({TALK})::INT) AS cues, coalesce(sum(({TALK})::INT) / nullif(sum((NOT is_comment)::INT), 0), 0) AS share FROM v_events GROUP BY ALL"


@query(sql("SELECT * FROM d", "v_events", d=DENSITY))
def dialogue_density(spark, sf_dir):
    return K.dialogue_density(A.v_events(spark, sf_dir))


@query(sql("SELECT show, episode, arg_max(track, (share, -track)) FILTER (cues >= 1 AND share >= 0.3) AS track, CASE WHEN count(*) FILTER (cues >= 1 AND share >= 0.3) = 0 THEN 'no-reference' ELSE 'ok' END AS status FROM d GROUP BY ALL", "v_events", d=DENSITY))
def select_reference_track(spark, sf_dir):
    return K.select_reference_track(K.dialogue_density(A.v_events(spark, sf_dir)), 1, 0.3)


@query(sql("SELECT show, episode, track, ev_no FROM v_events WHERE (episode + track) % 4 IN (0, 1, 3)", "v_events"))
def union_tracks(spark, sf_dir):
    e = A.v_events(spark, sf_dir)
    n = (F.col("episode") + F.col("track")) % 4
    tracks = e.select(*KEYS, "track").distinct().withColumn("language", F.when(n == 0, "ENG").when(n == 1, F.lit(None)).when(n == 2, "fre").otherwise("und"))
    return K.union_tracks(e, tracks).select(*EV)


MERGED = f"""SELECT show, episode, layer + 1 AS layer, start_ms, end_ms, style, text, 0 AS side, track AS t, ev_no AS n FROM (SELECT *, row_number() OVER (PARTITION BY show, episode, start_ms, end_ms, style, trim(plaintext) ORDER BY track, ev_no) AS rn FROM v_events WHERE {SIGN}) WHERE rn = 1
UNION ALL SELECT show, episode, 0, start, "end", 'Dubtitles', text, 1, 0, card_no FROM v_cards"""


def _cards_ms(spark, sf_dir):
    return A.v_cards(spark, sf_dir).select(*KEYS, "card_no", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "text")


@query(sql("SELECT show, episode, layer, start_ms, end_ms, style, text, row_number() OVER (PARTITION BY show, episode ORDER BY start_ms, end_ms, side, t, n) AS ord FROM merged", "v_events", "v_cards", merged=MERGED))
def merge_track(spark, sf_dir):
    return K.merge_track(A.v_events(spark, sf_dir), _cards_ms(spark, sf_dir))[0]


@query(sql("SELECT episode, CASE WHEN sum(e) = 0 THEN 'no-signs' WHEN sum(c) = 0 THEN 'empty' ELSE 'ok' END AS status FROM (SELECT episode, 1 AS e, 0 AS c FROM v_events WHERE episode % 3 <> 0 UNION ALL SELECT episode, 0, 1 FROM v_cards WHERE episode % 5 <> 0) GROUP BY episode", "v_events", "v_cards"))
def merge_status(spark, sf_dir):
    return K.merge_track(A.v_events(spark, sf_dir).where("episode % 3 <> 0"), _cards_ms(spark, sf_dir).where("episode % 5 <> 0"))[1].select("episode", "status")


@query(sql("SELECT show, episode, track, ev_no, row_number() OVER (PARTITION BY show, episode ORDER BY start_ms, end_ms, track, ev_no) AS ord FROM v_events", "v_events"))
def sort_track(spark, sf_dir):
    e = A.v_events(spark, sf_dir).withColumns({"__side": F.lit(0), "__t": F.col("track"), "__n": F.col("ev_no")})
    return K.sort_track(e).select(*EV, "ord")


STYLES = """SELECT l_orderkey AS episode, l_linenumber AS track, l_returnflag AS style, min(l_linestatus) AS fontname, min(l_quantity)::BIGINT AS fontsize FROM lineitem GROUP BY ALL"""


def _styles(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("track"), F.col("l_returnflag").alias("style"))
    return g.agg(F.min("l_linestatus").alias("fontname"), F.min("l_quantity").cast("long").alias("fontsize"))


@query(sql("SELECT episode, style, arg_min(track, track) AS track, arg_min(fontname, track) AS fontname, arg_min(fontsize, track) AS fontsize FROM s GROUP BY ALL", s=STYLES))
def first_style(spark, sf_dir):
    return K.first_style(_styles(spark, sf_dir), ["episode"])


@query(sql("SELECT s.* FROM s JOIN (SELECT episode, style, arg_min(fontname, track) AS f, arg_min(fontsize, track) AS z FROM s GROUP BY ALL) b USING (episode, style) WHERE fontname <> f OR fontsize <> z", s=STYLES))
def style_conflicts(spark, sf_dir):
    return K.style_conflicts(_styles(spark, sf_dir), ["episode"])


@query(sql("SELECT episode, sum((fontname <> f)::INT) AS wrap_differs, count(DISTINCT (fontsize % 3, fontsize % 2)) AS resolutions FROM t JOIN (SELECT episode, arg_min(fontname, track) AS f FROM t GROUP BY ALL) USING (episode) GROUP BY episode", s=STYLES, t="SELECT episode, track, min(fontname) AS fontname, min(fontsize) AS fontsize FROM s GROUP BY ALL"))
def track_mismatch(spark, sf_dir):
    t = _styles(spark, sf_dir).groupBy("episode", "track").agg(F.min("fontname").alias("wrap_style"), F.min("fontsize").alias("z"))
    return K.track_mismatch(t.withColumns({"play_x": F.col("z") % 3, "play_y": F.col("z") % 2}), ["episode"])


@query("""SELECT o_orderkey, greatest(32, round_even(y / 17.0, 0))::INT AS fontsize, round(greatest(1.5, greatest(32, round_even(y / 17.0, 0)) / 22), 6) AS outline, greatest(10, round_even(y / 22.0, 0))::INT AS margin FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2161 = 0 THEN 720 ELSE o_orderkey % 2161 END AS y FROM orders)""")
def dub_style(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", K.dub_style(F.col("o_orderkey") % 2161).alias("s")).select("o_orderkey", "s.fontsize", F.round("s.outline", 6).alias("outline"), "s.margin")


@query(sql("SELECT file, track_id FROM v_tracks WHERE type = 'subtitles' AND codec = 'ass' AND language = 'eng'", "v_tracks"))
def accepted_sub_streams(spark, sf_dir):
    return K.accepted_sub_streams(A.v_tracks(spark, sf_dir)).select("file", "track_id")


@query(sql("SELECT file, min(track_id) FILTER (type = 'audio' AND language = 'eng') AS track_id FROM v_tracks GROUP BY file", "v_tracks"))
def pick_audio(spark, sf_dir):
    return K.pick_audio(A.v_tracks(spark, sf_dir))


ORIGINAL = """SELECT file, list_sort(list(DISTINCT language)) AS l FROM (SELECT *, bool_or(is_default) OVER (PARTITION BY file) AS d, row_number() OVER (PARTITION BY file ORDER BY track_id) AS rn FROM v_tracks WHERE type = 'audio') WHERE CASE WHEN d THEN is_default ELSE rn = 1 END GROUP BY file"""


@query(sql("SELECT file, array_to_string(l, ',') AS languages FROM o", "v_tracks", o=ORIGINAL))
def original_language(spark, sf_dir):
    return K.original_language(A.v_tracks(spark, sf_dir)).select("file", F.array_join("languages", ",").alias("languages"))


@query(sql("SELECT file, track_id FROM v_tracks WHERE type = 'subtitles' AND (language = 'eng' OR regexp_matches(name, '(?i)sign|song|title'))", "v_tracks"))
def keep_subtitle_tracks(spark, sf_dir):
    return K.keep_subtitle_tracks(A.v_tracks(spark, sf_dir)).select("file", "track_id")


@query(sql("SELECT file, bool_or(type = 'subtitles' AND name = 'Dubtitles') AS has FROM v_tracks GROUP BY file", "v_tracks"))
def has_named_track(spark, sf_dir):
    return K.has_named_track(A.v_tracks(spark, sf_dir))


PLAN = """SELECT t.*, CASE WHEN type = 'audio' THEN w ELSE w OR regexp_matches(name, '(?i)sign|song|karaoke|lyric|caption|title|credit|insert') END AS selected FROM (SELECT v.*, language = 'eng' OR coalesce(list_contains(o.l, language), false) AS w FROM v_tracks v LEFT JOIN o USING (file)) t"""


@query(sql("SELECT file, track_id, selected, CASE WHEN selected OR NOT bool_or(selected) OVER (PARTITION BY file, type) THEN 'keep' ELSE 'drop' END AS action, CASE WHEN NOT selected THEN NULL WHEN type = 'audio' AND language = 'eng' THEN 'yes' ELSE 'no' END AS default_flag FROM p", "v_tracks", o=ORIGINAL, p=PLAN))
def track_plan(spark, sf_dir):
    return K.track_plan(A.v_tracks(spark, sf_dir)).select("file", "track_id", "selected", "action", "default_flag")


@query("""SELECT o_orderkey AS file, CASE WHEN o_orderkey % 11 = 0 THEN 'missing-av' WHEN o_orderkey % 7 = 0 THEN 'no-dubtitles-track' WHEN o_orderkey % 5 > 2 THEN 'duration-mismatch' WHEN o_orderkey % 3 = 0 THEN 'font-count-mismatch' ELSE 'ok' END AS status, o_orderkey % 2 AS odd_fonts FROM orders""")
def mux_audit(spark, sf_dir):
    k = F.col("file")
    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.lit(1440.0).alias("duration"), F.lit(4).alias("fonts"))
    after = before.select("file", (F.col("duration") + k % 5).alias("duration"), F.when(k % 3 == 0, 3).otherwise(4).alias("fonts"), (k % 2).alias("odd_fonts"), (k % 11 != 0).alias("has_video"), F.lit(True).alias("has_audio"), (k % 7 != 0).alias("has_dub"))
    return K.mux_audit(before, after)


# ---- library ------------------------------------------------------------------------------------
LISTED = """SELECT file_no, CASE file_no % 9 WHEN 0 THEN replace(path, '/Season', '/Extras/Season') WHEN 1 THEN replace(path, '.mkv', ' NCOP.mkv') WHEN 2 THEN replace(path, '.mkv', '.txt') WHEN 3 THEN replace(path, '.mkv', '.MP4') ELSE path END AS path FROM v_files"""


def _listed(spark, sf_dir):
    k, p = F.col("file_no") % 9, F.col("path")
    swap = lambda a, b: F.replace(p, F.lit(a), F.lit(b))
    return A.v_files(spark, sf_dir).select("file_no", F.when(k == 0, swap("/Season", "/Extras/Season")).when(k == 1, swap(".mkv", " NCOP.mkv")).when(k == 2, swap(".mkv", ".txt")).when(k == 3, swap(".mkv", ".MP4")).otherwise(p).alias("path"))


@query(sql("SELECT file_no, regexp_replace(path, '\\.[^./]*$', '') AS stem, CASE WHEN file_no % 9 = 3 THEN '.mp4' ELSE '.mkv' END AS ext FROM l WHERE file_no % 9 > 2", "v_files", l=LISTED))
def scan_library(spark, sf_dir):
    return L.scan_library(_listed(spark, sf_dir)).select("file_no", "stem", "ext")


@query(sql("SELECT file_no FROM l WHERE file_no % 9 <> 0", "v_files", l=LISTED))
def skip_extras(spark, sf_dir):
    extras = spark.createDataFrame([(x,) for x in T.EXTRA_DIRS], "word string")
    return L.skip_extras(_listed(spark, sf_dir), extras).select("file_no")


def _stems(spark, sf_dir):
    return A.v_files(spark, sf_dir).withColumn("stem", L.stem_of(F.col("path")))


def _sidecars(spark, sf_dir):
    k = F.col("file_no")
    marks = F.array(F.when(k % 4 == 0, F.lit(".eng.dubtitles.ass")), F.when(k % 3 == 0, F.lit(".eng.dubtitles.srt")), F.when(k % 10 == 1, F.lit(".dubtitles.fail")))
    listing = _stems(spark, sf_dir).select("stem", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("mark")).select(F.concat("stem", "mark").alias("path"))
    return L.sidecars_of(listing)


@query(sql("SELECT file_no, CASE WHEN file_no % 4 = 0 THEN regexp_replace(path, '\\.mkv$', '.eng.dubtitles.ass') WHEN file_no % 3 = 0 THEN regexp_replace(path, '\\.mkv$', '.eng.dubtitles.srt') END AS source FROM v_files WHERE file_no % 4 = 0 OR file_no % 3 = 0 OR file_no % 10 = 1", "v_files"))
def sub_source(spark, sf_dir):
    return _stems(spark, sf_dir).join(L.sub_source(_sidecars(spark, sf_dir)), "stem").select("file_no", "source")


def _stamped(spark, sf_dir):
    f = _stems(spark, sf_dir)
    k = F.col("file_no")
    stamps = f.where(k % 5 < 3).select("stem", F.when(k % 5 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (F.col("mtime") + F.when(k % 2 == 0, 0.5).otherwise(1.0)).alias("mtime"), F.lit(True).alias("muxed"))
    return L.stamp_valid(f, stamps)


@query(sql("SELECT file_no, file_no % 5 IN (0, 2) AND file_no % 2 = 0 AS stamped FROM v_files", "v_files"))
def stamp_valid(spark, sf_dir):
    return _stamped(spark, sf_dir).select("file_no", "stamped")


@query(sql("""SELECT file_no, CASE WHEN file_no % 5 IN (0, 2) AND file_no % 2 = 0 THEN 'already-muxed' WHEN file_no % 4 = 0 THEN 'already-ass' WHEN file_no % 3 = 0 THEN 'already-srt' WHEN file_no % 13 = 0 THEN 'already-muxed' WHEN file_no % 10 = 1 THEN 'skip-prior-crash' WHEN file_no % 7 = 0 THEN 'no-eng-dub' ELSE 'todo' END AS status FROM v_files""", "v_files"))
def needs_work(spark, sf_dir):
    k = F.col("file_no")
    probe = _stems(spark, sf_dir).select("stem", (k % 13 == 0).alias("has_named"), (k % 7 != 0).alias("has_eng"))
    return L.needs_work(_stamped(spark, sf_dir), _sidecars(spark, sf_dir), probe).select("file_no", "status")


@query(sql("""SELECT file_no, CASE WHEN file_no % 4 <> 0 AND file_no % 3 <> 0 THEN 'no-sub' WHEN file_no % 5 IN (0, 2) AND file_no % 2 = 0 THEN 'already-muxed' WHEN 5368709120 * 1 + file_no * 1000 < size * 1.1 + 5368709120 THEN 'skip-no-room' ELSE 'plan' END AS status FROM v_files""", "v_files"))
def mux_status(spark, sf_dir):
    free = (F.lit(5 << 30) + F.col("file_no") * 1000).cast("long")
    f = _stamped(spark, sf_dir).join(L.sub_source(_sidecars(spark, sf_dir)), "stem", "left").withColumns({"has_named": F.lit(False), "free": free})
    return L.mux_status(f).select("file_no", "status")


@query("SELECT o_orderkey, o_orderkey * 300000 * 100 >= o_custkey * 1000000 * 110 + 5368709120 * 100 AS room FROM orders")
def has_room(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", L.has_room(F.col("o_orderkey") * 300_000, F.col("o_custkey") * 1_000_000).alias("room"))


@query(sql("SELECT sum((file_no % 4 <> 0 AND file_no % 3 <> 0)::INT) AS generate, sum((file_no % 4 <> 0 AND file_no % 3 = 0)::INT) AS repair, sum((file_no % 4 = 0)::INT) AS mux FROM v_files", "v_files"))
def dry_run_counts(spark, sf_dir):
    return L.dry_run_counts(_stems(spark, sf_dir).join(_sidecars(spark, sf_dir), "stem", "left"))


@query(sql("""SELECT file_no, row_number() OVER (PARTITION BY show ORDER BY CASE WHEN st > 0 AND NOT (s >= st AND s < 1000000) THEN 1 ELSE 0 END, CASE WHEN st > 0 THEN s ELSE 0 END, CASE WHEN st > 0 THEN e ELSE 0 END, path) AS rank
FROM (SELECT *, CASE show WHEN 'Show 1' THEN 7 WHEN 'Show 2' THEN 3 ELSE 0 END AS st, CASE WHEN file_no % 17 = 0 THEN 1000000 ELSE file_no % 12 + 1 END AS s, CASE WHEN file_no % 17 = 0 THEN 0 ELSE file_no % 24 + 1 END AS e FROM v_files)""".replace("CASE show WHEN", "CASE v_files.show WHEN"), "v_files"))
def order_files(spark, sf_dir):
    return L.order_files(A.v_files(spark, sf_dir), {"Show 1": 7, "Show 2": 3}).select("file_no", "rank")


@query("SELECT n_name AS listed, row_number() OVER (ORDER BY n_nationkey) AS rank, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) THEN 'ok' ELSE 'skip-missing' END AS status FROM nation")
def show_priority(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    there = table(spark, sf_dir, "customer").where("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("show"))
    return L.show_priority(n.select(F.col("n_name").alias("show"), F.col("n_nationkey").alias("ord")), there).withColumnRenamed("show", "listed")


INODES = """SELECT DISTINCT l_partkey AS ino, l_suppkey % 3 AS dev, l_quantity::BIGINT AS size, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_quantity::BIGINT AS path FROM lineitem"""


@query(sql("SELECT path, partners FROM (SELECT path, count(*) OVER (PARTITION BY ino, dev, size) - 1 AS partners FROM i) WHERE partners > 0", i=INODES))
def hardlink_groups(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    f = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ino"), (F.col("l_suppkey") % 3).alias("dev"), q.alias("size"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q).alias("path")).distinct()
    return L.hardlink_groups(f)


@query("SELECT '/v/' || (o_orderkey % 500) AS stem, '/v/' || (o_orderkey % 500) || CASE min(o_orderkey % 3) WHEN 0 THEN '.mkv' WHEN 1 THEN '.mp4' ELSE '.m4v' END AS path FROM orders GROUP BY o_orderkey % 500")
def stem_to_video(spark, sf_dir):
    ext = F.element_at(F.array(F.lit(".mkv"), F.lit(".mp4"), F.lit(".m4v")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return L.stem_to_video(table(spark, sf_dir, "orders").select(F.concat(F.lit("/v/"), (F.col("o_orderkey") % 500).cast("string"), ext).alias("path")).distinct())


@query("SELECT DISTINCT o_custkey AS stem FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def new_since(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stem"), "o_orderstatus")
    return L.new_since(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"))


# ---- glossary -----------------------------------------------------------------------------------
DENY = r"SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)"
MINED = r"""SELECT core AS term, count(*) AS n, bool_or(i > 1) AS inside FROM (SELECT i, trim(w, '''’-') AS core FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT regexp_extract_all(unnest(string_split_regex(text, '[.!?…]+|\n')), '[A-Za-z][A-Za-z''’\-]{2,}') AS ws FROM documents)))
WHERE regexp_matches(core, '^[A-Z][a-z]{3,}$') GROUP BY core"""
KEPT = "SELECT term, n FROM mined WHERE inside AND n >= 3 AND lower(term) NOT IN (SELECT w FROM deny)"


def _deny(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()


def _mined(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("all").alias("show"), "text")
    none = spark.createDataFrame([], "show string, term string")
    return G.mine_names(d, _deny(spark, sf_dir), none)


@query(sql("SELECT 'all' AS show, term, n FROM kept", deny=DENY, mined=MINED, kept=KEPT))
def mine_names(spark, sf_dir):
    return _mined(spark, sf_dir)


def _first_terms(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.lit("all").alias("show"), F.col("n_nationkey").alias("ord"), F.initcap(F.lower("n_name")).alias("term"))


FIRST = "SELECT n_nationkey AS ord, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS term FROM nation WHERE n_name NOT LIKE '% %'"


@query(sql("SELECT ord, term FROM first UNION ALL SELECT 24 + row_number() OVER (ORDER BY term), term FROM kept WHERE lower(term) NOT IN (SELECT lower(term) FROM first)", deny=DENY, mined=MINED, kept=KEPT, first=FIRST))
def additive_terms(spark, sf_dir):
    return G.additive_terms(_first_terms(spark, sf_dir).where("term not like '% %'"), _mined(spark, sf_dir)).select("ord", "term")


@query(sql("SELECT 'all' AS show, string_agg(term, ', ' ORDER BY n DESC, term) AS prompt FROM (SELECT * FROM kept ORDER BY n DESC, term LIMIT 30)", deny=DENY, mined=MINED, kept=KEPT))
def top_names(spark, sf_dir):
    m = _mined(spark, sf_dir)
    return G.top_names(rank_within(m.select("show", "term"), "show", ["term"], "ord"), m)


def _terms(spark, sf_dir):
    """Names from the parts' brands and types, phrases from their names."""
    p = table(spark, sf_dir, "part")
    show = F.concat(F.lit("show "), (F.col("p_partkey") % 5).cast("string")).alias("show")
    return p.select(show, F.when(F.col("p_partkey") % 2 == 0, "name").otherwise("phrase").alias("kind"), F.col("p_partkey").alias("ord"), F.concat("p_brand", F.lit(" "), (F.col("p_partkey") % 40).cast("string")).alias("term"))


TERMS = "SELECT 'show ' || (p_partkey % 5) AS show, CASE WHEN p_partkey % 2 = 0 THEN 'name' ELSE 'phrase' END AS kind, p_partkey AS ord, p_brand || ' ' || (p_partkey % 40) AS term FROM part"


@query(sql("SELECT show, term, row_number() OVER (PARTITION BY show ORDER BY p, o) - 1 AS ord FROM (SELECT show, term, min((kind = 'phrase', ord)) AS m, min((kind = 'phrase')) AS p, arg_min(ord, (kind = 'phrase', ord)) AS o FROM t WHERE term NOT LIKE '%1' GROUP BY ALL)".replace("min((kind = 'phrase', ord)) AS m, ", ""), t=TERMS))
def pending_terms(spark, sf_dir):
    t = _terms(spark, sf_dir)
    return G.pending_terms(t, t.where("term like '%1'").select("show", "term"))


@query(sql("SELECT show, NOT (count(*) >= 3 AND sum((lower(term) IN (SELECT lower(term) FROM t x WHERE ord % 4 = 0 AND x.show = t.show AND x.show <> 'show 2'))::INT) = 0) AS ok FROM t WHERE kind = 'name' GROUP BY show", t=TERMS))
def wiki_sanity_gate(spark, sf_dir):
    t = _terms(spark, sf_dir)
    return G.wiki_sanity_gate(t, t.where("ord % 4 = 0 and show <> 'show 2'").select("show", F.upper("term").alias("title")))


@query(sql("""SELECT show, kind, ord, CASE WHEN k = 0 THEN 'Canon ' || term ELSE term END AS term, k < 4 AS verified, CASE k WHEN 1 THEN 'low-confidence' WHEN 2 THEN 'no-match' WHEN 3 THEN 'no-match' END AS flagged FROM (SELECT *, length(term) * 7 % 6 AS k FROM (SELECT *, show || term AS u FROM t))""".replace("length(term) * 7 % 6", "ascii(substr(term, length(term), 1)) % 6"), t=TERMS))
def verify_apply(spark, sf_dir):
    t = _terms(spark, sf_dir)
    k = F.ascii(F.substring("term", -1, 1)) % 6
    adj = t.select("show", "term").distinct().where(k < 4).select("show", "term", F.when(k < 2, F.concat(F.lit("Canon "), "term")).otherwise("").alias("canonical"), F.when(k == 0, "high").when(k == 1, "low").when(k == 2, "high").otherwise("none").alias("confidence"))
    return G.verify_apply(t, adj)


@query(sql("SELECT file_no, CASE WHEN file_no % 12 + 1 = 3 THEN 'Season 03' WHEN show IN ('Show 1', 'Show 3') THEN show END AS glossary FROM v_files", "v_files"))
def glossary_for(spark, sf_dir):
    shows = spark.createDataFrame([("Show 1",), ("Show 3",), ("Season 03",)], "show string")
    return G.glossary_for(A.v_files(spark, sf_dir), shows).select("file_no", "glossary")


# Every character that is no part of a word stands between marks, so a word's ends can be told in
# any alphabet.
@query(r"""SELECT conv_id, turn, replace(regexp_replace(one, chr(1) || '(?i:the)' || chr(1), chr(1) || 'th€' || chr(1), 'g'), chr(1), '') AS text, n + len(regexp_extract_all(one, chr(1) || '(?i:the)' || chr(1))) AS n FROM (
SELECT conv_id, turn, regexp_replace(m, p, chr(1) || 'OF-XXX' || chr(1), 'g') AS one, len(regexp_extract_all(m, p)) AS n FROM (
SELECT conv_id, turn, chr(1) || regexp_replace(text, '([^\pL\pN\pM_])', chr(1) || '\1' || chr(1), 'g') || chr(1) AS m, chr(1) || '(?i:of)' || chr(1) || ' ' || chr(1) || '(?i:the)' || chr(1) AS p FROM conversations))""")
def phrase_fixes(spark, sf_dir):
    fixes = spark.createDataFrame([("all", "phrase", "the", "th€"), ("all", "phrase", "of the", "OF-XXX")], "show string, kind string, key string, value string")
    return G.phrase_fixes(table(spark, sf_dir, "conversations").select(F.lit("all").alias("show"), "conv_id", "turn", "text"), fixes).select("conv_id", "turn", "text", "n")


TOK = r"SELECT DISTINCT regexp_extract(tok, '^([^\pL\pN_'']*)([\pL\pN_''][\pL\pN_''-]*?)([^\pL\pN_'']*)$', 2) AS core FROM (SELECT unnest(string_split_regex(trim(text), '\s+')) AS tok FROM conversations)"


def _tokens(spark, sf_dir):
    return G.distinct_tokens(table(spark, sf_dir, "conversations").select(F.lit("all").alias("show"), "text"))


@query(sql("SELECT core, 'X' || lower(core) AS fixed FROM tok WHERE length(core) = 5", tok=TOK))
def token_fixes(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    fixes = t.where(F.length("core") == 5).select("show", F.lit("token").alias("kind"), F.col("low").alias("key"), F.concat(F.lit("X"), "low").alias("value")).distinct()
    return G.token_fixes(t, fixes).select("core", "fixed")


@query(sql("SELECT core FROM tok WHERE core <> '' AND lower(core) NOT IN (SELECT w FROM deny)", tok=TOK, deny=DENY))
def english_gate(spark, sf_dir):
    return G.english_gate(_tokens(spark, sf_dir), _deny(spark, sf_dir)).select("core")


def _names(spark, sf_dir):
    """Mined names of four letters or more, misspelt in the texts by a swap of two inner letters."""
    m = _mined(spark, sf_dir)
    return rank_within(m.select("show", "term"), "show", ["term"], "ord").select("show", F.lit("name").alias("kind"), "ord", "term")


def _misspelt(names):
    t = F.col("term")
    swap = F.concat(F.substring(t, 1, 2), F.substring(t, 4, 1), F.substring(t, 3, 1), F.expr("substring(term, 5)"))
    return names.select("show", F.col("ord").alias("line"), F.concat(F.lit("then "), swap, F.lit(", and "), t).alias("text"))


def _no_fixes(spark):
    return spark.createDataFrame([("all", "token", "then", "Then")], "show string, kind string, key string, value string")


@query()
def fuzzy_names(spark, sf_dir):
    names = _names(spark, sf_dir)
    return G.fuzzy_names(G.distinct_tokens(_misspelt(names)), names.select("show", "ord", F.col("term").alias("name")))


@query()
def phonetic_names(spark, sf_dir):
    names = _names(spark, sf_dir)
    return G.phonetic_names(G.distinct_tokens(_misspelt(names)), names.select("show", "ord", F.col("term").alias("name")))


@query()
def correct_names(spark, sf_dir):
    names = _names(spark, sf_dir)
    return G.correct_names(_misspelt(names), names, _no_fixes(spark), _deny(spark, sf_dir), ["line"])


def _suspects(spark, sf_dir):
    cards = A.v_cards(spark, sf_dir)
    names = _names(spark, sf_dir)
    return G.name_suspect(cards, names, _deny(spark, sf_dir), ["episode", "card_no"])


@query()
def name_suspect(spark, sf_dir):
    return _suspects(spark, sf_dir)


@query()
def wiki_candidates(spark, sf_dir):
    t = _terms(spark, sf_dir)
    pages = t.select("show", F.col("ord"), F.concat(F.lit("The "), "term").alias("title"))
    return G.wiki_candidates(t.select("show", "term").distinct(), pages)


# ---- repair -------------------------------------------------------------------------------------
@query()
def repair_targets(spark, sf_dir):
    cards = A.v_cards(spark, sf_dir).withColumn("word_probs", F.array((F.col("card_no") * 31 % 100).cast("double")))
    return R.repair_targets(cards, _suspects(spark, sf_dir), -40, 50, 25.0).select(*R.CARD)


PICK = "SELECT * FROM v_cards WHERE no_speech_prob <= 50 AND (avg_logprob < -40 OR card_no * 31 % 100 < 25)"


def _targets(spark, sf_dir):
    cards = A.v_cards(spark, sf_dir).withColumn("word_probs", F.array((F.col("card_no") * 31 % 100).cast("double")))
    return R.repair_targets(cards, cards.select(*R.CARD, F.lit(False).alias("suspect")), -40, 50, 25.0)


@query(sql("SELECT show, episode, card_no FROM p ORDER BY show, episode, card_no LIMIT 15", "v_cards", p=PICK))
def limit_targets(spark, sf_dir):
    return R.limit_targets(_targets(spark, sf_dir)).select(*R.CARD)


AROUND = "SELECT show, episode, card_no, text, coalesce(lag(text) OVER (PARTITION BY show, episode ORDER BY card_no), '') AS prev, coalesce(lead(text) OVER (PARTITION BY show, episode ORDER BY card_no), '') AS next FROM v_cards"


@query(sql("SELECT show, episode, card_no, prev, next FROM a", "v_cards", a=AROUND))
def context_lines(spark, sf_dir):
    return R.context_lines(A.v_cards(spark, sf_dir)).select(*R.CARD, "prev", "next")


def _requests(spark, sf_dir):
    cards = A.v_cards(spark, sf_dir)
    ref = C.refs(cards, A.v_cues(spark, sf_dir)).select(*R.CARD, "ref")
    terms = spark.createDataFrame([("all", "Ann, Bo")], "show string, names string")
    return R.repair_requests(_targets(spark, sf_dir), ref, R.context_lines(cards), terms)


@query(sql("""SELECT p.show, p.episode, p.card_no, 'Correct recognition errors in one caption line. Change only garbled words and misspelt names; else return it unchanged.' || chr(10) || 'Names: Ann, Bo.' || chr(10) || 'Line: ' || p.text || chr(10) || CASE WHEN prev <> '' THEN 'Previous line: ' || prev || chr(10) ELSE '' END
|| CASE WHEN next <> '' THEN 'Next line: ' || next || chr(10) ELSE '' END || '<reference>' || substr(ref, 1, 300) || '</reference>' || chr(10) || 'Corrected line:' AS prompt FROM p JOIN refs USING (show, episode, card_no) JOIN a USING (show, episode, card_no) WHERE ref IS NOT NULL""", "v_cards", "v_cues", p=PICK, refs=C.REFS, a=AROUND))
def repair_requests(spark, sf_dir):
    return _requests(spark, sf_dir)[0].select(*R.CARD, "prompt")


def _capital(c: str) -> str:
    """One capital for each letter, as SQL has it: a letter that Python spells with two or more (fl, and
    others that have no capital of their own) stays, the sharp s becomes the capital one."""
    return "\u1e9e" if c == "\u00df" else next((x for x in (c.upper(), c.title()) if len(x) == 1), c)


def shouting_model():
    """A stand-in for a text-to-text model: the asked line in capitals, as long as it was; fails on every
    seventh length."""
    def ask(prompt: str) -> str:
        line = next(x for x in prompt.split("\n") if x.startswith("Line: "))[6:]
        if len(line) % 7 == 0:
            raise ValueError("no answer")
        return "".join(map(_capital, line))

    return ask


ASKED = "SELECT p.show, p.episode, p.card_no, split_part(p.text, chr(10), 1) AS line FROM p JOIN refs USING (show, episode, card_no) WHERE ref IS NOT NULL"


@query(sql("SELECT show, episode, card_no, 'upper' AS model, CASE WHEN length(line) % 7 = 0 THEN '' ELSE upper(line) END AS output, CASE WHEN length(line) % 7 = 0 THEN 'ValueError: no answer' END AS error FROM asked", "v_cards", "v_cues", p=PICK, refs=C.REFS, asked=ASKED))
def score_requests(spark, sf_dir):
    return R.score_requests(_requests(spark, sf_dir)[0], shouting_model, "upper")


@query(r"""SELECT conv_id, turn, length(o) * 10 < greatest(length(text), 1) * 6 OR length(o) * 10 > greatest(length(text), 1) * 15 OR (regexp_matches(o, '(?i)\bzed\b') AND NOT regexp_matches(text, '(?i)\bzed\b')) AS second FROM (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN substr(text, 1, length(text) // 2) WHEN 1 THEN text || ' Zed' ELSE text END AS o FROM conversations)""")
def needs_second_pass(spark, sf_dir):
    o = F.when(F.col("turn") % 3 == 0, F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" Zed"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.needs_second_pass(F.col("text"), o, F.array(F.lit("Zed"))).alias("second"))


REPLIED = """SELECT *, CASE card_no % 4 WHEN 0 THEN 'New ' || text WHEN 1 THEN lower(text) WHEN 2 THEN '' END AS o, CASE WHEN card_no % 8 = 0 THEN 'second' ELSE '' END AS s FROM v_cards"""


def _accepted(spark, sf_dir):
    cards = A.v_cards(spark, sf_dir)
    k = F.col("card_no") % 4
    replies = cards.where(k < 3).select(*R.CARD, F.when(k == 0, F.concat(F.lit("New "), "text")).when(k == 1, F.lower("text")).otherwise("").alias("output"), F.when(F.col("card_no") % 8 == 0, "second").otherwise("").alias("second"))
    return R.accept_repair(cards, replies)


ACCEPTED = """SELECT show, episode, card_no, CASE WHEN card_no % 4 = 0 THEN CASE WHEN s <> '' THEN s ELSE o END ELSE text END AS repaired, CASE WHEN card_no % 4 = 3 THEN 'untouched' WHEN card_no % 4 = 0 THEN 'repaired' ELSE 'kept' END AS status FROM replied"""


@query(sql("SELECT * FROM acc", "v_cards", replied=REPLIED, acc=ACCEPTED))
def accept_repair(spark, sf_dir):
    return _accepted(spark, sf_dir).select(*R.CARD, "repaired", "status")


@query(sql("SELECT show, episode, card_no, repaired AS text FROM acc", "v_cards", replied=REPLIED, acc=ACCEPTED))
def apply_repairs(spark, sf_dir):
    done = _accepted(spark, sf_dir).where("status = 'repaired'")
    return R.apply_repairs(A.v_cards(spark, sf_dir), done).select(*R.CARD, "text")


@query(sql("""SELECT show, episode, count(*) AS targets, sum((status = 'repaired')::INT) AS repaired, 0 AS skipped_no_ref, sum(l) AS latency_sum, list_sort(list(l))[least(count(*) - 1, round_even(0.95 * (count(*) - 1), 0))::BIGINT + 1] AS latency_p95 FROM (SELECT *, (episode * 31 + card_no * 17) % 500 AS l FROM acc) GROUP BY ALL""", "v_cards", replied=REPLIED, acc=ACCEPTED))
def repair_summary(spark, sf_dir):
    return R.repair_summary(_accepted(spark, sf_dir).withColumn("latency_ms", (F.col("episode") * 31 + F.col("card_no") * 17) % 500))


@query(sql("SELECT show, episode, card_no, md5(text) AS big, lower(text) AS small FROM v_cards", "v_cards"))
def compare_models(spark, sf_dir):
    c = A.v_cards(spark, sf_dir)
    scored = c.select(*R.CARD, F.lit("big").alias("model"), F.md5("text").alias("output")).unionByName(c.select(*R.CARD, F.lit("small").alias("model"), F.lower("text").alias("output")))
    return R.compare_models(scored, ["big", "small"])


@query(sql("SELECT CASE WHEN m = 0 THEN 'big' ELSE 'small' END AS model, count(*) AS n, sum((episode * 31 + card_no * 17 + m) % 500) AS latency_sum FROM v_cards, (VALUES (0), (1)) x(m) GROUP BY m", "v_cards"))
def model_latency(spark, sf_dir):
    c = A.v_cards(spark, sf_dir).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1))))
    return R.model_latency(c.select(F.when(F.col("m") == 0, "big").otherwise("small").alias("model"), ((F.col("episode") * 31 + F.col("card_no") * 17 + F.col("m")) % 500).alias("latency_ms")))
