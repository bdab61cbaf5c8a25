"""Queries over reflow, gate, joins and timing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators import gate, joins, reflow, timing
from cueloom.plans import adaptors as A
from cueloom.plans.adaptors import KEYS, sql
from cueloom.sources.scratch import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


WORD = ["show", "episode", "pos"]
HOLED = """SELECT show, episode, pos, text, CASE WHEN pos % 5 = 2 THEN NULL ELSE start END AS start, CASE WHEN pos % 7 = 3 THEN NULL WHEN pos % 11 = 4 THEN start - 50 ELSE "end" END AS "end", seg, prob FROM v_words"""


def holed(spark, sf_dir):
    p = F.col("pos")
    return A.v_words(spark, sf_dir).withColumns({"start": F.when(p % 5 != 2, F.col("start")), "end": F.when(p % 7 == 3, F.lit(None)).when(p % 11 == 4, F.col("start") - 50).otherwise(F.col("end"))})


FILLED = """SELECT h.*, CASE WHEN g = 0 THEN greatest(coalesce(m, 0), 0) ELSE m END AS filled FROM (
SELECT *, max(CASE WHEN start IS NOT NULL THEN greatest(coalesce("end", start), start) ELSE "end" END) OVER (PARTITION BY show, episode, g ORDER BY pos) AS m
FROM (SELECT *, count(start) OVER (PARTITION BY show, episode ORDER BY pos) AS g FROM holed)) h"""


@query(sql("""SELECT show, episode, pos, coalesce(start, lag(filled) OVER (PARTITION BY show, episode ORDER BY pos), 0) AS start, filled AS "end" FROM filled""", "v_words", holed=HOLED, filled=FILLED))
def fill_timestamps(spark, sf_dir):
    return reflow.fill_timestamps(holed(spark, sf_dir)).select(*WORD, "start", "end")


TIGHT = """SELECT show, episode, seg, CASE WHEN seg % 4 = 1 THEN NULL ELSE start + 100 END AS lo, CASE WHEN seg % 6 = 5 THEN start - 500 ELSE "end" - 100 END AS hi FROM v_segments"""


@query(sql("""SELECT w.show, w.episode, w.pos, CASE WHEN hi >= lo THEN least(greatest(start, lo), hi) ELSE start END AS start,
CASE WHEN hi >= lo THEN greatest(least(greatest("end", lo), hi), least(greatest(start, lo), hi)) ELSE "end" END AS "end" FROM v_words w LEFT JOIN tight USING (show, episode, seg)""", "v_words", "v_segments", tight=TIGHT))
def clamp_words(spark, sf_dir):
    w = A.v_words(spark, sf_dir)
    s = A.v_segments(w).withColumns({"start": F.when(F.col("seg") % 4 != 1, F.col("start") + 100), "end": F.when(F.col("seg") % 6 == 5, F.col("start") - 500).otherwise(F.col("end") - 100)})
    return reflow.clamp_words(w, s).select(*WORD, "start", "end")


JITTER = """SELECT show, episode, pos, pos // 21 AS seg, start, "end" FROM v_words"""


@query(sql("""SELECT show, episode, pos, start + shift AS start, "end" + shift AS "end" FROM (SELECT *, sum(gap) OVER (PARTITION BY show, episode, seg ORDER BY pos DESC) AS shift FROM (
SELECT *, CASE WHEN lead(start) OVER (PARTITION BY show, episode, seg ORDER BY pos) - "end" > 500 THEN lead(start) OVER (PARTITION BY show, episode, seg ORDER BY pos) - "end" ELSE 0 END AS gap FROM jitter))""", "v_words", jitter=JITTER))
def dejitter(spark, sf_dir):
    w = A.v_words(spark, sf_dir).withColumn("seg", F.floor(F.col("pos") / 21).cast("long"))
    return reflow.dejitter(w, 500).select(*WORD, "start", "end")


SPANS = """SELECT *, sum(CASE WHEN start - prev > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY show, episode ORDER BY pos) AS span_id FROM (SELECT *, lag("end") OVER (PARTITION BY show, episode ORDER BY pos) AS prev FROM v_words)"""
PIECES = """SELECT *, coalesce(sum(CASE WHEN regexp_matches(text, '[.!?…]$') THEN 1 ELSE 0 END) OVER (PARTITION BY show, episode, span_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece_id FROM spans"""
GROUPS = """SELECT show, episode, span_id, piece_id, string_agg(trim(text), ' ' ORDER BY pos) AS text, arg_min(start, pos) AS start, arg_max("end", pos) AS natural_end, min(pos) AS first_pos FROM pieces GROUP BY ALL HAVING trim(string_agg(trim(text), ' ' ORDER BY pos)) <> ''"""
TIMED = """SELECT *, CASE WHEN e <= start THEN start + 83 ELSE e END AS "end" FROM (SELECT *, least(greatest(natural_end, start + 830, start + length(text) * 59), start + 7000, coalesce(lead(start) OVER (PARTITION BY show, episode ORDER BY first_pos) - 83, start + 7000)) AS e FROM groups)"""


@query(sql("SELECT show, episode, pos, span_id FROM spans", "v_words", spans=SPANS))
def split_spans(spark, sf_dir):
    return reflow.split_spans(A.v_words(spark, sf_dir), 500).select(*WORD, "span_id")


@query(sql("SELECT show, episode, pos, span_id, piece_id FROM pieces", "v_words", spans=SPANS, pieces=PIECES))
def split_sentences(spark, sf_dir):
    return reflow.split_sentences(reflow.split_spans(A.v_words(spark, sf_dir), 500)).select(*WORD, "span_id", "piece_id")


def _pieces(spark, sf_dir):
    return reflow.split_sentences(reflow.split_spans(A.v_words(spark, sf_dir), 500)).withColumn("group_id", F.lit(0))


@query(sql("""SELECT show, episode, first_pos, start, "end" FROM timed""", "v_words", spans=SPANS, pieces=PIECES, groups=GROUPS, timed=TIMED))
def time_cards(spark, sf_dir):
    # 1/59 characters for each millisecond keeps the times whole.
    groups = reflow.groups_of(_pieces(spark, sf_dir))
    timed = reflow.time_cards(groups, 830, 7000, 1 / 59, 83)
    return timed.select("show", "episode", "first_pos", "start", F.round("end").cast("long").alias("end"))


# Pieces that are too long, as lists; ranges (a, b) of their words are cut again and again.
LISTS = """SELECT show, episode, span_id, piece_id, min(first) AS first, count(*) AS n, list(start ORDER BY pos) AS s, list("end" ORDER BY pos) AS e, list(regexp_matches(trim(text), '[,;:]$') ORDER BY pos) AS cl,
list_prepend(0, list(reach ORDER BY pos)) AS reach FROM (SELECT *, sum(length(trim(text)) + 1) OVER (PARTITION BY show, episode, span_id, piece_id ORDER BY pos) AS reach, min(pos) OVER (PARTITION BY show, episode, span_id, piece_id) AS first FROM pieces) GROUP BY show, episode, span_id, piece_id"""
LONG_LISTS = """SELECT *, list_transform(range(1, n), lambda p: s[p + 1] - e[p]) AS pause FROM lists WHERE n > 1 AND (reach[n + 1] - 1 > 84 OR e[n] - s[1] > 7000)"""
CUTS = """SELECT show, episode, span_id, piece_id, 0::BIGINT AS a, n AS b, true AS over FROM long_lists
UNION ALL SELECT show, episode, span_id, piece_id, a, b, b - a > 1 AND (reach[b + 1] - reach[a + 1] - 1 > 84 OR e[b] - s[a + 1] > 7000) FROM (
SELECT show, episode, span_id, piece_id, s, e, reach, unnest([a, c]) AS a, unnest([c, b]) AS b FROM (
SELECT k.*, s, e, reach, CASE WHEN list_max(pause[a + 1:b - 1]) > 0 THEN list_min(list_transform(list_filter(range(a + 1, b), lambda p: pause[p] = list_max(pause[a + 1:b - 1])), lambda p: {'d': abs(p - (a + b) / 2), 'q': -p, 'p': p})).p
WHEN list_bool_or(cl[a + 1:b - 1]) THEN list_min(list_transform(list_filter(range(a + 1, b), lambda p: cl[p]), lambda p: {'d': abs(p - (a + b) / 2), 'q': p, 'p': p})).p
ELSE list_min(list_transform(range(a + 1, b), lambda p: {'d': abs(reach[p + 1] - reach[a + 1] - (reach[b + 1] - reach[a + 1] - 1) / 2), 'q': p, 'p': p})).p END AS c
FROM cuts k JOIN long_lists USING (show, episode, span_id, piece_id) WHERE k.over))"""
GROUPED = """SELECT p.*, coalesce(g.group_id, 0) AS group_id FROM (SELECT *, row_number() OVER (PARTITION BY show, episode, span_id, piece_id ORDER BY pos) - 1 AS at FROM pieces) p
LEFT JOIN (SELECT show, episode, span_id, piece_id, a, b, row_number() OVER (PARTITION BY show, episode, span_id, piece_id ORDER BY a) - 1 AS group_id FROM cuts WHERE NOT over) g
ON p.show = g.show AND p.episode = g.episode AND p.span_id = g.span_id AND p.piece_id = g.piece_id AND p.at >= g.a AND p.at < g.b"""
OVERFLOW = {"lists": LISTS, "long_lists": LONG_LISTS, "cuts": CUTS, "grouped": GROUPED}
JOINED = """SELECT show, episode, pos, text, pos * 400 AS start, pos * 400 + 380 + pos % 2 * 20 AS "end", seg FROM v_words"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(sql("SELECT show, episode, pos, span_id, piece_id, group_id FROM grouped", "v_words", joined=JOINED, spans=SPANS.replace("FROM v_words", "FROM joined"), pieces=PIECES, **OVERFLOW)))
def split_overflow(spark, sf_dir):
    joined = A.v_words(spark, sf_dir).withColumn("start", F.col("pos") * 400).withColumn("end", F.col("pos") * 400 + 380 + (F.col("pos") % 2) * 20)
    whole = reflow.split_sentences(reflow.split_spans(joined, 500))
    return reflow.split_overflow(whole, 84, 7000).select(*WORD, "span_id", "piece_id", "group_id")


# The words' times are whole and in their segments, so filling, clamping and closing gaps leave them.
CARDS = """SELECT show, episode, string_agg(trim(g.text), ' ' ORDER BY pos) AS text, arg_min(g.start, pos) AS start, arg_max(g."end", pos) AS natural_end, min(pos) AS first_pos, avg(ln(greatest(prob / 100.0, 0.0001))) AS lp, max(no_speech_prob) / 100.0::DOUBLE AS nsp
FROM grouped g JOIN (SELECT show, episode, seg, no_speech_prob FROM v_segments) USING (show, episode, seg) GROUP BY show, episode, span_id, piece_id, group_id HAVING trim(string_agg(trim(g.text), ' ' ORDER BY pos)) <> ''"""
ENDED = """SELECT *, row_number() OVER (PARTITION BY show, episode ORDER BY first_pos) AS card_no, CASE WHEN e <= start THEN start + 83 ELSE e END AS "end" FROM (SELECT *, least(greatest(natural_end, start + 830, start + length(text) / 0.017::DOUBLE), start + 7000, coalesce(lead(start) OVER (PARTITION BY show, episode ORDER BY first_pos) - 83, start + 7000)) AS e FROM cards)"""
WRAPPED = """SELECT t, CASE WHEN n < 2 THEN t ELSE (SELECT min({'o': CASE WHEN greatest(length(c.l), length(c.r)) > 42 THEN 1 ELSE 0 END, 's': CASE WHEN greatest(length(c.l), length(c.r)) > 42 THEN greatest(length(c.l), length(c.r)) ELSE abs(length(c.l) - length(c.r)) END, 'i': c.i, 'x': c.l || chr(10) || c.r}) FROM (SELECT unnest(cuts) AS c)).x END AS wrapped
FROM (SELECT t, len(w) AS n, list_transform(range(1, len(w)), lambda i: {'l': array_to_string(w[:i], ' '), 'r': array_to_string(w[i + 1:], ' '), 'i': i}) AS cuts FROM (SELECT t, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT text AS t FROM cards WHERE length(text) > 42)))"""


@query(recursive(sql("""SELECT show, episode, card_no, start, round("end", 3)::DOUBLE AS "end", coalesce(wrapped, text) AS text, round(lp, 6) AS avg_logprob, nsp AS no_speech_prob FROM ended LEFT JOIN wrapped ON t = text""",
                     "v_words", "v_segments", spans=SPANS, pieces=PIECES, **OVERFLOW, cards=CARDS, ended=ENDED, wrapped=WRAPPED)))
def reflow_cards(spark, sf_dir):
    w = A.v_words(spark, sf_dir)
    s = A.v_segments(w).withColumn("no_speech_prob", F.col("no_speech_prob") / 100)
    cards = reflow.reflow(w.withColumn("prob", F.col("prob") / 100), s, gap=500, max_dur=7000, min_dur=830, cps=0.017, min_gap=83)
    return cards.withColumns({"end": F.round("end", 3), "avg_logprob": F.round("avg_logprob", 6)})


@query(sql("""SELECT show, episode, span_id, piece_id, count(*) AS n_words, max(no_speech_prob) AS no_speech_prob, round(avg(ln(greatest(prob / 100.0, 0.0001))), 6) AS avg_logprob
FROM pieces JOIN (SELECT show, episode, seg, no_speech_prob FROM v_segments) USING (show, episode, seg) GROUP BY ALL""", "v_words", "v_segments", spans=SPANS, pieces=PIECES))
def card_confidence(spark, sf_dir):
    p = _pieces(spark, sf_dir)
    s = A.v_segments(A.v_words(spark, sf_dir))
    scored = reflow.card_confidence(p.withColumn("prob", F.col("prob") / 100), s)
    n = p.groupBy("show", "episode", "span_id", "piece_id").agg(F.count(F.lit(1)).alias("n_words"))
    return scored.join(n, ["show", "episode", "span_id", "piece_id"]).select("show", "episode", "span_id", "piece_id", "n_words", "no_speech_prob", F.round("avg_logprob", 6).alias("avg_logprob"))


@query(sql("""SELECT show, episode, card_no, coalesce(word_probs, '') AS word_probs FROM (SELECT c.show, c.episode, c.card_no, string_agg(w.prob::VARCHAR, ',' ORDER BY w.pos) AS word_probs FROM v_long_cards c LEFT JOIN v_words w
ON c.show = w.show AND c.episode = w.episode AND w."end" > c.start + 350 AND w.start < c."end" + 350 GROUP BY ALL)""", "v_words", "v_long_cards"))
def card_word_probs(spark, sf_dir):
    w = A.v_words(spark, sf_dir).drop("text")
    # The cards are made before the words are a table: there they lie together, so no words are shuffled.
    cards = materialize(A.v_long_cards(w).withColumns({"start": F.col("start") + 350, "end": F.col("end") + 350}), "long-cards")
    w = materialize(w, "words")
    out = reflow.card_word_probs(cards, w, digits=0)
    return out.select(*KEYS, "card_no", F.array_join(F.transform("word_probs", lambda p: p.cast("long").cast("string")), ",").alias("word_probs"))


WRAP = r"""SELECT t, list_transform(range(1, len(w)), lambda i: {'l': array_to_string(w[:i], ' '), 'r': array_to_string(w[i + 1:], ' '), 'i': i}) AS cuts, len(w) AS n FROM (SELECT t, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations))"""


@query(sql(r"""SELECT t AS text, CASE WHEN length(t) <= 42 OR n < 2 THEN t ELSE (SELECT min({'o': CASE WHEN greatest(length(c.l), length(c.r)) > 42 THEN 1 ELSE 0 END,
's': CASE WHEN greatest(length(c.l), length(c.r)) > 42 THEN greatest(length(c.l), length(c.r)) ELSE abs(length(c.l) - length(c.r)) END, 'i': c.i, 'x': c.l || chr(10) || c.r}) FROM (SELECT unnest(cuts) AS c)).x END AS wrapped FROM wrap""", wrap=WRAP))
def wrap_balance(spark, sf_dir):
    t = A.table(spark, sf_dir, "conversations").select(F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).distinct()
    return t.select("text", T.wrap_balance(F.col("text")).alias("wrapped"))


# ---- gate ---------------------------------------------------------------------------------------
TOKENS = """SELECT doc_id, t, len(t) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM documents) WHERE len(t) >= 2"""
GRAMS = """SELECT doc_id, n, k, g, count(*) AS c FROM (SELECT doc_id, n, k, unnest(list_transform(range(1, n - k + 2), lambda i: array_to_string(t[i:i + k - 1], ' '))) AS g FROM tok, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL"""
LOOPED = """SELECT doc_id FROM grams GROUP BY doc_id HAVING bool_or(n >= 6 AND (k = 1 AND c * 100 >= n * 60 OR k > 1 AND c >= 3 AND c * k * 100 >= n * 60))"""
CARD_TOKENS = """SELECT {'e': episode, 'c': card_no} AS doc_id, t, len(t) AS n FROM (SELECT episode, card_no, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM v_cards)"""


@query(sql(r"""SELECT show, episode, card_no, CASE WHEN regexp_matches(text, '(?i)amara\.org|thank you for watching|copyright|www\.|http|thonin') THEN 'blocklist' WHEN doc_id IS NOT NULL THEN 'repetition' WHEN no_speech_prob > 95 AND avg_logprob < -200 THEN 'music' END AS drop_reason,
CASE WHEN avg_logprob < -60 THEN 'low_conf' WHEN no_speech_prob > 50 THEN 'maybe_silence' END AS flag FROM v_cards LEFT JOIN looped ON doc_id = {'e': episode, 'c': card_no}""", "v_cards", tok=CARD_TOKENS, grams=GRAMS, looped=LOOPED))
def drop_reason(spark, sf_dir):
    c = A.v_cards(spark, sf_dir)
    block = [r"amara\.org", "thank you for watching", "copyright", r"www\.", "http", "thonin"]
    return c.select(*KEYS, "card_no", T.drop_reason(F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob"), block, 95, -200).alias("drop_reason"),
                    T.flag_reason(F.col("no_speech_prob"), F.col("avg_logprob"), 50, -60).alias("flag"))


@query(sql("SELECT d.doc_id, l.doc_id IS NOT NULL AS repetition FROM documents d LEFT JOIN looped l USING (doc_id)", tok=TOKENS, grams=GRAMS, looped=LOOPED))
def is_repetition(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.is_repetition(F.col("text")).alias("repetition"))


@query(sql("""SELECT doc_id, n AS tokens, max(c) AS top FROM grams WHERE k = 2 GROUP BY ALL""", tok=TOKENS, grams=GRAMS))
def max_ngram_share(spark, sf_dir):
    return gate.max_ngram_share(A.table(spark, sf_dir, "documents"), 2, ["doc_id"])


ISLANDS = """SELECT *, count(*) OVER (PARTITION BY episode, run) AS n, row_number() OVER (PARTITION BY episode, run ORDER BY card_no) AS k, max("end") OVER (PARTITION BY episode, run) AS last FROM (
SELECT *, card_no - row_number() OVER (PARTITION BY episode, text ORDER BY card_no) || text AS run FROM v_repeat_cards)"""


@query(sql("""SELECT show, episode, card_no, text, start, CASE WHEN n >= 4 THEN last ELSE "end" END AS "end" FROM islands WHERE n < 4 OR k = 1""", "v_repeat_cards", islands=ISLANDS))
def collapse_runs(spark, sf_dir):
    return gate.collapse_runs(A.v_repeat_cards(spark, sf_dir)).select(*KEYS, "card_no", "text", "start", "end")


QC = """SELECT show, episode, count(*) AS cards, sum(CASE WHEN avg_logprob < -60 OR no_speech_prob > 50 THEN 1 ELSE 0 END) AS flagged, sum(CASE WHEN avg_logprob < -80 OR no_speech_prob > 60 THEN 1 ELSE 0 END) AS low_conf,
max("end" - start) AS max_dur, sum(CASE WHEN length(replace(text, chr(10), ' ')) * 1000 > 17 * ("end" - start) THEN 1 ELSE 0 END) AS over_cps,
sum(CASE WHEN "end" - start > 7001 OR len(string_split(text, chr(10))) > 2 OR len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 42)) > 0 THEN 1 ELSE 0 END) AS violations, sum(avg_logprob) AS lp_sum FROM v_cards GROUP BY ALL"""


def _qc(spark, sf_dir):
    c = A.v_cards(spark, sf_dir)
    return gate.caption_qc(c.withColumn("flag", T.flag_reason(F.col("no_speech_prob"), F.col("avg_logprob"), 50, -60)), unit=1000, low_lp=-80, high_nsp=60)


@query(sql("SELECT * FROM qc", "v_cards", qc=QC))
def caption_qc(spark, sf_dir):
    return _qc(spark, sf_dir)


@query(sql("""SELECT show, count(*) AS episodes, sum(cards) AS cards, sum(flagged) AS flagged, sum(violations) AS violations, (SELECT substr(sha256(min(text)), 1, 12) FROM benchmark) AS fingerprint FROM qc GROUP BY show""", "v_cards", qc=QC))
def run_summary(spark, sf_dir):
    body = A.table(spark, sf_dir, "benchmark").agg(F.min("text").alias("body")).select(F.lit("all").alias("show"), "body")
    return gate.run_summary(_qc(spark, sf_dir), body)


@query(sql("""SELECT CASE WHEN avg_logprob < -60 THEN 'low_conf' WHEN no_speech_prob > 50 THEN 'maybe_silence' END AS status, count(*) AS n FROM v_cards GROUP BY 1""", "v_cards"))
def status_counts(spark, sf_dir):
    return gate.status_counts(A.v_cards(spark, sf_dir).withColumn("status", T.flag_reason(F.col("no_speech_prob"), F.col("avg_logprob"), 50, -60)))


@query(sql("""SELECT show, episode, card_no, row_number() OVER (PARTITION BY show, episode ORDER BY card_no) AS cue_no FROM v_cards""", "v_cards"))
def number_cues(spark, sf_dir):
    return reflow.number_cues(A.v_cards(spark, sf_dir)).select(*KEYS, "card_no", "cue_no")


# ---- joins and timing ---------------------------------------------------------------------------
@query(sql("""SELECT c.show, c.episode, c.card_no, q.cue_no FROM v_long_cards c JOIN v_long_cues q ON c.show = q.show AND c.episode = q.episode AND least(c."end", q."end" + 300) > greatest(c.start, q.start - 300)""", "v_words", "v_long_cards", "v_long_cues"))
def range_join(spark, sf_dir):
    w = materialize(A.v_words(spark, sf_dir).select(*KEYS, "seg", "start", "end"), "words")
    cues = A.v_long_cues(w).select(*KEYS, "cue_no", F.col("start").alias("cue_start"), F.col("end").alias("cue_end"))
    return joins.range_join(A.v_long_cards(w), cues, ("start", "end"), ("cue_start", "cue_end"), slack=300).select(*KEYS, "card_no", "cue_no")


REFS = """SELECT c.show, c.episode, c.card_no, string_agg(q.text, ' ' ORDER BY q.start, q."end", q.text) AS ref FROM v_cards c LEFT JOIN v_cues q ON c.show = q.show AND c.episode = q.episode AND q."end" > c.start AND q.start < c."end" GROUP BY ALL"""


def refs(cards, cues):
    c = cues.select(*KEYS, F.col("start").alias("q_start"), F.col("end").alias("q_end"), F.col("text").alias("q_text"))
    met = joins.range_join(cards.select(*KEYS, "card_no", "start", "end"), c, ("start", "end"), ("q_start", "q_end"))
    return cards.join(joins.collect_text(met, [*KEYS, "card_no"], ["q_start", "q_end"], "q_text", "ref", cap=300), [*KEYS, "card_no"], "left")


@query(sql("SELECT show, episode, card_no, substr(ref, 1, 300) AS ref FROM refs", "v_cards", "v_cues", refs=REFS))
def overlap_ref(spark, sf_dir):
    return refs(A.v_cards(spark, sf_dir), A.v_cues(spark, sf_dir)).select(*KEYS, "card_no", "ref")


NEAR = """SELECT show, episode, card_no, cue_no, d AS delta FROM (SELECT c.show, c.episode, c.card_no, q.cue_no, q.start - c.start AS d, row_number() OVER (PARTITION BY c.show, c.episode, c.card_no ORDER BY abs(q.start - c.start), q.start, q.cue_no) AS rn
FROM {cards} c JOIN {cues} q ON c.show = q.show AND c.episode = q.episode AND abs(q.start - c.start) <= 5000) WHERE rn = 1"""


@query(sql(NEAR.format(cards="v_long_cards", cues="v_long_cues"), "v_words", "v_long_cards", "v_long_cues"))
def nearest_onset(spark, sf_dir):
    w = A.v_words(spark, sf_dir)
    return joins.nearest_onset(A.v_long_cards(w), A.v_long_cues(w), radius=5000)


PTS = """SELECT s.show, s.episode, row_number() OVER (PARTITION BY s.show, s.episode ORDER BY s.card_no) - 1 AS i, count(*) OVER (PARTITION BY s.show, s.episode) AS n, c.start AS x, -delta AS y FROM near s JOIN v_long_cards c USING (show, episode, card_no)"""
# All pairs of up to 60 points; beyond, the 200 that the operator's fixed rule picks.
PICKS = """SELECT DISTINCT show, episode, least(i, j) AS i, greatest(i, j) AS j FROM (SELECT show, episode, s * 7919 % n AS i, (s * 7919 + 1 + s * 104729 % (n - 1)) % n AS j FROM (SELECT DISTINCT show, episode, n FROM pts WHERE n > 60), range(0, 200) r(s))"""
LINES = """SELECT a.show, a.episode, a.i, b.i AS j, (b.y - a.y) / (b.x - a.x)::DOUBLE AS b, a.y - (b.y - a.y) / (b.x - a.x)::DOUBLE * a.x AS a FROM pts a JOIN pts b ON a.show = b.show AND a.episode = b.episode AND a.i < b.i AND a.x <> b.x
WHERE a.n <= 60 OR (a.show, a.episode, a.i, b.i) IN (SELECT (show, episode, i, j) FROM picks)"""
SCORED = """SELECT show, episode, arg_max({'a': a, 'b': b}, (n, -i, -j)) AS m FROM (SELECT l.show, l.episode, l.i, l.j, l.a, l.b, count(*) AS n FROM lines l JOIN pts p ON p.show = l.show AND p.episode = l.episode AND abs(p.y - (l.a + l.b * p.x)) <= 300 + 3e-7 GROUP BY ALL) GROUP BY ALL"""
FITS = """SELECT p.show, p.episode, max(p.n) AS matched, CASE WHEN max(p.n) > 1 THEN count(*) ELSE 0 END AS inliers, CASE WHEN count(*) >= 10 THEN regr_intercept(p.y, p.x) END AS a, CASE WHEN count(*) >= 10 THEN regr_slope(p.y, p.x) END AS b
FROM pts p LEFT JOIN scored s ON p.show = s.show AND p.episode = s.episode WHERE m IS NULL OR abs(p.y - (m.a + m.b * p.x)) <= 300 + 3e-7 GROUP BY ALL"""
FIT_VIEWS = {"near": NEAR.format(cards="v_long_cards", cues="v_long_cues"), "pts": PTS, "picks": PICKS, "lines": LINES, "scored": SCORED, "fits": FITS}


@query(sql("SELECT show, episode, matched, inliers, round(a, 3) AS offset_a, round(b, 7) AS drift_b FROM fits", "v_words", "v_long_cards", "v_long_cues", **FIT_VIEWS))
def ransac_fit(spark, sf_dir):
    w = materialize(A.v_words(spark, sf_dir).select(*KEYS, "seg", "start", "end"), "words")
    fit = timing.ransac_fit(timing.onset_pairs(A.v_long_cards(w), A.v_long_cues(w), 5000), 300)
    return fit.select(*KEYS, F.col("matched").cast("long").alias("matched"), F.col("inliers").cast("long").alias("inliers"), F.round("offset_a", 3).alias("offset_a"), F.round("drift_b", 7).alias("drift_b"))


# All lines: for each point i, the slopes of lines through it are swept together with the ends of the
# stretches of slopes for which another point lies in the band.
TURNS = """SELECT show, episode, i, j, x, y, dy / dx::DOUBLE AS b, unnest([0, 1, 2]) AS kind, unnest([least((dy - 300 - 3e-7) / dx, (dy + 300 + 3e-7) / dx), dy / dx::DOUBLE, greatest((dy - 300 - 3e-7) / dx, (dy + 300 + 3e-7) / dx)]) AS v
FROM (SELECT a.show, a.episode, a.i, b.i AS j, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy FROM pts a JOIN pts b ON a.show = b.show AND a.episode = b.episode AND a.x <> b.x)"""
SWEPT = """SELECT *, sum(CASE kind WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) OVER (PARTITION BY show, episode, i ORDER BY v, kind ROWS UNBOUNDED PRECEDING) AS n FROM turns"""
SWEPT_BEST = "SELECT show, episode, arg_max({'a': y - b * x, 'b': b}, (n, -i, -j)) AS m FROM swept WHERE kind = 1 AND i < j GROUP BY ALL"


@query(sql("SELECT show, episode, matched, inliers, round(a, 3) AS offset_a, round(b, 7) AS drift_b FROM fits", "v_words", "v_long_cards", "v_long_cues", near=FIT_VIEWS["near"], pts=PTS, turns=TURNS, swept=SWEPT, scored=SWEPT_BEST, fits=FITS))
def ransac_fit_long(spark, sf_dir):
    """All lines through two points, in episodes of any length."""
    w = materialize(A.v_words(spark, sf_dir).select(*KEYS, "seg", "start", "end"), "words")
    fit = timing.ransac_fit(timing.onset_pairs(A.v_long_cards(w), A.v_long_cues(w), 5000), 300, cap=None)
    return fit.select(*KEYS, F.col("matched").cast("long").alias("matched"), F.col("inliers").cast("long").alias("inliers"), F.round("offset_a", 3).alias("offset_a"), F.round("drift_b", 7).alias("drift_b"))


@query(sql("""SELECT user_id, (CASE WHEN n >= 2 THEN (v[j3] * (4 - d3) + v[j3 + 1] * d3) / 4.0 - (v[j1] * (4 - d1) + v[j1 + 1] * d1) / 4.0 END) AS iqr FROM (SELECT *, (n + 1) - j1 * 4 AS d1, (n + 1) * 3 - j3 * 4 AS d3 FROM (
SELECT user_id, v, n, least(greatest((n + 1) // 4, 1), n - 1) AS j1, least(greatest((n + 1) * 3 // 4, 1), n - 1) AS j3 FROM (SELECT user_id, list(event_id % 1000 ORDER BY event_id % 1000) AS v, count(*) AS n FROM events GROUP BY user_id)))"""))
def residual_iqr(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list((F.col("event_id") % 1000).cast("double")).alias("v"))
    return e.select("user_id", timing.residual_iqr(F.col("v")).alias("iqr"))


@query(sql("""SELECT show, episode, card_no, start - (120 + start // 1000) AS aligned_start, "end" - (120 + "end" // 1000) AS aligned_end, false AS low_confidence FROM v_cards WHERE episode % 2 = 0
UNION ALL SELECT show, episode, card_no, start, "end", true FROM v_cards WHERE episode % 2 = 1""", "v_cards"))
def align_card(spark, sf_dir):
    c = A.v_cards(spark, sf_dir)
    fit = c.where("episode % 2 = 0").select(*KEYS).distinct().withColumns({"offset_a": F.lit(120.0), "drift_b": F.lit(0.001)})
    return timing.align(c, fit).select(*KEYS, "card_no", *[F.round(x).cast("long").alias(x) for x in ("aligned_start", "aligned_end")], "low_confidence")


HIT = """SELECT c.*, EXISTS (SELECT 1 FROM v_cues q WHERE q.show = c.show AND q.episode = c.episode AND least(c."end", q."end" + 300) - greatest(c.start, q.start - 300) > 0) AS hit FROM v_cards c"""
COVER = """SELECT show, episode, count(*) AS cue_count, sum(CASE WHEN EXISTS (SELECT 1 FROM v_cards c WHERE q.show = c.show AND q.episode = c.episode AND least(c."end", q."end" + 300) - greatest(c.start, q.start - 300) > 0) THEN 1 ELSE 0 END) AS cues_covered FROM v_cues q GROUP BY ALL"""
SPAN = ("start", "end")


@query(sql("SELECT show, episode, card_no, CASE WHEN hit THEN 'on-cue' ELSE 'in-gap' END AS classification FROM hit", "v_cards", "v_cues", hit=HIT))
def classify_cards(spark, sf_dir):
    return timing.classify_cards(A.v_cards(spark, sf_dir), A.v_cues(spark, sf_dir), 300, SPAN).select(*KEYS, "card_no", "classification")


@query(sql("SELECT * FROM cover", "v_cards", "v_cues", cover=COVER))
def covered_cues(spark, sf_dir):
    return timing.covered_cues(A.v_cards(spark, sf_dir), A.v_cues(spark, sf_dir), 300, SPAN)


VERDICT = """SELECT show, episode, card_no, count(*) AS frames, sum(CASE WHEN voiced THEN 1 ELSE 0 END) AS voiced, CASE WHEN sum(CASE WHEN voiced THEN 1 ELSE 0 END) * 10 >= 3 * count(*) THEN 'in_gap_speech' ELSE 'in_gap_silent' END AS verdict FROM v_frames GROUP BY ALL"""


@query(sql(VERDICT, "v_frames"))
def vad_verdict(spark, sf_dir):
    return timing.vad_verdict(A.v_frames(spark, sf_dir))


REPORT = """SELECT c.show, c.episode, count(*) AS cards, sum(hit::INT) AS on_cue, sum((NOT hit)::INT) AS in_gap, sum((NOT hit AND verdict = 'in_gap_silent')::INT) AS in_gap_silent, sum((NOT hit AND verdict = 'in_gap_speech')::INT) AS in_gap_speech, 0 AS in_gap_vad_error,
sum((NOT hit AND no_speech_prob <= 50)::INT) AS nsp_clean, sum((NOT hit AND no_speech_prob > 50 AND no_speech_prob <= 95)::INT) AS nsp_flag, sum((NOT hit AND no_speech_prob > 95)::INT) AS nsp_drop,
sum((NOT hit AND avg_logprob >= -60)::INT) AS lp_clean, sum((NOT hit AND avg_logprob < -60 AND avg_logprob >= -200)::INT) AS lp_flag, sum((NOT hit AND avg_logprob < -200)::INT) AS lp_drop,
sum((NOT hit AND flag = 'maybe_silence')::INT) AS flag_maybe_silence, sum((NOT hit AND flag = 'low_conf')::INT) AS flag_low_conf, sum((NOT hit AND flag IS NULL)::INT) AS flag_none, sum((hit AND coalesce(flag, '') = 'maybe_silence')::INT) AS maybe_silence_on_cue
FROM (SELECT *, CASE WHEN avg_logprob < -60 THEN 'low_conf' WHEN no_speech_prob > 50 THEN 'maybe_silence' END AS flag, CASE WHEN (episode + card_no) % 5 = 0 THEN NULL WHEN (episode + card_no) % 3 = 0 THEN 'in_gap_speech' ELSE 'in_gap_silent' END AS verdict FROM hit) c GROUP BY ALL"""
RATED = """SELECT r.*, coalesce(cue_count, 0) AS cue_count, coalesce(cues_covered, 0)::BIGINT AS cues_covered, on_cue / cards AS pct_on_cue, CASE WHEN cue_count > 0 THEN cues_covered / cue_count END AS pct_cues_covered,
CASE WHEN in_gap = 0 OR in_gap_silent + in_gap_speech > 0 THEN in_gap_speech / cards END AS false_in_gap_rate FROM report r LEFT JOIN cover USING (show, episode)"""


def _report(spark, sf_dir):
    cards, cues = A.v_cards(spark, sf_dir), A.v_cues(spark, sf_dir)
    n = F.col("episode") + F.col("card_no")
    cards = cards.withColumns({"flag": T.flag_reason(F.col("no_speech_prob"), F.col("avg_logprob"), 50, -60), "verdict": F.when(n % 5 == 0, F.lit(None)).when(n % 3 == 0, "in_gap_speech").otherwise("in_gap_silent")})
    placed = timing.classify_cards(cards, cues, 300, SPAN)
    return timing.episode_report(placed, timing.covered_cues(cards, cues, 300, SPAN), unit=100)


@query(sql("SELECT * FROM rated", "v_cards", "v_cues", hit=HIT, cover=COVER, report=REPORT, rated=RATED))
def episode_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query(sql("""SELECT CASE WHEN g = 0 THEN s END AS show, count(*) AS episodes, sum(cards) AS cards, sum(on_cue) AS on_cue, sum(in_gap) AS in_gap, sum(in_gap_silent) AS in_gap_silent, sum(in_gap_speech) AS in_gap_speech, sum(in_gap_vad_error) AS in_gap_vad_error,
sum(cue_count) AS cue_count, sum(cues_covered) AS cues_covered, sum(on_cue) / sum(cards) AS pct_on_cue, sum(cues_covered) / sum(cue_count) AS pct_cues_covered,
sum(CASE WHEN false_in_gap_rate IS NOT NULL THEN in_gap_speech END) / sum(CASE WHEN false_in_gap_rate IS NOT NULL THEN cards END) AS false_in_gap_rate
FROM (SELECT *, 'show ' || (episode % 3) AS s FROM rated), (VALUES (0), (1)) v(g) GROUP BY g, CASE WHEN g = 0 THEN s END""", "v_cards", "v_cues", hit=HIT, cover=COVER, report=REPORT, rated=RATED))
def show_rollup(spark, sf_dir):
    shows = _report(spark, sf_dir).withColumn("show", F.concat(F.lit("show "), (F.col("episode") % 3).cast("string")))
    return timing.show_rollup(shows)


ALIGNED = """SELECT c.show, c.episode, c.card_no, c.start - (coalesce(a, 0) + coalesce(b, 0) * c.start) AS s, c."end" - (coalesce(a, 0) + coalesce(b, 0) * c."end") AS e FROM v_long_cards c LEFT JOIN fits f ON c.show = f.show AND c.episode = f.episode WHERE c.episode % 10 <> 9"""
PLACED = """SELECT c.*, EXISTS (SELECT 1 FROM v_long_cues q WHERE q.show = c.show AND q.episode = c.episode AND least(c.e, q."end" + 300) > greatest(c.s, q.start - 300)) AS hit FROM aligned c"""
COVERED = """SELECT show, episode, count(*) AS cue_count, count(*) FILTER (EXISTS (SELECT 1 FROM aligned c WHERE q.show = c.show AND q.episode = c.episode AND least(c.e, q."end" + 300) > greatest(c.s, q.start - 300))) AS cues_covered FROM v_long_cues q GROUP BY ALL"""


@query(sql("""SELECT e.show, e.episode, CASE WHEN e.episode % 10 = 9 THEN 'bad-conf' WHEN cue_count IS NULL THEN 'no-reference' ELSE 'ok' END AS status, CASE WHEN cue_count > 0 THEN p.cards END AS cards, CASE WHEN cue_count > 0 THEN p.on_cue END AS on_cue,
CASE WHEN p.cards > 0 THEN cue_count END AS cue_count, CASE WHEN p.cards > 0 THEN cues_covered END AS cues_covered, CASE WHEN p.cards > 0 THEN f.inliers END AS inliers, CASE WHEN p.cards > 0 THEN round(f.a, 3) END AS offset_a
FROM (SELECT DISTINCT show, episode FROM v_long_cards) e LEFT JOIN (SELECT show, episode, count(*) AS cards, count(*) FILTER (hit) AS on_cue FROM placed GROUP BY ALL) p USING (show, episode)
LEFT JOIN covered USING (show, episode) LEFT JOIN fits f USING (show, episode)""", "v_words", "v_long_cards", "v_long_cues", **FIT_VIEWS, aligned=ALIGNED, placed=PLACED, covered=COVERED))
def timing_report(spark, sf_dir):
    # Made where their words lie: no words are written or shuffled.
    made = materialize(A.v_long_cards(A.v_words(spark, sf_dir)), "long-cards")
    cards = made.withColumns({"no_speech_prob": (F.col("episode") * 7 + F.col("card_no") * 3) % 100, "avg_logprob": -((F.col("episode") * 13 + F.col("card_no") * 7) % 300)})
    cards = cards.withColumn("flag", T.flag_reason(F.col("no_speech_prob"), F.col("avg_logprob"), 50, -60))
    status = cards.select(*KEYS).distinct().withColumn("status", F.when(F.col("episode") % 10 == 9, "bad-conf").otherwise("ok"))
    out = timing.timing_report(cards, A.cues_of(made), tol=300, radius=5000, unit=100, band=300, status=status)
    return out.select(*KEYS, "status", "cards", "on_cue", "cue_count", "cues_covered", F.col("inliers").cast("long").alias("inliers"), F.round("offset_a", 3).alias("offset_a"))


@query(sql("""SELECT show, episode, card_no, CASE WHEN no_speech_prob <= 50 THEN 'clean_le_0.5' WHEN no_speech_prob <= 95 THEN 'flag_gt_0.5_le_0.95' ELSE 'drop_gt_0.95' END AS nsp_band,
CASE WHEN avg_logprob >= -60 THEN 'clean_ge_-0.6' WHEN avg_logprob >= -200 THEN 'flag_lt_-0.6_ge_-2.0' ELSE 'drop_lt_-2.0' END AS lp_band FROM v_cards""", "v_cards"))
def score_bands(spark, sf_dir):
    return A.v_cards(spark, sf_dir).select(*KEYS, "card_no", T.band_nsp(F.col("no_speech_prob"), 50, 95).alias("nsp_band"), T.band_lp(F.col("avg_logprob"), -60, -200).alias("lp_band"))


@query(sql("""SELECT c.show, c.episode, c.card_no, q.cue_no, least(c."end", q."end" + 300) - greatest(c.start, q.start - 300) > 0 AS overlaps FROM v_cards c JOIN v_cues q ON c.episode = q.episode AND c.card_no + 1 = q.cue_no""", "v_cards", "v_cues"))
def overlap_slack(spark, sf_dir):
    q = A.v_cues(spark, sf_dir).select("episode", "cue_no", F.col("start").alias("qs"), F.col("end").alias("qe"))
    c = A.v_cards(spark, sf_dir).withColumn("cue_no", F.col("card_no") + 1).join(q, ["episode", "cue_no"])
    return c.select(*KEYS, "card_no", "cue_no", T.overlap_slack(F.col("start"), F.col("end"), F.col("qs"), F.col("qe"), 300).alias("overlaps"))
