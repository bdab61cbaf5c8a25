"""Subtitle events and media tracks: dialogue, signs, merging, planning, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.operators.joins import KEYS

# Tags and style names.
KARAOKE = r"\\[kK][fo]?\d"
POSITIONED = r"\\(?:pos|move)\(|\\an[134567 89]"
DRAWING = r"\\p\d|\\clip|\\iclip"
ANIMATED = r"\\t\(|\\fade?\(|\\move\("
NOT_DIALOGUE_STYLE = "(?i)karaoke|translat|sign|song|caption|title|credit|note|lyric|romaji|kashi|insert|warning"
KEEP_STYLE = "(?i)karaoke|sign|song|caption|title|credit|note|lyric|romaji|kashi|insert"
DROP_STYLE = "(?i)main|dialog|default|flashback|thought|secondary|monolog|narrat|warning|italics|translat|^alt"
SIGNS_NAME = "(?i)sign|song|karaoke|lyric|caption|title|credit|insert"
SUB_LANGS = ("eng", "en", "und", "")
KEEP_LANGS = ("eng", "en", "dut", "nld", "nl", "und", "")
TRACK_NAME = "Dubtitles"


def _plain() -> Column:
    return F.regexp_replace("plaintext", r"^\s+|\s+$", "")


def is_dialogue() -> Column:
    style = F.coalesce("style", F.lit(""))
    return ~F.col("is_comment") & ~F.col("text").rlike(KARAOKE) & ~F.col("text").rlike(POSITIONED) & ~style.rlike(NOT_DIALOGUE_STYLE) & (_plain() != "")


def dialogue_events(events: DataFrame) -> DataFrame:
    """Plain spoken lines: no comment, karaoke, placed text or sign style; something to read."""
    return events.where(is_dialogue())


def keep_sign_events(events: DataFrame) -> DataFrame:
    """Signs, songs and captions; a dialogue style drops an event whatever its tags."""
    style, t = F.coalesce("style", F.lit("")), F.col("text")
    kept = F.when(F.col("is_comment") | (_plain() == ""), False).when(style.rlike(DROP_STYLE), False)
    kept = kept.when(t.rlike(KARAOKE) | t.rlike(DRAWING) | t.rlike(POSITIONED) | t.rlike(ANIMATED), True).otherwise(style.rlike(KEEP_STYLE))
    return events.where(kept)


def dedup_events(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first of events with equal times, style and text, in order of track and event."""
    w = Window.partitionBy(*keys, "start_ms", "end_ms", "style", _plain()).orderBy("track", "ev_no")
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def union_tracks(events: DataFrame, tracks: DataFrame, langs: Sequence[str] = SUB_LANGS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Events of all tracks (keys, track, language) in an accepted language; null counts as ''."""
    ok = tracks.where(F.lower(F.coalesce("language", F.lit(""))).isin(*langs)).select(*keys, "track")
    return events.join(ok, [*keys, "track"], "left_semi")


def cue_intervals(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, cue_no, start, end, text) of the dialogue events, in order of time, seconds."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "text_")
    out = dialogue_events(events).withColumn("text_", _plain())
    return out.select(*keys, (F.row_number().over(w) - 1).alias("cue_no"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("text_").alias("text"))


def dialogue_density(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, track, cues, share): dialogue events, and their share of all that are no comment."""
    out = events.groupBy(*keys, "track").agg(F.sum(is_dialogue().cast("int")).alias("cues"), F.sum((~F.col("is_comment")).cast("int")).alias("__all"))
    return out.select(*keys, "track", "cues", F.coalesce(F.try_divide("cues", "__all"), F.lit(0.0)).alias("share"))


def select_reference_track(density: DataFrame, min_cues: int = 50, min_share: float = 0.70, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, track, status): the track with the largest share of those that qualify, the lower on
    a tie; null and no-reference without any."""
    fit = F.when((F.col("cues") >= min_cues) & (F.col("share") >= min_share), F.struct("share", (-F.col("track")).alias("t")))
    best = density.groupBy(*keys).agg(F.max(fit).alias("b"))
    return best.select(*keys, (-F.col("b.t")).alias("track"), F.when(F.col("b").isNull(), "no-reference").otherwise("ok").alias("status"))


def merge_track(events: DataFrame, cards: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Kept, distinct sign events and the cards as one track (keys, layer, start_ms, end_ms, style,
    text, ord), signs one layer up; and each episode's status: no-signs without source events,
    empty without cards, else ok. Cards: (keys, card_no, start_ms, end_ms, text)."""
    signs = dedup_events(keep_sign_events(events), keys).select(*keys, (F.col("layer") + 1).alias("layer"), "start_ms", "end_ms", "style", "text", F.lit(0).alias("__side"), F.col("track").alias("__t"), F.col("ev_no").alias("__n"))
    dub = cards.select(*keys, F.lit(0).cast(events.schema["layer"].dataType).alias("layer"), "start_ms", "end_ms", F.lit(TRACK_NAME).alias("style"), "text", F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__t"), F.col("card_no").alias("__n"))
    both = sort_track(signs.unionByName(dub), keys)
    counts = events.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("c")).unionByName(cards.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("c"))).groupBy(*keys).agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
    return both, counts.select(*keys, F.when(F.col("e") == 0, "no-signs").when(F.col("c") == 0, "empty").otherwise("ok").alias("status"))


def sort_track(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ord, the place by start and end; signs before dialogue, then as they came."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "__side", "__t", "__n")
    return events.withColumn("ord", F.row_number().over(w)).drop("__side", "__t", "__n")


def first_style(styles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first track's definition of each style."""
    w = Window.partitionBy(*keys, "style").orderBy("track")
    return styles.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def style_conflicts(styles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Later definitions that differ from the first in font or size."""
    w = Window.partitionBy(*keys, "style").orderBy("track")
    font, size = F.first("fontname").over(w), F.first("fontsize").over(w)
    return styles.withColumns({"__f": font, "__s": size}).where(~F.col("fontname").eqNullSafe(F.col("__f")) | ~F.col("fontsize").eqNullSafe(F.col("__s"))).drop("__f", "__s")


def track_mismatch(tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, wrap_differs, resolutions): tracks whose wrap style differs from the first one's, and
    distinct resolutions. tracks: (keys, track, wrap_style, play_x, play_y)."""
    base = F.first("wrap_style").over(Window.partitionBy(*keys).orderBy("track"))
    out = tracks.withColumn("__d", (~F.col("wrap_style").eqNullSafe(base)).cast("int"))
    return out.groupBy(*keys).agg(F.sum("__d").alias("wrap_differs"), F.size(F.collect_set(F.struct("play_x", "play_y"))).alias("resolutions"))


def dub_style(play_y: Column) -> Column:
    """struct(fontsize, outline, margin) of the dialogue style for a script's height; 0 means 720."""
    y = F.coalesce(F.nullif(play_y, F.lit(0)), F.lit(720))
    size = F.greatest(F.lit(32), F.bround(y / 17).cast("int"))
    return F.struct(size.alias("fontsize"), F.greatest(F.lit(1.5), size / 22).alias("outline"), F.greatest(F.lit(10), F.bround(y / 22).cast("int")).alias("margin"))


# ---- probe tables: (file, track_id, type, codec, language, name, is_default) ------------------------
def _lang() -> Column:
    return F.lower(F.coalesce("language", F.lit("")))


def accepted_sub_streams(probe: DataFrame, langs: Sequence[str] = SUB_LANGS, codecs: Sequence[str] = ("ass", "ssa")) -> DataFrame:
    """Text subtitle tracks in an accepted language."""
    return probe.where((F.col("type") == "subtitles") & F.col("codec").isin(*codecs) & _lang().isin(*langs))


def pick_audio(probe: DataFrame, require_eng: bool = True) -> DataFrame:
    """(file, track_id): the first English audio, else null, or the first one at all."""
    audio = F.when(F.col("type") == "audio", F.col("track_id"))
    eng = F.min(F.when(_lang().isin("eng", "en"), audio))
    return probe.groupBy("file").agg((eng if require_eng else F.coalesce(eng, F.min(audio))).alias("track_id"))


def original_language(probe: DataFrame) -> DataFrame:
    """(file, languages): those of the default audio tracks, else of the first audio track."""
    audio = probe.where("type = 'audio'").withColumns({"__first": F.row_number().over(Window.partitionBy("file").orderBy("track_id")) == 1, "__any": F.max(F.coalesce("is_default", F.lit(False)).cast("int")).over(Window.partitionBy("file"))})
    chosen = audio.where(F.when(F.col("__any") == 1, F.coalesce("is_default", F.lit(False))).otherwise(F.col("__first")))
    return chosen.groupBy("file").agg(F.array_sort(F.collect_set(F.nullif(_lang(), F.lit("")))).alias("languages"))


def keep_subtitle_tracks(probe: DataFrame, langs: Sequence[str] = KEEP_LANGS) -> DataFrame:
    """Subtitle tracks in a wanted language, in several, or named as signs or songs."""
    return probe.where((F.col("type") == "subtitles") & (_lang().isin(*langs, "mul") | F.coalesce("name", F.lit("")).rlike(SIGNS_NAME)))


def has_named_track(probe: DataFrame, name: str = TRACK_NAME) -> DataFrame:
    """(file, has): whether a subtitle track has exactly this name."""
    return probe.groupBy("file").agg(F.coalesce(F.bool_or((F.col("type") == "subtitles") & (F.col("name") == name)), F.lit(False)).alias("has"))


def track_plan(probe: DataFrame, langs: Sequence[str] = KEEP_LANGS) -> DataFrame:
    """Adds action (keep or drop), selected and default_flag. Wanted are ``langs`` and the original
    language; where nothing of a type is wanted, no selection is made and all of it stays."""
    out = probe.join(original_language(probe).withColumnRenamed("languages", "__o"), "file", "left")
    wanted = _lang().isin(*langs) | F.array_contains(F.coalesce("__o", F.array().cast("array<string>")), _lang())
    sub = wanted | (_lang() == "mul") | F.coalesce("name", F.lit("")).rlike(SIGNS_NAME)
    out = out.withColumn("selected", F.when(F.col("type") == "audio", wanted).when(F.col("type") == "subtitles", sub).otherwise(F.lit(True)))
    some = F.max(F.col("selected").cast("int")).over(Window.partitionBy("file", "type"))
    flag = F.when(~F.col("selected"), F.lit(None)).when(F.col("type") == "audio", F.when(_lang().isin("eng", "en"), "yes").otherwise("no")).when(F.col("type") == "subtitles", "no")
    return out.withColumns({"action": F.when(F.col("selected") | (some == 0), "keep").otherwise("drop"), "default_flag": flag}).drop("__o")


def mux_audit(before: DataFrame, after: DataFrame, tol: float = 2.0) -> DataFrame:
    """(file, status, odd_fonts). before: (file, duration, fonts); after: (file, duration, fonts,
    odd_fonts, has_video, has_audio, has_dub)."""
    b = before.select("file", F.col("duration").alias("__d"), F.col("fonts").alias("__f"))
    out = after.join(b, "file")
    status = (F.when(~(F.col("has_video") & F.col("has_audio")), "missing-av").when(~F.col("has_dub"), "no-dubtitles-track")
              .when(F.abs(F.col("duration") - F.col("__d")) > tol, "duration-mismatch").when(F.col("fonts") != F.col("__f"), "font-count-mismatch").otherwise("ok"))
    return out.select("file", status.alias("status"), "odd_fonts")
