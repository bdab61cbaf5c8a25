"""Column functions over titles, paths, captions and replies. Each takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLOCKLIST = [
    r"amara\.org", "thank you for watching", "thanks for watching", "thanks for your support", "please subscribe",
    "subscribe to (the|our|my) channel", "like and subscribe", "see you (in the )?next (video|time)", "subtitles by",
    "captions? by", "transcri(bed|ption) by", "translated by", "copyright", r"www\.", "http",
]
EXTRA_DIRS = ["behind the scenes", "deleted scenes", "featurettes", "interviews", "scenes", "shorts", "trailers", "other", "extras"]
VIDEO_EXTS = (".mkv", ".mp4", ".m4v")
NAMED_PROMPT = ("This is ", ", a Japanese anime (English dub). Transcribe the spoken English accurately, with natural punctuation.")
NEUTRAL_PROMPT = "Japanese anime, English dub. Transcribe the spoken English accurately, with natural punctuation."
ALLPAGES_QUERY = "?action=query&list=allpages&apnamespace=0&aplimit=500&apfilterredir=nonredirects&format=json"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fmt_srt_ts(seconds: Column) -> Column:
    """Seconds -> HH:MM:SS,mmm; the seconds part is rounded by itself (59.9996 gives 60,000)."""
    minutes = F.floor(seconds / 60).cast("long")
    return F.translate(F.format_string("%02d:%02d:%06.3f", F.floor(minutes / 60).cast("long"), minutes % 60, (seconds - minutes * 60).cast("double")), ".", ",")


def fmt_srt_ms(ms: Column) -> Column:
    """Whole milliseconds -> HH:MM:SS,mmm."""
    part = lambda unit, of: F.floor(ms / unit) % of
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


def rebase_path(path: Column, src: str, dst: str) -> Column:
    """Swap the leading ``src`` for ``dst``; an empty ``dst`` leaves the path."""
    if not dst:
        return path
    return F.when(F.startswith(path, F.lit(src)), F.concat(F.lit(dst), F.substring(path, F.lit(len(src) + 1), F.length(path)))).otherwise(path)


def season_episode(path: Column) -> Column:
    """struct(season, episode) of the tag in the file name; (1000000, 0) without one."""
    name = F.substring_index(path, "/", -1)
    number = lambda i, none: F.coalesce(F.regexp_extract(name, r"[Ss](\d+)[Ee](\d+)", i).try_cast("int"), F.lit(none))
    return F.struct(number(1, 1_000_000).alias("season"), number(2, 0).alias("episode"))


def clean_title(title: Column) -> Column:
    """Without (YYYY) and {...}."""
    return F.trim(F.regexp_replace(title, r"\s*\(\d{4}\)|\s*\{[^}]*\}", ""))


def wiki_api_candidates(title: Column) -> Column:
    """API addresses by slug, hyphenated title and first word; distinct, in this order."""
    t = F.lower(clean_title(title))
    slug = F.regexp_replace(t, "[^a-z0-9]", "")
    hyphenated = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    first = F.coalesce(F.nullif(F.regexp_extract(t, r"(\S+)", 1), F.lit("")), slug)
    names = F.array_distinct(F.filter(F.array(slug, hyphenated, first), lambda s: s != ""))
    return F.transform(names, lambda s: F.concat(F.lit("https://"), s, F.lit(".fandom.com/api.php")))


def normalize_api(url: Column) -> Column:
    """<scheme>://<host>/api.php."""
    base = F.regexp_extract(url, "^(https?://[^/]+)", 1)
    return F.concat(F.regexp_replace(F.when(base != "", base).otherwise(url), "/+$", ""), F.lit("/api.php"))


def allpages_url(api: Column, cont: Column) -> Column:
    """The page-list address, with the percent-encoded continuation if there is one."""
    encoded = F.replace(F.replace(F.replace(F.url_encode(cont), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
    return F.concat(api, F.lit(ALLPAGES_QUERY), F.when(F.coalesce(cont, F.lit("")) != "", F.concat(F.lit("&apcontinue="), encoded)).otherwise(F.lit("")))


def show_key(root: Column) -> Column:
    """The last part of a root directory, or of the parent if the root is a video file."""
    parts = F.filter(F.split(root, "/"), lambda p: p != "")
    is_file = F.lower(root).rlike(r"\.(mkv|mp4|m4v)$")
    return F.coalesce(F.get(parts, F.size(parts) - F.when(is_file, 2).otherwise(1)), F.lit(""))


def norm_text(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def token_parts(token: Column) -> Column:
    """struct(pre, core, post); core is empty where the token has none."""
    pattern = r"(?U)^([^\w']*)([\w'][\w'-]*?)([^\w']*)$"
    return F.struct(*[F.regexp_extract(token, pattern, i).alias(n) for i, n in ((1, "pre"), (2, "core"), (3, "post"))])


LEAST_FUZZY_CUTOFF = 0.84


def fuzzy_cutoff(n: Column) -> Column:
    """Least similarity for a token of n characters."""
    return F.when(n <= 5, 0.95).when(n <= 7, 0.90).otherwise(LEAST_FUZZY_CUTOFF)


def one_indel(a: Column, b: Column) -> Column:
    """Whether the strings differ by exactly one inserted or deleted character."""
    return (F.abs(F.length(a) - F.length(b)) == 1) & (F.levenshtein(a, b) == 1)


def wrap_balance(text: Column, width: int = 42) -> Column:
    """One or two lines: the most even cut with both lines within ``width``, else the one with the
    shortest longer line; the first of equals."""
    def cut(words: Column, total: Column) -> Column:
        # One pass over the words with the left line's length so far; the right line is the rest.
        start = F.struct(F.lit(-1).alias("left"), F.lit(0).alias("i"), F.lit(2).alias("over"), F.lit(0).alias("score"), F.lit(0).alias("at"))

        def step(acc: Column, w: Column) -> Column:
            left, i = acc["left"] + 1 + F.length(w), acc["i"] + 1
            right = total - left - 1
            over = (F.greatest(left, right) > width).cast("int")
            score = F.when(over == 0, F.abs(left - right)).otherwise(F.greatest(left, right))
            better = (i < F.size(words)) & ((over < acc["over"]) | (over == acc["over"]) & (score < acc["score"]))
            pick = lambda new, name: F.when(better, new).otherwise(acc[name]).alias(name)
            return F.struct(left.alias("left"), i.alias("i"), pick(over, "over"), pick(score, "score"), pick(i, "at"))

        best = F.aggregate(words, start, step, lambda acc: acc["at"])
        return let(best, lambda i: F.concat(F.array_join(F.slice(words, F.lit(1), i), " "), F.lit("\n"), F.array_join(F.slice(words, i + 1, F.size(words)), " ")))

    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return F.when(F.length(t) <= width, t).otherwise(let(words, lambda w: F.when(F.size(w) < 2, t).otherwise(let(F.length(F.array_join(w, " ")), lambda n: cut(w, n)))))


def parse_adjudication(reply: Column) -> Column:
    """struct(canonical, confidence, dub_note) of the JSON between the first { and the last }."""
    kind = "canonical string, confidence string, dub_note string"
    d = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), kind)
    level = F.lower(F.coalesce(d["confidence"], F.lit("none")))
    return F.struct(F.coalesce(d["canonical"], F.lit("")).alias("canonical"), F.when(d.isNull(), "none").when(level.isin("high", "low", "none"), level).otherwise("low").alias("confidence"),
                    F.coalesce(d["dub_note"], F.lit("")).alias("dub_note"))


def first_line_clean(reply: Column) -> Column:
    """The reply's first line without surrounding space and quotes."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    line = F.element_at(F.split(strip(F.coalesce(reply, F.lit(""))), r"\r\n|\r|\n"), 1)
    return strip(F.regexp_replace(strip(line), '^"+|"+$', ""))


def silence_seconds(log: Column) -> Column:
    """Sum of every silence_duration in a log text."""
    found = F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(r"silence_duration:\s*([0-9.]+)"), F.lit(1))
    return F.aggregate(F.transform(found, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def frames_of(pcm: Column, rate: int = 16_000, ms: int = 30, width: int = 2) -> Column:
    """The whole frames of a PCM binary, as an array; a partial tail is dropped."""
    size = rate * ms // 1000 * width
    n = F.floor(F.octet_length(pcm) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(pcm, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def band_nsp(nsp: Column, flag=0.5, drop=0.95) -> Column:
    return F.when(nsp <= flag, "clean_le_0.5").when(nsp <= drop, "flag_gt_0.5_le_0.95").otherwise("drop_gt_0.95")


def band_lp(lp: Column, flag=-0.6, drop=-2.0) -> Column:
    return F.when(lp >= flag, "clean_ge_-0.6").when(lp >= drop, "flag_lt_-0.6_ge_-2.0").otherwise("drop_lt_-2.0")


def overlap_slack(a0: Column, a1: Column, b0: Column, b1: Column, tol) -> Column:
    """Whether [a0, a1] and [b0 - tol, b1 + tol] share more than a point."""
    return F.least(a1, b1 + tol) - F.greatest(a0, b0 - tol) > 0


def glossary_term_list(terms: Column, cap: int = 1000) -> Column:
    """Distinct terms, in order, joined by ", " up to the first that would pass ``cap``."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(acc: Column, t: Column) -> Column:
        more = F.when(acc["text"] == "", t).otherwise(F.concat(acc["text"], F.lit(", "), t))
        full = acc["full"] | (F.length(more) > cap)
        return F.struct(F.when(full, acc["text"]).otherwise(more).alias("text"), full.alias("full"))

    return F.aggregate(F.array_distinct(F.coalesce(terms, F.array().cast("array<string>"))), start, add, lambda acc: acc["text"])


def initial_prompt(curated: Column, show: Column) -> Column:
    """The curated prompt, or else a neutral one that names the show if it is known."""
    named = F.concat(F.lit(NAMED_PROMPT[0]), F.nullif(show, F.lit("")), F.lit(NAMED_PROMPT[1]))
    return F.coalesce(F.nullif(curated, F.lit("")), named, F.lit(NEUTRAL_PROMPT))


def build_repair_prompt(line: Column, ref: Column, terms: Column, before: Column, after: Column) -> Column:
    """A strict prompt for one line; absent parts are left out, the reference is quoted as data."""
    part = lambda head, c, tail="\n": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c, F.lit(tail))).otherwise(F.lit(""))
    return F.concat(
        F.lit("Correct recognition errors in one caption line. Change only garbled words and misspelt names; else return it unchanged.\n"),
        part("Names: ", terms, ".\n"), F.lit("Line: "), line, F.lit("\n"), part("Previous line: ", before), part("Next line: ", after),
        part("<reference>", ref, "</reference>\n"), F.lit("Corrected line:"))


def build_verify_prompt(term: Column, candidates: Column, show: Column) -> Column:
    """Asks which candidate title a term stands for, as JSON."""
    return F.concat(F.lit("Show: "), F.coalesce(show, F.lit("")), F.lit("\nTerm: "), term, F.lit("\nCandidates: "), F.array_join(candidates, "; "),
                    F.lit('\nAnswer with {"canonical": ..., "confidence": "high|low|none", "dub_note": ...}.'))


def is_repetition(text: Column, min_tokens: int = 6, percent: int = 60) -> Column:
    """Whether one word, or a two- or three-word run that occurs three times, covers the share."""
    def dominated(t: Column) -> Column:
        n = F.size(t)

        def top(k: int) -> Column:
            grams = t if k == 1 else F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(k)), " "))
            # Equal ones stand together in the sorted array: one pass counts the runs.
            start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

            def step(acc: Column, g: Column) -> Column:
                run = F.when(g == acc["last"], acc["run"] + 1).otherwise(F.lit(1))
                return F.struct(g.alias("last"), run.alias("run"), F.greatest(acc["top"], run).alias("top"))

            return F.aggregate(F.sort_array(grams), start, step, lambda acc: acc["top"])

        loop = lambda k: let(top(k), lambda c: (c >= 3) & (c * k * 100 >= n * percent))
        # A run occurs no more often than its first word, so most texts are decided by their words.
        return let(top(1), lambda c: F.when(c * 300 < n * percent, F.lit(False)).otherwise((c * 100 >= n * percent) | loop(3) | loop(2)))

    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0)), lambda t: F.when(F.size(t) < min_tokens, F.lit(False)).otherwise(dominated(t)))


def drop_reason(text: Column, nsp: Column, lp: Column, blocklist: list[str] | None = None, nsp_drop=0.95, lp_drop=-2.0) -> Column:
    """blocklist, repetition, music, or null; missing scores count as 0."""
    blocked = text.rlike("(?i)" + "|".join(blocklist or BLOCKLIST))
    music = (F.coalesce(nsp, F.lit(0)) > nsp_drop) & (F.coalesce(lp, F.lit(0)) < lp_drop)
    return F.when(blocked, "blocklist").when(is_repetition(text), "repetition").when(music, "music")


def flag_reason(nsp: Column, lp: Column, nsp_flag=0.5, lp_flag=-0.6) -> Column:
    """low_conf, maybe_silence, or null."""
    return F.when(F.coalesce(lp, F.lit(0)) < lp_flag, "low_conf").when(F.coalesce(nsp, F.lit(0)) > nsp_flag, "maybe_silence")


def needs_second_pass(line: Column, output: Column, names: Column) -> Column:
    """Whether an output changed the length much or holds a name that the line had not."""
    a, b = F.length(output), F.greatest(F.length(line), F.lit(1))
    has = lambda where, name: F.regexp_like(where, F.concat(F.lit(r"(?iU)\b\Q"), name, F.lit(r"\E\b")))
    return (a * 10 < b * 6) | (a * 10 > b * 15) | F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: has(output, n) & ~has(line, n))
