"""Secret scans: named patterns plus character Markov models.

Two first-order Markov chains over the token alphabet, one of random strings and one of ordinary
identifiers, are counted from labelled samples. A long token whose log-likelihood ratio is in
favour of the random chain is reported besides what the patterns find. All work on texts is done
by DataFrame functions.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import let, quoted, replace_columns

# The base patterns and the least lengths of what they keep.
_KEY = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_BETWEEN = r"[\"']?\x20*[:=]\x20*[\"']?"
_VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = f"{_KEY}{_BETWEEN}{_VALUE}+"
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: What a token is made of.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_TOKEN = "[A-Za-z0-9+/_=-]"
#: Characters of the shortest token that the models judge, and of the shortest they learn from.
TOKEN_LEAST, SAMPLE_LEAST = 20, 8
#: Log-likelihood ratio, in nats, from which a token is reported.
THRESHOLD = 8.0
#: Added to every count.
SMOOTHING = 0.5
_BLOCK = 256

_OPEN, _CLOSE = "\u0001", "\u0002"


def _marked(text: Column, pattern: str) -> Column:
    """``text`` with marks around each match; marks in the text are other control signs first."""
    return F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "\u0003\u0003"), pattern, f"{_OPEN}$0{_CLOSE}")


def _spans(marked: Column) -> Column:
    """(start, end, token) of each marked match, in code points of the unmarked text.

    Sums of the pieces' lengths go by blocks, so a text with very many matches costs no square.
    """
    def of(pieces: Column, sizes: Column, blocks: Column) -> Column:
        def start(i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            return (F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), lambda n, x: n + x)
                    + F.aggregate(F.slice(sizes, b * _BLOCK + 1, i - b * _BLOCK), F.lit(0), lambda n, x: n + x))

        matches = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
        return F.transform(matches, lambda i: let(start(i), lambda s: F.struct(s.alias("start"), (s + F.get(sizes, i)).alias("end"), F.get(pieces, i).alias("token"))))

    def blocks_of(sizes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(sizes, b * _BLOCK + 1, _BLOCK), F.lit(0), lambda n, x: n + x))

    def bound(pieces: Column) -> Column:
        return let(F.transform(pieces, lambda x: F.length(x)), lambda sizes: let(blocks_of(sizes), lambda blocks: of(pieces, sizes, blocks)))

    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    return let(marked, lambda m: F.when(F.contains(m, F.lit(_OPEN)), let(F.split(m, f"[{_OPEN}{_CLOSE}]"), bound)).otherwise(none))


def find_base(text: Column) -> dict[str, Column]:
    """Spans of each base kind. Matches of assign whose value is too short are found, so that the
    search goes on behind them, and then unmarked."""
    short = f"{_OPEN}({_KEY}{_BETWEEN}{_VALUE}{{1,{ASSIGN_LEAST - 1}}}){_CLOSE}"
    return {"assign": _spans(F.regexp_replace(_marked(text, ASSIGN), short, "$1")), "access": _spans(_marked(text, ACCESS)), "hex": _spans(_marked(text, HEX))}


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus __found: the spans of each base kind and of long tokens. The costly search of the
    texts; written once, it serves ``samples_from`` and ``scan``."""
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    spans = {**find_base(body), "token": _spans(_marked(body, f"{_TOKEN}{{{TOKEN_LEAST},}}"))}
    return docs.withColumn("__found", F.struct(*[c.alias(n) for n, c in spans.items()]))


def _searched(docs: DataFrame, text: str) -> DataFrame:
    return docs if "__found" in docs.columns else with_spans(docs, text)


def samples_from(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, random, n): labelled samples, each distinct token once with its count. ``docs`` may
    have spans already.

    Random are the values of the base patterns' matches; ordinary are all other tokens of at
    least SAMPLE_LEAST characters from texts in which no base pattern matches.
    """
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    found = _searched(docs, text).select(body.alias("body"), "__found.*")
    value = lambda s: F.regexp_replace(s["token"], f"^{_KEY}{_BETWEEN}", "")
    secret = F.concat(F.transform("assign", value), F.transform("access", lambda s: s["token"]), F.transform("hex", lambda s: s["token"]))
    both = found.select(F.when(F.size(secret) > 0, secret).otherwise(F.regexp_extract_all("body", F.lit(f"{_TOKEN}{{{SAMPLE_LEAST},}}"), F.lit(0))).alias("tokens"), (F.size(secret) > 0).alias("random"))
    return both.select(F.explode("tokens").alias("token"), "random").groupBy("token", "random").agg(F.count(F.lit(1)).alias("n"))


def train(samples: DataFrame) -> list[float]:
    """Log ratio, random over ordinary, of each pair of characters, row by row.

    ``samples``: (token, random, n); null tokens are void, null counts are 1. The driver gets at
    most 2 x 67 x 67 counts. Without samples of both kinds all ratios are 0.
    """
    rows = samples.where("token is not null and random is not null").select("random", F.coalesce("n", F.lit(1)).alias("n"), F.split("token", "").alias("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.element_at("c", i), F.element_at("c", i + 1)))
    counts = rows.where(F.size("c") > 1).select("random", "n", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()
    by: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for r in counts:
        if all(c in ALPHABET for c in r["pair"]):
            by[r["random"]][r["pair"]] = r["n"]
    if not by[True] or not by[False]:
        return [0.0] * len(ALPHABET) ** 2
    total = {k: {a: sum(by[k].get(a + b, 0) for b in ALPHABET) + SMOOTHING * len(ALPHABET) for a in ALPHABET} for k in by}
    share = lambda k, a, b: (by[k].get(a + b, 0) + SMOOTHING) / total[k][a]
    return [log(share(True, a, b) / share(False, a, b)) for a in ALPHABET for b in ALPHABET]


def log_ratio(token: Column, model: list[float]) -> Column:
    """The token's log-likelihood ratio; characters outside the alphabet count nothing."""
    table = F.array(*[F.lit(x) for x in model])
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.sequence(F.lit(1), F.size(places) - 1)
    n = len(ALPHABET)

    def add(total: Column, i: Column) -> Column:
        a, b = F.element_at(places, i), F.element_at(places, i + 1)
        return total + F.when((a > 0) & (b > 0), F.element_at(table, (a - 1) * n + b)).otherwise(F.lit(0.0))

    return F.when(F.size(places) > 1, F.aggregate(pairs, F.lit(0.0), add)).otherwise(F.lit(0.0))


def scan(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs``, which may have spans of ``with_spans`` already, plus spans: an array of (start, end, kind, token), code points, end
    exclusive, by start and then kind as listed in KINDS; an input column ``spans`` gives way.

    Kind markov are tokens of at least TOKEN_LEAST characters whose log ratio is above
    ``threshold`` and which overlap no base span. A null text has no spans.
    """
    staged = _searched(docs, text)
    base = F.concat("__found.assign", "__found.access", "__found.hex")
    free = F.filter("__found.token", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    staged = staged.withColumn("__markov", F.filter(free, lambda t: log_ratio(t["token"], model) > threshold))
    of = lambda k: F.col("__markov" if KINDS[k] == "markov" else f"__found.{KINDS[k]}")

    def ranked_by(k: int) -> Column:
        return F.transform(of(k), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"), s["token"].alias("token")))

    all_ = F.concat(*[ranked_by(k) for k in range(len(KINDS))])
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(all_), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["rank"] + 1).alias("kind"), s["token"].alias("token")))
    return replace_columns(staged, {"spans": spans}).drop("__found", "__markov")


def joined(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of each span, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"] != KINDS[-1]) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
