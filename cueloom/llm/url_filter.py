"""URL filters: host and path rules looked up by hashed expressions.

Every url is expanded into its host suffixes times its path prefixes. The rules are listed by a short
prefix of their SHA-256 digest. Each expression meets such a list through an equality join on its own
digest's prefix alone; the full digest then confirms the match within the list, and the longest rule
wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import lower_ascii, materialize, quoted, replace_columns

#: Rules up to this number are broadcast (below 100 bytes each); more are joined by shuffle.
BROADCAST_RULES = 200_000
#: Copies of each rule in the shuffled join, over which a hot expression such as com/ is spread.
RULE_COPIES = 16
#: Hex digits of the digest that the join compares: 32 bits.
PREFIX_DIGITS = 8

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short literal rule list as a table (host, path, verdict)."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
                broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Judge every row's url by ``rules`` (host, path, verdict 'allow' or 'block').

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest
    host + path wins, then the longer host, then block over allow. Adds host, path, rule (host +
    path, null without a match) and verdict (``default`` without a match); input columns of these
    names give way. A null url, or one without ``://``, has an empty host and path; only a rule
    for an empty host could fit it. Rules with a null part are void, repeated rules count once,
    repeated urls are judged once and each row keeps its own copy. An empty rule table gives
    every row the default.
    """
    known = (rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
             .select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict"))
             .groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict")))
    known = materialize(known.withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))
                        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)), "url-rules")
    # At most one row: the host label counts and path lengths that any rule has. Both are bounded
    # by the longest name and path, not by the number of rules.
    shape = known.agg(F.collect_set(_labels(F.col("r_host"))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"), F.count(F.lit(1)).alias("n")).first()

    urls = pages.select(F.col(quoted(url)).alias("__u")).distinct().select("__u", host_of(F.col("__u")).alias("__h"), path_of(F.col("__u")).alias("__p"))
    # substring_index counts from the right if the count is negative
    suffix = F.transform(F.array(*[F.lit(-n) for n in shape["labels"]]) if shape["labels"] else F.array().cast("array<int>"),
                         lambda n: F.when(_labels(F.col("__h")) >= -n, F.call_function("substring_index", F.col("__h"), F.lit("."), n)))
    prefix = F.transform(F.array(*[F.lit(n) for n in shape["lengths"]]) if shape["lengths"] else F.array().cast("array<int>"),
                         lambda n: F.when(F.length("__p") >= n, F.substring(F.col("__p"), F.lit(1), n)))
    expressions = (urls.withColumn("__s", F.explode(F.filter(suffix, lambda x: x.isNotNull())))
                   .withColumn("__q", F.explode(F.filter(prefix, lambda x: x.isNotNull())))
                   .select("__u", _digest(F.col("__s"), F.col("__q")).alias("__d"))
                   .withColumn("__d_short", F.substring("__d", 1, PREFIX_DIGITS)))
    # Rules that share a short prefix are few: of n rules, n / 2 ** 32 on average besides the first.
    listed = known.groupBy("short").agg(F.collect_list(F.struct("digest", "r_host", "r_path", "r_verdict")).alias("rules"))
    if shape["n"] <= broadcast_rules:
        near = expressions.join(F.broadcast(listed), F.col("__d_short") == F.col("short"))
    else:
        spread = listed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(RULE_COPIES - 1))))
        near = (expressions.withColumn("__u_copy", F.pmod(F.xxhash64("__u"), F.lit(RULE_COPIES)).cast("int"))
                .join(spread, (F.col("__d_short") == F.col("short")) & (F.col("__u_copy") == F.col("copy"))))
    confirmed = F.filter("rules", lambda r: r["digest"] == F.col("__d"))
    met = near.select("__u", F.inline(confirmed))
    best = met.groupBy("__u").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), F.col("r_verdict").alias("verdict"),
        F.concat("r_host", "r_path").alias("rule"))).alias("__best"))
    out = pages.join(best, F.col(quoted(url)).eqNullSafe(F.col("__u")), "left")
    link = F.col(quoted(url))
    return replace_columns(out.drop("__u"), {"host": host_of(link), "path": path_of(link), "rule": F.col("__best.rule"),
                                          "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default))}).drop("__best")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    """Of host and path with a separator that neither can move: the host's length."""
    return F.sha2(F.concat_ws(" ", F.length(host).cast("string"), host, path), 256)
