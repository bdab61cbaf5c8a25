"""Quality rules: base rules, then robust multivariate outliers for each language and source.

Five statistics of every text vary from text to text in any corpus: mean word length, share of
different words, marks for each word, capitals among the letters and share of short words. They are
taken as logarithms of rates, which are smoothed by some words of the corpus's average, so that the
rates of short texts do not scatter more than those of long ones.

Every group's minimum-covariance-determinant estimate comes from concentration steps: take the h
rows with the smallest Mahalanobis distances, estimate their mean and covariance, and again until no
determinant falls any more. Two starts are followed and the one with the smaller determinant wins.

Languages and all rows together get such estimates too. A group's estimate is drawn towards that of
its language, this towards that of all rows, and this towards the variances of all rows, as if the
parent's were some rows more; so a small group has a sound estimate, a large one its own, and no size
is treated otherwise than another.

A row is an outlier if its distance, scaled so that the median row of its group has the median of a
chi-squared variable, is beyond a high quantile of that variable.

All of it is aggregation: a step counts binned distances to find the h-th and then adds up sums and
products, so no group is ever gathered. A group has as many bins as logarithms of distances span,
a few thousand at most, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cueloom.llm.common import WORD_SPACE, let, materialize, quoted, replace_columns

# Fixed values of the base rules.
WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Share of a group's rows that an estimate covers; rows for which a parent's estimate counts.
COVERED, PRIOR_ROWS = 0.75, 40
#: A concentration step goes on while some logarithm of a determinant falls by more than this.
LEAST_FALL, MOST_STEPS = 0.01, 40
#: Number of statistics; median and the 0.9999999 quantile of a chi-squared variable with as many
#: degrees of freedom.
D, CHI2_MEDIAN, CHI2_CUTOFF = 5, 4.3515, 40.863
#: Least standard deviation, which only keeps a singular covariance from being divided by.
LEAST_DEVIATION = 1e-6
#: Words of the corpus's average that every text's rates get besides its own; letters of a short word.
SMOOTHING_WORDS, SHORT_WORD = 100, 3
COUNTS = ("n_distinct", "n_short", "n_digits", "n_capitals", "n_marks")
#: Groups (250 bytes each) up to which their estimates are broadcast. Beyond, they are joined by shuffle,
#: in so many copies, over which a hot group's rows are dealt.
BROADCAST_GROUPS, SPREAD = 100_000, 32
#: Width of the bins in which medians and distances (as logarithms) are counted.
BIN = 1 / 128


def statistics(text: Column) -> Column:
    """The base rules' counts of a text, and those of the outlier test, as one struct; null has no
    words."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, WORD_SPACE), lambda w: w != "")

    found = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("long")

    def counts(w: Column) -> Column:
        lines = let(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines"),
            F.when(F.size(w) >= WINDOW_WORDS, _repeated_words(w)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.size(F.filter(w, lambda x: F.length(x) <= SHORT_WORD)).cast("long").alias("n_short"),
            found(r"\p{Nd}").alias("n_digits"), found(r"\p{Lu}").alias("n_capitals"), found(r"[^\p{L}\p{Nd}\x20\x09-\x0D]").alias("n_marks"))

    return let(words, counts)


def _repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more, by 64-bit window hashes."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW_WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW_WORDS)]))

    def covered(v: Column) -> Column:
        by_hash = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = lambda s: F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(
            F.get(s, k)["x"].eqNullSafe(F.get(s, k - 1)["x"]) | F.get(s, k)["x"].eqNullSafe(F.get(s, k + 1)["x"]), F.get(s, k)["i"])), lambda p: p.isNotNull())
        total = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW_WORDS)))), F.lit(0), lambda n, x: n + x)
        return let(let(by_hash, again), lambda p: let(F.array_sort(p), total))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(covered(v)))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``statistics`` and base_failed; input columns of these names give way."""
    out = docs.withColumn("__counts", statistics(F.col(quoted(text))))
    failed = (F.col("__counts.n_words") < LEAST_WORDS) | (100 * F.col("__counts.n_repeat_words") > MOST_REPEATED_PERCENT * F.col("__counts.n_words"))
    return replace_columns(out, {**{n: F.col(f"__counts.{n}") for n in (*STATISTICS, *COUNTS)}, "base_failed": failed}).drop("__counts")


def _vector(totals: Row) -> list[Column]:
    """The statistics of a text. ``totals``: the sums of the counts over all texts. Two of them vary
    little and are multiplied, so that bins of one width suit all."""
    sums = {c: totals[c] or 0 for c in ("n_words", "word_chars", *COUNTS)} | {"letters": sum((totals[c] or 0) * k for c, k in (("word_chars", 1), ("n_digits", -1), ("n_marks", -1)))}
    usual = lambda c: max(sums[c] / max(sums["n_words"], 1) * SMOOTHING_WORDS, 1e-3)
    of = lambda c: F.col("word_chars") - F.col("n_digits") - F.col("n_marks") if c == "letters" else F.col(c)
    rate = lambda c, base: F.log((of(c) + usual(c)) / (of(base) + usual(base)))
    variety = F.log(F.greatest(F.col("n_distinct"), F.lit(1))) / F.log(F.greatest(F.col("n_words"), F.lit(2)))
    return [4 * rate("word_chars", "n_words"), 16 * variety, rate("n_marks", "n_words"), rate("n_capitals", "letters"), rate("n_short", "n_words")]


def _attach(rows: DataFrame, groups: DataFrame, on: list[str], few: bool, x: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with what ``groups`` (one row each) says of their group; ``x`` tells rows apart."""
    if few:
        return rows.join(F.broadcast(groups), on, how)
    copies = groups.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("__copy", F.pmod(F.xxhash64(*x), F.lit(SPREAD)).cast("int")).join(copies, [*on, "__copy"], how).drop("__copy")


def _quantile(rows: DataFrame, keys: list[str], value: Column, share: float) -> DataFrame:
    """keys and q: the upper end of the bin in which the share of each group's rows is reached."""
    # Dealt by bin first, so that what reaches a group's window is one row for each bin, not for each
    # bin and task.
    bins = rows.groupBy(*keys, F.floor(value / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n")).repartition(*keys, "bin")
    run, all_ = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    reached = bins.withColumns({"up_to": F.sum("n").over(run), "of": F.sum("n").over(all_)}).where(F.col("up_to") >= share * F.col("of"))
    return reached.groupBy(*keys).agg(((F.min("bin") + 1) * BIN).alias("q"))


def _distance(x: list[Column], center: str, white: str) -> Column:
    """Squared Mahalanobis distance; ``white`` is the inverse of the covariance's Cholesky factor (rows
    of the lower triangle, one after the other)."""
    d = [v - F.get(F.col(center), F.lit(i)) for i, v in enumerate(x)]
    z = [sum((F.get(F.col(white), F.lit(_cov(i, j))) * d[j] for j in range(1, i + 1)), F.get(F.col(white), F.lit(_cov(i, 0))) * d[0]) for i in range(len(x))]
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _cov(i: int, j: int) -> int:
    """Place of an entry in the rows of a lower triangle, one after the other."""
    return max(i, j) * (max(i, j) + 1) // 2 + min(i, j)


def _root(df: DataFrame, cov: str) -> DataFrame:
    """Adds root, the inverse of the Cholesky factor of ``cov``, and spread, the logarithm of its
    determinant. One column at a time and written for a row a group, so the many steps are few rows'."""
    kept = df.columns
    for i in range(D):
        for j in range(i + 1):
            v = F.get(F.col(cov), F.lit(_cov(i, j)))
            for k in range(j):
                v = v - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}")
            df = df.withColumn(f"__l{i}{j}", F.sqrt(F.greatest(v, F.lit(LEAST_DEVIATION**2))) if i == j else v / F.col(f"__l{j}{j}"))
    for i in range(D):
        for j in range(i, -1, -1):
            v = F.lit(1.0) if i == j else -sum((F.col(f"__l{i}{k}") * F.col(f"__w{k}{j}") for k in range(j + 1, i)), F.col(f"__l{i}{j}") * F.col(f"__w{j}{j}"))
            df = df.withColumn(f"__w{i}{j}", v / F.col(f"__l{i}{i}"))
    spread = sum((F.log(f"__l{i}{i}") for i in range(1, D)), F.log("__l00"))
    return df.select(*kept, F.array(*[f"__w{i}{j}" for i in range(D) for j in range(i + 1)]).alias("root"), spread.alias("spread"))


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, center and cov of each group's rows (x0, x1, ...)."""
    d = D
    sums = [F.avg(f"x{i}").alias(f"m{i}") for i in range(d)] + [F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)]
    cov = [F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i in range(d) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"m{i}" for i in range(d)]).alias("center"), F.array(*cov).alias("cov"))


def fit(rows: DataFrame) -> DataFrame:
    """(g, center, root, scale) of every group of ``rows`` (g, its parent p, x0, x1, ...), drawn
    towards its parent's estimate, which is drawn towards that of all rows."""
    x = [f"x{i}" for i in range(D)]
    rows = materialize(rows, "outlier-rows")
    variances = rows.agg(*[F.var_pop(c).alias(c) for c in x]).first()
    own, parent, all_ = F.concat(F.lit("g"), "g"), F.concat(F.lit("p"), "p"), F.lit("all")
    members = materialize(rows.select(F.explode(F.array(own, parent, all_)).alias("level"), *x), "members")
    above_of = materialize(rows.select(own.alias("level"), parent.alias("above")).distinct(), "parents")
    few = above_of.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    sizes = members.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    raw = materialize(_concentrate(members, few).join(sizes, "level"), "estimates")
    plain = [(variances[f"x{i}"] or 0.0) if i == j else 0.0 for i in range(D) for j in range(i + 1)]

    def drawn(df: DataFrame, towards: dict[str, Column]) -> DataFrame:
        share = F.col("n") / (F.col("n") + PRIOR_ROWS)
        return df.withColumns({v: F.zip_with(v, up, lambda a, b: share * a + (1 - share) * b) for v, up in towards.items()})

    def cascade(each: DataFrame, values: list[str], last: dict[str, Column]) -> DataFrame:
        """All rows are drawn towards ``last``, languages towards all rows, whose estimate is one row,
        and groups towards these."""
        top = drawn(each.where("level = 'all'"), last)
        of_all = top.first()
        if of_all is None:
            return each
        parents = drawn(each.where("startswith(level, 'p')"), {v: F.array(*[F.lit(y) for y in of_all[v]]) for v in values})
        up = parents.select(F.col("level").alias("above"), *[F.col(v).alias(f"__{v}") for v in values])
        groups = drawn(each.join(above_of, "level").join(up, "above"), {v: F.col(f"__{v}") for v in values}).drop("above", *[f"__{v}" for v in values])
        return top.unionByName(parents).unionByName(groups)

    placed = cascade(raw, ["center", "cov"], {"cov": F.array(*[F.lit(v) for v in plain])})
    model = materialize(_root(placed, "cov").select("level", "n", "center", "root"), "drawn")
    scored = _attach(members, model.select("level", "center", "root"), ["level"], few, x).select("level", _distance([F.col(c) for c in x], "center", "root").alias("dist"))
    scale = _quantile(scored, ["level"], _log(F.col("dist")), 0.5).select("level", F.array(F.exp("q") / CHI2_MEDIAN).alias("scale"))
    scale = cascade(materialize(scale.join(model.select("level", "n"), "level"), "scales"), ["scale"], {"scale": F.array(F.lit(1.0))})
    out = model.where("startswith(level, 'g')").join(scale.select("level", "scale"), "level")
    return materialize(out.select(F.substr("level", F.lit(2)).alias("g"), "center", "root", F.col("scale")[0].alias("scale")), "mcd")


def _log(distance: Column) -> Column:
    return F.log(distance + 1e-9)


def _concentrate(rows: DataFrame, few: bool) -> DataFrame:
    """(level, center, cov) of every level of ``rows`` (level, x0, x1, ...) by concentration steps."""
    d, keys = D, ["level", "start"]
    names = [f"x{i}" for i in range(d)]
    x = [F.col(n) for n in names]
    long = rows.select("level", F.posexplode(F.array(*x)).alias("k", "v"))
    middle = _quantile(long, ["level", "k"], F.col("v"), 0.5).withColumnRenamed("q", "middle")
    far = _quantile(_attach(long, middle, ["level", "k"], few, ["v"]), ["level", "k"], F.abs(F.col("v") - F.col("middle")), 0.5)
    first = middle.join(far, ["level", "k"]).groupBy("level").agg(F.sort_array(F.collect_list(F.struct("k", "middle", "q"))).alias("start"))
    at = _attach(rows, materialize(first, "medians"), ["level"], few, names)
    z = [(x[i] - F.col("start")[i]["middle"]) / F.greatest(1.4826 * F.col("start")[i]["q"], F.lit(LEAST_DEVIATION)) for i in range(d)]
    starts = F.array(sum((v * v for v in z[1:]), z[0] * z[0]), F.greatest(*[F.abs(v) for v in z]))
    scored = at.select("level", *x, F.posexplode(starts).alias("start", "dist"))
    best = None
    for step in range(MOST_STEPS):
        near = _quantile(scored, keys, _log(F.col("dist")), COVERED)
        inside = _attach(scored, near, keys, few, names).where(_log(F.col("dist")) <= F.col("q"))
        now = _root(_estimate(inside, keys), "cov")
        if best is None:
            best = materialize(now.withColumn("falls", F.lit(True)), f"mcd-{step}")
        else:  # bins are coarse, so a step may also rise a little; then the last estimate stays
            both = now.join(best.select(*keys, F.struct("center", "cov", "root", "spread").alias("last")), keys)
            falls = F.col("spread") < F.col("last.spread") - LEAST_FALL
            best = materialize(both.select(*keys, *[F.when(falls, F.col(c)).otherwise(F.col(f"last.{c}")).alias(c) for c in ("center", "cov", "root", "spread")], falls.alias("falls")), f"mcd-{step}")
        if not best.where("falls").take(1):
            break
        scored = _attach(rows, best.select(*keys, "center", "root"), ["level"], few, names).select("level", *x, "start", _distance(x, "center", "root").alias("dist"))
    return best.groupBy("level").agg(F.min_by(F.struct("center", "cov"), F.struct("spread", "start")).alias("b")).select("level", "b.center", "b.cov")


def judge(stated: DataFrame, lang: str = "lang", source: str = "source", cutoff: float = CHI2_CUTOFF) -> DataFrame:
    """``stated`` (from base_statistics) with kept; an input column kept gives way.

    Rows that fail the base rules are not kept and not part of any estimate. The others are kept
    unless they are outliers of their (lang, source) group; null is a language or source like any
    other. However few rows a group has, it has an estimate (see ``fit``). Repeated rows count as
    often as they stand. An empty table stays empty.
    """
    names = [f"__x{i}" for i in range(D)]
    group = F.to_json(F.struct(F.col(quoted(lang)).alias("lang"), F.col(quoted(source)).alias("source")))
    parent = F.to_json(F.struct(F.col(quoted(lang)).alias("lang")))
    counted = materialize(stated.withColumns({"__g": group, "__p": parent}), "statistics")
    sums = ("n_words", "word_chars", *COUNTS)
    totals = counted.where("not base_failed").agg(*[F.sum(c).alias(c) for c in sums]).first()
    table = counted.withColumns(dict(zip(names, _vector(totals), strict=True)))
    model = fit(table.where("not base_failed").select(F.col("__g").alias("g"), F.col("__p").alias("p"), *[F.col(n).alias(n[2:]) for n in names]))
    known = model.select(F.col("g").alias("__g"), F.col("center").alias("__center"), F.col("root").alias("__root"), F.col("scale").alias("__scale"))
    out = _attach(table, known, ["__g"], known.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS, names, "left")
    odd = _distance([F.col(n) for n in names], "__center", "__root") > cutoff * F.col("__scale")
    kept = ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))
    return replace_columns(out, {"kept": kept}).drop("__g", "__p", "__center", "__root", "__scale", *names)
