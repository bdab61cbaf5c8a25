"""Name correction and glossary mining as dictionary joins.

Glossaries are long tables: terms (show, kind, ord, term) and fixes (show, kind, key, value), kind
being name or phrase, token or phrase. Similarities are worked out on distinct tokens only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.functions.phrases import Phrases
from cueloom.functions.similarity import metaphone, title_case
from cueloom.operators.nearest import nearest_names
from cueloom.operators.ranks import rank_within
from cueloom.sources.scratch import materialize

#: Rows of a glossary or word list up to which it is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
#: Tasks over which a show's texts are dealt where its phrases are too many to be broadcast.
SPREAD = 64


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def phrase_fixes(df: DataFrame, fixes: DataFrame, text: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Replace phrases, the longest key first, each in what the ones before it left; adds n, the
    number of replacements. Null texts are empty ones.

    Each task searches its texts for all phrases of a show at once. Up to ``limit`` phrases are sent to
    every task. More reach the tasks by the shuffle that deals the texts out: a show's texts go to
    SPREAD tasks, each of which gets the show's phrases ahead of the texts and holds only these.
    """
    pairs = fixes.where("kind = 'phrase' and key is not null and value is not null").select("show", "key", "value").distinct()
    rest = [c for c in df.columns if c not in (text, "n")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    shape = ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], f"`{text}` string", "n int"])
    order = [c for c in df.columns if c != "n"]
    if pairs.limit(limit + 1).count() <= limit:
        found: dict[str | None, list[tuple[str, str]]] = {}
        for r in pairs.toLocalIterator():
            found.setdefault(r["show"], []).append((r["key"], r["value"]))
        sent = df.sparkSession.sparkContext.broadcast(found)

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built: dict[str | None, Phrases] = {}
            for batch in batches:
                shows = batch.column("show").to_pylist()
                for show in set(shows) - set(built):
                    built[show] = Phrases(sent.value.get(show, ()) if show is not None else ())
                yield _rewritten(batch, rest, text, [built[s].replace(t) for s, t in zip(shows, batch.column(text).to_pylist(), strict=True)])

        return df.select(*rest, text).mapInArrow(rewrite, shape).select(*order, "n")
    row = F.struct(*rest, text)
    dealt = df.select("show", F.pmod(F.xxhash64(*[c for c in df.columns if c != "n"]), F.lit(SPREAD)).alias("copy"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), row.alias("row"))
    copies = pairs.select("show", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("copy"), F.lit(0).alias("rank"), "key", "value", F.lit(None).cast(dealt.schema["row"].dataType).alias("row"))
    both = dealt.unionByName(copies).repartition("show", "copy").sortWithinPartitions("show", "copy", "rank")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pairs_of, phrases = None, [], None
        for batch in batches:
            kept, new = [], []
            texts = pa.compute.struct_field(batch.column("row"), text).to_pylist()
            for k, (show, copy, rank, key, value) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("show", "copy", "rank", "key", "value")], strict=True)):
                if (show, copy) != at:
                    at, pairs_of, phrases = (show, copy), [], None
                if rank == 0:
                    pairs_of.append((key, value))
                    continue
                phrases = phrases or Phrases(pairs_of if show is not None else ())
                kept.append(k)
                new.append(phrases.replace(texts[k]))
            rows = batch.column("row").take(pa.array(kept, pa.int64()))
            yield _rewritten(pa.RecordBatch.from_arrays(rows.flatten(), names=[*rest, text]), rest, text, new)

    return both.mapInArrow(streamed, shape).select(*order, "n")


def _rewritten(batch: pa.RecordBatch, rest: Sequence[str], text: str, new: Sequence[tuple[str, int]]) -> pa.RecordBatch:
    columns = [*[batch.column(c) for c in rest], pa.array([t for t, _ in new], pa.string()), pa.array([n for _, n in new], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[*rest, text, "n"])


def distinct_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """(show, core, low) of the tokens of all texts, each once."""
    core = T.token_parts(F.col("__tok"))["core"]
    tokens = df.select("show", F.explode(F.split(F.trim(F.col(text)), r"\s+")).alias("__tok")).select("show", core.alias("core")).where("core <> ''")
    return tokens.distinct().withColumn("low", F.lower("core"))


def token_fixes(tokens: DataFrame, fixes: DataFrame) -> DataFrame:
    """Tokens (show, core, low) with fixed, the listed replacement, where there is one."""
    f = fixes.where("kind = 'token'").select("show", F.col("key").alias("low"), F.col("value").alias("fixed"))
    return tokens.join(small(f), ["show", "low"])


def english_gate(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens that are no listed word."""
    return tokens.join(small(words.select(F.lower("word").alias("low")).distinct()), "low", "left_anti")


def fuzzy_names(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(show, core, low, name, score): the closest name above the length's cutoff, the larger name
    on a tie. A winner equal to the token, or one inserted or deleted letter away, is refused and
    not replaced."""
    t = tokens.where((F.length("core") >= 4) & ~F.contains("core", F.lit("'"))).withColumn("text", title_case("core"))
    cutoff = T.fuzzy_cutoff(F.length("core"))
    best = nearest_names(t.groupBy("show", "text").agg(F.min(cutoff).alias("cutoff")), names.select("show", "name").distinct(), 1)
    best = best.groupBy("show", "text").agg(F.max(F.struct("score", "name")).alias("b")).select("show", "text", "b.name", "b.score")
    found = t.join(best, ["show", "text"]).where(F.col("score") >= cutoff).select("show", "core", "low", "name", "score")
    return found.where((F.lower("name") != F.col("low")) & ~T.one_indel(F.col("low"), F.lower("name")))


def phonetic_names(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(show, core, low, name): the first name of the glossary that sounds like the token, unless
    it is equal or one letter away."""
    t = tokens.where((F.length("core") >= 4) & ~F.contains("core", F.lit("'"))).withColumn("__code", metaphone("low")).where("__code <> ''")
    n = names.withColumn("__code", metaphone("name"))
    first = t.join(small(n), ["show", "__code"]).groupBy("show", "core", "low").agg(F.min_by("name", "ord").alias("name"))
    return first.where((F.lower("name") != F.col("low")) & ~T.one_indel(F.col("low"), F.lower("name")))


def correction_table(tokens: DataFrame, terms: DataFrame, fixes: DataFrame, words: DataFrame) -> DataFrame:
    """(show, core, fixed): what each distinct token becomes; tokens that stay are left out."""
    names = terms.where("kind = 'name'").select("show", "ord", F.col("term").alias("name"))
    listed = token_fixes(tokens, fixes).select("show", "core", "fixed")
    rest = tokens.join(fixes.where("kind = 'token'").select("show", F.col("key").alias("low")), ["show", "low"], "left_anti")
    rest = rest.join(names.select("show", F.lower("name").alias("low")), ["show", "low"], "left_anti")
    rest = english_gate(rest, words)
    fuzzy = materialize(fuzzy_names(rest, names), "fuzzy")
    heard = phonetic_names(rest.join(fuzzy.select("show", "core"), ["show", "core"], "left_anti"), names)
    return listed.unionByName(fuzzy.select("show", "core", F.col("name").alias("fixed"))).unionByName(heard.select("show", "core", F.col("name").alias("fixed")))


def correct_names(df: DataFrame, terms: DataFrame, fixes: DataFrame, words: DataFrame, ident: Sequence[str], text: str = "text") -> DataFrame:
    """(ident, show, text, n): texts with corrected names, single spaces between tokens, and the
    number of changes. ``ident`` identifies a row."""
    staged = phrase_fixes(df.select("show", *ident, text), fixes, text)
    table = materialize(correction_table(materialize(distinct_tokens(staged, text), "tokens"), terms, fixes, words), "corrections")  # counted, then joined
    tokens = staged.select("show", *ident, "n", F.posexplode(F.split(F.trim(F.col(text)), r"\s+")).alias("__pos", "__tok")).withColumn("__p", T.token_parts(F.col("__tok")))
    joined = tokens.withColumn("core", F.col("__p.core")).join(small(table), ["show", "core"], "left")
    new = F.when(F.col("fixed").isNotNull(), F.concat("__p.pre", "fixed", "__p.post")).otherwise(F.col("__tok"))
    rows = F.sort_array(F.collect_list(F.struct("__pos", new.alias("t"))))
    return joined.groupBy("show", *ident, "n").agg(F.array_join(F.transform(rows, lambda r: r["t"]), " ").alias(text), F.count("fixed").alias("__m")).select("show", *ident, text, (F.col("n") + F.col("__m")).alias("n"))


def name_suspect(df: DataFrame, terms: DataFrame, words: DataFrame, ident: Sequence[str], cutoff: float = 0.78, text: str = "text") -> DataFrame:
    """(show, ident, suspect): whether a text holds an unlisted capitalized token, or one close to a
    name."""
    names = terms.where("kind = 'name'").select("show", "ord", F.col("term").alias("name"))
    tokens = distinct_tokens(df, text).where(F.length("core") >= 4)
    tokens = materialize(english_gate(tokens.join(names.select("show", F.lower("name").alias("low")), ["show", "low"], "left_anti"), words), "tokens")
    upper = F.substring("core", 1, 1).rlike(r"^\p{Lu}")
    low = tokens.where(~upper).withColumn("text", title_case("core"))
    close = nearest_names(low.select("show", "text", F.lit(cutoff).alias("cutoff")).distinct(), names.select("show", F.col("name")).distinct(), 1)
    near = low.join(close.select("show", "text").distinct(), ["show", "text"]).select("show", "core").distinct()
    odd = materialize(tokens.where(upper).select("show", "core").unionByName(near).withColumn("__odd", F.lit(True)), "odd")  # counted, then joined
    exploded = df.select("show", *ident, F.explode(F.split(F.trim(F.col(text)), r"\s+")).alias("__tok")).withColumn("core", T.token_parts(F.col("__tok"))["core"])
    return exploded.join(small(odd), ["show", "core"], "left").groupBy("show", *ident).agg(F.coalesce(F.bool_or("__odd"), F.lit(False)).alias("suspect"))


def mine_names(texts: DataFrame, deny: DataFrame, existing: DataFrame, min_count: int = 3, text: str = "text") -> DataFrame:
    """(show, term, n): capitalized words seen ``min_count`` times or more, and at least once inside
    a sentence, that are neither denied (word) nor known (show, term)."""
    sentences = texts.select("show", F.explode(F.split(text, r"[.!?…]+|\n")).alias("s"))
    words = sentences.select("show", F.posexplode(F.regexp_extract_all("s", F.lit(r"[A-Za-z][A-Za-z'’\-]{2,}"), F.lit(0))).alias("i", "w"))
    cores = words.select("show", "i", F.regexp_replace("w", r"^['’\-]+|['’\-]+$", "").alias("term")).where(F.col("term").rlike("^[A-Z][a-z]{3,}$"))
    counted = cores.groupBy("show", "term").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("i") > 0).alias("inside")).where(f"inside and n >= {min_count}")
    low = counted.withColumn("__low", F.lower("term"))
    low = low.join(deny.select(F.lower("word").alias("__low")).distinct(), "__low", "left_anti")
    return low.join(existing.select("show", F.lower("term").alias("__low")).distinct(), ["show", "__low"], "left_anti").select("show", "term", "n")


def additive_terms(existing: DataFrame, mined: DataFrame) -> DataFrame:
    """Existing names (show, ord, term), then the new ones by name behind them."""
    top = existing.groupBy("show").agg(F.max("ord").alias("top"))
    new = mined.join(existing.select("show", F.lower("term").alias("__low")), (mined["show"] == existing["show"]) & (F.lower(mined["term"]) == F.col("__low")), "left_anti")
    new = rank_within(new.select("show", "term"), "show", ["term"], "r").join(top, "show", "left").select("show", (F.coalesce("top", F.lit(-1)) + F.col("r")).cast(existing.schema["ord"].dataType).alias("ord"), "term")
    return existing.select("show", "ord", "term").unionByName(new)


def top_names(terms: DataFrame, counts: DataFrame, k: int = 30) -> DataFrame:
    """(show, prompt): the k most counted names, earlier ones first on a tie. Each task gives up all
    but its own first k before the exchange, so no show gathers more than k rows of each."""
    rows = terms.join(counts.select("show", "term", "n"), ["show", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("show").orderBy(F.desc("n"), "ord"))
    kept = rows.withColumn("r", rank).where(F.col("r") <= k)
    return kept.groupBy("show").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ", ").alias("prompt"))


def wiki_candidates(terms: DataFrame, titles: DataFrame, k: int = 6, cutoff: float = 0.62) -> DataFrame:
    """(show, term, title, score, rank): the k most similar titles, in the case seen first; of equal
    scores the larger title."""
    t = titles.groupBy("show", F.lower("title").alias("name")).agg(F.min_by("title", "ord").alias("title"))
    asked = terms.select("show", "term", F.lower("term").alias("text"))
    best = nearest_names(asked.select("show", "text", F.lit(cutoff).alias("cutoff")).distinct(), t, k)
    rank = F.row_number().over(Window.partitionBy("show", "text").orderBy(F.desc("score"), F.desc("name")))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.join(best, ["show", "text"]).join(t, ["show", "name"]).select("show", "term", "title", "score", "rank")


def pending_terms(terms: DataFrame, verified: DataFrame, force: bool = False) -> DataFrame:
    """(show, term, ord) not verified yet, each once at its first place; names before phrases."""
    first = terms.groupBy("show", "term").agg(F.min(F.struct((F.col("kind") == "phrase").alias("p"), "ord")).alias("at"))
    rest = first if force else first.join(verified.select("show", "term"), ["show", "term"], "left_anti")
    return rank_within(rest, "show", ["at", "term"], "r").select("show", "term", (F.col("r") - 1).cast("int").alias("ord"))


def wiki_sanity_gate(terms: DataFrame, titles: DataFrame, least: int = 3) -> DataFrame:
    """(show, ok): not ok if a show has ``least`` names or more and none is a title."""
    t = titles.select("show", F.lower("title").alias("__low")).distinct().withColumn("__hit", F.lit(1))
    names = terms.where("kind = 'name'").withColumn("__low", F.lower("term")).join(t, ["show", "__low"], "left")
    return names.groupBy("show").agg((~((F.count(F.lit(1)) >= least) & (F.count("__hit") == 0))).alias("ok"))


def verify_apply(terms: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Terms with their adjudications (show, term, canonical, confidence): a sure other spelling
    replaces the term; adds verified and flagged (low-confidence, no-match or null)."""
    a = adjudications.select("show", "term", F.coalesce("canonical", F.lit("")).alias("__c"), F.coalesce("confidence", F.lit("none")).alias("__f"), F.lit(True).alias("__seen"))
    out = terms.join(a, ["show", "term"], "left")
    sure = F.col("__f") == "high"
    flag = F.when(F.col("__seen") & (~sure | (F.col("__c") == "")), F.when((F.col("__f") == "low") & (F.col("__c") != ""), "low-confidence").otherwise("no-match"))
    return out.withColumns({"verified": F.coalesce("__seen", F.lit(False)), "flagged": flag, "term": F.when(sure & (F.col("__c") != ""), F.col("__c")).otherwise(F.col("term"))}).drop("__c", "__f", "__seen")


def glossary_for(files: DataFrame, shows: DataFrame, path: str = "path") -> DataFrame:
    """Files with glossary: the nearest ancestor directory that has one (show); null without."""
    parts = F.split(path, "/")
    above = files.select(path, F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("depth", "dir"))
    best = above.join(small(shows.select(F.col("show").alias("dir")).distinct()), "dir").groupBy(path).agg(F.max_by("dir", "depth").alias("glossary"))
    return files.join(best, path, "left")
