"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import decontamination, language, mixing, quality, repeats, runs, secrets, sharding, simhash, spelling, toxicity, url_filter, warc
from cueloom.llm.common import WORD_SPACE, let, materialize, scratch_path

#: The rule list of op1.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
#: Target weights of op9: what each source's share of the mixture is to be; all others weigh 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, shingle=4, bits=64, distance=4, segments=simhash.needed_segments(4), similarity=None).select("doc_id", "fingerprint", "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.capture_histories(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep=False)
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = quality.base_statistics(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return quality.judge(stated).select("doc_id", *quality.STATISTICS, "base_failed", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", sharding.text_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "shard", "group_start")
    return sharding.number_slots(rows, ["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def source_weights(docs: DataFrame, weights: dict[str, float]) -> dict[str | None, float]:
    """A weight for every source of ``docs``: the given one, or 1."""
    found = [r["source"] for r in docs.select("source").distinct().collect()]
    return {s: weights.get(s, 1.0) for s in sorted(found, key=str)}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, source_weights(docs, MIX_WEIGHTS))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")), "secret-spans")
    found = secrets.scan(docs, secrets.train(secrets.samples_from(docs))).select("doc_id", "spans")
    counts = [secrets.count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("spans"), base_only=True), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every 31st word of a document, by its CRC-32, a letter is deleted first."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(spelling.words_of(F.col("text")), lambda w: F.length(w) >= spelling.LEAST_LETTERS)).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = found.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.group_variants(spelling.word_counts(words)).select("word", "form", "root", "n", "n_near", "form_n")


def planted_runs(docs: DataFrame) -> DataFrame:
    """Of every tenth document, by its CRC-32, the words from some place on are repeated from there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.filter(F.split("text", WORD_SPACE), lambda w: w != "")
    return docs.withColumn("text", F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)))).otherwise(F.col("text")))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    at = found.withColumn("best", best)
    return at.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "margin", "accepted")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_simhash, op3_decontamination, op4_warc, op5_repeats, op6_quality, op7_toxicity, op8_sharding, op9_mixing, op10_secrets,
                                op11_spelling, op12_runs, op13_language)}

#: The byte table of CRC-32, which DuckDB lacks.
_CRC_TABLE = """t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""

ORACLES: dict[str, str] = {
    "op1_url_filters": r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j AS (
  SELECT p.*, (SELECT max_by({'rule': rule_host || rule_path, 'verdict': rule_verdict}, length(rule_host || rule_path)) FROM r
               WHERE (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)) AS best
  FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM j
""",
    "op4_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NULL AND latest IS NOT NULL OR page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < latest THEN latest END AS refers_to
FROM p
""",
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op9_mixing": """
WITH RECURSIVE s AS (
  SELECT source, (CASE source WHEN 'src0' THEN 4 WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END)::BIGINT AS share FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT list(source ORDER BY source) AS names, list(share ORDER BY source) AS shares, sum(share)::BIGINT AS period FROM s),
run(slot, done, pick) AS (
  SELECT -1::BIGINT, list_transform(names, lambda x: 0::BIGINT), 0::BIGINT FROM l
  UNION ALL
  SELECT slot, list_transform(done, lambda d, i: d + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT slot + 1 AS slot, done, list_min(list_filter(list_transform(range(1, len(names) + 1), lambda i: {
      'due': ((done[i] + 1) * period + shares[i] - 1) // shares[i], 'next': ((done[i] + 2) * period)::DOUBLE / shares[i], 'name': names[i], 'i': i,
      'ready': done[i] < shares[i] AND done[i] * period // shares[i] <= slot + 1}), lambda c: c.ready)).i AS pick
    FROM run, l WHERE slot < period - 1)),
p AS (SELECT names[pick] AS source, done[pick] - 1 AS k, slot FROM run, l WHERE slot >= 0),
r AS (SELECT doc_id, source, (n // 16)::BIGINT AS block, (n % 16)::INT AS place FROM (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents))
SELECT doc_id, source, block, block // share * period + p.k * period // share AS release, block // share * period + ((p.k + 1) * period + share - 1) // share AS deadline, block // share * period + p.slot AS slot, place
FROM r JOIN s USING (source) JOIN p ON p.source = r.source AND p.k = r.block % share, l
""",
    "op11_spelling": r"""
WITH RECURSIVE @,
r AS (
  SELECT doc_id, run, count(*) AS m, encode(doc_id::VARCHAR || ':' || run) AS b
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
h AS (
  SELECT run, m, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, x: xor(t.crc[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM r, t),
w AS (
  SELECT word, sum(m)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, m FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
s AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS skip, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM s a JOIN s b ON a.skip = b.skip AND a.word <> b.word
  UNION SELECT s.word, s.n, w.word, w.n FROM s JOIN w ON s.rest = w.word
  UNION SELECT w.word, w.n, s.word, s.n FROM s JOIN w ON s.rest = w.word),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM p GROUP BY word),
g AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM w LEFT JOIN f USING (word)),
z(word, root) AS (
  SELECT word, word FROM g
  UNION ALL SELECT z.word, g.form FROM z JOIN g ON g.word = z.root WHERE g.form IS NOT NULL),
u AS (SELECT z.word, z.root FROM z JOIN g ON g.word = z.root WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM g JOIN u USING (word)
""".replace("@", _CRC_TABLE),
    "op12_runs": r"""
WITH @,
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, x: xor(t.crc[(xor(c, x) & 255) + 1], c >> 8))) AS h
  FROM documents, t),
m AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM d),
c AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM m),
e AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM c),
p AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM e),
x AS (SELECT a.doc_id, a.n, a.i, b.i - a.i AS q FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
y AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM x) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM y z WHERE z.doc_id = y.doc_id AND z.q < y.q AND z.s <= y.s AND z.s + z.len >= y.s + y.len)),
o AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN o USING (doc_id, i) GROUP BY doc_id),
a AS (
  SELECT doc_id, count(*) AS n_runs, first({'s': s, 'len': len, 'q': q} ORDER BY len DESC, s, q) AS best, string_agg(concat_ws(',', s, len, q) || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)
""".replace("@", _CRC_TABLE),
}
