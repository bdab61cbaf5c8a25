"""Language of texts by compression: the dictionary that shortens a text most names its language.

Every language has a raw-content dictionary for zstandard, pieces of its training texts one after
another. A text is cut into blocks, every block is compressed alone with each dictionary, and the
language with the fewest bytes in total wins. Where the runner-up is nearly as short, the answer is
rejected.

Pieces are chosen by hash over all training texts, so a dictionary is a spread sample of bounded size,
and long texts or many copies of one text do not fill it. The driver and every task hold the
dictionaries and nothing else of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.common import lower_ascii, materialize, quoted

#: Bytes of one language's dictionary, and of all together: many languages have smaller ones each.
DICTIONARY_BYTES, MODEL_BYTES = 96 << 10, 32 << 20
#: Characters of a piece of training text, and bytes of a block that is compressed alone.
PIECE, BLOCK = 256, 16 << 10
LEVEL = 6
#: Share of its bytes by which the winner has to be shorter than the next language.
LEAST_MARGIN = 0.01
UNKNOWN = "und"
HAS_LETTER = r"\p{L}"

Dictionaries = Mapping[str, bytes]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """The dictionary of every language of ``docs``; rows without a language or a letter teach nothing.

    Each is up to ``size`` bytes of pieces of its texts with the smallest hashes, equal pieces once.
    Languages stand in order of their training bytes, most first.
    """
    rows = docs.select(F.col(quoted(lang)).alias("lang"), lower_ascii(F.col(quoted(text))).alias("body")).where(F.col("lang").isNotNull() & F.col("body").rlike(HAS_LETTER))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("body")).alias("n")).collect()}
    if not totals:
        return {}
    size = min(size, MODEL_BYTES // len(totals))
    # Twice as many bytes as are wanted pass this threshold, so that equal pieces do no harm.
    share = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(int(min(1.0, 2 * size / n) * (1 << 62))))])
    pieces = F.regexp_extract_all("body", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    hashed = F.transform(pieces, lambda p: F.struct(F.shiftrightunsigned(F.xxhash64(p), 2).alias("h"), p.alias("piece")))
    chosen = rows.select("lang", F.explode(F.filter(hashed, lambda x: x["h"] < share[F.col("lang")])).alias("x")).select("lang", "x.h", "x.piece").distinct()
    run = F.sum(F.octet_length("piece")).over(Window.partitionBy("lang").orderBy("h", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = materialize(chosen.withColumn("upto", run).where(F.col("upto") <= size), "pieces")
    found: dict[str, list[tuple[int, str]]] = {}
    for r in best.select("lang", "h", "piece").toLocalIterator():
        found.setdefault(r["lang"], []).append((r["h"], r["piece"]))
    return {k: " ".join(p for _, p in sorted(found[k])).encode() for k in sorted(found, key=lambda k: (-totals[k], k))}


def sizes(body: bytes, coders: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of a text with each dictionary."""
    blocks = [body[k : k + BLOCK] for k in range(0, len(body), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in coders]


def coders_of(dictionaries: Dictionaries) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in dictionaries.values():
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def identify(docs: DataFrame, dictionaries: Dictionaries, doc_id: str = "doc_id", text: str = "text", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """(doc_id, lang, score, margin, accepted) of every row.

    lang is the language whose dictionary makes the text shortest; of equal ones the first, which
    has the most training text.
    margin is the share of the runner-up's bytes that it saves (1 if there is no other language),
    accepted says whether that is ``least_margin`` or more, and score is the language's share of
    exp(-bytes) over all languages. Null texts and texts without a letter are ``und`` with score 0 and
    margin 0, and so is everything where nothing was learned. Repeated rows are judged alike; other
    columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(dictionaries))
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = coders_of(shared.value)
        for batch in batches:
            rows: list[tuple[str, float, float]] = []
            for body in batch.column(1).to_pylist():
                if body is None or not coders:
                    rows.append((UNKNOWN, 0.0, 0.0))
                    continue
                n = np.array(sizes(body, coders))
                k = int(n.argmin())
                others = np.delete(n, k)
                margin = float(1 - n[k] / others.min()) if len(others) else 1.0
                rows.append((names[k], float(1 / np.exp(np.maximum(n[k] - n, -700.0)).sum()), margin))
            lang, score, margin = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=["doc_id", "lang", "score", "margin"])

    known = F.when(F.col(quoted(text)).rlike(HAS_LETTER), lower_ascii(F.col(quoted(text))).cast("binary"))
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), known.alias("body"))
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, score double, margin double")
    return found.withColumn("accepted", (F.col("lang") != UNKNOWN) & (F.col("margin") >= least_margin))
