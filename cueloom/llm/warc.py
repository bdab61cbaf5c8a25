"""WARC archives and their merged capture index.

Archives are gzip members, one for each record (a record of 16 MB or more takes several), so a
record can be read alone from its offset. Spark's text sink writes them: a member of less than 16 MB
ends with a zero byte, the highest of its length, and this byte is the sink's line separator. A new
archive begins when one has its bytes. Reading parses by Content-Length, so payloads may hold
anything.

Every archive yields a run of index entries that is sorted where it is read. The runs are dealt out
by range of (url key, timestamp, record) into ranges of bounded size; the part of every run that falls
into a range is still in order, and a loser tree merges these parts, so the ranges in turn are the
captures of all archives in one global order. What a task holds is one archive, or one range.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import materialize, quoted

#: Payloads of fewer bytes are always stored as responses.
MIN_REVISIT_BYTES = 0
#: Packed bytes after which a new archive begins.
ARCHIVE_BYTES = 64 << 20
#: Bytes of a record that one gzip member takes; fewer than 2 ** 24, so that it ends with a zero byte.
MEMBER_BYTES = (1 << 24) - 1
#: Index entries, about, of one range of the merge.
RANGE_ROWS = 250_000
#: Capture times go round in a hundred years, so that every page id has one.
CAPTURE_SECONDS = 36_525 * 86_400
#: Repeated payloads (80 bytes each) up to this number are broadcast; more are joined by shuffle.
BROADCAST_DIGESTS = 100_000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:cueloom:capture:"
INDEX = "urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: each 10 hex digits are 8 base32 ones."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            min_revisit_bytes: int = MIN_REVISIT_BYTES, first_second: int = 1_577_836_800) -> DataFrame:
    """One WARC/1.1 record (column ``value``, without the closing line ends) for each row.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest
    page_id is the response and the others revisit it; rows that repeat that id with that payload
    are responses too. A null page_id is smaller than any other; a null html is an empty payload,
    a null url leaves the target out, line ends in a url are percent-encoded. The capture time is
    ``first_second`` plus the page_id in seconds, modulo ``CAPTURE_SECONDS``, in UTC.
    """
    rows = pages.select(F.col(quoted(page_id)).cast("long").alias("id"), F.col(quoted(url)).alias("url"), F.coalesce(F.col(quoted(html)), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    repeated = (rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.max("id").alias("latest"), F.count(F.lit(1)).alias("n"))
                .where("n > 1 and latest is not null").drop("n"))
    repeated = materialize(repeated, "repeated-payloads")
    if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, ["digest", "size"], "left")
    revisit = F.col("latest").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("latest")))
    name = F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    second = F.pmod(F.coalesce("id", F.lit(0)), F.lit(CAPTURE_SECONDS)) + F.lit(first_second)
    day = F.date_from_unix_date(F.floor(second / 86_400).cast("int")).cast("string")
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(second % 86_400 / 3600), F.floor(second % 3600 / 60), second % 60)
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name),
        F.concat(F.lit("WARC-Date: "), day, clock),
        F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <{_ID}"), F.col("latest").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body).alias("value"))


def _members(batches: Iterator[pa.RecordBatch], archive_bytes: int, member_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records (value) -> (archive, member): a record's gzip members, in one row since the sink does not
    keep the order of rows, without their last byte, which is zero. Archives are numbered within the
    task."""
    archive = size = 0
    for batch in batches:
        numbers, members = [], []
        for text in batch.column(0):
            record = memoryview(text.as_buffer())
            if len(record) + 4 > member_bytes:
                parts = [*[record[i : i + member_bytes] for i in range(0, len(record), member_bytes)], b"\r\n\r\n"]
            else:
                parts = [bytes(record) + b"\r\n\r\n"]
            packed = b"".join(_packed(part) for part in parts)
            numbers.append(archive)
            members.append(packed[:-1])
            size += len(packed)
            if size >= archive_bytes:
                archive, size = archive + 1, 0
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(members, pa.binary())], names=["archive", "member"])


def _packed(data: bytes | memoryview) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, member_bytes: int = MEMBER_BYTES, **names: str | int) -> None:
    """Write the rows' records as gzipped WARC files in folders below ``path``."""
    members = records(pages, **names).select(F.col("value").cast("binary")).mapInArrow(lambda batches: _members(batches, archive_bytes, member_bytes), "archive long, member binary")
    # The sink passes the bytes of a string on as they are.
    members.select("archive", F.col("member").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\0").text(path)


def read_records(content: memoryview) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields in lower case, block) of each record of an archive; offset
    and length are those of its gzip members, and a record begins with a member."""
    at = 0
    while at < len(content):
        begin, data, need, fields, head = at, b"", None, {}, b""
        while need is None or len(data) < need:
            if at >= len(content):
                raise ValueError(f"the record at {begin} is cut short")
            part, at = _unpacked(content, at)
            data += part
            if need is None:
                head, found, _ = data.partition(b"\r\n\r\n")
                if not head.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record at {begin}")
                if found:
                    lines = [line.decode("utf-8").partition(":") for line in head.split(b"\r\n")[1:]]
                    fields = {name.strip().lower(): value.strip() for name, _, value in lines}
                    need = len(head) + 8 + int(fields["content-length"])
        yield begin, at - begin, fields, data[len(head) + 4 : need - 4]


def _unpacked(content: memoryview, at: int, step: int = 1 << 14) -> tuple[bytes, int]:
    """The data of the gzip member at a place, and where the next one begins."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        if at >= len(content):
            raise ValueError("a gzip member is cut short")
        out.append(unpack.decompress(content[at : at + step]))
        at += min(step, len(content) - at) - len(unpack.unused_data)
    return b"".join(out), at


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query: com,example)/path?query."""
    if not url or "://" not in url:
        return url or ""
    try:
        parts = urlsplit(url)
    except ValueError:
        return url
    host = ",".join(reversed(parts.netloc.lower().split(".")))
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _entry(archive: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(rest) if (rest := fields.get(name, "")[1 + len(_ID) : -1]) else None
    kind = fields["warc-type"]
    if kind == "revisit":
        size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
            raise ValueError(f"{archive} at {offset}: the payload does not fit its digest")
    stamp = "".join(c for c in fields["warc-date"] if c.isdigit())
    return {"urlkey": url_key(fields.get("warc-target-uri")), "timestamp": stamp, "page_id": number("warc-record-id"), "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to"), "archive": archive, "offset": offset, "length": length}


def _order(entry: dict) -> tuple:
    return entry["urlkey"], entry["timestamp"], -1 if entry["page_id"] is None else entry["page_id"], entry["archive"], entry["offset"]


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``; those of one archive form a sorted run."""
    from pyspark.sql.types import _parse_datatype_string

    shape = _parse_datatype_string(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                archive = "/".join(name.split("/")[-2:])
                entries = sorted((_entry(archive, *record) for record in read_records(memoryview(content.as_buffer()))), key=_order)
                for lo in range(0, len(entries), 10_000):
                    yield pa.RecordBatch.from_pylist(entries[lo : lo + 10_000], schema=to_arrow_schema(shape))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, shape)


class LoserTree:
    """Merges sorted lists: a tournament whose inner nodes remember the loser of their match."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        self.winner = self._play(1)

    def _beats(self, a: int, b: int) -> bool:
        """Exhausted runs lose; the earlier run wins a tie."""
        if b < 0 or self.at[b] >= len(self.runs[b]):
            return True
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or x == y and a < b

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < len(self.runs) else -1
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return won

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in the run) in merged order."""
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            node = (run + self.size) // 2
            while node:
                if not self._beats(run, self.losers[node]):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's entries in order. A run is what arrives in order from one archive."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows).combine_chunks()
    cols = [table.column(c).to_pylist() for c in ("urlkey", "timestamp", "page_id", "archive", "offset")]
    keys = [(u, t, -1 if p is None else p, a, o) for u, t, p, a, o in zip(*cols, strict=True)]
    starts = [i for i in range(len(keys)) if i == 0 or keys[i][3] != keys[i - 1][3] or keys[i] < keys[i - 1]]
    runs = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
    order = [starts[run] + i for run, i in LoserTree(runs)]
    yield from table.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=10_000)


def capture_histories(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all archives below ``path`` in order of url key, timestamp and page_id;
    partitions follow each other in that order.

    Columns: urlkey, timestamp (UTC), page_id, payload_bytes (of the full payload, also for a
    revisit), payload_digest, record_type, refers_to, archive, offset and length (of the record's
    packed bytes there). No archives give no rows. The number of ranges grows with the captures; a
    hot url key is split between ranges by its timestamps.
    """
    runs = materialize(index_runs(spark, path), "index-runs")
    ranges = max(1, -(-runs.count() // range_rows))
    order = ["urlkey", "timestamp", F.coalesce("page_id", F.lit(-1)), "archive", "offset"]
    return runs.repartitionByRange(ranges, *order).mapInArrow(_merge, runs.schema)
