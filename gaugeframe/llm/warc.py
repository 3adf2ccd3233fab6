"""Web archives: records with revisits, segments and chunked transfer framing, written and read back by Spark.

An archive is a text output whose rows are whole records; the writer puts the blank lines between
them. Payloads longer than a segment are cut into a record and continuations. Reading parses
record lengths, groups continuations by the origin identifier, orders them by segment number, checks the
total length and decodes the chunks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import bounded_batches, raw_text
from gaugeframe.runtime import scratch, tune

SEGMENT_BYTES = 8 * 1024
CHUNK_BYTES = 4096
ARCHIVE_RECORDS = 2000
# Fixed values of the format.
VERSION = b"WARC/1.1"
BETWEEN = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions after the size and trailers after the last chunk are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2:line + 2 + size])
        if body[line + 2 + size:line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is longer or shorter than its size")
        at = line + 4 + size


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in headers] + [b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + BETWEEN + block


def _records(page_id: int | None, url: str, payload: bytes, revisit: bool, refers_to: int | None, segment: int) -> list[bytes]:
    name = f"<urn:uuid:{uuid.uuid4()}>"
    ident = "" if page_id is None else page_id
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Target-URI", target), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Page-ID", ident),
              ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if revisit:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", REVISIT_PROFILE),
                        ("WARC-Refers-To-Page", refers_to), ("WARC-Payload-Length", len(payload))], b"")]
    block = HTTP_HEAD + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        return [record(first, block)]
    starts = range(0, len(block), segment)
    out = [record([*first, ("WARC-Segment-Number", 1)], block[:segment])]
    for number, start in enumerate(starts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if number == len(starts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                           ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name),
                           ("WARC-Segment-Number", number), *last], block[start:start + segment]))
    return out


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lowered) and block of every record of an archive."""
    at = 0
    while at < len(content):
        if not content.startswith(VERSION, at):
            raise ValueError(f"no record at byte {at}")
        end = content.index(BETWEEN, at)
        lines = content[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start, size = end + 4, int(headers["content-length"])
        yield headers, content[start:start + size]
        if content[start + size:start + size + 4] != BETWEEN:
            raise ValueError("a record is longer or shorter than its length")
        at = start + size + 4


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   segment: int = SEGMENT_BYTES, records_per_archive: int = ARCHIVE_RECORDS) -> None:
    """Write a record per row into archives under ``folder``.

    Of equal payloads the row with the largest id is the response, others revisit it; rows tied at that id are all
    responses. Null html is an empty payload, a null id is the smallest, a null url is empty.
    """
    tune(pages.sparkSession)
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), raw_text(html).alias("payload"))
    keyed = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    narrow = keyed.select("page_id", "sha")
    best = narrow.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = (narrow.join(best, "sha").filter("NOT (page_id <=> refers_to)")
                .select(F.col("page_id").alias("__page"), F.col("sha").alias("__sha"), "refers_to").distinct())
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("sha") == F.col("__sha"))
    marked = (keyed.join(revisits.hint("shuffle_hash"), same, "left")
              .select("page_id", "url", "payload", F.col("__sha").isNotNull().alias("revisit"), "refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in _records(*row, segment)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = marked.mapInArrow(write, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.options(
        lineSep=BETWEEN.decode(), compression="gzip", maxRecordsPerFile=records_per_archive).text(folder)


_FIELDS = ("page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, "
           "record_id string, origin string, segment bigint, total_length bigint, block binary")


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def _decoded(block: bytes) -> bytes:
    head, _, body = block.partition(BETWEEN)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def read_archives(spark, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact, one row per response or revisit.

    Whole responses are decoded where they are read; only segments are shuffled, and a group is one payload. ``intact`` is
    false where segments are missing, the total length differs or the digest does. An empty folder gives no rows.
    """
    tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(gzip.decompress(content.as_py())):
                    kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:")
                    number, length, stored = _number(h.get("warc-segment-number")), None, None
                    if kind == "revisit":
                        length = _number(h.get("warc-payload-length"))
                    elif number is None:
                        payload = _decoded(block)
                        length, stored = len(payload), None
                        digest = digest if payload_digest(payload) == digest else f"!{payload_digest(payload)}"
                    else:
                        stored = block
                    rows.append((_number(h.get("warc-page-id")), kind, length, digest, _number(h.get("warc-refers-to-page")),
                                 h.get("warc-record-id"), h.get("warc-segment-origin-id", h.get("warc-record-id")), number,
                                 _number(h.get("warc-segment-total-length")), stored))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    bounded_batches(spark)
    records = files.mapInArrow(read, _FIELDS)
    return (records.filter("segment IS NULL").select(
        "page_id", "payload_bytes", F.ltrim(F.col("payload_digest"), F.lit("!")).alias("payload_digest"), "record_type", "refers_to",
        (~F.startswith("payload_digest", F.lit("!"))).alias("intact"))
        .unionByName(_reassembled(records.filter("segment IS NOT NULL"))))


def _reassembled(segments: DataFrame) -> DataFrame:
    def join(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("segment", "block", "total_length", "page_id", "payload_digest"))),
                      key=lambda r: r[0])
        block = b"".join(r[1] for r in rows)
        whole = [r[0] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1][2] == len(block)
        payload = _decoded(block) if whole else b""
        found = payload_digest(payload)
        return pa.table({"page_id": pa.array([rows[0][3]], pa.int64()), "payload_bytes": pa.array([len(payload)], pa.int64()),
                         "payload_digest": [found], "record_type": ["response"], "refers_to": pa.array([None], pa.int64()),
                         "intact": [whole and found == rows[0][4]]})
    return segments.groupBy("origin").applyInArrow(
        join, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean")


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages into fresh archives in the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "archives")
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder)
