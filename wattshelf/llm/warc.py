"""WARC archives: writing with segmentation, reading with segment reassembly and chunked-transfer decoding."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ordinary pages exceed this, so large ones come as several records; chunks are as large.
SEGMENT_BYTES = 1 << 14
ARCHIVE_BYTES = 8 << 20
CHUNK_BYTES = 1 << 14
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD_SCHEMA = (
    "page_id bigint, record_id string, record_type string, segment bigint, origin string, total bigint, refers_to string, "
    "digest string, uri string, block binary"
)
PAGE_SCHEMA = (
    "page_id bigint, record_id string, record_type string, refers_to string, header_digest string, payload_digest string, "
    "payload_bytes bigint, uri string, payload binary, whole boolean"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(kind: str, row: int | None, digest: str) -> str:
    """The same for rows that repeat a page: their records are copies of each other."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}/{row}/{digest}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped, a cut body is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than announced")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block, chunked or not."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    return unchunked(body) if headers.get(b"transfer-encoding") == b"chunked" else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def page_records(row: int | None, uri: str, payload: bytes, first_row: int | None, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """A page as WARC records: a revisit, or a response cut into segments of at most ``segment_bytes``."""
    digest = f"sha1:{base32_sha1(payload)}"
    own = record_id("page", row, digest)
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    detail = [("WARC-Payload-Digest", digest)] + ([("X-Row", row)] if row is not None else [])
    if first_row != row:
        block = HTTP_HEAD.replace(b"Transfer-Encoding: chunked\r\n", b"X-Payload-Bytes: %d\r\n" % len(payload))
        more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id("page", first_row, digest)), ("X-Refers-To-Row", first_row)]
        kind = [("WARC-Type", "revisit"), ("Content-Type", "application/http; msgtype=response")]
        return [_record(kind + common + detail + more, block)]
    block = HTTP_HEAD + chunked(payload)
    kind = [("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response")]
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(pieces) == 1:
        return [_record(kind + common + detail, block)]
    out = [_record(kind + common + detail + [("WARC-Segment-Number", 1)], pieces[0])]
    for n, piece in enumerate(pieces[1:], 2):
        fields = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"segment {n}", row, digest)), ("WARC-Date", DATE),
            ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n),
        ]
        if n == len(pieces):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record(fields, piece))
    return out


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of an uncompressed archive, cut by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not at the start of a record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if stop > len(data):
            raise ValueError("record shorter than announced")
        yield fields, data[start:stop]
        at = stop
        while data[at : at + 2] == b"\r\n":
            at += 2


def gunzip_members(data: bytes) -> bytes:
    """All gzip members of an archive, read in slices so that each byte is copied a bounded number of times."""
    out, at = [], 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = data[at : at + 16384]
            if not piece:
                raise ValueError("gzip member is cut")
            out.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        while at < len(data) and data[at] == 0:
            at += 1
    return b"".join(out)


def with_first_copy(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(row, uri, payload, first_row): the smallest row with the same payload, or the row itself.

    Only digests are shuffled to find copies; a digest that many rows share is counted before the shuffle
    and joined back as one row.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("row"), F.coalesce("url", F.lit("")).alias("uri"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    digests = rows.select("row", F.sha2("payload", 256).alias("_digest"), F.octet_length("payload").alias("_bytes"))
    firsts = (
        digests.filter((F.col("_bytes") >= min_bytes) & F.col("row").isNotNull())
        .groupBy("_digest")
        .agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(F.col("_digest").alias("_d"), "_first")
    )
    later = (
        digests.join(firsts, F.col("_digest") == F.col("_d"))
        .filter("row <> _first")
        .groupBy(F.col("row").alias("_row"))
        .agg(F.first("_first").alias("_first"))
    )
    return rows.join(later, F.col("row") == F.col("_row"), "left").select(
        "row", "uri", "payload", F.coalesce("_first", "row").alias("first_row")
    )


def write_warc(
    pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write a record for each page (page_id, url, html) as gzip archives below ``path``.

    Records are gzip members of their own. Of the pages with equal payloads of at least ``min_bytes`` the
    one with the smallest page_id is a response, the others revisit it. Payloads beyond ``segment_bytes`` are
    cut into segments, so an archive never exceeds about ``archive_bytes`` plus one segment. Archives are
    written by Spark, one file per archive, and so survive lost executors.

    A null html is an empty payload, a null url an empty URI. Rows that repeat a page_id give a record each;
    a page with a null page_id is always a response. Other columns are ignored; no pages give no archives.
    """
    placed = with_first_copy(pages, min_bytes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive():
            return pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for row, uri, payload, first in zip(*(batch.column(i) for i in range(4))):
                uri = " ".join(uri.as_py().split())
                for record in page_records(row.as_py(), uri, payload.as_py(), first.as_py(), segment_bytes):
                    held.append(gzip.compress(record, 5, mtime=0))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield archive()
                        held, size = [], 0
        if held:
            yield archive()

    packed = placed.mapInArrow(pack, "archive binary")
    # Spark's text writer puts the bytes out as they are; gzip readers skip zero bytes after a member.
    packed.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", "\x00"
    ).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, one row each; an archive is one task's unit."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                data = gunzip_members(content.as_py())
                for fields, block in parse_records(data):
                    integer = lambda name: int(fields[name]) if name in fields else None  # noqa: E731, B023
                    rows.append((
                        integer("x-row"), fields["warc-record-id"], fields["warc-type"], integer("warc-segment-number"),
                        fields.get("warc-segment-origin-id"), integer("warc-segment-total-length"),
                        fields.get("x-refers-to-row"), fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                        fields.get("warc-target-uri"), block,
                    ))
                    size += len(block)
                    if size >= 4 << 20:
                        yield records_batch(names, rows)
                        rows, size = [], 0
                if rows:
                    yield records_batch(names, rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def records_batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "segment": pa.int64(), "total": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], names=names
    )


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: continuation records grouped by origin, ordered by segment number, joined.

    ``whole`` is false where segment numbers have gaps, the last segment is missing, or the joined length is
    not the announced total. Records without segments pass through without a shuffle; records that repeat a
    record identifier (copies of a page) come back as often as they were written.
    """
    single = records.filter("segment IS NULL").withColumn("whole", F.lit(True))
    segments = records.filter("segment IS NOT NULL").withColumn("_origin", F.coalesce("origin", "record_id"))
    head = F.col("segment") == 1
    named = ["page_id", "record_id", "record_type", "refers_to", "digest", "uri"]
    joined = (
        segments.groupBy("_origin")
        .agg(
            *[F.max(F.when(head, F.col(c))).alias(c) for c in named],
            F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("_parts"),
            F.max("total").alias("total"),
            F.count_if(head).alias("_copies"),
        )
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.greatest(F.lit(1), F.col("_copies")).cast("int"))))
        .withColumn("block", F.expr("unhex(array_join(transform(_parts, p -> hex(p.block)), ''))"))
        .withColumn(
            "whole",
            F.coalesce(
                (F.octet_length("block") == F.col("total"))
                & (F.col("_parts.segment") == F.sequence(F.lit(1).cast("bigint"), F.size("_parts").cast("bigint"))),
                F.lit(False),
            ),
        )
    )
    columns = [*named, "block", "whole"]
    return single.select(*columns).unionByName(joined.select(*columns))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page_id, record_type, refers_to, payload (null for revisits), digest and length.

    ``payload_digest`` and ``payload_bytes`` are computed from the decoded payload; for a revisit they are
    those of the record it refers to as stored in its header. A record that is not whole, or whose digest is
    not the announced one, is an error. An empty folder gives no rows.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not r["whole"]:
                    raise ValueError(f"record {r['record_id']} lacks segments")
                if r["record_type"] == "revisit":
                    head = r["block"].split(b"\r\n")
                    size = next(int(h.split(b":")[1]) for h in head if h.lower().startswith(b"x-payload-bytes:"))
                    payload, digest = None, r["digest"]
                else:
                    payload = http_payload(r["block"])
                    size, digest = len(payload), base32_sha1(payload)
                    if digest != r["digest"]:
                        raise ValueError(f"record {r['record_id']} does not have its digest")
                out.append((r["page_id"], r["record_id"], r["record_type"], r["refers_to"], r["digest"], digest, size, r["uri"], payload, True))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary(), pa.bool_()]
            names = [f.split()[0] for f in PAGE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    whole = reassemble(read_records(spark, path))
    return whole.select("page_id", "record_id", "record_type", "refers_to", "digest", "uri", "block", "whole").mapInArrow(decode, PAGE_SCHEMA)
