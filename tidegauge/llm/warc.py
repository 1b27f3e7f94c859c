"""WARC archives: writing records, and reading them back with segment reassembly (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_path, small_batches

#: A longer block is written as one record and its continuations, so no record is longer than this.
SEGMENT_BYTES = 64 << 10
#: With SEGMENT_BYTES this bounds an archive file to about 128 MB, which one read takes as a whole.
RECORDS_PER_FILE = 2048
CHUNK_BYTES = 16 << 10

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

READ_SCHEMA = "page_id long, target_uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, verified boolean"
_SEGMENT_SCHEMA = "page_id long, target_uri string, digest string, segment int, total long, block binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in bare upper-case base32: 160 bits are 32 digits without padding."""
    digits = F.sha1(payload)
    parts = []
    for i in range(8):  # five hexadecimal digits are four of base 32
        bits = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(31)
            parts.append(F.substring(F.lit(_ALPHABET), at + 1, F.lit(1)))
    return F.concat(*parts)


def _raw(text: Column) -> Column:
    return text.cast("binary")


def chunked(payload: Column, size: int = CHUNK_BYTES) -> Column:
    """A binary column in HTTP/1.1 chunked transfer framing."""
    count = F.ceil(F.octet_length(payload) / F.lit(size)).cast("int")
    pieces = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(
            _raw(F.lower(F.hex(F.least(F.lit(size), F.octet_length(payload) - i * size).cast("long")))),
            _raw(F.lit(_CRLF)),
            F.substring(payload, i * size + 1, F.lit(size)),
            _raw(F.lit(_CRLF)),
        ).cast("string"),
    )
    return F.concat(_raw(F.array_join(pieces, "")), _raw(F.lit("0\r\n\r\n")))


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with digest, record_type and refers_to.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page_id is the response. Only
    payloads that occur more than once are joined back, from a written table, so Spark knows its
    size before it chooses how to join.
    """
    spark = pages.sparkSession
    keyed = pages.withColumns({"_key": F.sha2("payload", 256), "_n": F.octet_length("payload")})
    again = keyed.filter(F.col("_n") >= min_bytes).groupBy("_key").agg(F.min("page_id").alias("_first"), F.count("*").alias("_copies")).filter("_copies > 1").drop("_copies")
    again = materialise(again, "warc-repeats").withColumn("_known", F.lit(True))
    joined = keyed.join(again, "_key", "left")
    revisit = F.coalesce(F.col("_known") & (F.col("_n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False))
    return joined.select(
        "page_id", "url", "payload",
        base32_sha1(F.col("payload")).alias("digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a record per row of pages (page_id long, url string, payload binary) as WARC 1.1 files.

    Spark's own text writer puts the bytes down with the record separator as line separator, so any
    file system that Spark writes to will do, and a lost task is simply written again. A block over
    ``segment_bytes`` goes to continuation records that name their origin and segment number. A
    revisit holds the response's HTTP head alone and is one record. A null payload counts as empty; a null url leaves
    its header out; line ends in a url are escaped. A null page_id is the smallest only among nulls.
    Rows with the same page_id and payload are all of the same type.
    """
    known = roles(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("payload", F.lit(b"")).alias("payload")), min_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    is_revisit = F.col("record_type") == "revisit"
    block = F.when(is_revisit, _raw(F.concat(F.lit(_HEAD + "Content-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n")))).otherwise(
        F.concat(_raw(F.lit(_HEAD + "Transfer-Encoding: chunked\r\n\r\n")), chunked(F.col("payload"), chunk_bytes))
    )
    cut = known.withColumn("block", block).withColumn("_segments", F.when(is_revisit, 1).otherwise(F.ceil(F.octet_length("block") / F.lit(segment_bytes)).cast("int")))
    parts = cut.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_segments") - 1))).withColumn("part", F.when(F.col("_segments") == 1, F.col("block")).otherwise(F.substring(F.col("block"), F.col("_at") * segment_bytes + 1, F.lit(segment_bytes))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    optional = lambda on, name, value: F.when(on, line(name, value)).otherwise("")
    many, first = F.col("_segments") > 1, F.col("_at") == 0
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, urn(F.col("page_id"))).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":segment:"), (F.col("_at") + 1).cast("string"), F.lit(">")))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        optional(F.col("url").isNotNull(), "WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        optional(is_revisit, "WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        optional(is_revisit, "WARC-Refers-To", urn(F.col("refers_to"))),
        optional(many, "WARC-Segment-Number", (F.col("_at") + 1).cast("string")),
        optional(many & ~first, "WARC-Segment-Origin-ID", urn(F.col("page_id"))),
        optional(many & (F.col("_at") == F.col("_segments") - 1), "WARC-Segment-Total-Length", F.octet_length("block").cast("string")),
        optional(first, "Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("part").cast("string")),
        F.lit(_CRLF),
    )
    record = F.concat(_raw(head), F.col("part")).cast("string")
    parts.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


_PAGE = re.compile(rb"<urn:page:(-?\d+|none)")


def _page(value: bytes | None) -> int | None:
    found = _PAGE.match(value or b"")
    return None if not found or found[1] == b"none" else int(found[1])


def records(content: bytes) -> Iterator[tuple[dict[bytes, bytes], memoryview]]:
    """Header fields (lower-case names) and block of each record of an archive."""
    view, at = memoryview(content), 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        begin = end + 4
        at = begin + int(fields[b"content-length"])
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {begin} does not end where its length says")
        yield fields, view[begin:at]
        at += 4


def unchunked(body: bytes) -> bytes:
    """Decodes chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        at += size + 2


def http_payload(block: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return (unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body), fields


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _row(page_id, uri, digest: str, block: bytes) -> tuple:
    payload = http_payload(block)[0]
    own = digest32(payload)
    return page_id, uri, "response", None, own, len(payload), payload, own == digest


_READ = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("verified", pa.bool_())])
_SEGMENTS = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("digest", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _parse(segmented: bool):
    """Reads whole records, or else the segments of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in records(content.as_py()):
                    if (b"warc-segment-number" in fields) != segmented:
                        continue
                    origin = fields.get(b"warc-segment-origin-id", fields[b"warc-record-id"])
                    page, uri = _page(origin), fields.get(b"warc-target-uri")
                    uri = uri if uri is None else uri.decode("utf-8", "replace")
                    digest = fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                    held += len(block)
                    if segmented:
                        total = fields.get(b"warc-segment-total-length")
                        rows.append((page, uri, digest, int(fields[b"warc-segment-number"]), total and int(total), bytes(block)))
                    elif fields[b"warc-type"] == b"revisit":
                        length = int(http_payload(bytes(block))[1][b"content-length"])
                        rows.append((page, uri, "revisit", _page(fields[b"warc-refers-to"]), digest, length, None, True))
                    else:
                        rows.append(_row(page, uri, digest, bytes(block)))
                    if held > 4 << 20:
                        yield _batch(rows, _SEGMENTS if segmented else _READ)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, _SEGMENTS if segmented else _READ)

    return run


def _joined(key: tuple[pa.Scalar, ...], segments: pa.Table) -> pa.Table:
    """Puts the segments of one record together and verifies their number and total length."""
    rows = sorted(segments.to_pylist(), key=lambda r: r["segment"])
    block, total = b"".join(r["block"] for r in rows), rows[-1]["total"]
    if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or total != len(block):
        raise ValueError(f"the segments of record {rows[0]['page_id']} hold {len(block)} bytes of {total}")
    row = _row(rows[0]["page_id"], rows[0]["target_uri"], rows[0]["digest"], block)
    return pa.Table.from_batches([_batch([row] * rows[0]["copies"], _READ)])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record that ``write_warc`` was given, in READ_SCHEMA.

    ``payload`` is null for revisits; ``payload_digest`` is computed from a response's decoded
    payload, and ``verified`` tells whether its header says the same. Files are read whole, one at a
    time. Only segments are shuffled, by origin and digest; a group is the segments of one record.
    Segments that are missing or too short raise an error. An archive without records gives no rows.
    """
    small_batches(spark)  # bounds a batch's bytes: most files fill one by themselves
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(_parse(False), READ_SCHEMA)
    segments = files.mapInArrow(_parse(True), _SEGMENT_SCHEMA)
    single = segments.groupBy("page_id", "digest", "segment").agg(F.first("target_uri").alias("target_uri"), F.max("total").alias("total"), F.first("block").alias("block"), F.count("*").cast("int").alias("copies"))
    return whole.unionByName(single.groupBy("page_id", "digest").applyInArrow(_joined, READ_SCHEMA))


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to archives in the shared folder and returns what ``read_warc`` finds there.

    An empty table gives archives without records and no rows."""
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
