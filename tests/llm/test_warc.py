"""Archives are read back as they were written; segments are put together and verified."""

from __future__ import annotations

import base64
import hashlib

import pytest

from tidegauge.llm import queries, warc
from tidegauge.llm.common import shared_path

from ..oracle_tools import compare

PAGES = "page_id long, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least: int = 0):
    first: dict[bytes, int] = {}
    for page, _, payload in rows:
        if len(payload or b"") >= least:
            first[payload or b""] = min(page, first.get(payload or b"", page))
    out = []
    for page, url, payload in rows:
        own = payload or b""
        lead = first.get(own, page)
        out.append((page, url, digest(own), len(own), "response" if page == lead else "revisit", None if page == lead else lead, own if page == lead else None))
    return sorted(out, key=str)


ROWS = [
    (3, "http://a/1", b"<html>one</html>"), (1, "http://a/2", b"<html>one</html>"), (2, None, b"<html>two</html>"), (9, "http://b/x\r\ny", b""), (4, "http://c", None),
    (5, "http://d", bytes(range(256)) * 900), (6, "http://e", "Grüße 東京 ".encode() * 9000), (7, "http://f", bytes(range(256)) * 900), (8, "http://g", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
]


def read(df):
    return sorted(((r.page_id, r.target_uri, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 1000, "chunk_bytes": 300, "records_per_file": 2}, {"segment_bytes": 64, "chunk_bytes": 7}, {"min_bytes": 100}])
def test_round_trip(spark, options):
    rows = ROWS if options.get("segment_bytes") != 64 else [r for r in ROWS if len(r[2] or b"") < 1000]
    got = read(warc.archive_round_trip(spark.createDataFrame(rows, PAGES), **options))
    want = [(p, None if u is None else u.replace("\r", "%0D").replace("\n", "%0A"), *rest) for p, u, *rest in expected(rows, options.get("min_bytes", 0))]
    assert got == sorted(want, key=str)


def test_repeated_and_null_pages(spark):
    rows = [(1, "u", b"x" * 200_000), (1, "u", b"x" * 200_000), (None, "v", b"y"), (2, None, None)]
    df = warc.archive_round_trip(spark.createDataFrame(rows, PAGES + ""))
    assert sorted((str(r.page_id), r.record_type, r.payload_bytes) for r in df.collect()) == [("1", "response", 200_000), ("1", "response", 200_000), ("2", "response", 0), ("None", "response", 1)]


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_missing_segments_are_an_error(spark):
    path = shared_path(spark, "broken")
    warc.write_warc(spark.createDataFrame([(1, "u", b"z" * 5000)], PAGES), path, segment_bytes=1000)
    content = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    records = list(warc.records(content))
    assert [f.get(b"warc-segment-number") for f, _ in records] == [b"%d" % i for i in range(1, len(records) + 1)]
    assert int(records[-1][0][b"warc-segment-total-length"]) == sum(len(b) for _, b in records)
    assert {f[b"warc-segment-origin-id"] for f, _ in records[1:]} == {records[0][0][b"warc-record-id"]}
    cut = content.index(b"WARC/1.1", 10)
    gone = shared_path(spark, "gone")
    spark.createDataFrame([(content[:cut].decode("latin-1").removesuffix("\r\n\r\n"),)], "value string").write.option("lineSep", "\r\n\r\n").text(gone)
    with pytest.raises(Exception, match="segments of record 1"):
        warc.read_warc(spark, gone).collect()


def test_chunks():
    assert warc.unchunked(b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        warc.unchunked(b"4\r\nabc\r\n0\r\n\r\n")


def test_query_is_its_sql(spark, small):
    assert compare(spark, queries.op10_warc, queries.ORACLE_SQL["op10_warc"], small) == []
