"""Matroska files by round trip and by hand; URL rules against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import matroska as mk
from tidegauge.llm import queries
from tidegauge.llm import url_rules as ur

from .helpers import DOCS, ODD, documents, table


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=20_000), st.sampled_from([1, 7, 64, 300, 512]))
def test_round_trip(payload, frame):
    if len(payload) / frame > 3000:
        payload = payload[: 3000 * frame]
    data = mk.mux(payload, frame)
    media = mk.parse(data)
    assert mk.payload_of(data, media) == payload
    assert len(media.packets) == -(-len(payload) // frame)
    assert [p.timestamp_ns for p in media.packets] == sorted(p.timestamp_ns for p in media.packets)
    assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    for _, track, place in media.cues:
        assert track == 1 and data[place : place + 4] == bytes.fromhex("1F43B675")


@settings(max_examples=100, deadline=None)
@given(st.integers(0, (1 << 56) - 2))
def test_variable_lengths(n):
    coded = mk.vint(n)
    assert mk.read_vint(coded, 0) == (n, len(coded))
    assert mk.read_vint(mk.vint(5, 4), 0) == (5, 4)


def block(kind: int, frames: list[bytes]) -> bytes:
    return b"\x81" + (3).to_bytes(2, "big") + bytes([0x80 | kind << 1]) + (mk._lace(frames, kind) if kind else b"") + b"".join(frames)


@pytest.mark.parametrize("kind,frames", [(0, [b"abc"]), (1, [b"a" * 600, b"b" * 255, b"", b"c"]), (2, [b"ab", b"cd", b"ef"]), (3, [b"a" * 500, b"b" * 20, b"c" * 900, b"d"])])
def test_lacing(kind, frames):
    data = block(kind, frames)
    packets = mk._block(data, 0, len(data), 40, 1_000_000, 0, None, {})
    assert [data[p.offset : p.offset + p.length] for p in packets] == frames
    assert {(p.track, p.timestamp_ns, p.keyframe, p.lacing) for p in packets} == {(1, 43_000_000, True, mk.LACING[kind])}


def test_block_groups_and_unknown_sizes():
    group = mk.element(0xA0, mk.element(0xA1, block(0, [b"xyz"])) + mk._uint(0xFB, 1))
    cluster = mk._uint(0xE7, 40) + group
    body = mk.element(mk.INFO, mk._uint(0x2AD7B1, 1_000_000)) + mk._TRACKS
    open_ended = mk._HEADER + mk._id(mk.SEGMENT) + b"\xff" + body + mk._id(mk.CLUSTER) + b"\xff" + cluster + mk._id(mk.CLUSTER) + b"\xff" + cluster
    media = mk.parse(open_ended)
    assert [(p.timestamp_ns, p.keyframe, p.cluster) for p in media.packets] == [(43_000_000, False, 0), (43_000_000, False, 1)]
    assert mk.payload_of(open_ended, media) == b"xyzxyz"


def test_broken_files():
    whole = mk.mux(b"q" * 3000)
    for bad in (b"", b"\x00" * 20, whole[:-10], whole[4:], *(whole[:n] for n in range(0, len(whole), 97))):
        with pytest.raises(ValueError):
            mk.parse(bad)
    cluster = lambda data: mk._HEADER + mk.element(mk.SEGMENT, mk._TRACKS + mk.element(mk.CLUSTER, mk._uint(0xE7, 0) + mk.element(0xA3, data)))
    for cut in (b"\x81", b"\x81\x00\x00", b"\x81\x00\x00\x82", b"\x81\x00\x00\x82\x03", b"\x81\x00\x00\x82\x01\xff\xff", b"\x81\x00\x00\x86\x02\x40"):
        with pytest.raises(ValueError):
            mk.parse(cluster(cut))


@pytest.mark.parametrize("frame", [2_300, 30_000, 200_000])
def test_long_frames(frame):
    """A block's time is 16 bits: clusters end before it runs over."""
    payload = bytes(range(256)) * 4000
    data = mk.mux(payload, frame)
    media = mk.parse(data)
    assert mk.payload_of(data, media) == payload
    assert all(abs(p.timestamp_ns - k * frame * 1_000_000_000 // mk.RATE) <= 1_000_000 for k, p in enumerate(media.packets))


def test_packets_of_a_track_that_is_not_described(spark):
    data = mk._HEADER + mk.element(mk.SEGMENT, mk.element(mk.CLUSTER, mk._uint(0xE7, 5) + mk.element(0xA3, b"\x85\x00\x01\x80abc")))
    row = mk.packet_table(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).collect()
    assert [(r.track, r.byte_length, r.timestamp_ns, r.codec) for r in row] == [(5, 3, 6_000_000, None)]


def test_media_of_documents(spark):
    rows = [*documents(6, 10), (None, "x"), (1, "twice"), (1, "twice")]
    got = sorted(mk.read_back(mk.to_media(table(spark, rows))).collect(), key=str)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    assert len({(r.payload_sha256, r.media_sha256, r.feature, r.media_bytes) for r in got}) == len({r.payload_sha256 for r in got})


def test_packets_of_documents(spark):
    media = mk.to_media(table(spark, [(1, "a" * 10_000), (2, None)]))
    rows = mk.packet_table(media).orderBy("id", "packet").collect()
    assert [r.packet for r in rows if r.id == 1] == list(range(20))
    assert sum(r.byte_length for r in rows if r.id == 1) == 10_048
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    assert b"".join(stored[1][r.byte_offset : r.byte_offset + r.byte_length] for r in rows if r.id == 1) == b"a" * 10_000 + b"\0" * 48
    assert mk.packet_table(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0
    assert mk.to_media(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- URLs

URLS = [None, "", "nothing", "http://", "http://Example.COM/en/7/x?q=1#f", "https://sub.example.com/en/9", "ftp://com/en/", "http://xcom/en/", "http://a.net/de/1", "http://example.net/de/8?x", "http://www.example.net/de/81", "http://org/es/", "http://a.org?/es/", "http://a.org#/es/", "a://b://c/d", "http://a.com/en", "http://ÄÖ.com/en/ü", "://h/p", "http://h?x/y", "http://user@a.com:80/en/x"]


def plain(url: str | None) -> tuple[str, str, str | None, str | None]:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in ur.FIXED:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best and best[1], best and best[0]


def test_fixed_rules(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: r for r in ur.judge(rows, ur.Rules([], [], {})).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain(url)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), url


def labelled(n: int = 300):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        host, part, query = rng.choice(["a.info", "b.biz", "c.io"]), rng.choice(["casino", "news", "shop"]), rng.choice(["", "?ref=spam", "?id=1"])
        blocked = (part == "casino" and host == "b.biz") or (query == "?ref=spam" and host == "a.info")
        rows.append((i, f"http://{host}/{part}/{i}{query}", blocked))
    return rows


def test_mined_rules(spark):
    rows = labelled()
    rules = ur.mine(spark.createDataFrame(rows, "page_id long, url string, blocked boolean"))
    assert rules.sets
    for s, sure in zip(rules.sets, rules.confidence, strict=True):
        hit = [b for _, u, b in rows if s <= ur.url_tokens(u)]
        assert sure == pytest.approx(sum(hit) / len(hit)) and sure >= 0.6
    for _, u, b in rows:  # the index finds what a look at every rule finds
        own = ur.url_tokens(u)
        assert rules.score(u) == max((c for s, c in zip(rules.sets, rules.confidence, strict=True) if s <= own), default=0.0)
        assert (rules.score(u) > 0.9) == b


def test_no_rule_is_missed(spark):
    """All sets of tokens that any blocked URL has, counted one by one."""
    rng = random.Random(4)
    rows = labelled(200) + [(1000 + i, "http://very.long.host.io/" + "/".join(["casino", "same", "path", "for", "all", "copies", "of", "one", "page"]), True) for i in range(25)]
    rows += [(2000 + i, f"https://c.io/{rng.choice(['news', 'casino'])}/{i}", rng.random() < 0.3) for i in range(100)]
    where: dict = {}
    for i, (_, u, _) in enumerate(rows):
        for x in ur.url_tokens(u):
            where.setdefault(x, []).append(i)
    first: dict = {}
    for x in sorted(where):
        first.setdefault(tuple(where[x]), x)
    urls = [(frozenset(x for x in ur.url_tokens(u) if first[tuple(where[x])] == x), b) for _, u, b in rows]
    sets = {frozenset(c) for t, b in urls if b for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)}
    sure = {}
    for s in sets:
        bad, clean = (sum(s <= t for t, b in urls if b == k) for k in (True, False))
        if bad >= 20:
            sure[s] = bad / (bad + clean)
    want = {s for s, c in sure.items() if c >= 0.6 and not any(sure[o] >= c for o in sure if o < s)}
    rules = ur.mine(spark.createDataFrame(rows, "page_id long, url string, blocked boolean"))
    assert set(rules.sets) == want and len(rules.sets) == len(want)


def test_odd_labels(spark):
    schema = "page_id long, url string, blocked boolean"
    assert ur.mine(spark.createDataFrame([], schema)).sets == []
    assert ur.mine(spark.createDataFrame([(1, "http://a/b", False), (2, None, None)], schema)).sets == []
    rules = ur.mine(spark.createDataFrame([(None, None, True), (1, "", True), (1, "http://a.b/cc", True), (1, "http://a.b/cc", True), (2, "http://d.e/ff", False)], schema), confidence=0.9, least_pages=2)
    assert rules.score("http://a.b/cc") > 0 and rules.score("http://d.e/gg") == 0
    assert ur.judge(spark.createDataFrame([], "page_id long, url string, score string"), rules).count() == 0
    long = "http://x.com/" + "y/" * 50_000
    assert ur.judge(spark.createDataFrame([(None, long, 1), (3, long, 2), (3, long, 2)], "page_id long, url string, verdict int"), rules).count() == 3


def test_query_judges_every_page(spark, small):
    rows = queries.op6_url_rules(spark, small).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict


def test_odd_texts_have_media():
    for t in ODD:
        payload = mk.text_payload((t or "").encode())
        data = mk.mux(payload)
        assert mk.payload_of(data, mk.parse(data)) == payload
