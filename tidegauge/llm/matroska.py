"""Matroska media columns: writing PCM tracks, and parsing EBML into packet tables (operator 5)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches, texts_of

RATE = 8000
FRAME = 512
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 16
UNIT = 64

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
_NO_LACING, _XIPH, _FIXED, _EBML_LACING = range(4)
LACING = ("none", "xiph", "fixed", "ebml")


# ---------------------------------------------------------------- writing


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size; the all-ones value of each width is kept for unknown sizes."""
    n = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def element(number: int, data: bytes) -> bytes:
    return _id(number) + vint(len(data)) + data


def _uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _float(number: int, value: float) -> bytes:
    return element(number, struct.pack(">d", value))


_HEADER = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_TRACKS = element(TRACKS, element(0xAE, _uint(0xD7, 1) + _uint(0x73C5, 1) + _uint(0x83, 2) + element(0x86, b"A_PCM/INT/LIT") + element(0xE1, _float(0xB5, RATE) + _uint(0x9F, 1) + _uint(0x6264, 8))))


def _lace(frames: list[bytes], kind: int) -> bytes:
    """The lacing header of a block of several frames."""
    out = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == _XIPH:
        for n in sizes[:-1]:
            out += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == _EBML_LACING:
        out += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            d = b - a
            n = next(n for n in range(1, 9) if abs(d) < 1 << 7 * n - 1)
            out += vint(d + (1 << 7 * n - 1) - 1, n)
    return out


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file with the payload as one track of unsigned 8-bit PCM at 8 kHz.

    Frames of equal size share a block under fixed-size lacing, others under EBML or Xiph lacing;
    each cluster has a cue point. A block's time is 16 bits relative to its cluster's, so long frames
    make clusters of fewer blocks."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    info = element(INFO, _uint(0x2AD7B1, 1_000_000) + _float(0x4489, len(payload) * 1000 / RATE) + element(0x4D80, b"tidegauge") + element(0x5741, b"tidegauge"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    step = FRAMES_PER_BLOCK * max(1, min(BLOCKS_PER_CLUSTER, 0x7FFF * RATE // (1000 * FRAMES_PER_BLOCK * frame)))
    for c in range(0, len(frames), step):
        time = c * frame * 1000 // RATE
        body = [_uint(0xE7, time)]
        for b in range(c, min(c + step, len(frames)), FRAMES_PER_BLOCK):
            own = frames[b : b + FRAMES_PER_BLOCK]
            kind = _NO_LACING if len(own) == 1 else _FIXED if len(own[-1]) == frame else _XIPH if len(own) % 2 else _EBML_LACING
            head = b"\x81" + struct.pack(">hB", b * frame * 1000 // RATE - time, 0x80 | kind << 1)
            body.append(element(0xA3, b"".join([head, _lace(own, kind) if kind else b"", *own])))
        cues.append(element(0xBB, _uint(0xB3, time) + element(0xB7, _uint(0xF7, 1) + _uint(0xF1, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


# ---------------------------------------------------------------- parsing


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    length: int
    keyframe: bool
    cluster: int
    lacing: str


class Media(NamedTuple):
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    duration: float


def read_vint(data: bytes, at: int) -> tuple[int | None, int]:
    """A size and the place after it; None for the unknown size."""
    n = 9 - data[at].bit_length() if at < len(data) else 9
    if n > 8 or at + n > len(data):
        raise ValueError(f"no variable-length number at byte {at}")
    value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, first byte and end of the elements in a range. A cluster or segment of unknown size ends
    before the next element that can't be in it."""
    while at < end:
        n = 9 - data[at].bit_length()
        if n > 4:
            raise ValueError(f"no element id at byte {at}")
        number = int.from_bytes(data[at : at + n], "big")
        size, begin = read_vint(data, at + n)
        if size is None:
            stop = end if number == SEGMENT else _unknown_end(data, begin, end)
        else:
            stop = begin + size
        if stop > end:
            raise ValueError(f"element {number:#x} at byte {at} is longer than what holds it")
        yield number, begin, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        n = 9 - data[at].bit_length()
        if int.from_bytes(data[at : at + n], "big") in (CLUSTER, CUES, TRACKS, INFO, EBML, SEGMENT):
            return at
        size, begin = read_vint(data, at + n)
        if size is None:
            raise ValueError("nested unknown sizes")
        at = begin + size
    return end


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    return 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]


def _block(data: bytes, a: int, b: int, cluster_time: int, scale: int, cluster: int, key: bool | None, durations: dict[int, int]) -> list[Packet]:
    begin = a
    track, a = read_vint(data, a)
    if a + 3 > b or data[a + 2] & 6 and a + 4 > b:
        raise ValueError(f"the block at byte {begin} ends in its header")
    relative, flags = struct.unpack(">hB", data[a : a + 3])
    a += 3
    kind = flags >> 1 & 3
    if kind == _NO_LACING:
        sizes = [b - a]
    else:
        count, a = data[a] + 1, a + 1
        if kind == _FIXED:
            if (b - a) % count:
                raise ValueError("a fixed-size lace does not divide evenly")
            sizes = [(b - a) // count] * count
        else:
            sizes = []
            for i in range(count - 1):
                if a >= b:
                    raise ValueError(f"the block at byte {begin} ends in its lacing")
                if kind == _XIPH:
                    n = 0
                    while a < b - 1 and data[a] == 255:
                        n, a = n + 255, a + 1
                    n, a = n + data[a], a + 1
                elif not i:
                    n, a = read_vint(data, a)
                else:
                    width = 9 - data[a].bit_length()
                    raw, a = int.from_bytes(data[a : a + width], "big") & (1 << 7 * width) - 1, a + width
                    n = sizes[-1] + raw - ((1 << 7 * width - 1) - 1)
                sizes.append(n)
            sizes.append(b - a - sum(sizes))
            if min(sizes) < 0:
                raise ValueError("a lace is longer than its block")
    out, time = [], (cluster_time + relative) * scale
    for n in sizes:
        out.append(Packet(track, time, a, n, bool(flags & 0x80) if key is None else key, cluster, LACING[kind]))
        a += n
        time += n * 1_000_000_000 // durations[track] if track in durations else 0
    return out


def parse(data: bytes) -> Media:
    """Tracks, packets with byte ranges, and cue points of a Matroska file."""
    tracks: dict[int, dict] = {}
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    scale, duration, cluster = 1_000_000, 0.0, -1
    rates: dict[int, int] = {}  # bytes a second of PCM tracks, from which laced frames get their times
    top = list(_elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for number, a, b in top:
        if number != SEGMENT:
            continue
        base = a
        for kind, x, y in _elements(data, a, b):
            if kind == INFO:
                for k, p, q in _elements(data, x, y):
                    if k == 0x2AD7B1:
                        scale = _number(data, p, q)
                    elif k == 0x4489:
                        duration = _real(data, p, q)
            elif kind == TRACKS:
                for k, p, q in _elements(data, x, y):
                    if k != 0xAE:
                        continue
                    entry = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0}
                    for m, u, v in _elements(data, p, q):
                        if m == 0xD7:
                            entry["number"] = _number(data, u, v)
                        elif m == 0x83:
                            entry["type"] = _number(data, u, v)
                        elif m == 0x86:
                            entry["codec"] = data[u:v].decode("ascii", "replace")
                        elif m == 0xE1:
                            for n, r, s in _elements(data, u, v):
                                if n == 0xB5:
                                    entry["rate"] = _real(data, r, s)
                                elif n == 0x9F:
                                    entry["channels"] = _number(data, r, s)
                                elif n == 0x6264:
                                    entry["bits"] = _number(data, r, s)
                    tracks[entry["number"]] = entry
                    if entry["codec"].startswith("A_PCM") and entry["bits"]:
                        rates[entry["number"]] = max(1, int(entry["rate"] * entry["channels"] * entry["bits"] // 8))
            elif kind == CLUSTER:
                cluster, time = cluster + 1, 0
                for k, p, q in _elements(data, x, y):
                    if k == 0xE7:
                        time = _number(data, p, q)
                    elif k == 0xA3:
                        packets += _block(data, p, q, time, scale, cluster, None, rates)
                    elif k == 0xA0:
                        inner = list(_elements(data, p, q))
                        key = all(m != 0xFB for m, _, _ in inner)
                        for m, u, v in inner:
                            if m == 0xA1:
                                packets += _block(data, u, v, time, scale, cluster, key, rates)
            elif kind == CUES:
                for k, p, q in _elements(data, x, y):
                    if k == 0xBB:
                        time = 0
                        for m, u, v in _elements(data, p, q):
                            if m == 0xB3:
                                time = _number(data, u, v)
                            elif m == 0xB7:
                                found = {n: _number(data, r, s) for n, r, s in _elements(data, u, v)}
                                cues.append((time, found.get(0xF7, 0), base + found.get(0xF1, 0)))
    return Media(tracks, packets, cues, duration)


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p.offset : p.offset + p.length] for p in media.packets if p.track == track])


def feature(media: Media, payload: bytes) -> str:
    """What the container and its samples look like, in a string of fixed form."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    laced = ",".join(f"{k}:{n}" for k in LACING if (n := sum(p.lacing == k for p in media.packets)))
    crossings = int(np.count_nonzero(np.diff(np.signbit(samples))))
    return f"packets={len(media.packets)};clusters={len(media.cues)};lacing={laced};duration_ms={media.duration:.3f};mean={samples.mean():.6f};rms={np.sqrt((samples * samples).mean()):.6f};crossings={crossings}"


# ---------------------------------------------------------------- tables


def text_payload(text: bytes) -> bytes:
    """The text's bytes, filled with zeros to a positive multiple of UNIT."""
    return text + b"\0" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column: each text as a Matroska file.

    docs needs ``doc_id`` and ``text``; a null text counts as empty and becomes one unit of zeros;
    repeated rows and null ids stay as they are; an empty table gives no rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                texts = texts_of(part).cast(pa.large_binary()).to_pylist()
                media = pa.array([mux(text_payload(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKETS = "id long, track int, packet int, timestamp_ns long, byte_offset long, byte_length long, keyframe boolean, cluster int, lacing string, codec string"


def packet_table(media: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of each media value; null media have no packets, and the packets of a track
    that the file does not describe have no codec. A file cut short or malformed is an error."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                found = parse(data)
                rows = [(key, p.track, i, p.timestamp_ns, p.offset, p.length, p.keyframe, p.cluster, p.lacing, found.tracks.get(p.track, {}).get("codec")) for i, p in enumerate(found.packets)]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
                if rows:
                    yield from pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PACKETS.split(", ")]).to_batches(8192)

    return media.select(F.col(id_column).cast("long").alias("id"), F.col(column)).mapInArrow(run, PACKETS)


def read_back(media: DataFrame) -> DataFrame:
    """Payload digests and features of what the media column of ``to_media`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                found = parse(data)
                payload = payload_of(data, found)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(found, payload)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
