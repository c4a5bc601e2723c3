"""Media columns in the Ogg container.

Writing: a payload is cut into packets of 8-bit samples, dealt in turn to several
logical streams. Each stream has a header packet on a page of its own (begin of
stream) and data pages of at most 255 lacing values; a packet may span pages. The
streams' pages are interleaved by time. A page's granule position is the number of
samples of its stream that are complete with it.

Reading verifies the checksum of every page, reassembles packets from the lacing
values, tells the logical streams apart by serial number, checks page sequences, and
derives each packet's end time from the granule position of the page it ends on and
the samples of the packets after it on that page. Any Ogg file can be read that way;
samples are put together again in order of time. Faults raise OggError; the
operator media_features turns them into a feature `error:...` and null payload.

Null and empty texts are one padded unit. Everything follows from the text alone:
equal texts give equal media. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNIT = 192
RATE = 8000
STREAMS = 2
PACKET = 5 * UNIT
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sBBIIQ")  # magic, version, stream number, streams, rate, samples of the stream
MAGIC = b"KLPCM8\0\0"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """What is wrong with an Ogg file."""


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, most significant bit first, start 0, no final
    xor: zlib's CRC works from the other end, so bits are reversed before and after."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    c = checksum(head + lacing + body)
    return head[:22] + struct.pack("<I", c) + head[26:] + lacing + body


def _stream_pages(serial: int, ident: bytes, packets: list[bytes]) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream."""
    out = [(0, _page(FIRST, 0, serial, 0, bytes([len(ident)]), ident))]
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body = b"".join(packets)
    at, done, open_ = 0, 0, False
    for number, i in enumerate(range(0, len(lacing), 255), 1):
        part = lacing[i : i + 255]
        size = sum(part)
        last = max((k for k, x in enumerate(part) if x < 255), default=-1)
        done = at + sum(part[: last + 1]) if last >= 0 else done
        flags = CONTINUED * open_ | LAST * (i + 255 >= len(lacing))
        out.append((done if last >= 0 else -1, _page(flags, done if last >= 0 else -1, serial, number, part, body[at : at + size])))
        at, open_ = at + size, part[-1] == 255
    if len(out) == 1:
        out.append((0, _page(LAST, 0, serial, 1, b"", b"")))
    return out


def mux(payload: bytes, streams: int = STREAMS, packet: int = PACKET, rate: int = RATE) -> bytes:
    packets = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    base = zlib.crc32(payload) & 0xFFFFFF00
    made = []
    for k in range(streams):
        own = packets[k::streams]
        ident = _IDENT.pack(MAGIC, 1, k, streams, rate, sum(map(len, own)))
        made.append(_stream_pages(base | k, ident, own))
    out = [pages[0][1] for pages in made]  # all first pages come before any data page
    rest = []
    for k, pages in enumerate(made):
        high = 0
        for g, page in pages[1:]:
            high = max(high, g)
            rest.append((high, k, page))
    rest.sort(key=lambda x: x[:2])
    return b"".join([*out, *(page for _, _, page in rest)])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: end of each packet on the stream's own clock, in samples; None without a granule position
    ends: list[int | None] = field(default_factory=list)
    pages: int = 0
    closed: bool = False
    _part: list[bytes] = field(default_factory=list)
    _next: int = 0


def demux(data: bytes) -> list[Stream]:
    """The logical streams of an Ogg file, in order of appearance."""
    found: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise OggError(f"page at byte {at} is cut off or of another version")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        s = found.get(serial)
        if flags & FIRST:
            if s:
                raise OggError(f"stream {serial} begins twice")
            s = found[serial] = Stream(serial)
        if s is None or s.closed or number != s._next or bool(flags & CONTINUED) != bool(s._part):
            raise OggError(f"page {number} of stream {serial} is out of order")
        s._next, s.pages, s.closed = number + 1, s.pages + 1, bool(flags & LAST)
        here, pos, start, size = [], at + 27 + n, at + 27 + n, 0
        for x in lacing:
            size += x
            if x < 255:
                here.append(b"".join([*s._part, data[start : start + size]]))
                s._part, start, size = [], start + size, 0
        if size:
            s._part.append(data[start : start + size])
        # The granule position is the end of the last packet that ends here; those before it end earlier by what follows them.
        clock: list[int | None] = []
        back = granule
        for p in reversed(here):
            clock.append(back if granule >= 0 else None)
            back -= len(p)
        s.packets += here
        s.ends += clock[::-1]
        at = end
    for s in found.values():
        if s._part or not s.closed:
            raise OggError(f"stream {s.serial} has no end")
    return list(found.values())


def read_payload(data: bytes) -> tuple[bytes, str]:
    """The samples in order of time, and a line of features of the container."""
    streams = demux(data)
    timed = []
    for s in streams:
        magic, version, k, n, rate, total = _IDENT.unpack(s.packets[0])
        if magic != MAGIC or version != 1 or n != len(streams) or not rate:
            raise OggError(f"header of stream {s.serial}")
        body, ends = s.packets[1:], s.ends[1:]
        if sum(map(len, body)) != total or (ends and ends[-1] != total):
            raise OggError(f"granule positions of stream {s.serial}")
        # packets of all streams are of one length but for the last, so start times give the turn
        timed += [((e or 0) - len(p), k, p) for p, e in zip(body, ends)]
    timed.sort(key=lambda x: x[:2])
    payload = b"".join(p for _, _, p in timed)
    seconds = max((e for s in streams for e in s.ends[1:] if e is not None), default=0) / rate
    level = sum(payload) / max(1, len(payload))
    return payload, f"ogg;streams={len(streams)};pages={sum(s.pages for s in streams)};packets={len(timed)};seconds={seconds:.6f};mean={level:.6f}"


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as an Ogg file."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            raw = [x.encode() for x in b.column(b.schema.get_field_index("text")).fill_null("").to_pylist()]
            media = pa.array([mux(padded(x)) for x in raw], pa.large_binary()).cast(pa.binary())
            yield pa.record_batch([b.column(b.schema.get_field_index("doc_id")), pa.array([len(x) for x in raw], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests of the stored bytes and of the payload read back from them."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(data):
        try:
            payload, feature = read_payload(data)
        except (OggError, struct.error, IndexError) as e:
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), f"error:{e}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index("media"))
            got = [one(x.as_py() or b"") for x in col]
            rest = [pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)]
            yield pa.record_batch([b.column(b.schema.get_field_index(c)) for c in names[:2]] + rest, names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
