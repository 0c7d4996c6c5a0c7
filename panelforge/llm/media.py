"""Ogg containers in a binary column: written, checked, taken apart.

A file holds logical streams, each a chain of pages with its own serial number. A page has a
header, up to 255 lacing values and their bytes; 255 means that the packet goes on. The checksum
is a CRC-32 with polynomial 0x04C11DB7 that isn't reflected; it is had from the reflected
one of zlib over bit-reversed bytes. Times come from granule positions: samples so far.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, prepare, spread, texts_of

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
UNKNOWN = -1  # granule position of a page on which no packet ends
SAMPLE_MAGIC, NOTE_MAGIC = b"pcm8\0\0\0\0", b"note\0\0\0\0"
RATE, PACKET = 8000, 4096  # samples a second, samples in a packet


def page_checksum(page: bytes) -> int:
    """The checksum of a page whose checksum field is zero."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{raw:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    check = page_checksum(head + body)
    return head[:22] + struct.pack("<I", check) + head[26:] + body


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of a logical stream of (packet, granule position at its end). The first packet has a page of its own."""
    out: list[bytes] = []
    lacing, body, granule, went_on = bytearray(), bytearray(), UNKNOWN, False

    def flush(goes_on: bool, last: bool = False) -> None:
        nonlocal lacing, body, granule, went_on
        flags = CONTINUED * went_on | FIRST * (not out) | LAST * last
        out.append(_page(flags, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, went_on = bytearray(), bytearray(), UNKNOWN, goes_on

    for k, (packet, at) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while values:
            take = values[: 255 - len(lacing)]
            values = values[len(take) :]
            size = sum(take)
            lacing += take
            body += packet[done : done + size]
            done += size
            if not values:
                granule = at
            if len(lacing) == 255 and (values or k + 1 < len(packets)):
                flush(bool(values))
        if k == 0 or k + 1 == len(packets):
            flush(False, k + 1 == len(packets))
    return out


def write_ogg(payload: bytes, serial: int = 1, rate: int = RATE, packet: int = PACKET) -> bytes:
    """A file with the payload as unsigned 8-bit samples in one logical stream and its length as a note in another, interleaved."""
    head = (SAMPLE_MAGIC + struct.pack("<IB", rate, 8), 0)
    sound = pages_of([head, *((payload[k : k + packet], min(k + packet, len(payload))) for k in range(0, len(payload), packet))], serial)
    note = pages_of([(NOTE_MAGIC + struct.pack("<Q", len(payload)), 0), (b"samples", len(payload))], serial + 1)
    return b"".join([sound[0], note[0], *sound[1:-1], note[1], *sound[1:][-1:]])


@dataclass
class Stream:
    """A logical stream: whole packets, the time at which each page's last packet ends, and what was wrong."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of pages on which a packet ends
    pages: int = 0
    bad_pages: int = 0
    lost_pages: int = 0
    ended: bool = False
    _open: list[bytes] | None = None
    _next: int = 0

    def seconds(self, rate: int) -> list[float]:
        return [g / rate for g in self.granules]


def raw_pages(data: bytes) -> Iterator[tuple[bool, int, int, int, int, bytes, bytes]]:
    """(checksum holds, flags, granule, serial, number, lacing, body); bytes that are no page are passed over."""
    at = 0
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        _, version, flags, granule, serial, number, check, n = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            at += 4
            continue
        page = data[at:end]
        holds = page_checksum(page[:22] + bytes(4) + page[26:]) == check
        yield holds, flags, granule, serial, number, lacing, page[27 + n :]
        at = end if holds else at + 4


def read_ogg(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number. Pages with wrong checksums are left out, and the packets that they break."""
    streams: dict[int, Stream] = {}
    for holds, flags, granule, serial, number, lacing, body in raw_pages(data):
        s = streams.setdefault(serial, Stream(serial))
        s.pages += 1
        if not holds:
            s.bad_pages += 1
            continue
        if number != s._next:
            s.lost_pages += max(0, number - s._next)
            s._open = None
        s._next = number + 1
        if not flags & CONTINUED:
            s._open = []
        at, ends = 0, False
        for v in lacing:
            if s._open is not None:
                s._open.append(body[at : at + v])
            at += v
            if v < 255:
                if s._open is not None:
                    s.packets.append(b"".join(s._open))
                    ends = True
                s._open = []
        if ends and granule != UNKNOWN:
            s.granules.append(granule)
        s.ended |= bool(flags & LAST)
    return streams


def samples_of(data: bytes) -> tuple[bytes, int, Stream] | None:
    """The samples, the rate and the stream of the first sound stream whose header holds."""
    for s in read_ogg(data).values():
        if s.packets and s.packets[0][:8] == SAMPLE_MAGIC and len(s.packets[0]) == 13:
            rate, _ = struct.unpack("<IB", s.packets[0][8:])
            return b"".join(s.packets[1:]), rate, s
    return None


def features(samples: bytes, rate: int, stream: Stream) -> str:
    """Length, level and zero crossings of the samples, and the stream's pages and packets."""
    x = np.frombuffer(samples, np.uint8)
    high = x >= 128
    mean = int(x.sum(dtype=np.int64)) / max(1, len(x))
    energy = int((x.astype(np.int32) - 128).astype(np.int64).__pow__(2).sum()) / max(1, len(x))
    crossings = int((high[1:] != high[:-1]).sum())
    end = stream.seconds(rate)[-1] if stream.granules else 0.0
    return f"seconds={end:.6f};mean={mean:.6f};rms={energy**0.5:.6f};crossings={crossings};pages={stream.pages};packets={len(stream.packets)};bad={stream.bad_pages}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as 8-bit samples in an Ogg file, read back: sizes, digests and features.

    A null text is empty; the payload is padded with zero bytes to a positive multiple of 64. Equal texts
    give equal values, repeated rows repeat theirs; a very long text is one file; an empty table gives no rows; other columns are pruned. A file that doesn't read back whole raises an error instead of giving a row.
    """
    prepare(docs.sparkSession)

    def row(doc: int, text: bytes) -> tuple:
        file = write_ogg(text + bytes(-len(text) % 64 or 64 * (not text)))
        samples, rate, stream = samples_of(file)
        if stream.bad_pages or stream.lost_pages or not stream.ended or stream.granules[-1] != len(samples):
            raise ValueError(f"document {doc}: its file doesn't read back whole")
        return doc, len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(file), hashlib.sha256(file).hexdigest(), features(samples, rate, stream)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for ids, texts in chunks(batches):
            columns = zip(*map(row, ids, texts), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return spread(texts_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
