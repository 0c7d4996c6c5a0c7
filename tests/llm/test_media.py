from __future__ import annotations

import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import media


def slow_checksum(data: bytes) -> int:
    c = 0
    for byte in data:
        c ^= byte << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@given(st.binary(max_size=300))
def test_checksum(data):
    assert media.page_checksum(data) == slow_checksum(data)


@settings(deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 700))
def test_round_trip(payload, packet):
    file = media.write_ogg(payload, packet=packet)
    samples, rate, stream = media.samples_of(file)
    assert samples == payload and rate == media.RATE and not stream.bad_pages and not stream.lost_pages
    assert stream.granules[-1] == len(payload) and stream.ended
    assert stream.granules == sorted(stream.granules)
    assert len(media.read_ogg(file)) == 2


@pytest.mark.parametrize("size", [0, 254, 255, 256, 510, 255 * 255 - 1, 255 * 255, 255 * 255 + 1, 200_000])
def test_lacing_bounds(size):
    packet = bytes(k % 251 for k in range(size))
    pages = media.pages_of([(b"head", 0), (packet, size), (b"", size)], 9)
    (stream,) = media.read_ogg(b"".join(pages)).values()
    assert stream.packets == [b"head", packet, b""]


def test_interleaved_streams_and_times():
    a = media.pages_of([(b"a", 0), (b"a1" * 300, 800), (b"a2" * 300, 1600)], 1)
    b = media.pages_of([(b"b", 0), (b"b1" * 40_000, 5)], 2)
    mixed = b"".join(x for k in range(max(len(a), len(b))) for x in (a[k : k + 1] + b[k : k + 1]))
    streams = media.read_ogg(mixed)
    assert streams[1].packets == [b"a", b"a1" * 300, b"a2" * 300] and streams[2].packets == [b"b", b"b1" * 40_000]
    assert streams[1].seconds(8000)[-1] == 0.2 and streams[2].granules == [0, 5]


def test_damage_is_found():
    file = bytearray(media.write_ogg(bytes(range(256)) * 2000))
    file[70_000] ^= 1
    stream = media.read_ogg(bytes(file))[1]
    assert stream.bad_pages == 1 and stream.lost_pages == 1
    assert b"".join(stream.packets[1:]) != bytes(range(256)) * 2000
    assert media.read_ogg(b"no pages here OggS") == {}


def test_query_values(spark):
    rows = [(1, "abc"), (2, None), (3, "x" * 64), (4, "é" * 100_000)]
    got = {r["doc_id"]: r for r in media.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.write_ogg(payload)).hexdigest()
    assert struct.unpack("<I", media.write_ogg(b"")[22:26])[0]
