from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest

from cohortlake.llm import isomedia as iso

from .conftest import ODD


def test_round_trip():
    r = random.Random(1)
    for n in [0, 1, 191, 192, 193, iso.CHUNK - 1, iso.CHUNK, iso.CHUNK + 1, 2 * iso.CHUNK, 5 * iso.CHUNK + 7]:
        payload = iso.padded("".join(chr(r.choice([97, 98, 233])) for _ in range(n)))
        data = iso.wrap(payload)
        (t,) = iso.tracks(data)
        assert iso.payload(data, t) == payload and len(payload) % 192 == 0 and len(payload) >= 192
        assert (t.codec, t.timescale, t.duration, t.samples) == ("raw", 8000, len(payload), len(payload))
        assert t.keyframes == t.spans == [(len(data) - len(payload), len(data))]


def video(wide=False, listed=True, sync=(1, 4)):
    """Two interleaved tracks: five frames of listed sizes in three chunks, and fixed-size samples between them."""
    sizes = [10, 3, 7, 10, 2]
    frames = [bytes([k]) * n for k, n in enumerate(sizes)]
    sound = [b"A" * 4, b"B" * 4]
    body = frames[0] + frames[1] + sound[0] + frames[2] + frames[3] + sound[1] + frames[4]
    head = iso.box(b"ftyp", b"isom", bytes(4)) + struct.pack(">I4sQ", 1, b"mdat", len(body) + 16) + body
    at = len(head) - len(body)
    chunks = [at, at + 17, at + 38]

    def track(codec, stsc, stsz, offsets, extra=b"", version=0):
        mdhd = iso.full(b"mdhd", struct.pack(">QQIQ", 0, 0, 90000, 1 << 33), bytes(4), version=1) if version else iso.full(b"mdhd", struct.pack(">IIII", 0, 0, 600, 1200), bytes(4))
        place = iso.full(b"co64", struct.pack(f">I{len(offsets)}Q", len(offsets), *offsets)) if wide else iso.full(b"stco", struct.pack(f">I{len(offsets)}I", len(offsets), *offsets))
        stsd = iso.full(b"stsd", struct.pack(">I", 1), iso.box(codec, bytes(8)))
        stbl = iso.box(b"stbl", stsd, iso.full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)), stsz, place, extra)
        return iso.box(b"trak", iso.box(b"mdia", mdhd, iso.box(b"minf", stbl)))

    stsz = iso.full(b"stsz", struct.pack(">II5I", 0, 5, *sizes))
    stss = iso.full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)) if sync else b""
    moov = iso.box(b"moov", track(b"avc1", [(1, 2, 1), (3, 1, 1)], stsz, chunks, stss, version=1), iso.box(b"free", b"x"), track(b"mp4a", [(1, 1, 1)], iso.full(b"stsz", struct.pack(">II", 4, 2)), [at + 13, at + 34]))
    return head + moov, frames, sound, at


@pytest.mark.parametrize("wide", [False, True])
def test_sample_tables(wide):
    data, frames, sound, at = video(wide)
    v, a = iso.tracks(data)
    assert (v.codec, v.timescale, v.duration, v.samples, a.codec, a.duration) == ("avc1", 90000, 1 << 33, 5, "mp4a", 1200)
    assert iso.payload(data, v) == b"".join(frames) and iso.payload(data, a) == b"".join(sound)
    assert v.keyframes == [(at, at + 10), (at + 24, at + 34)]
    assert iso.tracks(video(wide, sync=())[0])[0].keyframes == v.spans


def test_last_box_reaches_the_end():
    payload = iso.padded("abc")
    data = iso.wrap(payload)
    at = len(data) - len(payload) - 8
    open_ = data[:at] + struct.pack(">I4s", 0, b"mdat") + payload
    assert iso.payload(open_, iso.tracks(open_)[0]) == payload
    assert [p[-1] for p, _, _ in iso.walk(data)][:3] == [b"ftyp", b"moov", b"mvhd"]


def test_index_of_broken_containers(spark):
    data = video()[0]
    rows = [(1, bytearray(data)), (2, None), (3, bytearray(b"junk")), (4, bytearray(data[:60])), (5, bytearray(b"")), (6, bytearray(iso.wrap(b"x" * 192)[:-10]))]
    got = {r["doc_id"]: r for r in iso.index(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert [t["codec"] for t in got[1]["tracks"]] == ["avc1", "mp4a"] and got[1]["error"] is None
    assert got[2]["tracks"] is None and got[2]["error"] is None
    assert got[5]["tracks"] == [] or got[5]["tracks"] is None
    assert all(got[k]["error"] for k in (3, 4, 6))


def test_media_table(docs):
    got = iso.media_digests(docs(ODD, clash=True)).collect()
    want = []
    for i, t, *_ in ODD:
        raw = (t or "").encode()
        body = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.append((i, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert all(r["media_bytes"] > r["payload_bytes"] and r["feature"].startswith("raw 8000 ") for r in got)
    same = [tuple(r) for r in got if r["doc_id"] == 6]
    assert same[0] == same[1]
    assert iso.media_digests(docs([])).count() == 0
