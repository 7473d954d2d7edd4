"""Media columns: ISO base media containers (nested boxes with sample tables).

``wrap`` stores a payload as a sound track of 8-bit samples; ``index`` walks the boxes of any such container, decodes
its sample tables, and gives each track's codec, time scale, duration and the byte ranges of its sync samples
(keyframes) without decoding a payload; ``payload`` reads a track's stored bytes through the tables.

Boxes with 32-bit, 64-bit or to-the-end sizes, 32- or 64-bit chunk offsets, fixed or listed sample sizes, and
containers with any number of tracks are read. Null text reads as empty: its payload is 192 blanks. A null or broken
container has a null index and its error as text. Equal rows give equal values; further columns are ignored. A very long text
is one payload: its container is held whole by the task that writes it and by the one that reads it. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, map_arrow, slices, staged, texts

#: Payloads are padded to a multiple of so many bytes, which is also the sample size of a chunk.
UNIT = 192
RATE = 8000
#: Samples (of one byte) in a chunk.
CHUNK = 192 * 64
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf", b"dinf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def wrap(payload: bytes, rate: int = RATE, chunk: int = CHUNK) -> bytes:
    """A container whose only track holds the payload as unsigned 8-bit mono samples."""
    n = len(payload)
    chunks = -(-n // chunk)
    last = n - (chunks - 1) * chunk
    runs = [(1, chunk, 1)] * (chunks > 1) + [(chunks, last, 1)] if chunks > 1 and last != chunk else [(1, min(n, chunk), 1)]
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")

    def moov(first: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", 1, n)),
            full(b"stco", struct.pack(">I", chunks), (first + chunk * np.arange(chunks)).astype(">u4").tobytes()),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    first = len(head) + len(moov(0)) + 8
    return head + moov(first) + struct.pack(">I4s", n + 8, b"mdat") + payload


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, its end) of the boxes there, in order."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if start + size > end or body > start + size:
            raise ValueError(f"box {kind!r} reaches beyond its parent")
        yield kind, body, start + size
        start += size
    if start != end:
        raise ValueError("bytes left over between boxes")


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box with its path, parents before children."""
    for kind, a, b in boxes(data, start, end):
        yield (*path, kind), a, b
        if kind in NESTED:
            yield from walk(data, a, b, (*path, kind))


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    samples: int
    #: Samples that follow on each other in the file, (first byte, end).
    spans: list[tuple[int, int]]
    #: Sync samples that follow on each other, merged likewise.
    keyframes: list[tuple[int, int]]


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    if not len(start):
        return []
    new = np.r_[True, start[1:] != end[:-1]]
    last = np.r_[new[1:], True]
    return list(zip(start[new].tolist(), end[last].tolist()))


def _track(data: bytes, parts: dict[bytes, tuple[int, int]]) -> Track:
    at = lambda kind: parts[kind][0] + 4  # noqa: E731  past version and flags
    u32 = lambda a, n: np.frombuffer(data, ">u4", n, a).astype(np.int64)
    if data[parts[b"mdhd"][0]] == 1:
        timescale, duration = struct.unpack_from(">IQ", data, at(b"mdhd") + 16)
    else:
        timescale, duration = struct.unpack_from(">II", data, at(b"mdhd") + 8)
    codec = data[at(b"stsd") + 8 : at(b"stsd") + 12].decode("latin-1").strip()
    size, n = (int(x) for x in u32(at(b"stsz"), 2))
    wide = b"co64" in parts
    place = parts[b"co64" if wide else b"stco"][0] + 4
    (chunks,) = u32(place, 1).tolist()
    offsets = np.frombuffer(data, ">u8" if wide else ">u4", chunks, place + 4).astype(np.int64)
    (runs,) = u32(at(b"stsc"), 1).tolist()
    table = u32(at(b"stsc") + 4, 3 * runs).reshape(-1, 3)
    per = np.repeat(table[:, 1], np.diff(np.r_[table[:, 0], chunks + 1]))
    if len(per) != chunks or int(per.sum()) != n:
        raise ValueError("the sample tables disagree")
    if size and b"stss" not in parts:  # one-size samples, each a sync sample: no list of them is needed
        spans = _merged(offsets, offsets + per * size)
        keys = spans
    else:
        sizes = np.full(n, size) if size else u32(at(b"stsz") + 8, n)
        within = np.cumsum(sizes) - sizes
        first = np.cumsum(per) - per
        start = np.repeat(offsets - (within[first] if n else 0), per) + within
        spans = _merged(start, start + sizes)
        if b"stss" in parts:
            sync = u32(at(b"stss") + 4, int(u32(at(b"stss"), 1)[0])) - 1
            keys = _merged(start[sync], (start + sizes)[sync])
        else:
            keys = spans
    if any(b > len(data) for _, b in spans):
        raise ValueError("samples lie beyond the end")
    return Track(codec, int(timescale), int(duration), n, spans, keys)


def tracks(data: bytes) -> list[Track]:
    """The container's tracks, from its sample tables alone."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif b"trak" in path:
            found[-1][path[-1]] = (a, b)
    return [_track(data, x) for x in found]


def payload(data: bytes, track: Track) -> bytes:
    return b"".join(data[a:b] for a, b in track.spans)


def feature(found: list[Track]) -> str:
    """Codec, time scale, duration and keyframe byte ranges of each track."""
    return ";".join(f"{t.codec} {t.timescale} {t.duration} " + ",".join(f"{a}-{b}" for a, b in t.keyframes) for t in found)


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container of every document's text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        values = texts(part)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in values], pa.int64()), pa.array([wrap(padded(x)) for x in values], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(as_text(docs), run, "doc_id long, n_bytes long, media binary", "text")


KINDS = pa.list_(pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))


def index(df: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, tracks (codec, timescale, duration, samples, keyframes) and error of every container."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out, errors = [], []
        for data in part.column(1).to_pylist():
            try:
                found = tracks(data) if data is not None else None
                out.append(found and [{"codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": t.samples, "keyframes": [{"start": a, "end": b} for a, b in t.keyframes]} for t in found])
                errors.append(None)
            except (ValueError, KeyError, IndexError, struct.error) as e:
                out.append(None)
                errors.append(str(e) or "broken")
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, KINDS), pa.array(errors, pa.string())], names=[key, "tracks", "error"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, F.col(column)), run, f"{key} {kind}, tracks array<struct<codec:string,timescale:long,duration:long,samples:long,keyframes:array<struct<start:long,end:long>>>>, error string", column)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(stored: DataFrame) -> DataFrame:
    """What the stored containers hold: sizes and digests of payload and container, and the feature."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for doc, n, data in zip(*(part.column(k).to_pylist() for k in range(3))):
                    found = tracks(data)
                    body = payload(data, found[0])
                    rows.append((doc, n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(found)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every document's container as a table in the shared folder, reads it back and digests it."""
    return digests(staged(media(docs), "media"))
