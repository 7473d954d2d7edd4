"""Token ids in a compact file format: a static range asymmetric numeral system.

A file holds consecutive documents. One frequency table, counted over all its ids, is shared by its blocks. A block
codes its ids on interleaved lanes, each with its own 64-bit state, and stands alone: the directory gives its place in
the file (the checkpoint), its first id and the checksum of its ids, so blocks can be decoded in parallel or singly.
Blocks of one file are coded side by side as one wide vector.

``write`` deals documents out by ranges of doc_id and writes files in ascending order, as rows of a Parquet table in
the shared folder; ``read`` decodes them. Null text reads as empty (the end token alone); null doc_ids come first; rows
with one doc_id are ordered by text and coded in one task, file by file. An empty table gives no files. Further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, broadcast_if_small, running, slices, staged
from .tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
END = 2
MAGIC = b"RANSIDS1"
#: Frequencies add up to 2**SCALE; states stay in [LOW, LOW << 32).
SCALE = 19
LOW = np.uint64(1 << 31)
LANES, STEPS = 512, 512
#: A file is closed at the first document that brings it to so many ids.
FILE_IDS = 1 << 22
#: Documents of a range, about; each range makes a file at least.
PART_ROWS = 4096
_HEAD = struct.Struct("<8sQQIIIIII")


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole numbers of at least 1 that add up to 2**scale, near the counts' shares."""
    if len(counts) > 1 << scale:
        raise ValueError("more symbols than the table has room for")
    spare = (1 << scale) - len(counts)
    share = counts * (spare / counts.sum())
    out = np.floor(share).astype(np.int64)
    rest = spare - int(out.sum())
    out[np.argsort(-(share - out), kind="stable")[:rest]] += 1
    return out + 1


def encode(ids: np.ndarray, docs: list[int | None], lengths: list[int], lanes: int = LANES, steps: int = STEPS) -> bytes:
    """One file. ids: those of all documents, one after the other."""
    symbols, index, counts = _symbols(ids)
    freq = frequencies(counts)
    low = np.cumsum(freq) - freq
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    blocks = -(-n // (lanes * steps))
    steps = -(-n // (lanes * blocks))
    each = lanes * steps
    fill = np.full(blocks * each, int(np.argmax(freq)), dtype=np.int64)
    fill[:n] = index
    grid = fill.reshape(blocks, steps, lanes).transpose(1, 0, 2).reshape(steps, blocks * lanes)
    f64, c64 = freq.astype(np.uint64), low.astype(np.uint64)
    scale, half, room = np.uint64(SCALE), np.uint64(32), np.uint64(63 - SCALE)
    x = np.full(blocks * lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    per = np.zeros((steps, blocks), dtype=np.int64)
    for s in range(steps - 1, -1, -1):
        row = grid[s]
        f = f64.take(row)
        over = x >= f << room
        at = np.flatnonzero(over)
        full = x[at]
        words.append(full.astype(np.uint32))
        x[at] = full >> half
        per[s] = np.add.reduce(over.reshape(blocks, lanes), axis=1)
        q = x // f
        f *= q
        x -= f
        q <<= scale
        x += q
        x += c64.take(row)
    stream = np.concatenate(words[::-1])
    owner = np.repeat(np.tile(np.arange(blocks, dtype=np.uint16), steps), per.ravel())
    stream = stream[np.argsort(owner, kind="stable")]
    sizes = per.sum(axis=0)
    body, directory, at, word = [], [], 0, 0
    for b in range(blocks):
        data = x[b * lanes : (b + 1) * lanes].astype("<u8").tobytes() + stream[word : word + int(sizes[b])].astype("<u4").tobytes()
        first = b * each
        directory.append((at, first, int(sizes[b]), zlib.crc32(ids[first : min(n, first + each)].astype("<u4").tobytes())))
        body.append(data)
        at += len(data)
        word += int(sizes[b])
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    known = np.array([0 if d is None else d for d in docs], dtype="<i8").tobytes() + np.array([d is not None for d in docs], dtype=np.uint8).tobytes()
    names = zlib.compress(known + np.array(lengths, dtype="<u8").tobytes(), 1)
    places = np.array(directory, dtype="<u8").tobytes()
    return _HEAD.pack(MAGIC, n, len(docs), len(symbols), lanes, steps, blocks, len(table), len(names)) + table + names + places + b"".join(body)


def _symbols(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids in order, each id's place among them, and their counts."""
    if int(ids.max()) < 1 << 20:
        ids = ids.astype(np.int64)
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        place = np.zeros(len(counts), dtype=np.int64)
        place[symbols] = np.arange(len(symbols))
        return symbols, place.take(ids), counts[symbols]
    return np.unique(ids, return_inverse=True, return_counts=True)


def decode(data: bytes, only: list[int] | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file; only: ids of these blocks alone. ValueError where a checksum fails."""
    magic, n, docs, kinds, lanes, steps, blocks, t, m = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    at = _HEAD.size
    table = np.frombuffer(zlib.decompress(data[at : at + t]), dtype="<u4")
    symbols, freq = np.cumsum(table[:kinds].astype(np.int64)), table[kinds:].astype(np.int64)
    names = zlib.decompress(data[at + t : at + t + m])
    ids, valid, lengths = np.frombuffer(names, "<i8", docs), np.frombuffer(names, np.uint8, docs, 8 * docs), np.frombuffer(names, "<u8", docs, 9 * docs)
    at += t + m
    places = np.frombuffer(data, "<u8", 4 * blocks, at).reshape(blocks, 4).astype(np.int64)
    at += 32 * blocks
    chosen = np.arange(blocks) if only is None else np.array(only)
    found = _unwind(data, at, places[chosen], symbols, freq, lanes, steps)
    parts = []
    for k, b in enumerate(chosen.tolist()):
        part = found[k][: n - int(places[b, 1])]
        if zlib.crc32(part.astype("<u4").tobytes()) != places[b, 3]:
            raise ValueError(f"block {b} does not match its checksum")
        parts.append(part)
    return [int(i) if v else None for i, v in zip(ids.tolist(), valid.tolist())], lengths.astype(np.int64), np.concatenate(parts)


def _unwind(data: bytes, body: int, places: np.ndarray, symbols: np.ndarray, freq: np.ndarray, lanes: int, steps: int) -> np.ndarray:
    """The ids of the blocks at these places: blocks x ids."""
    blocks = len(places)
    x = np.concatenate([np.frombuffer(data, "<u8", lanes, body + int(p[0])) for p in places]).astype(np.uint64)
    streams = [np.frombuffer(data, "<u4", int(p[2]), body + int(p[0]) + 8 * lanes) for p in places]
    words = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
    next_ = np.cumsum([0, *(len(s) for s in streams)])[:-1]
    symbol_at = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.int32), freq)
    f64, c64 = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    out = np.empty((steps, blocks * lanes), dtype=symbol_at.dtype)
    mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for s in range(steps):
        slot = x & mask
        sym = symbol_at.take(slot.view(np.int64))
        out[s] = sym
        sym = sym.astype(np.int64)
        x >>= scale
        x *= f64.take(sym)
        x += slot
        x -= c64.take(sym)
        need = x < LOW
        count = np.add.reduce(need.reshape(blocks, lanes), axis=1)
        at = np.flatnonzero(need)
        word = words[np.arange(len(at)) + np.repeat(next_ - (np.cumsum(count) - count), count)]
        x[at] = (x[at] << half) | word
        next_ = next_ + count
    if (x != LOW).any():
        raise ValueError("a lane does not end where it began")
    return symbols.astype(np.uint32)[out.reshape(steps, blocks, lanes).transpose(1, 0, 2).reshape(blocks, steps * lanes)]


def write(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Files in ascending doc_id order: part, file, before (ids of the part's earlier files), n_ids, data."""

    def run(batches):
        part, file, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def closed():
            data = encode(np.concatenate(held), names, lengths)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, file, before, n, data), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "file", "before", "n_ids", "data"])

        for batch in batches:
            for rows in slices(batch, "text"):
                ids, sizes = encoder(vocabulary).flat(rows.column(1))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, np.uint32(end))
                at = 0  # so many of these ids are in files
                for doc, upto, size in zip(rows.column(0).to_pylist(), (ends + np.arange(1, len(ends) + 1)).tolist(), (sizes + 1).tolist()):
                    names.append(doc)
                    lengths.append(size)
                    n += size
                    if n >= file_ids:
                        held.append(ids[at:upto])
                        yield closed()
                        file, before, n, at, names, lengths, held = file + 1, before + n, 0, upto, [], [], []
                held.append(ids[at:])
        if names:
            yield closed()

    parts = max(1, docs.count() // PART_ROWS)
    dealt = as_text(docs).repartitionByRange(parts, "doc_id").coalesce(parts).sortWithinPartitions("doc_id", "text")
    return staged(dealt.mapInArrow(run, "part int, file int, before long, n_ids long, data binary"), "ids", "none")


def read(files: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 [, ids] of every document in the files."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.lit("").alias("key"), "part", "n")  # a row for each range
    starts = staged(running(parts, "part", "n").select("part", F.col("before").alias("first")), "starts", rows=parts.count())

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                before, data = (batch.column(c)[k].as_py() for c in range(2))
                docs, lengths, found = decode(data)
                raw = memoryview(found.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                cuts = [(4 * (b - a), 4 * b) for a, b in zip(lengths.tolist(), ends.tolist())]
                columns = [pa.array(docs, pa.int64()), pa.array(before + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(raw[a:b]) for a, b in cuts], pa.int64())]
                if ids:
                    columns.append(pa.array([bytes(raw[a:b]) for a, b in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    placed = files.join(broadcast_if_small(starts), "part").select((F.col("before") + F.col("first")).alias("before"), "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
