from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cohortlake.llm import bpe_count, rans
from cohortlake.llm.tokens import Encoder, encoder

from .conftest import ODD

PIECES = ["the", " ", "  ", "\n", "\t", "don't", "'s", "DON'T", "é", "ß", "İ", "İ,", "你好", "🎉", "12", "½", "<|endoftext|>", "<|startoftext|>", "~", " ~ ", "...", "a.b", "\xa0", " ", "é", "́", "aaaa", "###", "x!", "\r\n", "\x1c", "_", "'", "''"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, monkeypatch):
    monkeypatch.setattr("cohortlake.llm.tokens.KEEP", 40)
    own, tk = Encoder(public_tokenizers.path(name), name.startswith("byte")), Tokenizer.from_file(public_tokenizers.path(name))
    for seed in range(6):
        found = texts(200, seed)
        for x, data in zip(found, own.ids(found)):
            assert np.frombuffer(data, "<u4").tolist() == tk.encode(x, add_special_tokens=False).ids, repr(x)


EDGES = [None, "", " ", "\n", "  ", "a", " a", "a ", "  b", "b  ", "\t\tx", "x\n", "\n x", "a'", "'s", " 's", "x''s", "I'll5", "5'll", "a.'re", "×é÷É", "é\u0301.", "²a1b", "’s — “q”", "你 好　x", "\xa0\nb", "a \u2028 b", "Привет, мир", "\x00a\x7f", "<|endoftext|>", "a<|endoftext|> b", "<|endoftext|"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_flat_equals_library(name, monkeypatch):
    monkeypatch.setattr("cohortlake.llm.tokens.KEEP", 40)
    own, tk = Encoder(public_tokenizers.path(name), name.startswith("byte")), Tokenizer.from_file(public_tokenizers.path(name))
    r = random.Random(3)
    for found in [EDGES, [], [None, ""], [" "], *([r.choice(EDGES) for _ in range(60)] for _ in range(20)), *(texts(200, seed) for seed in range(6))]:
        for array in (pa.array(found, pa.string()), pa.array(["x  ", *found, " y"], pa.large_string()).slice(1, len(found))):
            ids, sizes = own.flat(array)
            parts = np.split(ids, np.cumsum(sizes))
            assert len(parts.pop()) == 0 and len(sizes) == len(found)
            for x, part in zip(found, parts):
                assert part.tolist() == tk.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_flat_looks_up_distinct_chunks():
    class Counted(dict):
        looked = 0

        def get(self, *a):
            Counted.looked += 1
            return super().get(*a)

        def __getitem__(self, k):
            Counted.looked += 1
            return super().__getitem__(k)

    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    own.young, text = Counted(), "the quick brown fox, " * 5000
    ids, sizes = own.flat(pa.array([text] * 3))
    assert ids.tobytes() == own.whole(text) * 3 and sizes.tolist() == [len(ids) // 3] * 3
    assert Counted.looked < 50


def test_counts_equal_library(monkeypatch):
    monkeypatch.setattr("cohortlake.llm.bpe_count.KEEP", 40)
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe_count.Counts("byte_bpe_50k.json")
    for seed in range(6):
        found = texts(200, seed)
        assert own.counts(found) == [len(e.ids) for e in tk.encode_batch(found, add_special_tokens=False)]


def test_merging_overlaps():
    m = bpe_count.counter("byte_bpe_50k.json").merges
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["a" * n for n in range(1, 40)] + ["=" * n for n in range(1, 40)] + ["abababab", " the", "z"]
    assert m.counts([w.encode() for w in words]).tolist() == [len(tk.encode(w, add_special_tokens=False).ids) for w in words]


def test_token_counts_table(docs):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, bpe_count.token_counts(docs(ODD, clash=True)).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(tk.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in ODD), key=str)
    assert got == want
    assert bpe_count.token_counts(docs([])).count() == 0


@pytest.mark.parametrize("n,kinds", [(1, 1), (63, 5), (1000, 1), (5000, 700), (300_000, 40_000)])
def test_rans_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds).astype("<u4")
    data = rans.encode(ids, [5, None], [n - 1, 1], lanes=64, steps=128)
    docs_, lengths, found = rans.decode(data)
    assert docs_ == [5, None] and lengths.tolist() == [n - 1, 1] and (found == ids).all()


def test_rans_blocks_and_checksums():
    ids = np.random.default_rng(1).integers(0, 300, 100_000).astype("<u4")
    data = rans.encode(ids, [1], [len(ids)], lanes=64, steps=128)
    parts = [rans.decode(data, [b])[2] for b in range(len(ids) // (64 * 128) + 1)]
    assert (np.concatenate(parts) == ids).all()
    broken = bytearray(data)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(broken))
    with pytest.raises(ValueError):
        rans.decode(b"x" * 200)


def test_rans_large_ids():
    ids = np.array([0, 2**32 - 1, 7, 2**31], dtype="<u4")
    assert (rans.decode(rans.encode(ids, [1], [4]))[2] == ids).all()


def test_token_files(docs):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    files = rans.write(docs(ODD, clash=True), file_ids=500)
    assert files.count() > 1
    got = [tuple(r) for r in rans.read(files).collect()]
    rows = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for i, t in rows:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert rans.read(rans.write(docs([]))).count() == 0


def test_read_returns_ids(docs):
    (r,) = rans.read(rans.write(docs([(1, "hello world")])), ids=True).collect()
    assert bytes(r["ids"]) == encoder("byte_bpe_50k.json").ids(["hello world"])[0] + (2).to_bytes(4, "little")
