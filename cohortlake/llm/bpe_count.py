"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie one after the other in one array of symbols. Each round looks up the rank of
every adjacent pair, takes each sequence's lowest rank, merges all pairs of that rank from the left, and drops
sequences that have nothing left to merge. Symbols that survive are counted. A pair with a merged symbol always ranks
after the merge that made the symbol, so merging all pairs of one rank at once equals merging them one by one.

Null text reads as empty: no bytes, no tokens. Special strings inside texts count as one token and part the text, as
the library has it by default. Equal rows are counted once each; further columns are ignored. A very long text is cut at
white space like any other; one pre-token without any is held whole, at some 40 bytes a byte. An empty table gives no rows.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import as_text, map_arrow, texts
from .tokens import KEEP, cut_chunks

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
_BEYOND = regex.compile("[^\\u0000-\\u00ff]")
_NONE = np.int64(1 << 40)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """The vocabulary's merges, as a hash table of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab["".join(p)] for p in pairs], dtype=np.int64)
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.special = sorted({x["content"] for x in spec["added_tokens"]}, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        #: Letters of newer Unicode versions are told apart by the library's own pre-tokenizer.
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.bits = 20
        keys = left << 32 | right
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        held = np.bincount(slot, minlength=1 << self.bits)
        self.end = np.cumsum(held).astype(np.int32)
        self.start = self.end - held.astype(np.int32)
        self.most = int(held.max())

    def words(self, text: str) -> list[str]:
        """The text's pre-tokens."""
        if text.isascii() or not _BEYOND.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's place in the table, -1 if it has none."""
        keys = left << 32 | right
        slot = self._slot(keys)
        start, end = self.start[slot], self.end[slot]
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.flatnonzero(start < end)
        for k in range(self.most):
            at = start[todo] + k
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (at + 1 < end[todo])]
            if not len(todo):
                break
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of the (not empty) words."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        out = np.ones(len(words), dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols):
            place = np.full(len(symbols), -1, dtype=np.int64)
            place[:-1] = self.find(symbols[:-1], symbols[1:])
            place[:-1][owner[:-1] != owner[1:]] = -1
            rank = np.where(place >= 0, self.rank[place], _NONE)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(first, append=len(symbols))
            done = least == _NONE
            out[owner[first[done]]] = length[done]
            least_of = np.repeat(least, length)
            merge = (rank == least_of) & (rank < _NONE)
            here = np.arange(len(symbols))
            gap = here - np.maximum.accumulate(np.where(merge, -1, here))
            merge &= gap % 2 == 1
            symbols[merge] = self.made[place[merge]]
            keep = np.repeat(~done, length)
            keep[1:] &= ~merge[:-1]
            symbols, owner = symbols[keep], owner[keep]
        return out


class Counts:
    """Counts by worker: chunks that were counted are kept, twice KEEP at most."""

    def __init__(self, name: str):
        self.merges = Merges(public_tokenizers.path(name))
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _learn(self, chunks: list[str]) -> None:
        found = [self.merges.words(c) for c in chunks]
        words = [w for x in found for w in x]
        each = self.merges.counts([w.encode() for w in words])
        owner = np.repeat(np.arange(len(chunks)), [len(x) for x in found])
        self.young.update(zip(chunks, np.bincount(owner, each, len(chunks)).astype(np.int64).tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        special = self.merges.split
        parts = [special.split(x) if special and any(s in x for s in self.merges.special) else [x] for x in texts]
        cut = [[c for x in p for c in ([x] if x in self.merges.special else cut_chunks(x) or self.merges.words(x))] for p in parts]
        if len(self.young) > KEEP:
            self.old, self.young = self.young, {}
        new = {c for x in cut for c in x}.difference(self.young)
        for s in self.merges.special:
            self.young[s] = 1
            new.discard(s)
        if new:
            again = {c: n for c in new if (n := self.old.get(c))}
            self.young.update(again)
            if rest := [c for c in new if c not in again]:
                self._learn(rest)
        get = self.young.__getitem__
        return [sum(map(get, x)) for x in cut]


@lru_cache(maxsize=2)
def counter(name: str) -> Counts:
    return Counts(name)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        values = texts(part)
        n = counter(vocabulary).counts(values)
        size = [len(x.encode()) for x in values]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(as_text(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", "text")
