"""Token ids of whole texts by the tokenizers library, each distinct word once.

Both vocabularies cut texts at white space before they merge: a text's ids are those of its chunks, one after
the other. So chunks are encoded once per batch and kept. Texts with special strings or with white space other than
space, tab, line feed and carriage return go to the library whole.

``Encoder.ids`` cuts strings one by one. ``Encoder.flat`` cuts an Arrow array of texts on its bytes, for a byte-level vocabulary:
the kinds of two neighbouring bytes tell where the vocabulary's own rule parts them, Arrow numbers the distinct chunks,
and Python sees only those; the ids of all occurrences are gathered as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

#: White space and separators on which regular-expression engines may differ.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")
_LETTERS, _AFTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"[ \t\n\r.,;:!?|$%&*#]|\Z"
#: Letters before a mark that always parts them from it, else what stands between white space.
_CHUNK = re.compile(rf" ?[{_LETTERS}]++(?={_AFTER})| ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]")
_WORD = re.compile(rf"[{_LETTERS}]++(?={_AFTER})|[^ \t\n\r]+")
#: What a byte-level vocabulary's own rule leaves in one piece, and how its model spells bytes (the line feed stays).
_SINGLE = re.compile(f" ?[{_LETTERS}]+").fullmatch
_SPELT = np.arange(256, dtype="<u4")
_SPELT[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = np.arange(256, 256 + 0x21 + 0x22 + 1)
_SPELT[0x0A] = 0x0A
#: Kinds of bytes: space, other white space, letter, digit, apostrophe, other printable ASCII, anything else but white space, and
#: first bytes of what _ODD names (looked at further).
_SPACE, _BLANK, _LETTER, _DIGIT, _QUOTE, _MARK, _ELSE, _LOOK = range(8)
#: Chunks kept by a worker, twice at most.
KEEP = 450_000


def cut_chunks(text: str) -> list[str] | None:
    """Chunks that a byte-level vocabulary encodes one by one; None for a text with odd white space."""
    if (not text.isascii() or not text.isprintable()) and _ODD.search(text):
        return None
    return _CHUNK.findall(text)


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each byte, whether two kinds part (1; 2: if a third that is no white space follows), odd code points."""
    odd = np.array([_ODD.match(chr(c)) is not None for c in range(1 << 16)])
    kind = np.full(256, _ELSE, dtype=np.uint8)
    for c in range(0x21, 0x7F):
        kind[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _QUOTE if chr(c) == "'" else _MARK
    kind[0x20], kind[[9, 10, 13]] = _SPACE, _BLANK
    kind[sorted({chr(c).encode()[0] for c in np.flatnonzero(odd).tolist()})] = _LOOK
    parts = np.zeros((8, 8), dtype=np.uint8)
    parts[_LETTER : _ELSE + 1, [_SPACE, _BLANK]] = 1
    parts[_BLANK, _LETTER : _ELSE + 1] = 1
    parts[_SPACE : _BLANK + 1, _SPACE : _BLANK + 1] = 2
    parts[_LETTER, [_DIGIT, _QUOTE, _MARK]] = parts[_DIGIT, [_LETTER, _QUOTE, _MARK]] = 1
    parts[_MARK, [_LETTER, _DIGIT]] = parts[_QUOTE, _DIGIT] = 1  # an apostrophe may go with the letters after it
    return kind, parts.ravel(), odd


_KIND, _PARTS, _ODD_POINT = _kinds()


def _cut_bytes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of the texts in data begin (as flags), and the positions of odd white space. ends: of texts that are not empty."""
    kind = _KIND.take(data)
    look = np.flatnonzero(kind == _LOOK)
    odd = look
    if len(look):
        a, b, c = (data.take(np.minimum(look + k, len(data) - 1)).astype(np.int32) for k in range(3))
        point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63))
        odd = look[_ODD_POINT.take(point)]
        kind[look] = _ELSE
    latin = np.flatnonzero(data == 0xC3)  # letters from U+00C0 to U+00FF, but the signs of multiplication and division
    if len(latin):
        latin = latin[~np.isin(data.take(latin + 1), (0x97, 0xB7))]
        kind[latin] = kind[latin + 1] = _LETTER
    cut = np.zeros(len(data), dtype=np.uint8)
    cut[1:] = _PARTS.take((kind[:-1] << 3) | kind[1:])
    runs = np.flatnonzero(cut == 2)  # white space after white space: the last before a word stands apart, at a text's end none does
    cut[runs] = kind.take(np.minimum(runs + 1, len(data) - 1)) > _BLANK
    last = ends[_PARTS.take(kind.take(np.maximum(ends - 2, 0)) << 3 | kind.take(ends - 1)) == 2] - 1
    cut[last] = 0
    cut[0] = cut[ends[:-1]] = 1
    return cut, odd


class Encoder:
    """ids(texts): for each text, its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, blanks: bool):
        """blanks: white space is part of the vocabulary (else it only separates)."""
        self.tk = Tokenizer.from_file(path)
        self.blanks = blanks
        self.special = tuple({x.content for x in self.tk.get_added_tokens_decoder().values()})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: What parts words while they are learned: a token of its own wherever it stands between others.
        self.mark = "\n" if blanks else " ~ "
        (self.mark_id,) = self.tk.encode(self.mark, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _chunks(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        if self.blanks:
            return cut_chunks(text)
        if (not text.isascii() or not text.isprintable()) and _ODD.search(text):
            return None
        return _WORD.findall(text.lower() if text.isascii() else text)

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone go to the library's model, which merges them. Others are encoded in long lines, the mark after
        each, and the ids are cut there again."""
        plain, single = [], []
        for w in words:
            if self.blanks and _SINGLE(w):
                single.append(w)
            elif w.isspace() or "~" in w:
                self.young[w] = self.whole(w)
            else:
                plain.append(w)
        if single:
            raw = np.frombuffer("\n".join(single).encode(), np.uint8)
            ids, cuts, merge = [], [], self.tk.model.tokenize
            for x in _SPELT.take(raw).tobytes().decode("utf-32-le").split("\n"):
                ids += [t.id for t in merge(x)]
                cuts.append(4 * len(ids))
            data, a = np.array(ids, dtype="<u4").tobytes(), 0
            for w, b in zip(single, cuts):
                self.young[w] = data[a:b]
                a = b
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = np.array(self.tk.encode_batch_fast([self.mark.join(part) + self.mark], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(part):
                raise ValueError("a chunk holds the mark")
            self._put(part, ids.tobytes(), cuts.tolist())

    def _put(self, words: list[str], data: bytes, cuts: list[int]) -> None:
        a = 0
        for w, b in zip(words, cuts):
            self.young[w] = data[4 * a : 4 * b]
            a = b + 1

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [self._chunks(x) for x in texts]
        new: set[str] = set()
        for x in cut:
            if x:
                new.update(x)
        self._make_room()
        new.difference_update(self.young.keys())
        self._add(new)
        get = self.young.__getitem__
        return [self.whole(x) if c is None else b"".join(map(get, c)) for x, c in zip(texts, cut)]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has. Null reads as empty."""
        if not self.blanks:
            found = self.ids([x or "" for x in texts.to_pylist()])
            return np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) // 4 for x in found], dtype=np.int64)
        texts = texts.fill_null("").cast(pa.large_string())
        _, places, buffer = texts.buffers()
        bounds = np.frombuffer(places, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        first, bounds = int(bounds[0]), bounds - bounds[0]
        if bounds[-1] == 0:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        data = np.frombuffer(buffer, np.uint8, int(bounds[-1]), first)
        cut, odd = _cut_bytes(data, np.unique(bounds[1:][bounds[1:] > 0]))
        whole = set((np.searchsorted(bounds, odd, side="right") - 1).tolist())
        for mark in self.special:
            for m in re.finditer(re.escape(mark.encode()), data):
                whole.add(int(np.searchsorted(bounds, m.start(), side="right")) - 1)
        for k in whole:
            cut[bounds[k] + 1 : bounds[k + 1]] = 0
        starts = np.append(np.flatnonzero(cut), len(data))
        chunks = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        index, words = chunks.indices.to_numpy(), chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = {int(index[np.searchsorted(starts, bounds[k])]) for k in whole}  # texts that go to the library whole
        self._make_room()
        ids = list(map(self.young.get, words))
        new = [k for k, x in enumerate(ids) if x is None]
        self._add([words[k] for k in new if k not in own])
        for k in new:
            ids[k] = self.whole(words[k]) if k in own else self.young[words[k]]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        count = sizes.take(index)
        ends = np.cumsum(count)
        at = np.repeat((np.cumsum(sizes) - sizes).take(index) - (ends - count), count)
        at += np.arange(len(at))
        upto = np.append(0, ends).take(np.searchsorted(starts, bounds))
        return np.frombuffer(b"".join(ids), dtype="<u4").take(at), np.diff(upto)

    def _make_room(self) -> None:
        if len(self.young) > KEEP:
            self.old, self.young = self.young, {}

    def _add(self, new: Iterable[str]) -> None:
        """Words that are not in young come there."""
        learn = []
        for w in new:
            if (known := self.old.get(w)) is None:
                learn.append(w)
            else:
                self.young[w] = known
        self._learn(learn)


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One for each worker process. name: a vocabulary file, whose place public_tokenizers knows."""
    tk = public_tokenizers.path(name)
    return Encoder(tk, blanks=name.startswith("byte"))
