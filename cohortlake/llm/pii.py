"""Personal data: exact base patterns, and further spans by a semi-Markov conditional random field.

The base is found by patterns in linear time and always stays. The field then looks at what the patterns miss: telephone
numbers without a plus or run into other numbers, card numbers with other separators or side by side, addresses of version 6,
masked e-mail addresses. Windows are cut around runs of digit groups, runs of colons and marks that stand for an @. Every segment
of a window between two boundaries of its groups, of at most ``LONGEST`` (64) characters, ``GROUPS`` (8) groups and labels of
32 characters, is a candidate, and each is scored as each of the four kinds by features of the whole segment: shape, groups, digits,
checks, the words before it and what stands next to it. Everything outside a segment scores zero. A dynamic program over segment ends
chooses boundaries and kinds jointly; segments never overlap the base, nor each other. The field is trained here, by the
likelihood of whole segmentations, on sentences made by a seeded generator.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Very long texts are read in one pass; runs of more
than the stated lengths hold no candidate as a whole, but their parts do. Ties of segmentations go to the one with fewer, later segments.
Repeated rows are each returned. An empty table gives no rows. Further columns are ignored by ``spans`` and kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_text, map_arrow, slices, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> Iterator[Span]:
    """Each @ with the run of local characters before it; a run starts after the last match and after the last @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), "email"
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base(text: str) -> list[Span]:
    """All spans of the base patterns, by start and then kind."""
    found = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: Characters and groups of a candidate at most.
LONGEST, GROUPS = 64, 8
_GROUPS = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9]+(?:[\x20().\-/]{1,3}[0-9]+)*(?![0-9A-Za-z])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Za-z]{0,32}(?::[0-9A-Za-z]{0,32}){2,8}(?![0-9A-Za-z:])")
_AT = r"(?:\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20at\x20|\x20@\x20)"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\x20\.\x20|\.)"
_MASKED = re.compile(rf"(?:[A-Za-z0-9_%+-]{{1,32}}(?:{_DOT}|\.)){{0,3}}[A-Za-z0-9_%+-]{{1,32}}{_AT}[A-Za-z0-9-]{{1,32}}(?:{_DOT}[A-Za-z0-9-]{{1,32}}){{1,4}}", re.I)
#: Part of every match of _MASKED, quick to look for.
_MASK = re.compile(rf"{_AT}[A-Za-z0-9-]{{1,32}}{_DOT}[A-Za-z0-9-]", re.I)
_MARK = re.compile(_AT, re.I)
_LABEL = re.compile(r"[A-Za-z0-9_%+-]+")
_WORDS = re.compile(r"[^\W\d_]+")
_RUN = re.compile("[0-9]+")
_LETTERS = re.compile("[A-Za-z]+")


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """The segments that the field scores as each kind: from any boundary of a window's groups to any later one, within bounds."""
    if _DIGIT.search(text):
        for m in _GROUPS.finditer(text):
            if m.end() - m.start() < 7:
                continue
            runs = [r.span() for r in _RUN.finditer(text, *m.span())]
            for i, (a, _) in enumerate(runs):
                open_ = a
                while open_ > m.start() and text[open_ - 1] in "+(" and a - open_ < 2:
                    open_ -= 1
                n = 0
                for x, b in runs[i : i + GROUPS]:
                    n += b - x
                    if b - open_ > LONGEST or n > 19:
                        break
                    if n >= 7:
                        yield from ((c, b) for c in range(open_, a + 1))
    if text.count(":") > 1:
        for m in _COLONS.finditer(text):
            if m.end() - m.start() <= LONGEST:
                marks = [k for k in range(*m.span()) if text[k] == ":"]
                starts = sorted({m.start(), *(k + 1 for k in marks), *marks[:1]})
                ends = sorted({m.end(), *marks, *(k + 1 for k in marks[-1:])})
                yield from ((a, b) for a in starts for b in ends if b > a and text.count(":", a, b) > 1)
    if _MASK.search(text):
        for m in _MASKED.finditer(text):
            mark = _MARK.search(text, *m.span())
            if mark:
                starts = [x.start() for x in _LABEL.finditer(text, m.start(), mark.start()) if x[0].lower() != "dot"]
                ends = [x.end() for x in _LABEL.finditer(text, mark.end(), m.end()) if x[0].lower() != "dot"]
                yield from ((a, b) for a in starts for b in ends[1:] if b - a <= LONGEST)


def open_candidates(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The base spans, and the candidates that keep clear of them."""
    found = base(text)
    starts, reach = [], []
    for a, b, _ in found:  # base spans may overlap: how far those so far reach
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    return found, [s for s in dict.fromkeys(candidates(text)) if not ((k := bisect_right(starts, s[1] - 1)) and reach[k - 1] > s[0])]


@lru_cache(maxsize=4096)
def _of_body(body: str) -> tuple[str, ...]:
    """Features of a segment's characters alone."""
    low, digits, groups = body.lower(), _digits(body), _RUN.findall(body)
    shape = _RUN.sub(lambda m: f"9{len(m[0])}", _LETTERS.sub("a", body))
    letters, marks = any(c.isalpha() for c in body), "".join(sorted({c for c in body if not c.isalnum()}))
    check = luhn(digits) if 12 <= len(digits) <= 19 else None
    out = [f"shape {shape if len(shape) < 24 else ''}", f"groups {'-'.join(str(len(g)) for g in groups[:6])}", f"marks {marks}", f"digits {min(len(digits), 20)}", f"letters {letters}"]
    out += [f"luhn {check} letters {letters}", f"luhn {check} marks {marks}", f"luhn {check} shape {shape if len(shape) < 24 else ''}", f"brackets {body.count('(') - body.count(')')}", f"begins {body[0] if not body[0].isalnum() else ''}"]
    if ":" in body:
        parts = body.split(":")
        hexed = all(re.fullmatch("[0-9a-fA-F]{0,4}", x) for x in parts)
        short, full = body.count("::"), sum(x != "" for x in parts)
        valid = hexed and ":::" not in body and (full == 8 and not short or full < 8 and short == 1) and not (body[0] == ":" and body[1] != ":") and not (body[-1] == ":" and body[-2] != ":")
        out += [f"hex {hexed} parts {full} short {short}", f"v6 {valid} digit {bool(digits)}", f"v6 {valid} full {full == 8}", f"v6 {valid} parts {full} {bool(digits)}", f"v6 {valid} mixed {any(re.search('[0-9]', x) and re.search('[a-fA-F]', x) for x in parts)}"]
    mark = _MARK.search(body)
    if mark:
        bracket = any(c in mark[0] for c in "[({")
        ends, before = re.split("[^a-z0-9]+", low[mark.end() :]), low[: mark.start()]
        out += [f"at {'bracket' if bracket else mark[0].strip().lower()}", f"end {len(ends[-1])} {bracket}", f"at {bracket} plain {'.' in body[mark.end() :]}"]
        dotted = "dot" in ends or "[" in low[mark.end() :] or "(" in low[mark.end() :]
        out += [f"form {bracket} {dotted} {len([x for x in ends if x and x != 'dot'])} {2 <= len(ends[-1]) <= 4}", f"blank dot {' . ' in body} {bracket}", f"labels {len([x for x in ends if x and x != 'dot'])}", f"local {'dot' in re.split('[^a-z0-9]+', before)} {'.' in before}"]
    return tuple(out)


def features(text: str, span: tuple[int, ...]) -> list[str]:
    """Of the whole segment: shape, groups, digits and checks, the words before it, and what stands next to it. Each has a weight for each kind."""
    a, b = span[:2]
    left, right = text[a - 1 : a] or "\n", text[b : b + 1] or "\n"
    side = lambda c: "line" if c == "\n" else "blank" if c.isspace() else "word" if c.isalnum() else c
    out = ["any", *_of_body(text[a:b]), f"left {side(left)}", f"right {side(right)}"]
    out += [f"goes on left {text[max(0, a - 2) : a - 1].isdigit()} {side(left)}", f"goes on right {text[b + 1 : b + 2].isdigit()} {side(right)}"]
    return out + [f"after {w.lower()}" for w in _WORDS.findall(text[max(0, a - 32) : a])[-2:]]


class Field:
    """Weights of the segment features for each kind, and sums and maxima over segmentations."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((1, len(KINDS)))

    def scores(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """segments x kinds."""
        get, zero = self.index.get, len(self.weights) - 1
        rows = [[get(f, zero) for f in features(text, s)] for s in spans]
        ids = np.fromiter((i for r in rows for i in r), dtype=np.int64)
        return np.add.reduceat(self.weights[ids], np.cumsum([0, *(len(r) for r in rows)])[:-1], axis=0) if rows else np.zeros((0, len(KINDS)))

    @staticmethod
    def _before(spans: list[tuple[int, int]]) -> list[int]:
        """How many of the spans, sorted by end, end by each one's start."""
        ends = [s[1] for s in spans]
        return [bisect_right(ends, s[0]) for s in spans]

    def best(self, text: str, spans: list[tuple[int, int]]) -> list[Span]:
        """The segmentation of the highest score, with its kinds."""
        spans = sorted({s[:2] for s in spans}, key=lambda s: (s[1], s[0]))
        score = self.scores(text, spans)
        kind, high = score.argmax(axis=1).tolist(), score.max(axis=1).tolist()
        before, top, taken = self._before(spans), [0.0], []
        for value, k in zip(high, before):
            with_it = top[k] + value
            taken.append(with_it > top[-1])
            top.append(max(with_it, top[-1]))
        out, k = [], len(spans)
        while k:
            if taken[k - 1]:
                out.append((*spans[k - 1], KINDS[kind[k - 1]]))
                k = before[k - 1]
            else:
                k -= 1
        return out[::-1]

    def train(self, examples: list[tuple[str, list[Span]]], rounds: int = 6, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """Ascends the log-likelihood of the given segmentations, one example after the other."""
        data = []
        for text, gold in examples:
            spans = sorted({*open_candidates(text)[1], *(s[:2] for s in gold)}, key=lambda s: (s[1], s[0]))
            if not spans:
                continue
            want = np.zeros((len(spans), len(KINDS)))
            for a, b, kind in gold:
                want[spans.index((a, b)), KINDS.index(kind)] = 1
            rows = [[self.index.setdefault(f, len(self.index)) for f in features(text, s)] for s in spans]
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            data.append((self._before(spans), np.array([i for r in rows for i in r]), owner, np.cumsum([0, *(len(r) for r in rows)])[:-1], want))
        self.weights = np.zeros((len(self.index) + 1, len(KINDS)))  # the last row: features never seen
        grown = np.ones_like(self.weights)
        for _ in range(rounds):
            for before, ids, owner, first, want in data:
                score = np.add.reduceat(self.weights[ids], first, axis=0)
                most = score.max(axis=1, keepdims=True)
                each = np.exp(score - most)
                weight = (most[:, 0] + np.log(each.sum(axis=1))).tolist()  # of the segment as any kind
                forward = [0.0]  # log of the summed scores of what lies before
                for w, k in zip(weight, before):
                    forward.append(_add(forward[-1], forward[k] + w))
                chance = [0.0] * (len(before) + 1)  # of each prefix being where the next segment starts
                chance[-1] = 1.0
                inside = np.zeros(len(before))
                for k in range(len(before), 0, -1):
                    p = chance[k] * math.exp(forward[before[k - 1]] + weight[k - 1] - forward[k])
                    inside[k - 1] = p
                    chance[before[k - 1]] += p
                    chance[k - 1] += chance[k] - p
                step = (want - inside[:, None] * each / each.sum(axis=1, keepdims=True))[owner]
                live = np.abs(step).max(axis=1) > 1e-4
                at, d = ids[live], step[live]
                d = d - decay * self.weights[at]
                np.add.at(grown, at, d * d)
                np.add.at(self.weights, at, rate * d / np.sqrt(grown[at]))
        return self


def _add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def _with_luhn(body: str) -> str:
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def sentences(n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Made-up sentences with marked personal data, and others with numbers that only look like it."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))

    def phone():
        area, a, b = r.choice("23456789") + number(2), r.choice("23456789") + number(2), number(4)
        return r.choice([f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"{area} {a} {b}", f"1-{area}-{a}-{b}", f"({area}) {a} {b}", f"0{number(3)}/{number(6)}", f"0{number(2)} {number(4)} {number(4)}", f"+1 ({area}) {a}-{b}", f"+{r.choice(['44', '49', '33'])} {area} {a} {b}"])

    def card():
        d, s = _with_luhn(r.choice("3456") + number(14)), r.choice([".", "/", ". ", " / ", " ", "-", ""])
        return s.join(d[k : k + 4] for k in range(0, 16, 4))

    def ip():
        part = lambda: f"{r.randrange(1, 1 << 16):x}"
        word = lambda: "".join(r.choice("abcdef") for _ in range(4))
        return r.choice([":".join(part() for _ in range(8)), ":".join((word if r.random() < 0.7 else part)() for _ in range(8)), f"2001:db8::{part()}", f"fe80::{part()}:{part()}:{part()}", f"2a00:{part()}::{part()}:{part()}", ":".join(part() for _ in range(r.randint(1, 4))) + "::" + ":".join(part() for _ in range(r.randint(1, 3)))])

    def email():
        user, host, end = r.choice([name(), name(), f"{name()}.{name()}", f"{name()[:1]}.{name()}", f"{name()}{number(2)}"]), r.choice([name(), name(), name(), f"{name()}.{name()}"]), r.choice(["com", "org", "net", "de", "fr", "io"])
        return r.choice([f"{user} [at] {host} [dot] {end}", f"{user}(at){host}.{end}", f"{user} at {host} dot {end}", f"{user}[at]{host}[dot]{end}", f"{user} [at] {host}.{end}", f"{user} @ {host} . {end}", f"{user} (at) {host} (dot) {end}", f"{user} at {host} dot {end}"])

    letters = lambda: r.choice(["abc", "def", "bad", "cafe", "face", "add", "dad", "beef", "dead", "fade", "abba", name(), name()])

    def other():
        h = r.randint(0, 23)
        broken = next(x for x in iter(lambda: r.choice("3456") + number(15), None) if not luhn(x))
        return r.choice([
            f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}", f"{h:02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", number(r.randint(7, 15)), broken,
            ".".join(broken[k : k + 4] for k in range(0, 16, 4)), " ".join(number(r.randint(1, 4)) for _ in range(r.randint(3, 7))), f"{number(3)}.{number(3)}.{number(3)}", f"{number(1)}.{number(2)}.{number(4)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
            f"{number(4)}-{number(4)}", f"{number(5)}-{number(5)}", f"{number(2)}/{number(2)}/{number(4)} {number(2)}.{number(2)}", f"{name()} at {name()} . {name()}", f"at {name()} dot", f"{name()}::{name()}::{name()}", f"{number(1)}:{number(1)}:{number(2)}", f"${number(3)}.{number(3)}.{number(3)}",
            f"{r.randint(1900, 1999)}-{r.randint(2000, 2030)} {number(2)}", f"{number(3)} {number(4)} {number(2)} {number(5)}",
            f"{letters()}::{letters()}", f"{letters()}::{letters()}::{letters()}", f"{letters()}::{letters()}({number(1)})", f"{letters()}:{letters()}:{letters()}", f"{broken} {number(4)}", f"token = \"{''.join(r.choice('0123456789abcdef') for _ in range(40))}\"", number(r.randint(17, 40)), f"{number(2)}:{number(2)}:{number(2)}.{number(3)}",
        ])

    leads = {"phone": ["tel", "phone", "call", "fax", "mobile", "call us", "reach me at", "telephone:", "number is"], "card": ["card", "visa", "card number", "pay with", "charged to"], "ip": ["from", "host", "address", "server", "connect to"], "email": ["mail", "write to", "email:", "contact", "send it to"]}
    made = {"phone": phone, "card": card, "ip": ip, "email": email}
    out = []
    for _ in range(n):
        text, gold = " ".join(name() for _ in range(r.randint(0, 4))), []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                kind = r.choice(list(made))
                lead = r.choice(leads[kind]) if r.random() < 0.3 else name()
                body = made[kind]()
                text += f" {lead} "
                gold.append((len(text), len(text) + len(body), kind))
                text += body
                if kind in ("phone", "card") and r.random() < 0.45:  # run into another number
                    text += " "
                    body, kind = r.choice([(f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 255)}", ""), (card(), "card"), (phone(), "phone"), (number(r.randint(2, 5)), "")])
                    gold += [(len(text), len(text) + len(body), kind)] if kind else []
                    text += body
            else:
                text += f" {r.choice(['on', 'item', 'page', 'order', 'version', 'total', name(), name()])} {other()}"
            text += r.choice([" ", ", ", ". ", "\n", "; "]) + " ".join(name() for _ in range(r.randint(1, 3)))
        covered = base(text)
        gold = [s for s in gold if not any(s[0] < b and a < s[1] for a, b, _ in covered)]
        out.append((text, gold))
    return out


#: Training sentences; the seed fixes them.
SENTENCES = 2500


@lru_cache(maxsize=1)
def field() -> Field:
    return Field().train(sentences(SENTENCES))


def spans_of(text: str, model: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then kind."""
    found, free = open_candidates(text)
    more = model.best(text, free) if free else []
    return found, sorted(found + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base by kind, base_sha256, and all spans of every document."""
    model = field()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text in zip(part.column(0).to_pylist(), texts(part)):
            found, every = spans_of(text, model)
            rows.append((doc, *(sum(s[2] == k for s in found) for k in KINDS), hashlib.sha256(written(found).encode()).hexdigest(), written(every)))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in SPANS.split(", ")])

    return map_arrow(as_text(docs), run, SPANS, "text")


def redact(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans gives way to the name of its first kind in brackets."""
    parts, at, reach = [], 0, -1
    for a, b, kind in spans:
        if a >= reach:
            parts += [text[at:a] if a > at else "", f"[{kind.upper()}]"]
        at = reach = max(b, reach)
    return "".join(parts) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text; n_chars, if there, follows. Null text stays null."""
    model = field()
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                new = [t and redact(t, spans_of(t, model)[1]) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                if count >= 0:
                    columns[count] = pa.array([n if t is None else len(t) for t, n in zip(new, columns[count].to_pylist())], part.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
