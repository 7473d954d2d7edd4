"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A label's potential comes from the line's own features and those of its neighbours,
and two more parameters weigh pairs of labels. Forward-backward marginals, weighted by line length, give the document's
good share, which a logistic curve fitted on the training documents turns into a score.

Labels are of documents, so training starts from lines that carry their document's label and then, ``ROUNDS`` times,
frees lines of bad documents that the chain alone holds to be good. It sees at most ``SAMPLE`` labelled documents (those of
the least hash of doc_id), whole; crc32(doc_id) mod 5 = 0 is held out. Scores are of whole texts, too.

Lines end at line feeds; empty lines are none. Null and empty texts, and a model without labels of both kinds, score as
the training documents do on average (0.5 without any). Repeated rows are scored each; labels that are null, not 0 or 1,
or contradict each other are left out. An empty table gives no rows. Further columns are ignored. A very long text is a slice of
its own, at some 50 bytes of memory a byte of text, and its lines are one chain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, slices

SAMPLE = 4000
THRESHOLD = 0.3
ROUNDS, STEPS, RATE = 1, 100, 0.08
DECAY = 1e-4
#: Running sums take some 50 bytes for each byte of text: so much text at a time.
SLICE = 2 << 20
_BYTES = np.arange(256)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def _of(chars: str) -> np.ndarray:
    return np.isin(_BYTES, [ord(c) for c in chars])


#: Kinds of bytes that are counted in every line.
KINDS = [_SPACE, _UPPER, _LETTER, (_BYTES >= 48) & (_BYTES <= 57), _of(".,;:'\"-()"), _of("!?"), _of("#$%&*+=@^_~"), _of("|<>[]{}\\/`"), _BYTES >= 192]
OWN = len(KINDS) + 5
WIDTH = 3 * OWN + 3


@dataclass
class Lines:
    """Lines of several texts: the text each is in, its bytes [start, end) there, and its features."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray

    @property
    def length(self) -> np.ndarray:
        return self.end - self.start


def _counted(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each kind each span has: three counts go into one running sum of 21 bits each."""
    each = 3 if int((end - start).max(initial=0)) < 1 << 21 else 1
    out = np.empty((len(start), len(KINDS)))
    for k in range(0, len(KINDS), each):
        part = KINDS[k : k + each]
        table = sum(kind.astype(np.uint64) << np.uint64(21 * i) for i, kind in enumerate(part))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data], dtype=np.uint64)])
        both = sums[end] - sums[start]
        for i in range(len(part)):
            out[:, k + i] = (both >> np.uint64(21 * i)) & np.uint64((1 << 21) - 1) if each == 3 else both
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _hashes(data: np.ndarray):
    """A function of spans: their polynomial hashes, from one running sum."""
    n = len(data)
    up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * up[:n], dtype=np.uint64)])
    return lambda a, b: (sums[b] - sums[a]) * down[a]


def lines_of(array: pa.Array) -> Lines:
    """The lines of a string column."""
    array = array.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    feeds = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    start = start[start < len(data)]
    end = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, start)], offsets[np.searchsorted(offsets, start, side="right")]) if len(start) else start
    start, end = start[end > start], end[end > start]
    doc = np.searchsorted(offsets, start, side="right") - 1
    n, size = len(start), np.maximum(end - start, 1)
    own = np.zeros((n, OWN))
    if n:
        counts = _counted(data, start, end)
        space = _SPACE[data]
        gap = np.concatenate([[True], space])
        gap[offsets[:-1]] = True
        begin = np.flatnonzero(~space & gap[:-1])
        stop = np.append(space, True)
        stop[offsets[1:]] = True
        until = np.flatnonzero(~space & stop[1:]) + 1
        hashed = _hashes(data)
        word = hashed(begin, until)
        a, b = np.searchsorted(begin, start), np.searchsorted(begin, end)
        words = b - a
        same = np.concatenate([[0], np.cumsum(word[1:] == word[:-1])]) if len(word) else np.zeros(1)
        last = np.maximum(b - 1, 0)
        again = np.where(words > 1, same[np.minimum(last, len(same) - 1)] - same[np.minimum(a, len(same) - 1)], 0)
        line = np.stack([doc.astype(np.uint64), hashed(start, end)], axis=1)
        _, inverse, times = np.unique(line, axis=0, return_inverse=True, return_counts=True)
        own[:, : len(KINDS)] = counts / size[:, None]
        own[:, 1] = counts[:, 1] / np.maximum(counts[:, 2], 1)
        own[:, -5] = np.log1p(size) / 5
        own[:, -4] = counts[:, 2] / np.maximum(words, 1) / 10
        own[:, -3] = again / np.maximum(words - 1, 1)
        own[:, -2] = np.minimum(times[inverse.ravel()] - 1, 3) / 3
        own[:, -1] = np.isin(data[end - 1], [46, 33, 63, 34, 41])
    features = np.zeros((n, WIDTH), dtype=np.float32)
    features[:, :OWN] = own
    after = np.flatnonzero(doc[1:] == doc[:-1]) + 1 if n else np.zeros(0, np.int64)
    features[after, OWN : 2 * OWN] = own[after - 1]
    features[after - 1, 2 * OWN : 3 * OWN] = own[after]
    features[:, -3] = 1
    features[after, -2] = 1
    features[after - 1, -1] = 1
    return Lines(doc, start - offsets[doc], end - offsets[doc], features)


def chains(doc: np.ndarray) -> list[np.ndarray]:
    """The k-th element: the k-th line of every document that has one, longest documents first."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(doc)])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    return [first[: np.searchsorted(-size, -k, side="left")] + k for k in range(int(size.max(initial=0)))]


def marginals(unary: np.ndarray, pair: np.ndarray, steps: list[np.ndarray], want_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Chance of good for each line; with want_pairs, also the expected count of each pair of labels.

    unary: log-odds of good; pair: 2 x 2 log-potentials (label, next label). Messages are log-odds as well.
    """
    forward, backward = np.array(unary, dtype=np.float64), np.zeros(len(unary))
    (p00, p01), (p10, p11) = pair
    for k in range(1, len(steps)):
        came = forward[steps[k - 1][: len(steps[k])]]
        forward[steps[k]] += np.logaddexp(p01, p11 + came) - np.logaddexp(p00, p10 + came)
    for k in range(len(steps) - 1, 0, -1):
        goes = backward[steps[k]] + unary[steps[k]]
        backward[steps[k - 1][: len(steps[k])]] = np.logaddexp(p10, p11 + goes) - np.logaddexp(p00, p01 + goes)
    expected = np.zeros((2, 2))
    if want_pairs and len(steps) > 1:
        after = np.concatenate(steps[1:])
        came, goes = forward[after - 1], backward[after] + unary[after]
        joint = np.stack([np.full(len(after), p00), p01 + goes, p10 + came, p11 + came + goes])
        joint = np.exp(joint - joint.max(axis=0))
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50))), expected


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pair: np.ndarray
    slope: float
    shift: float
    prior: float

    def good(self, lines: Lines) -> np.ndarray:
        """The marginal chance of good for each line."""
        return marginals(((lines.features - self.mean) / self.scale) @ self.weights, self.pair, chains(lines.doc))[0]

    def scores(self, lines: Lines, docs: int) -> np.ndarray:
        share, some = shares(lines, self.good(lines), docs)
        return np.where(some, 1 / (1 + np.exp(-(self.slope * _logit(share) + self.shift))), self.prior)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def shares(lines: Lines, good: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The length-weighted share of good in each document, and which documents have lines."""
    total = np.bincount(lines.doc, lines.length, docs)
    return np.bincount(lines.doc, lines.length * good, docs) / np.maximum(total, 1), total > 0


def _ascend(gradient, size: int, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def fit(lines: Lines, quality: np.ndarray) -> Model:
    """lines: of the training documents; quality: their labels."""
    if not len(quality) or len(set(quality.tolist())) < 2 or not len(lines.doc):
        prior = float(quality.mean()) if len(quality) else 0.5
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(_logit(np.array(prior))), prior)
    mean, scale = lines.features.mean(axis=0), lines.features.std(axis=0) + 1e-3
    mean[-3], scale[-3] = 0, 1
    x, steps, n = (lines.features - mean) / scale, chains(lines.doc), len(lines.doc)
    follows = np.concatenate([steps[0][:0], *steps[1:]])
    label = quality[lines.doc].astype(float)
    for round_ in range(ROUNDS + 1):
        held = np.zeros((2, 2))
        np.add.at(held, (label[follows - 1].astype(int), label[follows].astype(int)), 1)

        def gradient(p):
            good, pairs = marginals(x @ p[:WIDTH], p[WIDTH:].reshape(2, 2), steps, True)
            return np.concatenate([x.T @ (label - good), (held - pairs).ravel()]) / n - DECAY * p

        p = _ascend(gradient, WIDTH + 4)
        if round_ < ROUNDS:  # what lines look like on their own, without the pull of their document
            alone = 1 / (1 + np.exp(-np.clip(x @ p[:WIDTH], -50, 50)))
            label = np.where(quality[lines.doc] == 0, (alone > 0.9).astype(float), 1.0)
    model = Model(mean, scale, p[:WIDTH], p[WIDTH:].reshape(2, 2), 1.0, 0.0, float(quality.mean()))
    share, some = shares(lines, model.good(lines), len(quality))
    z, y = _logit(share[some]), quality[some]
    curve = lambda p: np.array([((y - 1 / (1 + np.exp(-np.clip(p[0] * z + p[1], -50, 50)))) * f).mean() for f in (z, 1)]) - 1e-3 * p
    slope, shift = _ascend(curve, 2, 400)
    model.slope, model.shift = max(0.0, float(slope)), float(shift)
    return model


def held_out() -> F.Column:
    """crc32 of doc_id as text, mod 5, is 0; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From at most sample labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "quality")
    rows = as_text(docs).join(F.broadcast(chosen), "doc_id")  # sample rows at most
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))  # repeated ones once

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = lines_of(part.column(1))
                ends = np.searchsorted(found.doc, np.arange(part.num_rows + 1))
                cut = list(zip(ends, ends[1:]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([found.length[a:b].astype("<i8").tobytes() for a, b in cut], pa.binary()), pa.array([found.features[a:b].tobytes() for a, b in cut], pa.binary())],
                    names=["doc_id", "quality", "lengths", "features"],
                )

    got = rows.select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, lengths binary, features binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    sizes = [len(r["lengths"]) // 8 for r in got]
    length = np.frombuffer(b"".join(r["lengths"] for r in got), dtype="<i8")
    matrix = np.frombuffer(b"".join(r["features"] for r in got), dtype=np.float32).reshape(-1, WIDTH)
    return fit(Lines(np.repeat(np.arange(len(got)), sizes), np.zeros(len(length), np.int64), length, matrix), np.array([r["quality"] for r in got]))


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score of each row's text; all other columns stay."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                score = model.scores(lines_of(part.column(at)), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{column}` double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = scored(as_text(docs), train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return scored(docs, train(docs, labels), name).filter(F.col(name) >= THRESHOLD).select(*docs.columns)
