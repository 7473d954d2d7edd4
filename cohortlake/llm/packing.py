"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration is a multiset of piece lengths that fits one sequence. Its program, as few configurations as cover
every length's count, depends on the histogram alone, which has at most ``capacity`` entries however large the corpus.
It is solved by multiplicative weights. Prices of lengths start at their share of a sequence, the dual of filling without
loss. A pass covers all counts in fractions: in each of its rounds a knapsack dynamic program over the prices, raised by how much
of a length is still uncovered, gives columns for the least covered lengths, full or not; columns of low worth wait for
later rounds. After a pass the price of each length rises by the factor exp(rate x loss), the loss being what the columns
that hold it fell short of the best column's worth, and the next pass begins. Every pass's prices give a bound that no
packing goes below. The fractional solution is rounded as the counts allow, and what that leaves is placed by best fit, also beside
what the columns left room for. The fewest sequences of all passes and of plain best fit count, with as much placed by
the program as can be; passes end where the bound is nearly met. Pieces find their place from their rank among pieces of equal
length: counts for each task and length, added up, stand for any global sort.

Null text reads as empty (the end token alone). Equal rows are packed once each. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, slices, staged, texts
from .tokens import encoder

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Passes over the program, rounds of pricing in each, and columns of a round.
PASSES, ROUNDS, COLUMNS = 6, 120, 384
#: How strongly prices rise after a pass (less each time), and within one with the share of a length still uncovered.
RATE, WITHIN = 2.0, 0.05
#: Amounts from here on are halved in the first half of a pass; smaller ones stay whole, so short counts need no rounding.
HALVED = 32
#: What rounding tries: the worth a column needs, and the share of each column's use that is rounded. The rest goes to best fit.
WORTHS, SHARES = (0.0, 0.9, 0.995, 1 - 1e-9), (1.0, 0.97, 0.9, 0.75)
#: Up to so many lengths, the knapsack program goes by lengths, else by capacities; both are exact.
FEW = 64
#: Passes end where no packing can be smaller by more than this share.
CLOSE = 1e-4
NEAR = 1e-9
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids] of every document, with its task and its number among the
    pieces of equal length there."""

    def run(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                out: tuple[list, ...] = tuple([] for _ in range(8))
                for doc, data in zip(part.column(0).to_pylist(), encoder(vocabulary).ids(texts(part))):
                    data += tail
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        piece = data[at : at + 4 * capacity]
                        n = len(piece) // 4
                        for column, x in zip(out, (doc, k, at // 4, n, zlib.crc32(piece), task, seen[n], piece)):
                            column.append(x)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 8 if ids else 7]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"][: len(kinds)]
    return as_text(docs).mapInArrow(run, PIECES + ", ids binary" * ids)


class Prices:
    """The best value that each capacity can hold, by unbounded knapsack. lengths ascend."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.best, self.last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        if len(lengths) <= FEW:  # length by length, 1, 2, 4, ... pieces of it at a time
            for k, (length, value) in enumerate(zip(lengths.tolist(), values.tolist())):
                while length <= capacity:
                    total = self.best[:-length] + value
                    better = total >= self.best[length:]  # ties go to the longest
                    self.best[length:][better], self.last[length:][better] = total[better], k
                    length, value = 2 * length, 2 * value
            return
        upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
        for c in range(int(lengths[0]), capacity + 1):
            n = upto[c]
            total = self.best[c - lengths[:n]] + values[:n]
            k = int(n - 1 - np.argmax(total[::-1]))  # ties go to the longest, which leaves short pieces to fill the rest
            if total[k] > self.best[c - 1]:
                self.best[c], self.last[c] = total[k], k
            else:
                self.best[c] = self.best[c - 1]

    def config(self, first: int = 0) -> dict[int, int]:
        """The configuration of the highest value (that holds the length first)."""
        found, c = Counter([first] * (first > 0)), self.capacity - first
        while c > 0:
            if self.last[c] < 0 or self.best[c] == self.best[c - 1]:
                c -= 1
            else:
                found[int(self.lengths[self.last[c]])] += 1
                c -= int(self.lengths[self.last[c]])
        return dict(found)


def best_fit(counts: dict[int, int], capacity: int, begun: list[tuple[dict[int, int], int]] = []) -> list[tuple[dict[int, int], int]]:  # noqa: B006
    """Best-fit decreasing, on groups of sequences that hold the same lengths: (lengths, how many sequences), those begun included."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    for held, n in begun:
        open_.setdefault(capacity - sum(k * v for k, v in held.items()), []).append((held, n))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            fits = room // length
            while left and open_.get(room):
                held, n = open_[room].pop()
                full = min(n, left // fits)
                rest = left - full * fits if full < n else 0
                if full:
                    open_.setdefault(room - fits * length, []).append((held | {length: held.get(length, 0) + fits}, full))
                if rest:
                    open_.setdefault(room - rest * length, []).append((held | {length: held.get(length, 0) + rest}, 1))
                if n - full - (rest > 0):
                    open_.setdefault(room, []).append((held, n - full - (rest > 0)))
                left -= full * fits + rest
            if not open_.get(room):
                open_.pop(room, None)
            if not left:
                break
        fits = capacity // length
        for n, each in ((left // fits, fits), (1, left % fits)):
            if n and each:
                open_.setdefault(capacity - each * length, []).append(({length: each}, n))
    return [x for group in open_.values() for x in group]


Used = dict[tuple[tuple[int, int], ...], float]


def covered(counts: dict[int, int], price: dict[int, float], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Used:
    """One pass: configurations (lengths with how many of each) and how often to use them, in fractions, never above the counts.

    price: of each length, such that no configuration is worth more than 1. Columns worth less are taken as rounds go by.
    """
    left, used = {k: float(v) for k, v in counts.items()}, {}
    for r in range(rounds):
        lengths = np.array(sorted(k for k, v in left.items() if v > NEAR))
        if not len(lengths):
            break
        share = np.array([left[k] / counts[k] for k in lengths.tolist()])
        own = np.array([price[k] for k in lengths.tolist()])
        prices = Prices(own * np.exp(WITHIN * (share - share.max())), lengths, capacity)
        least = 1 - ((r + 1) / rounds) ** 3
        for first in lengths[np.lexsort((-lengths, -share))][:COLUMNS].tolist():
            if left[first] <= NEAR:
                continue
            config = {k: min(a, max(1, int(left[k] + NEAR))) for k, a in prices.config(first).items()}
            step = min(left[k] / a for k, a in config.items())
            if step <= NEAR or sum(price[k] * a for k, a in config.items()) < least - NEAR:
                continue
            if 2 * r < rounds:
                step = step / 2 if step >= HALVED else math.ceil(step / 2) if step >= 1 else step
            key = tuple(sorted(config.items(), reverse=True))
            used[key] = used.get(key, 0.0) + step
            for k, a in config.items():
                left[k] -= step * a
    return used


def program(counts: dict[int, int], capacity: int = CAPACITY, passes: int = PASSES, rounds: int = ROUNDS) -> Iterator[tuple[Used, dict[int, float], int]]:
    """The solution of each pass, its prices, and the best bound on the number of sequences so far."""
    lengths = np.array(sorted(counts))
    asked = np.array([float(counts[k]) for k in lengths.tolist()])
    price, bound, at = lengths / capacity, 0, {k: i for i, k in enumerate(lengths.tolist())}
    for n in range(passes):
        price = price / Prices(price, lengths, capacity).best[capacity]
        bound = max(bound, math.ceil(float(price @ asked) - 1e-6))
        named = dict(zip(lengths.tolist(), price.tolist()))
        used = covered(counts, named, capacity, rounds)
        yield used, named, bound
        loss = np.zeros(len(lengths))
        for config, often in used.items():
            short = 1 - worth(config, named)
            for k, a in config:
                loss[at[k]] += often * a * short
        price = price * np.exp(RATE / (n + 1) * loss / asked)


def worth(config: tuple[tuple[int, int], ...], price: dict[int, float]) -> float:
    return sum(price[k] * a for k, a in config)


def rounded(counts: dict[int, int], used: Used, share: float = 1.0) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """A program's solution (or that share of it) in whole sequences as the counts allow, and what it leaves. The most used columns
    come first; what rounding down leaves of one goes on to the next."""
    left, done, due = dict(counts), [], 0.0
    for config, often in sorted(used.items(), key=lambda x: -x[1]):
        due += often * share
        n = min(int(due + 1e-6), *(left[k] // a for k, a in config))
        due = min(due - n, 1.0)
        if n:
            done.append((dict(config), n))
            for k, a in config:
                left[k] -= n * a
    return done, {k: v for k, v in left.items() if v}


@dataclass
class Packing:
    """configs cover the counts exactly: (lengths, how many sequences). bound: no packing has fewer. placed: pieces that the
    program placed, those that nothing goes beside included."""

    configs: list[tuple[dict[int, int], int]]
    bound: int
    placed: int

    @property
    def size(self) -> int:
        return sum(n for _, n in self.configs)


def solved(counts: dict[int, int], capacity: int = CAPACITY, passes: int = PASSES, rounds: int = ROUNDS) -> Packing:
    left = {k: v for k, v in counts.items() if v}
    alone = [({k: 1}, left.pop(k)) for k in [k for k in left if capacity - k < min(left)]]  # nothing goes beside these
    single = sum(n for _, n in alone)
    if not left:
        return Packing(alone, single, single)
    best = Packing(alone + best_fit(left, capacity), 0, single)
    for used, price, bound in program(left, capacity, passes, rounds):
        best.bound = single + bound
        for least, share in product(WORTHS, SHARES):
            begun, rest = rounded(left, {c: x for c, x in used.items() if worth(c, price) >= least}, share)
            tried = Packing(alone + best_fit(rest, capacity, begun), single + bound, single + sum(left.values()) - sum(rest.values()))
            best = min(best, tried, key=lambda p: (p.size, -p.placed))
        if best.size <= best.bound * (1 + CLOSE):
            break
    return best


def configurations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    return solved(counts, capacity).configs


def places(configs: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of it in each sequence, first offset), by length and rank."""
    rows, ranks, first = [], Counter(), 0
    for held, n in configs:
        at = 0
        for length, each in sorted(held.items(), reverse=True):
            rows.append((length, ranks[length], first, each, at))
            ranks[length] += n * each
            at += length * each
        first += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = 0, ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset; ids: also the token ids, as little-endian unsigned 32 bits."""
    cut = staged(pieces(docs, capacity, vocabulary, end, ids), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = places(configurations(counts, capacity))
    base = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    keys = table[:, 0] * (1 << 48) + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            if len(length) == 0:
                continue
            _, start, first, each, at = table[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1].T
            sequence, nth = first + (rank - start) // each, (rank - start) % each
            columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(at + nth * length)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return ranked.select(*names, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
