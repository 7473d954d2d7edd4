"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints are 64 bits, bit by bit the majority of the XXH64 of all shingles. Two documents are linked if their
fingerprints differ in at most ``radius`` bits; classes are the connected components. Equal fingerprints collapse
first, so copies cost nothing further.

The bits are put into partitions, correlated ones together. If partition i gets u_i units and the units add up to
radius + 1, then linked fingerprints differ in fewer than u_i bits in some partition i; a dynamic program deals the units
so that the estimated work (probes and candidates, from all fingerprints' bit frequencies) is least. Each fingerprint
is listed under its own bits of a partition and under those reached by fewer than u_i flips, of which the highest
sets a bit (one side of a pair does the probing). Candidates are verified on all 64 bits, and a bucket gives the edges of
a spanning forest, never all its pairs. A bucket above ``FULL`` rows is cut into blocks and dealt out by pairs of blocks.

Null and empty texts have fingerprint zero and are linked like any other. Fewer words than a shingle make one shingle.
Repeated rows are each returned. Null doc_ids are ignored where a class's least doc_id is sought. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, slices, staged
from .components import components

WORDS = 4
SEED = 42
RADIUS = 4
#: Rows of a bucket that one block takes.
FULL = 2048
#: Seconds for a row that is dealt out, and for a pair that is verified: what the plan weighs.
ROW_COST, PAIR_COST = 2e-6, 2e-8
SALTS = 16
#: Hot keys are broadcast up to so many.
SMALL = 20_000
_U = np.uint64


def shingle_hashes(text: str, words: int = WORDS) -> bytes:
    """The XXH64 of each shingle, big-endian, one after the other."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six blanks
    if not found:
        return b""
    joined, digest = b" ".join(found), xxhash.xxh64_digest
    if len(found) <= words:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    return b"".join([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :])])


def fingerprints(hashes: list[bytes]) -> np.ndarray:
    """The fingerprint of each document's shingle hashes."""
    counts = np.array([len(h) // 8 for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    some = np.flatnonzero(counts)
    cut, total = [], 0
    for k in some.tolist():  # so many shingles are spread to bits at once
        if not cut or total + counts[k] > 200_000:
            cut.append([])
            total = 0
        cut[-1].append(k)
        total += counts[k]
    for part in cut:
        bits = np.unpackbits(np.frombuffer(b"".join([hashes[k] for k in part]), dtype=np.uint8)).reshape(-1, 64)
        n = counts[part]
        sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[part] = np.packbits(sums * 2 > n[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprinted(docs: DataFrame, *keep: str) -> DataFrame:
    """row, doc_id, fp (the fingerprint as a signed long) and the columns to keep (kept_...); staged."""
    first = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *(F.col(c).alias(f"kept_{c}") for c in keep))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints([shingle_hashes(t or "") for t in part.column(2).to_pylist()])
                rest = [part.column(k) for k in range(3, part.num_columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64)), *rest], names=["row", "doc_id", "fp", *part.schema.names[3:]])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields[3:])
    return staged(first.mapInArrow(run, f"row long, doc_id long, fp long{kinds}"), "fingerprints")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many have both set."""

    def run(batches):
        gram, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().astype(">i8").view(np.uint8)).reshape(-1, 64).astype(np.float32)
            gram += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([n] * 64, pa.int64()), *(pa.array(gram[:, k].astype(np.int64)) for k in range(64))], names=["i", "n", *(f"b{k}" for k in range(64))])

    sums = fps.select("fp").mapInArrow(run, "i int, n long, " + ", ".join(f"b{k} long" for k in range(64)))
    rows = sums.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(f"b{k}").alias(f"b{k}") for k in range(64))).collect()
    gram = np.zeros((64, 64))
    for r in rows:
        gram[r["i"]] = [r[f"b{k}"] for k in range(64)]
    return (rows[0]["n"] if rows else 0), gram


def grouped_bits(n: int, gram: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 the highest) in partitions of nearly equal size, each grown by the bit most correlated with it."""
    p = np.diag(gram) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((gram / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        own = [left.pop(int(np.argmax(corr[np.ix_(left, left)].sum(axis=1))))]
        while len(own) < size:
            own.append(left.pop(int(np.argmax(corr[np.ix_(left, own)].sum(axis=1)))))
        out.append(sorted(own))
    return out


def within(n: int, gram: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """The probability that two fingerprints differ in at most 0, 1, ... most bits of the part.

    The mean and variance of that number follow from how often each two bits are set together; a beta-binomial distribution
    has both. Without more spread than independent bits have, it is theirs.
    """
    share = gram[np.ix_(part, part)] / max(n, 1)  # both set
    p = np.diag(share)
    one, none = p[:, None] - share, 1 - p[:, None] - p[None, :] + share  # the first alone, neither
    both = 2 * (share * none + one * one.T)  # two fingerprints differ in both bits
    q = 2 * p * (1 - p)
    np.fill_diagonal(both, q)
    size, mean = len(part), float(q.sum())
    rate, spread = mean / size, float(both.sum()) - mean * mean
    excess = (spread / max(size * rate * (1 - rate), 1e-12) - 1) / max(size - 1, 1)
    if excess <= 1e-6 or not 0 < rate < 1:
        dist = np.zeros(most + 2)
        dist[0] = 1
        for x in q:
            dist[1:] = dist[1:] * (1 - x) + dist[:-1] * x
            dist[0] *= 1 - x
        return np.cumsum(dist[: most + 1])
    excess = min(excess, 0.999)
    a, b = rate * (1 - excess) / excess, (1 - rate) * (1 - excess) / excess
    term = [lgamma(size + 1) - lgamma(k + 1) - lgamma(size - k + 1) + lgamma(k + a) + lgamma(size - k + b) - lgamma(size + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b) for k in range(min(most, size) + 1)]
    out = np.cumsum(np.exp(term))
    return np.minimum(np.append(out, [out[-1]] * (most + 1 - len(out))), 1.0)


def plan(n: int, gram: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions with their units, of the least estimated work over 1 to radius + 1 partitions."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, radius + 2):
        parts = grouped_bits(n, gram, m)
        table = {0: (0.0, [])}  # units dealt so far: work, units of each partition
        for part in parts:
            close = within(n, gram, part, radius)
            work = [0.0]
            for u in range(1, radius + 2):
                probes = 1 + sum(comb(len(part), k) for k in range(1, u)) / 2
                work.append(n * probes * ROW_COST + n * n / 2 * close[u - 1] * PAIR_COST)
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, units) in table.items():
                for u in range(radius + 2 - used):
                    new = (cost + work[u], [*units, u])
                    if used + u not in step or new[0] < step[used + u][0]:
                        step[used + u] = new
            table = step
        cost, units = table[radius + 1]
        if best is None or cost < best[0]:
            best = cost, [(part, u) for part, u in zip(parts, units) if u]
    return best[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def listed(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """key, fp: every fingerprint under each key that it is listed at or probes."""
    todo = []
    for i, (bits, units) in enumerate(parts):
        places = [_U(1) << _U(63 - b) for b in bits]
        mask = _U(sum(int(x) for x in places))
        flips = [(_U(0), _U(0))] + [(_U(sum(int(x) for x in c)), max(c)) for k in range(1, units) for c in combinations(places, k)]
        todo.append((_U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)), mask, flips))

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for salt, mask, flips in todo:
                own = fp & mask
                for flip, top in flips:
                    chosen = slice(None) if not flip else (own & top) == 0
                    keys = _mixed((own[chosen] ^ flip) + salt)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[chosen].view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of these distinct fingerprints connect; each found member leaves the search."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    rest = fp
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                hit = rest[near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                todo.extend(hit)
                rest = rest[~near]
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def bucket_edges(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all buckets; rows with one key are neighbours. key: any array of sorted numbers."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    a, b = [], []
    left = np.repeat(np.where(size <= small, size, 0), size) - (np.arange(len(key)) - np.repeat(first, size)) - 1
    at = np.flatnonzero(left > 0)
    for d in range(1, small):
        at = at[left[at] >= d]
        if not len(at):
            break
        near = np.bitwise_count(fp[at] ^ fp[at + d]) <= radius
        a.append(fp[at[near]])
        b.append(fp[at[near] + d])
    for k in np.flatnonzero(size > small).tolist():
        x, y = forest(np.unique(fp[first[k] : first[k] + size[k]]), radius)
        a.append(x)
        b.append(y)
    none = np.zeros(0, dtype=np.uint64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame, radius: int = RADIUS, full: int = FULL, parts: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """a, b: edges that connect just what links connect. fps: fp, distinct. parts: a plan (bits, units), else the one of least work."""
    rows = listed(fps, parts or plan(*bit_moments(fps), radius))
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > full)
    first = hot.limit(SMALL + 1).collect()
    if first:
        many = len(first)
        hot = hot if many > SMALL else fps.sparkSession.createDataFrame([(r["key"], r["n"]) for r in first], "key long, n long")
        # block pairs (i, j) of a hot bucket: each row goes to all pairs with its own block
        blocks = F.ceil(F.col("n") / full).cast("long")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        rows = rows.join(F.broadcast(hot) if many <= SMALL else hot, "key", "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select(F.when(F.col("blocks") > 1, pair).otherwise(F.col("key")).alias("key"), "fp")

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(parts):
            key, fp = (np.concatenate(x) for x in zip(*parts))
            a, b = bucket_edges(key, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:  # whole buckets at a time; the last one may go on in the next batch
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1][0][-1] != key[0]):
                yield done([*held, (key[:cut], fp[:cut])])
                held = []
            held.append((key[cut:], fp[cut:]))
        if held:
            yield done(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(found: DataFrame, *keep: str, radius: int = RADIUS) -> DataFrame:
    """row, doc_id, fp, root, component_id (and the columns to keep) of every row of ``fingerprinted``."""
    rows = found.select("row", "doc_id", "fp", *keep)
    n = rows.count()
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", rows=n)
    roots = components(links(fps, radius), n)
    linked = fps.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("of_class"))
    # one class may hold most fingerprints: its rows are dealt out by salt, the classes' least ids to every salt
    salts = F.explode(F.array(*(F.lit(k) for k in range(SALTS))))
    classes = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least.withColumn("salt", salts), ["root", "salt"]).select("fp", "root", "of_class")
    known = fps.join(classes, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("of_class", "least").alias("component_id"))
    known = staged(known, "classes", rows=n)  # so that the last join stands alone and Spark can split a fingerprint that many rows share
    return rows.join(known, "fp").select("row", "doc_id", "fp", "root", "component_id", *keep)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of every row."""
    return near_duplicates(fingerprinted(docs)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the least doc_id, of several that of the least hash of all its columns, so that any
    partitioning keeps the same; of equal rows, any."""
    content = F.xxhash64(*(F.col(c).cast("string") for c in docs.columns))
    name = "content"
    while name in docs.columns:
        name += "_"
    found = fingerprinted(docs.withColumn(name, content), *docs.columns, name)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(f"kept_{name}").alias("content"), "row")
    kept = near_duplicates(found, f"kept_{name}").groupBy("root").agg(F.min(order).alias("first")).select("first.row")
    rows = found.select("row")
    dropped = staged(rows.join(kept, "row", "left_anti"), "dropped", rows=rows.count())
    return found.join(broadcast_if_small(dropped), "row", "left_anti").select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))
