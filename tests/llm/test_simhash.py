from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from cohortlake.llm import simhash
from cohortlake.llm.components import components

from .conftest import ODD


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def classes_of(rows):
    fps = [plain(t) for _, t, *_ in rows]
    root = union(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (i, *_), r in zip(rows, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return sorted(((rows[k][0], f"{fps[k]:016x}", least[root[k]]) for k in range(len(rows))), key=str)


def near_copies(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(n):
        base = [word() for _ in range(r.choice([3, 8, 80, 200]))]
        for c in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2])):
                copy[r.randrange(len(copy))] = word()
            rows.append((1000 * k + c, " ".join(copy)))
    return rows


def test_classes_against_all_pairs(docs):
    rows = ODD + near_copies(1) + [(99, "Word"), (98, "word")]
    got = sorted(map(tuple, simhash.classes(docs(rows, clash=True)).collect()), key=str)
    assert got == classes_of(rows)
    assert simhash.classes(docs([])).count() == 0
    assert [tuple(r) for r in simhash.classes(docs([(5, None)])).collect()] == [(5, "0" * 16, 5)]


def test_deduplicated_keeps_one_of_each_class(docs):
    rows = ODD + near_copies(2, 30)
    kept = simhash.deduplicated(docs(rows, clash=True))
    assert kept.columns == docs(rows, clash=True).columns
    want = {c for _, _, c in classes_of(rows)}
    got = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(got) == len(set(got)) and {x for x in got if x is not None} == {c for c in want if c is not None}


def ball(n, seed, spread=6):
    """Fingerprints round one centre, and as many anywhere."""
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for _ in range(n):
        bits = rng.integers(0, 64, spread)
        out = np.append(out, np.bitwise_xor.reduce(np.left_shift(np.uint64(1), bits.astype(np.uint64))) ^ np.uint64(0x123456789ABCDEF0))
    return np.unique(out)


@pytest.mark.parametrize("full", [8, 2048])
def test_links_with_hot_buckets(spark, full):
    fp = ball(150, 3)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = simhash.links(df, full=full).collect()
    place = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    assert all((int(fp[place[e["a"]]]) ^ int(fp[place[e["b"]]])).bit_count() <= 4 for e in edges)
    true = [(i, j) for i, j in combinations(range(len(fp)), 2) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 4]
    assert union(len(fp), [(place[e["a"]], place[e["b"]]) for e in edges]) == union(len(fp), true)


UNEQUAL = [[(list(range(32)), 3), (list(range(32, 64)), 2)], [(list(range(20)), 1), (list(range(20, 40)), 1), (list(range(40, 64)), 3)], [(list(range(10, 64)), 4), (list(range(10)), 1)]]


@pytest.mark.parametrize("parts", [*UNEQUAL, None])
def test_links_of_unequal_thresholds(spark, parts):
    """Whole classes by plans of unequal thresholds, against all pairs."""
    fp = ball(60, 7, 5)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = simhash.links(df, full=64, parts=parts).collect()
    place = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    true = [(i, j) for i, j in combinations(range(len(fp)), 2) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 4]
    assert true and union(len(fp), [(place[e["a"]], place[e["b"]]) for e in edges]) == union(len(fp), true)


def test_estimates_count_joint_bits():
    """How often two fingerprints agree on a partition of correlated bits: counted, and estimated from the bits' pair moments."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (3000, 8))
    bits = np.repeat(base, 8, axis=1) ^ (rng.random((3000, 64)) < 0.05)
    gram = (bits.T @ bits).astype(float)
    part = simhash.grouped_bits(3000, gram, 4)[0]
    a, b = bits[rng.integers(0, 3000, 40_000)][:, part], bits[rng.integers(0, 3000, 40_000)][:, part]
    apart = (a != b).sum(axis=1)
    got = simhash.within(3000, gram, part, 4)
    p = bits.mean(axis=0)[part]
    alone = np.prod(1 - 2 * p * (1 - p))  # as if bits were independent
    for k in (1, 2, 3, 4):
        want = (apart <= k).mean()
        assert want / 3 < got[k] < want * 3 and got[k] > 50 * alone
    free = rng.integers(0, 2, (3000, 64))
    got = simhash.within(3000, (free.T @ free).astype(float), list(range(16)), 3)
    assert got[3] == pytest.approx(sum(__import__("math").comb(16, k) for k in range(4)) / 2**16, rel=0.2)


def test_ties_of_ids_do_not_depend_on_partitions(docs):
    rows = [(1, "same words in here"), (1, "same words in here", "b"), (None, "other"), (None, "other", "c")] * 3
    pick = lambda df: sorted(map(str, simhash.deduplicated(df).collect()))
    assert pick(docs(rows)) == pick(docs(rows[::-1]).repartition(3)) and len(pick(docs(rows))) == 2


def test_every_plan_finds_every_link(spark):
    """Whatever the units, a pair within the radius shares a key."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    pairs = [(x, x ^ np.bitwise_xor.reduce(np.left_shift(np.uint64(1), rng.choice(64, d, replace=False).astype(np.uint64)))) for x in a for d in range(1, 5)]
    fps = sorted({int(v.view(np.int64)) for p in pairs for v in p})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    bits = list(range(64))
    for parts in ([(bits[:32], 3), (bits[32:], 2)], [(bits[:20], 1), (bits[20:40], 2), (bits[40:], 2)], [(bits[k::5], 1) for k in range(5)]):
        keys = {}
        for r in simhash.listed(df, parts).collect():
            keys.setdefault(r["fp"], set()).add(r["key"])
        assert all(keys[int(x.view(np.int64))] & keys[int(y.view(np.int64))] for x, y in pairs)


def test_plan_deals_all_units():
    gram = np.full((64, 64), 2500.0)
    np.fill_diagonal(gram, 5000.0)
    for n in (10, 10_000, 10**9):
        parts = simhash.plan(n, gram * n / 10_000)
        assert sum(u for _, u in parts) == 5
        assert len({b for bits, _ in parts for b in bits}) == sum(len(bits) for bits, _ in parts)
    assert simhash.plan(0, np.zeros((64, 64)))


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (2000, 64))
    bits[:, 40] = bits[:, 3]
    parts = simhash.grouped_bits(2000, (bits.T @ bits).astype(float), 4)
    assert any({3, 40} <= set(p) for p in parts) and sorted(b for p in parts for b in p) == list(range(64))


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(150)] + [(500, 501 + k) for k in range(50)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(1100, edges)
    assert got == {n: want[n] for n in {v for e in edges if e[0] != e[1] for v in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
