from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlake.llm import packing

from .conftest import ODD


def check(counts, configs, capacity):
    got = Counter()
    for held, n in configs:
        assert sum(k * v for k, v in held.items()) <= capacity and n > 0
        for k, v in held.items():
            got[k] += v * n
    assert got == Counter({k: v for k, v in counts.items() if v})


def test_configurations_cover_exactly():
    r = random.Random(1)
    for capacity in (10, 64, 2048) * 5:
        counts = {r.randint(1, capacity): r.randint(0, 500) for _ in range(r.randint(1, 30))}
        configs = packing.configurations(counts, capacity)
        check(counts, configs, capacity)
        check(counts, packing.best_fit(counts, capacity), capacity)
        assert sum(n for _, n in configs) <= sum(n for _, n in packing.best_fit(counts, capacity))
        some = {k: v for k, v in counts.items() if v}
        for used, price, bound in packing.program(some, capacity, 2, 40):
            covered = Counter()
            for config, often in used.items():
                assert sum(k * a for k, a in config) <= capacity and packing.worth(config, price) <= 1 + 1e-9
                for k, a in config:
                    covered[k] += often * a
            assert all(v <= counts[k] + 1e-6 for k, v in covered.items())
            assert bound <= sum(n for _, n in configs)
    assert packing.configurations({}) == []


def test_few_sequences():
    """Halves and thirds fill sequences without loss; small pieces come within one of the bound."""
    assert sum(n for _, n in packing.configurations({6: 10, 4: 10, 5: 4}, 10)) == 12
    counts = {k: 50 for k in range(3, 400)}
    assert sum(n for _, n in packing.configurations(counts, 2048)) <= -(-sum(k * v for k, v in counts.items()) // 2048) + 1


def size(configs):
    return sum(n for _, n in configs)


def test_lengths_without_exact_fillings():
    """1043 + 532 + 472 = 2047 and 2 x 551 + 2 x 472 = 2046: 9 sequences where best fit takes 11."""
    for n in (1, 7, 1000):
        counts = {1043: 6 * n, 551: 6 * n, 532: 6 * n, 472: 12 * n}
        configs = packing.configurations(counts, 2048)
        check(counts, configs, 2048)
        assert size(configs) == 9 * n and size(packing.best_fit(counts, 2048)) == 11 * n


def test_hot_lengths_among_others():
    r = random.Random(6)
    counts = Counter({1043: 6000, 551: 6000, 532: 6000, 472: 12000})
    counts.update({k: r.randint(1, 4) for k in r.sample(range(3, 1200), 150)})
    found = packing.solved(counts)
    check(counts, found.configs, 2048)
    assert found.bound <= found.size <= found.bound * 1.001 < size(packing.best_fit(counts, 2048)) - 1000
    assert found.placed > 0.99 * sum(counts.values())


def test_gap_to_planted_packings():
    """Full and nearly full configurations, planted: the program comes within a hundredth of what was planted and places most pieces."""
    r = random.Random(8)
    for _ in range(4):
        counts, planted = Counter(), 0
        for _ in range(r.randint(2, 8)):
            cuts = sorted(r.sample(range(200, 2048 - r.randint(0, 3)), r.randint(1, 3)))
            config = [b - a for a, b in zip([0, *cuts], [*cuts, 2048 - r.randint(0, 2)])]
            often = r.randint(50, 5000)
            planted += often
            for k in config:
                counts[k] += often
        found = packing.solved(counts)
        check(counts, found.configs, 2048)
        assert found.bound <= planted and found.bound <= found.size <= min(1.01 * planted + 2, size(packing.best_fit(counts, 2048)))
        assert found.placed > 0.5 * sum(counts.values())


def test_weights_decide(monkeypatch):
    """Without full configurations the prices must move: with prices that stay, more sequences are needed."""
    r = random.Random(7)
    every = [{r.randint(200, 1024): r.randint(1, 10 ** r.randint(1, 5)) for _ in range(r.randint(2, 25))} for _ in range(4)]
    with_them = packing.solved(every[3])
    check(every[3], with_them.configs, 2048)
    monkeypatch.setattr(packing, "RATE", 0.0)
    without = packing.solved(every[3])
    assert with_them.size < without.size <= size(packing.best_fit(every[3], 2048)) and without.bound < with_them.bound <= with_them.size


def test_many_lengths_meet_the_bound():
    """A histogram like that of texts, most lengths once or twice: the bound is met, and the program places much of it."""
    r = random.Random(9)
    counts = Counter(min(2048, int(r.lognormvariate(5.7, 1.0)) + 1) for _ in range(12_000))
    found = packing.solved(counts)
    check(counts, found.configs, 2048)
    assert found.size <= found.bound * (1 + packing.CLOSE) + 1 and found.placed > 0.3 * sum(counts.values())


def test_best_fit_goes_on_from_begun_sequences():
    configs = packing.best_fit({3: 3, 2: 1}, 10, [({6: 1}, 2)])
    check({6: 2, 3: 3, 2: 1}, configs, 10)
    assert size(configs) == 3


@pytest.mark.parametrize("few", [0, 64])
def test_pricing_is_the_best_configuration(monkeypatch, few):
    monkeypatch.setattr(packing, "FEW", few)
    r = random.Random(2)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(2, 15), 4)))
        values = np.array([r.random() for _ in lengths])
        config = packing.Prices(values, lengths, 20).config()
        value = sum(values[lengths.tolist().index(k)] * v for k, v in config.items())
        best = max(sum(a * v for a, v in zip(c, values)) for c in product(range(11), repeat=4) if sum(a * k for a, k in zip(c, lengths)) <= 20)
        assert abs(value - best) < 1e-9 and sum(k * v for k, v in config.items()) <= 20


def test_pack_table(docs):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = ODD + [(100 + k, "a b c d") for k in range(60)]
    got = packing.pack(docs(rows, clash=True), capacity=256, ids=True).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256].tobytes()
            want[i, k, a, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs([])).count() == 0
