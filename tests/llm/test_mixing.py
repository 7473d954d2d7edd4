from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import pytest

from cohortlake.llm import mixing

from .conftest import CLASHES, ODD


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(rows):
    """Resharing until no target is above its cap."""
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in names}, sizes
        for s in over:
            capped[s] = 2.0 * sizes[s]


def rows(seed, n=300):
    r = random.Random(seed)
    out = [(100 + k, " ".join("w" * r.randint(1, 4) for _ in range(r.choice([0, 1, 5, 40, 300]))), r.choice(["a", "a", "a", "a", "b", "c", "é", "z", "", None])) for k in range(n)]
    return out + [(i, t, "odd") for i, t, *_ in ODD] + [(10_000, "x " * 30_000, "b")]


def dealt(rows_, slots, golden=mixing.GOLDEN):
    """The schedule slot by slot: source -> its slots; and the words of a block."""
    want, _ = plain_targets(rows_)
    need = {s: int(t + 0.5) for s, t in want.items() if int(t + 0.5) > 0}
    words = sum(need.values())
    block = max(1, -(-words // max(slots, mixing.EACH * len(need))))
    out = defaultdict(list)
    for k in range((2 * words + block) // (2 * block)):
        at = min(int((k * golden % 1) * words), words - 1)
        for s in sorted(need, key=lambda s: "n" if s is None else "s" + s):
            if at < need[s]:
                out[s].append(k)
                break
            at -= need[s]
    return out, block


@pytest.mark.parametrize("slots", [1500, 1 << 17])
def test_taken_meets_targets(docs, monkeypatch, slots):
    monkeypatch.setattr(mixing.mix, "__defaults__", (slots,))
    data = rows(1)
    got = mixing.taken(docs(data, clash=True)).collect()
    want, sizes = plain_targets(data)
    plan, block = dealt(data, slots)
    assert len(got) == len(data)
    sums = defaultdict(int)
    source = {i: s for i, _, s in data if i is not None and i > 9}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] in source:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
            sums[s] += r["taken"]
    for s in set(source.values()) - {"odd"}:
        assert sums[s] == min(len(plan[s]) * block, 2 * sizes[s]) and abs(sums[s] - want[s]) <= 3 * block
        mine = [r for r in got if r["doc_id"] in source and source[r["doc_id"]] == s]
        assert {r["slot"] for r in mine} - {-1} <= set(plan[s]) and min(r["slot"] for r in mine if r["taken"]) == plan[s][0]


def test_the_golden_ratio_decides(docs, monkeypatch):
    """Other points give other sources, other amounts and another order."""
    data = [r for r in rows(1) if r[0] is not None and r[0] > 9]
    df = docs(data)
    pick = lambda: sorted((r["doc_id"], r["taken"], r["slot"]) for r in mixing.taken(df).collect())
    first = pick()
    for golden in (0.5, 0.0, 2**0.5 / 7):
        monkeypatch.setattr(mixing, "GOLDEN", golden)
        other = pick()
        assert [x[2] for x in other] != [x[2] for x in first]
        if golden in (0.5, 0.0):  # few sources get any
            assert [x[1] for x in other] != [x[1] for x in first]


def test_equal_ids_and_rows_do_not_depend_on_partitions(docs):
    """Rows with one id differ by their texts, equal rows are alike: any partitioning gives the same rows."""
    r = random.Random(5)
    data = [(r.choice([None, 1, 2]), "w " * r.choice([0, 1, 7, 30]) + r.choice("ab"), r.choice("xy")) for _ in range(200)]
    pick = lambda df: sorted(map(str, mixing.taken(df).drop("row").collect()))
    df = docs(data)
    assert pick(df) == pick(df.repartition(5)) == pick(df.repartition(2, "text"))


def test_reruns_agree_and_sql_agrees(docs):
    data = [r for r in rows(2) if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    df = docs(data)
    one = sorted(map(tuple, mixing.taken(df).drop("row").collect()))
    assert one == sorted(map(tuple, mixing.taken(df.repartition(3)).drop("row").collect()))
    documents = df.toPandas()  # noqa: F841  read by DuckDB
    assert one == sorted(duckdb.sql(mixing.SQL).fetchall())


def test_schedule_is_even(docs, spark):
    """In any stretch of slots, each source has about its share."""
    sources = spark.createDataFrame([("a", 500_000.0), ("b", 300_000.0), ("c", 200_000.0), ("d", 10.0), ("e", 0.0)], "key string, target double")
    got, block, n = mixing.schedule(sources, 1000)
    got = got.collect()
    assert block == 1001 and len(got) == n and sorted(r["slot"] for r in got) == list(range(n))
    need = {"a": 500, "b": 300, "c": 200, "d": 1}
    by = defaultdict(list)
    for r in got:
        by[r["key"]].append((r["rank"], r["slot"]))
    assert all(sorted(x for x, _ in v) == list(range(len(v))) and abs(len(v) - need[k]) <= 2 for k, v in by.items())
    for k in "abc":
        slots = [s for _, s in sorted(by[k])]
        assert slots == sorted(slots)
        for start in range(0, 900, 100):  # chunks of slots do not show
            n = sum(start <= s < start + 100 for s in slots)
            assert abs(n - need[k] / 10) <= 4


def test_mix_covers_each_stream_once(docs, spark):
    data = rows(3, 80)
    sizes = mixing.sized(docs(data))
    sources = mixing.targets(sizes)
    parts = mixing.mix(mixing.placed(sizes, sources), sources, 4000).collect()
    for r in parts:
        assert 0 < r["words"] and r["first"] >= 0
    assert len({(r["row"], r["epoch"], r["first"]) for r in parts}) == len(parts)


def test_empty(docs):
    assert mixing.taken(docs([])).count() == 0
    assert mixing.mixed_documents(docs([])).count() == 0
    (r,) = mixing.taken(docs([(1, None, None)])).collect()
    assert (r["size"], r["target"], r["taken"]) == (0, 0.0, 0)


def test_mixed_documents(docs):
    data = rows(4)
    df = docs(data, clash=True)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and set(CLASHES) <= set(out.columns)
    times = defaultdict(int)
    slot = {(r["doc_id"], r["size"]): r["slot"] for r in mixing.taken(df).collect() if r["doc_id"] is not None and r["doc_id"] > 9}
    seen, order = set(), []
    for r in out.collect():
        if (key := (r["doc_id"], size(r["text"]))) in slot and key not in seen:
            seen.add(key)
            order.append(slot[key])
    assert order == sorted(order) and len(order) > 100  # rows come in the order of the schedule
    for r in out.collect():
        times[r["doc_id"], r["text"]] += 1
    for r in mixing.taken(docs([x for x in data if x[0] is not None and x[0] > 9])).collect():
        assert r["taken"] <= 2 * r["size"]
    assert max(v for (i, _), v in times.items() if i not in (6,)) <= 2
