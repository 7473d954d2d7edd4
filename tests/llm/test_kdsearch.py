from __future__ import annotations

import numpy as np
import pytest

from cohortlake.llm import kdsearch

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    ok = [(i, np.floor(256 * np.asarray(v, dtype=np.float32).astype(float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = sorted((-int(sum(int(x) * int(y) for x, y in zip(a, b))), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **how):
    return sorted(map(tuple, kdsearch.top_k(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), **how).collect()))


@pytest.mark.parametrize("shard,block", [(64, 3), (4096, 512)])
def test_against_all_pairs(spark, monkeypatch, shard, block):
    monkeypatch.setattr(kdsearch, "SHARD", shard)
    monkeypatch.setattr(kdsearch, "BLOCK", block)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 12))
    rows = [(k, (centres[k % 6] + rng.normal(size=12) / 4).tolist()) for k in range(700)]
    rows += [(700 + k, centres[0].tolist()) for k in range(120)]  # ties
    rows += [(900, None), (950, [None] + [1.0] * 11), (951, [float("nan")] * 12), (952, [float("inf")] * 12), (None, [1.0] * 12), (1000, [1.0, 2.0]), (1001, [3.0, -1.0]), (1050, [])]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]


def test_repeated_query_ids(spark):
    """Rows of a query's own id, which score highest, take no places of its neighbours."""
    rng = np.random.default_rng(3)
    others = [(k + 1, [float(x) for x in rng.uniform(0, 1, 4)]) for k in range(40)]
    for own in (2, 6, 30, 300):
        rows = others + [(50, [9.0] * 4)] * own
        assert run(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = [(k, [float(4 * 10**6 + k * 16384), float(k % 3)]) for k in range(60)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [*rows, (100, [1e30, 0.0]), (101, [3e38, 3e38])]) == brute(rows)


def test_wide_vectors_with_narrow_products(spark, monkeypatch):
    """One component above 2^63 / 64 squared keeps no vector out whose products fit; doubles would not tell these scores apart."""
    monkeypatch.setattr(kdsearch, "SHARD", 8)
    rows = [(k, [float(k % 7), 1.0, float(k)]) for k in range(60)] + [(100, [2.0**31, 0.0, 0.0]), (150, [0.0, 2.0**40, 1.0]), (151, [0.0, 2.0**5, 1.0])]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="no long"):
        run(spark, [*rows, (152, [0.0, 2.0**40, 0.0])])


def test_boxes_are_tight_and_leaves_whole():
    rng = np.random.default_rng(1)
    vectors, ids = rng.integers(-50, 50, (500, 5)).astype(float), np.arange(500)
    tree = kdsearch.Tree(vectors, ids, leaf=16)
    assert sorted(tree.ids.tolist()) == list(range(500))
    for (a, b, left, _), lo, hi in zip(tree.nodes.tolist(), tree.lo, tree.hi):
        assert (tree.vectors[a:b].min(axis=0) == lo).all() and (tree.vectors[a:b].max(axis=0) == hi).all()
        assert left >= 0 or b - a <= 16
    again = kdsearch.Tree.of_bytes(tree.to_bytes())
    assert (again.vectors == tree.vectors).all()


def test_bound_prunes(monkeypatch):
    """A known kth result spares the search all that cannot beat it."""
    rng = np.random.default_rng(2)
    tree = kdsearch.Tree(rng.normal(size=(2000, 3)).round(2) * 100, np.arange(2000))
    q = np.array([[50.0, 20.0, -10.0]])
    (top,) = tree.search(q, np.array([-1]), 5, np.array([-np.inf]), np.array([0]))
    (none,) = tree.search(q, np.array([-1]), 5, np.array([float(top[0][0])]), np.array([top[0][1]]))
    assert len(top) == 5 and none == []


def test_further_columns_and_their_names(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(120)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", *(f"'x' AS `{c}`" for c in ("row", "dim", "shard", "vec", "block", "worst", "worst_id", "tree", "query", "score", "rank", "query_id")))
    got = kdsearch.top_k(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == brute(rows)


def test_vectors_of_all_widths_meet(spark):
    """Components of 2, 4 and 8 bytes in one table."""
    rng = np.random.default_rng(9)
    rows = [(k, (rng.normal(size=4) * 10.0 ** rng.integers(0, 5)).tolist()) for k in range(150)] + [(150, [1e8, 0.0, 0.0, 0.0])]
    assert run(spark, rows) == brute(rows)
