"""Exact top-k inner-product search by KD-trees, one for each shard.

A shard's vectors are split at the median of the widest dimension down to leaves; every node has the tight box of its
vectors, the least id among them, and so a bound on any inner product with a query. Nodes are visited best bound
first and a search ends when no bound can beat the kth result. Queries search their own shard first; its kth result
goes with them to all other shards, in blocks of queries by shards.

Components become floor(scale * x). Vectors that are null, or hold a null or non-finite component, or one that is no long
after scaling, take no part. Scores are exact however wide; one among a query's k best that is no long (or the last one,
2^63 - 1) fails the query, as it fails the SQL. Vectors meet only those of equal length; an empty vector scores 0. A query's own row is that of its
vec_id: rows with one vec_id do not find each other, and each of them, repeated rows too, is searched for itself once.
Ties go to the smaller id. Rows without vec_id are left out. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SCALE = 256
K = 5
EVERY = 50
#: Vectors of a shard and queries of a block, about; vectors of a leaf at most.
SHARD, BLOCK, LEAF = 4096, 512, 64
FOUND = "query long, vec_id long, score long"
#: Vectors travel as the first of these that holds their components.
TYPES = (np.int16, np.int32, np.float64)
#: Stands for this score and all beyond, its negative likewise.
MOST = 2**63 - 1


class Tree:
    """vectors: whole numbers as float64; ids. Nodes are listed parents first; left is -1 at leaves."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # first, end, left, right
        lo, hi, least = [], [], []
        todo = [(0, len(ids), -1, 0)]
        nodes: list[list[int]] = []
        while todo:
            a, b, parent, side = todo.pop()
            own = order[a:b]
            box = vectors[own]
            lo.append(box.min(axis=0))
            hi.append(box.max(axis=0))
            least.append(ids[own].min())
            nodes.append([a, b, -1, -1])
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes) - 1
            spread = hi[-1] - lo[-1]
            if b - a > leaf and len(spread) and spread.max() > 0:
                mid = (b - a) // 2
                order[a:b] = own[np.argpartition(box[:, int(np.argmax(spread))], mid)]
                todo += [(a + mid, b, len(nodes) - 1, 1), (a, a + mid, len(nodes) - 1, 0)]
        self.nodes, self.lo, self.hi, self.least = np.array(nodes), np.array(lo), np.array(hi), np.array(least)
        self.vectors, self.ids = vectors[order], ids[order]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        vectors = self.vectors.astype(next(t for t in TYPES if t is np.float64 or np.abs(self.vectors).max(initial=0) <= np.iinfo(t).max))
        np.savez(out, nodes=self.nodes, lo=self.lo, hi=self.hi, least=self.least, vectors=vectors, ids=self.ids)
        return out.getvalue()

    @classmethod
    def of_bytes(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.__dict__.update(np.load(io.BytesIO(data)))
        tree.vectors = tree.vectors.astype(np.float64)
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, worst: np.ndarray, worst_id: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query at most k (score, id) that beat its (worst score, worst id), best first; its own id is left out."""
        bounds = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        reach = np.abs(queries) @ np.maximum(np.abs(self.hi), np.abs(self.lo)).T  # what sums of products stay below
        bounds += np.where(reach < 2**52, 0, reach * queries.shape[1] * 1e-15 + 1)
        nodes, least = self.nodes.tolist(), self.least.tolist()
        out = []
        for q in range(len(queries)):
            bound = bounds[q].tolist()
            limit, me = (worst[q].item(), -int(worst_id[q])), int(own[q])
            top: list[tuple[float, int]] = []  # the k best as (score, -id), the worst first
            heap = [(-bound[0], least[0], 0)]
            while heap and (-heap[0][0], -heap[0][1]) > limit:
                at = heapq.heappop(heap)[2]
                a, b, left, right = nodes[at]
                if left >= 0:
                    for child in (left, right):
                        if (bound[child], -least[child]) > limit:
                            heapq.heappush(heap, (-bound[child], least[child], child))
                    continue
                if reach[q, at] < 2**52:
                    score = self.vectors[a:b] @ queries[q]
                elif reach[q, at] < 2**62:
                    score = self.vectors[a:b].astype(np.int64) @ queries[q].astype(np.int64)
                else:
                    score = self.vectors[a:b].astype(np.int64).astype(object) @ queries[q].astype(np.int64).astype(object)
                near = np.flatnonzero(score >= limit[0]) if limit[0] > -np.inf else np.arange(b - a)
                near = near[self.ids[a:b][near] != me]  # before the cut: a query's id may have any number of rows
                if len(near) > 4 * k:
                    near = near[np.lexsort((self.ids[a:b][near], -score[near]))[:k]]
                for x, i in zip(score[near].tolist(), self.ids[a:b][near].tolist()):
                    if (x, -i) > limit:
                        (heapq.heappush if len(top) < k else heapq.heappushpop)(top, (x, -i))
                        if len(top) == k:
                            limit = max(limit, top[0])
            out.append([(int(x), -i) for x, i in sorted(top, reverse=True)])
        return out


def scaled(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, dim and vec (the scaled components, packed) of the vectors that take part; staged."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches):
        for batch in batches:
            row, vec_id, vec, dim = [], [], [], []
            for r, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(scale * v.values.to_numpy())
                if np.isfinite(x).all() and np.abs(x).max(initial=0) < 2**63:
                    row.append(r)
                    vec_id.append(i)
                    vec.append(_packed(x))
                    dim.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(dim, pa.int32()), pa.array(vec, pa.binary())], names=["row", "vec_id", "dim", "vec"])

    return staged(rows.filter("vec_id is not null and embedding is not null").mapInArrow(run, "row long, vec_id long, dim int, vec binary"), "vectors")


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in 2, 4 or 8 bytes each, as they need; the length tells which."""
    most = np.abs(x).max(initial=0)
    return x.astype(next(t for t in TYPES if t is np.float64 or most <= np.iinfo(t).max)).tobytes()


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(vectors), dim))
    size = np.array([len(v) for v in vectors])
    for t in TYPES:
        at = np.flatnonzero(size == dim * np.dtype(t).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join([vectors[k] for k in at.tolist()]), dtype=t).reshape(len(at), dim)
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    dim = int(pdf["dim"].iloc[0])
    tree = Tree(_matrix(pdf["vec"].tolist(), dim), pdf["vec_id"].to_numpy())
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [dim], "tree": [tree.to_bytes()]})


def _searcher(k: int):
    def search(queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data in trees["tree"] if len(queries) else ():
            own = queries["vec_id"].to_numpy()
            matrix = _matrix(queries["vec"].tolist(), int(queries["dim"].iloc[0]))
            found = Tree.of_bytes(data).search(matrix, own, k, queries["worst"].to_numpy(), queries["worst_id"].to_numpy())
            rows += [(q, i, max(-MOST, min(MOST, x))) for q, top in zip(queries["row"].tolist(), found) for x, i in top]
        return pd.DataFrame(rows, columns=["query", "vec_id", "score"]).astype("int64")

    return search


def top_k(df: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other rows. Queries: vec_id divisible by every."""
    rows = scaled(df, scale)
    shards = max(1, -(-rows.count() // SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    trees = staged(rows.groupBy("shard", "dim").applyInPandas(_build, "shard int, dim int, tree binary"), "trees", "none")
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    worst = {"worst": F.lit(-MOST - 1), "worst_id": F.lit(MOST)}  # beaten by all
    none = queries.withColumns(worst)
    by = ["shard", "dim", "block"]
    every_block = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a shard holds a block's worth of its own queries at most, about: its tree goes to them once
    home = staged(none.groupBy("shard", "dim").cogroup(trees.groupBy("shard", "dim")).applyInPandas(_searcher(k), FOUND), "home")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    kth = home.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("worst"), F.col("vec_id").alias("worst_id"))
    away = queries.join(kth, "row", "left").withColumns({c: F.coalesce(c, x) for c, x in worst.items()}).withColumnRenamed("shard", "home")
    away = away.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
    other = away.groupBy(*by).cogroup(every_block.groupBy(*by)).applyInPandas(_searcher(k), FOUND)
    best = home.unionByName(other).withColumn("rank", rank).filter(F.col("rank") <= k)
    best = best.withColumn("score", F.when(F.col("score").between(1 - MOST, MOST - 1), F.col("score")).otherwise(F.raise_error(F.lit("a score is no long")).cast("long")))
    return best.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


#: The same for DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""
