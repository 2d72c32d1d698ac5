"""Exact inner-product top-k search with KD-trees (operator 6).

Candidate vectors are dealt to shards of bounded size; queries are dealt to blocks of bounded size. A
shard and a block meet in one group (the shard's vectors are sent once for each block). There a KD-tree
is built: median splits along the widest side, each node with the tight bounding box of its vectors.
A query visits nodes best first by the largest product any point of the box could have, and stops when
that bound cannot reach its kth score. In a first round each query searches only one shard; the kth
score found there is a true lower bound and is handed to the second round, where the other shards start
from it. Boxes that tie with the bound are visited, so ties end with the smaller id.

Scores are integers: every component is floor(scale * x), kept exact in doubles while every product sum is
below 2^53 (checked), else in Python integers.

Rows of one id are told apart by their vectors (a 64-bit hash of both), and equal rows are one point with a count.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part, as
queries or as candidates; a query meets only candidates of its own length; every row but the query's own is a candidate,
also one with the query's id, and a repeated row as often as it stands; a repeated query row gets its results as often;
fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.llm._spark import checkpoint, runs, small_enough


class KdTree:
    """Arrays of nodes over ``points``: boxes, children (or a leaf's range of ``order``)."""

    def __init__(self, points: np.ndarray, leaf: int = 256):
        self.order = np.arange(len(points))
        self.low, self.high, self.children, self.range = [], [], [], []
        self._build(points, 0, len(points), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, points: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        own = points[self.order[lo:hi]]
        node = len(self.range)
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.range.append((lo, hi))
        self.children.append(None)
        side = self.high[node] - self.low[node]
        if hi - lo > leaf and side.max() > 0:
            axis, mid = int(side.argmax()), (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], mid)]
            self.children[node] = (self._build(points, lo, lo + mid, leaf), self._build(points, lo + mid, hi, leaf))
        return node

    def search(self, points: np.ndarray, ids: np.ndarray, copies: np.ndarray, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """Up to k (score, id) with scores of at least ``floor``, best first; a point counts as often as it has copies,
        the point at position ``own`` once less."""
        bounds = np.maximum(query * self.low, query * self.high).sum(1)
        heap, best = [(-bounds[0], 0)], []
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            lo, hi = self.range[node]
            at = self.order[lo:hi]
            score = points[at] @ query
            times = np.where(score >= floor, np.minimum(copies[at] - (at == own), k), 0)
            best += zip(np.repeat(-score, times).tolist(), np.repeat(ids[at], times).tolist(), strict=True)
            if len(best) >= k:
                best = heapq.nsmallest(k, best)
                floor = max(floor, -best[-1][0])
        return [(int(-s), i) for s, i in heapq.nsmallest(k, best)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384, block_rows: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of each query's k best candidates."""
    x = F.col(vector_col).cast("array<double>")
    clean = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("x"), x.alias("raw"))
    clean = clean.where(~F.exists("raw", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) & (F.size("raw") > 0)).drop("raw")
    clean = clean.withColumn("key", F.xxhash64("id", F.transform("x", lambda v: v + F.lit(0.0)))).groupBy("key").agg(F.first("id").alias("id"), F.first("x").alias("x"), F.max("q").alias("q"), F.count("*").alias("n"))
    clean = checkpoint(clean)
    total = max(1, clean.count())
    n_shards, n_blocks = -(-total // shard_rows), max(1, -(-clean.where("q").count() // block_rows))
    part = clean.select("key", "id", "n", "q", "x", F.size("x").alias("dim"), F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block"))
    queries = part.where("q").select("key", "id", "n", "x", "dim", "shard", "block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, marks in runs(batches, ["dim", "shard", "block"]):
            keys, ids, copies, asks, floors = table["key"].to_numpy(), table["id"].to_numpy(), table["n"].to_numpy(), table["ask"].to_numpy(zero_copy_only=False), table["floor"].to_numpy()
            vectors = table["x"].combine_chunks()
            out: list[tuple[int, int, int, int]] = []
            for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                x = vectors.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                ask = asks[lo:hi]
                if ask.all() or not ask.any():
                    continue
                points, queries, own = x[~ask], x[ask], {key: at for at, key in enumerate(keys[lo:hi][~ask].tolist())}
                if np.abs(points).max() * np.abs(queries).max() * x.shape[1] >= 2.0**53:
                    points, queries = (np.array([[int(v) for v in r] for r in m], object) for m in (points, queries))
                tree = KdTree(points)
                for key, q, v, floor in zip(keys[lo:hi][ask].tolist(), ids[lo:hi][ask].tolist(), queries, floors[lo:hi][ask], strict=True):
                    out += [(key, q, i, s) for s, i in tree.search(points, ids[lo:hi][~ask], copies[lo:hi][~ask], v, own.get(key, -1), k, floor)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "query_id", "vec_id", "score"])

    def search(asked: DataFrame, blocks: int) -> DataFrame:
        """``asked``: (dim, shard, block, key, id, n, x, floor); every shard's rows go once to each of its blocks."""
        pool = part.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "key", "id", "n", "x", F.lit(float("-inf")).alias("floor"), F.lit(False).alias("ask"))
        both = pool.unionByName(asked.withColumn("ask", F.lit(True)))
        sorted_ = both.repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block")
        return sorted_.mapInArrow(meet, "key long, query_id long, vec_id long, score long")

    ranked = W.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    if n_shards == 1:
        found = search(queries.withColumn("floor", F.lit(float("-inf"))), n_blocks)
    else:
        # a query's own shard meets few queries, so the shards are not cut into blocks here
        own = checkpoint(search(queries.withColumn("block", F.lit(0)).withColumn("floor", F.lit(float("-inf"))), 1))
        kth = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("key", F.col("score").cast("double").alias("floor"))
        others = F.array_remove(F.sequence(F.lit(0), F.lit(n_shards - 1)), F.col("shard"))
        asked = queries.join(kth, "key", "left").select("key", "id", "n", "x", "dim", F.explode(others).alias("shard"), "block", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        found = own.unionByName(search(asked, n_blocks))
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    asked_again = queries.where("n > 1").select("key", F.col("n").alias("times"))
    best = best.join(small_enough(asked_again), "key", "left").withColumn("_", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
