"""Spatial joins, one-to-one matching and related joins over boxes.

Boxes of one case meet by an equi-join on the case. Cases with more than ``crowded`` boxes on a side, which are
counted first, go through a grid instead: each box is listed under the cells it covers and meets the
other side by an equi-join on (case, cell); a pair is kept only in the cell that holds the upper left corner
of its intersection, so no pair is seen twice and no distinct is needed. Boxes that cover more than
``max_cells`` cells are listed under one row for their whole case instead.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import geometry as G
from canopy.operators.core import checkpoint, compiled, components, local_roots, runs, written


def prefixed(df: DataFrame, p: str, keep: tuple[str, ...] = ("case_id",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(p + c) for c in df.columns])


def same(a: Column, b: Column) -> Column:
    """Whether two values are equal, said as two bounds.

    An equality would become a key of the join on the case: both sides, though dealt by case, would be shuffled by case and
    value, and the pairs by case once more.
    """
    return (a <= b) & (a >= b)


def crowded_cases(*sides: DataFrame, crowded: int = 256) -> DataFrame:
    """Cases with more than ``crowded`` boxes on a side."""
    counts = [df.groupBy("case_id").count().where(F.col("count") > crowded).select("case_id") for df in sides]
    return checkpoint(reduce(DataFrame.union, counts).distinct())


def spatial_join(left: DataFrame, right: DataFrame, cell: int = 64, max_cells: int = 64, condition: Column | None = None, crowded: int | None = 256) -> DataFrame:
    """Pairs (columns ``l_*``, ``r_*``) of one case whose boxes overlap with a positive area.

    ``crowded`` None: the caller knows that no case is crowded.
    """
    compiled(left.sparkSession)
    a, b = prefixed(left, "l_"), prefixed(right, "r_")
    dense = None if crowded is None else crowded_cases(*([left] if left is right else [left, right]), crowded=crowded)
    if dense is None or dense.isEmpty():
        pairs = a.join(b, "case_id")
    else:
        pairs = _grid_join(a.join(dense, "case_id", "left_semi"), b.join(dense, "case_id", "left_semi"), cell, max_cells)
        pairs = pairs.unionByName(a.join(dense, "case_id", "left_anti").join(b, "case_id"))
    pairs = pairs.where(G.overlap("l_", "r_") > 0)
    return pairs if condition is None else pairs.where(condition)


def _grid_join(a: DataFrame, b: DataFrame, cell: int, max_cells: int) -> DataFrame:
    def cells(df: DataFrame, p: str) -> DataFrame:
        x, y, x2, y2 = G.edges(p)
        lo_x, hi_x, lo_y, hi_y = (F.floor(v / cell) for v in (x, x2, y, y2))
        wide = (hi_x - lo_x + 1) * (hi_y - lo_y + 1) > max_cells
        grid = F.transform(F.sequence(lo_x, hi_x), lambda i: F.transform(F.sequence(lo_y, hi_y), lambda j: F.struct(i.alias("i"), j.alias("j"))))
        return df.withColumn("wide", wide).withColumn("at", F.when(~wide, F.flatten(grid)))

    ca, cb = cells(a, "l_"), cells(b, "r_")
    fine = ca.where("NOT wide").withColumn("c", F.explode("at")).drop("wide", "at").join(cb.where("NOT wide").withColumn("c", F.explode("at")).drop("wide", "at"), ["case_id", "c"])
    home = (F.floor(F.greatest("l_x", "r_x") / cell) == F.col("c.i")) & (F.floor(F.greatest("l_y", "r_y") / cell) == F.col("c.j"))
    fine = fine.where(home).drop("c")
    coarse = ca.where("wide").drop("wide", "at").join(b, "case_id").unionByName(ca.where("NOT wide").drop("wide", "at").join(cb.where("wide").drop("wide", "at"), "case_id"))
    return fine.unionByName(coarse)


#: Pairs of one group that one task goes through; larger groups are split into their connected pairs.
GROUP_PAIRS = 1_000_000


def _settling_group(pairs: DataFrame, group: str, left: list[str], right: list[str], same: bool, limit: int) -> DataFrame:
    """``pairs`` with ``_group``: rows of different groups do not compete. It is ``group``, and in groups of more than
    ``limit`` pairs the connected component of the pair (by 64-bit hashes; a collision only joins two groups).
    ``same``: both sides name the same things."""
    large = checkpoint(pairs.groupBy(group).count().where(F.col("count") > limit).select(group))
    whole = F.xxhash64(group)
    if large.isEmpty():
        return pairs.withColumn("_group", whole)
    vertex = lambda cols, side: F.xxhash64(F.lit(side), *cols)
    heavy = pairs.join(large, group, "left_semi").withColumn("_v", vertex(left, 0))
    parts = components(heavy.select(F.col("_v").alias("a"), vertex(right, 0 if same else 1).alias("b")))
    heavy = heavy.join(parts.select(F.col("v").alias("_v"), F.col("component").alias("_group")), "_v").drop("_v")
    return pairs.join(large, group, "left_anti").withColumn("_group", whole).unionByName(heavy)


def by_parts(pairs: DataFrame, group: str, left: list[str], right: list[str], limit: int = GROUP_PAIRS) -> DataFrame:
    """``pairs`` of things of one kind dealt by ``_group``: their group, or in large groups their connected part."""
    return _settling_group(checkpoint(pairs), group, left, right, True, limit).repartition("_group").sortWithinPartitions("_group")


def match_one_to_one(pairs: DataFrame, left: list[str], right: list[str], score: str, group: str = "case_id", limit: int = GROUP_PAIRS) -> DataFrame:
    """Greedy matching (J02): of all pairs by falling score, ties by the keys, each side is used once.

    The pairs of a group are sorted by Spark and gone through once; a task holds the keys used in one group. Gives
    the optimal pairs wherever no box is contested, and at least half the optimal total else.
    """
    columns, n = pairs.columns, len(left)
    keyed = _settling_group(checkpoint(pairs), group, left, right, False, limit)
    keyed = keyed.select("_group", *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*left, *right])], *columns)
    dealt = keyed.repartition("_group").sortWithinPartitions("_group", F.col(score).desc(), *left, *right)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used_l, used_r = None, set(), set()
        for batch in batches:
            keep = []
            keys = [batch.column(i).to_pylist() for i in range(1 + 2 * n)]
            for i, (g, *k) in enumerate(zip(*keys, strict=True)):
                if g != now:
                    now, used_l, used_r = g, set(), set()
                a, b = tuple(k[:n]), tuple(k[n:])
                if a not in used_l and b not in used_r:
                    used_l.add(a)
                    used_r.add(b)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(batch.take(pa.array(keep, pa.int64())).columns[1 + 2 * n :], names=columns)

    return dealt.mapInArrow(pick, pairs.schema)


def assignment(size: int, edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Pairs (l, r) of greatest total weight, each side used once, from (l, r, weight) of whole numbers.

    Shortest augmenting paths with potentials over the given edges: the left side's ``size`` members come in one
    after the other, each with a place of its own of weight 0 to stay alone.
    """
    near: list[list[tuple[int, int]]] = [[(-1 - i, 0)] for i in range(size)]
    for i, j, weight in edges:
        near[i].append((j, -weight))
    left, right = [0] * size, defaultdict(int)
    owner: dict[int, int] = {}
    mate: dict[int, int] = {}
    for s in range(size):
        best, via, done, heap = {}, {}, set(), []
        i, base = s, 0
        while True:
            for j, cost in near[i]:
                if j not in done:
                    new = base + cost - left[i] - right[j]
                    if j not in best or new < best[j]:
                        best[j], via[j] = new, i
                        heappush(heap, (new, j))
            while heap[0][1] in done:
                heappop(heap)
            base, j = heappop(heap)
            done.add(j)
            if j not in owner:
                break
            i = owner[j]
        left[s] += base
        for k in done - {j}:
            left[owner[k]] += base - best[k]
            right[k] -= base - best[k]
        while True:
            i = via[j]
            owner[j], mate[i], j = i, j, mate.get(i)
            if i == s:
                break
    return [(i, j) for j, i in owner.items() if j >= 0]


def assign(pairs: DataFrame, left: list[str], right: list[str], score: str, group: str = "case_id", most: bool = False, tie: str | None = None, limit: int = GROUP_PAIRS) -> DataFrame:
    """Optimal one-to-one matching (J02): the pairs of greatest total score, each side used once.

    With ``most``, as many pairs as possible, and of those matchings the one of greatest total score. Scores count in
    steps of 1e-9; of equal totals the one with the greatest total of ``tie``, a column of small whole numbers, is taken.
    ``contested`` tells pairs whose sides have other partners. Groups of up to ``limit`` pairs are settled where the join has
    dealt them, in one pass; larger ones are split into connected parts, each of which one task solves.
    """
    columns = pairs.columns
    extra = [F.round(F.col(score) * 1_000_000_000).cast("long").alias("_score"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("_tie"), (F.lit(True) if most else F.col(score) > 0).alias("_worth")]
    # the count keeps the rows of a group together, as the join on the group has left them
    counted = pairs.withColumn("_open", F.count("*").over(W.partitionBy(group)) > limit)
    # a row of a large group is a run of its own and is passed on
    run = F.when(F.col("_open"), F.monotonically_increasing_id()).otherwise(F.xxhash64(group)).alias("_group")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ["_group"]):
            place = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            a, b = (_places(place, [table[k] for k in keys]) for keys in (left, right))
            passed, worth = (table[c].fill_null(False).to_numpy() for c in ("_open", "_worth"))
            contested = (np.bincount(a)[a] > 1) | (np.bincount(b)[b] > 1)
            keep = passed | (~contested & worth)
            at = np.flatnonzero(contested & ~passed)
            if len(at):
                scores, ties = (table[c].fill_null(0).to_numpy()[at] for c in ("_score", "_tie"))
                keep[at[_best_pairs(a[at], b[at], scores, ties, most)]] = True
            out = table.select(columns).append_column("contested", pa.array(contested, mask=passed))
            yield from out.filter(pa.array(keep)).to_batches()

    schema = pairs.withColumn("contested", F.lit(None).cast("boolean")).schema
    solved = written(counted.select(run, *extra, "_open", *columns).mapInArrow(solve, schema))
    if solved.where("contested IS NULL").isEmpty():
        return solved
    vertex = lambda cols, side: F.xxhash64(F.lit(side), *cols)
    heavy = solved.where("contested IS NULL").drop("contested").withColumn("_v", vertex(left, 0))
    parts = components(heavy.select(F.col("_v").alias("a"), vertex(right, 1).alias("b"))).select(F.col("v").alias("_v"), F.col("component").alias("_group"))
    dealt = heavy.join(parts, "_v").select("_group", *extra, F.lit(False).alias("_open"), *columns).repartition("_group").sortWithinPartitions("_group")
    return solved.where("contested IS NOT NULL").unionByName(dealt.mapInArrow(solve, schema))


def _places(run: np.ndarray, keys: list[pa.ChunkedArray]) -> np.ndarray:
    """Numbers from 0 of the distinct (run, keys), in their order; null is a value like the others, after them."""
    at = run
    for key in keys:
        coded = pa.concat_arrays(key.chunks).dictionary_encode()
        n = len(coded.dictionary)
        rank = np.full(n + 1, n)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(n)
        at = np.unique(at * (n + 1) + rank[coded.indices.fill_null(n).to_numpy()], return_inverse=True)[1]
    return at


#: Members of a part's smaller and larger side up to which all its matchings are gone through by ``_exhausted``.
FEW, MANY = 4, 32


def _best_pairs(a: np.ndarray, b: np.ndarray, scores: np.ndarray, ties: np.ndarray, most: bool) -> np.ndarray:
    """Positions of the pairs (a, b) of the best matching: of parts with a small side all at once, of others part by part."""
    size = int(a.max()) + 1
    root = local_roots(size + int(b.max()) + 1, a, size + b)[a]
    order = np.lexsort((b, a, root))
    a, b, scores, ties = a[order], b[order], scores[order], ties[order]
    first = np.flatnonzero(np.append(True, np.diff(root[order]) != 0))
    part = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    (i, rows), (j, cols) = (_inside(x, part, len(first)) for x in (a, b))
    total = np.add.reduceat(np.abs(scores), first)
    # a pair more outweighs all scores, a score all ties
    count, step = 2 * total + 1 if most else np.zeros_like(total), 2 * np.add.reduceat(np.abs(ties), first) + 1
    short, long = np.minimum(rows, cols), np.maximum(rows, cols)
    fits = (short.astype(float) + 1) * (count.astype(float) + total) * step < 2.0**60
    exact = (np.maximum.reduceat(np.abs(scores.astype(float)), first) < 2.0**40) & fits & (short <= FEW) & (long <= MANY)
    found = []
    swap = (rows < cols)[part]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    shape = np.where(exact, long * (FEW + 1) + short, 0)
    for kind in np.unique(shape[exact]):
        at = np.flatnonzero((shape == kind)[part])
        of = np.unique(part[at], return_inverse=True)[1]
        weight = (count[part[at]] + scores[at]) * step[part[at]] + ties[at]
        found.append(at[_exhausted(of, i[at], j[at], weight, *divmod(int(kind), FEW + 1))])
    for p in np.flatnonzero(~exact):
        lo, hi = int(first[p]), int(first[p] + np.searchsorted(part[first[p] :], p, side="right"))
        s, t = scores[lo:hi].tolist(), ties[lo:hi].tolist()
        n, d = (2 * sum(map(abs, s)) + 1 if most else 0), 2 * sum(map(abs, t)) + 1
        edges = {e: k for k, e in enumerate(zip(i[lo:hi].tolist(), j[lo:hi].tolist(), strict=True))}
        best = assignment(int(long[p]), [(*e, (n + s[k]) * d + t[k]) for e, k in edges.items()])
        found.append(np.array([lo + edges[e] for e in best], int))
    return order[np.concatenate(found)]


def _inside(x: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 within its part for each ``x``, and how many different ones a part has."""
    _, at, back = np.unique(x, return_index=True, return_inverse=True)
    order = np.argsort(part[at], kind="stable")
    size = np.bincount(part[at], minlength=parts)
    place = np.empty(len(at), int)
    place[order] = np.arange(len(at)) - (np.cumsum(size) - size)[part[at][order]]
    return place[back], size


def _exhausted(part: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Positions of the pairs (i, j) of greatest total weight in every part: row after row, the best total for each set of columns used."""
    n, none = int(part.max()) + 1, -(2**61)
    w, at = np.full((n, rows, cols), none), np.zeros((n, rows, cols), int)
    w[part, i, j], at[part, i, j] = weight, np.arange(len(weight))
    sets = np.arange(2**cols)
    best = np.full((n, len(sets)), none)
    best[:, 0] = 0
    took = np.full((rows, n, len(sets)), -1, np.int8)
    for r in range(rows):
        new = best.copy()
        for c in range(cols):
            having = sets[sets >> c & 1 == 1]
            value = best[:, having ^ 1 << c] + w[:, r, c, None]
            better = value > new[:, having]
            new[:, having] = np.where(better, value, new[:, having])
            took[r][:, having] = np.where(better, c, took[r][:, having])
        best = new
    state, out, every = best.argmax(axis=1), [], np.arange(n)
    for r in reversed(range(rows)):
        c = took[r][every, state].astype(int)
        hit = np.flatnonzero(c >= 0)
        out.append(at[hit, r, c[hit]])
        state[hit] ^= 1 << c[hit]
    return np.concatenate(out)


def match_nodes(pred: DataFrame, truth: DataFrame, iou_num: int = 1, iou_den: int = 2, tie: Column | None = None) -> DataFrame:
    """One-to-one matches of equal type with IoU of at least iou_num / iou_den and the greatest total IoU.

    A true box with an ink box (ix, iy, iw, ih, not null; glyphs) matches by the better of the two.
    """
    inter, union = G.overlap("l_", "r_"), G.union_area("l_", "r_")
    ok, score = inter * iou_den >= union * iou_num, G.iou("l_", "r_")
    if "ix" in truth.columns:
        ink = truth.where(F.col("iw") * F.col("ih") > 0).withColumns({c: F.col(f"i{c}") for c in "xywh"})
        pairs = spatial_join(pred, truth).withColumn("iou", score).unionByName(spatial_join(pred, ink).withColumn("iou", score))
        own = [c for c in pairs.columns if c not in ("iou", "r_x", "r_y", "r_w", "r_h")]
        pairs = pairs.groupBy(*own).agg(F.max("iou").alias("iou")).where((F.col("iou") * iou_den >= iou_num) & (F.col("l_type") == F.col("r_type")))
        pairs = pairs.join(truth.select("case_id", F.col("node").alias("r_node"), *[F.col(c).alias(f"r_{c}") for c in "xywh"]), ["case_id", "r_node"])
    else:
        pairs = spatial_join(pred, truth, condition=ok & same(F.col("l_type"), F.col("r_type"))).withColumn("iou", score)
    if tie is None:
        return assign(pairs, ["case_id", "l_node"], ["case_id", "r_node"], "iou")
    return assign(pairs.withColumn("tie", tie), ["case_id", "l_node"], ["case_id", "r_node"], "iou", tie="tie").drop("tie")


def best_overlap(left: DataFrame, right: DataFrame, key: str = "node") -> DataFrame:
    """For each left box the right box of largest IoU, ties to the smaller key."""
    pairs = spatial_join(left, right).withColumn("iou", G.iou("l_", "r_"))
    return pairs.groupBy("case_id", f"l_{key}").agg(F.min_by(f"r_{key}", F.struct(-F.col("iou"), F.col(f"r_{key}"))).alias("best"), F.max("iou").alias("iou"))


def covering_node(boxes: DataFrame, nodes: DataFrame, share: float, key: str = "node") -> DataFrame:
    """For each box the smallest node that covers at least ``share`` of it."""
    pairs = spatial_join(boxes, nodes, condition=G.overlap("l_", "r_") >= G.area("l_") * share)
    return pairs.groupBy("case_id", f"l_{key}").agg(F.min_by(f"r_{key}", F.struct(G.area("r_"), F.col(f"r_{key}"))).alias("cover"))


def suppress(findings: DataFrame, key: list[str], rank: list[str], iou: float, limit: int = GROUP_PAIRS) -> DataFrame:
    """Non-maximum suppression (J23): findings without a kept overlapping finding that ranks before them.

    ``rank``: numeric columns, larger ones first; ties go to the smaller key.
    """
    order = [f"_o{i}" for i in range(len(rank))]
    f = checkpoint(findings.withColumns({o: -F.col(c) for o, c in zip(order, rank, strict=True)}))
    side = lambda p: F.struct(*[F.col(p + c) for c in (*order, *key)])
    pairs = spatial_join(f, f, condition=(side("l_") < side("r_")) & (G.iou("l_", "r_") >= iou))
    return without_beaten(f, pairs, key, order, limit=limit).drop(*order)


def without_beaten(items: DataFrame, pairs: DataFrame, key: list[str], order: list[str], group: str = "case_id", limit: int = GROUP_PAIRS) -> DataFrame:
    """``items`` (group, key) without those that a kept one beats; in ``pairs`` l_* comes before r_* by ``order`` and key.

    Sorted by l, all that could beat l is known when l comes, so one pass over each group settles it.
    """
    left, right, n = [f"l_{k}" for k in key], [f"r_{k}" for k in key], len(key) + 1
    p = checkpoint(pairs.select(group, *[f"l_{c}" for c in order], *left, *right))
    keyed = _settling_group(p, group, [group, *left], [group, *right], True, limit)
    dealt = keyed.repartition("_group").sortWithinPartitions("_group", *[f"l_{c}" for c in order], *left)

    def beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone = None, set()
        for batch in batches:
            out = []
            for g, case, *k in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if g != now:
                    now, gone = g, set()
                a, b = (case, *k[: n - 1]), (case, *k[n - 1 :])
                if a not in gone and b not in gone:
                    gone.add(b)
                    out.append(b)
            columns = list(zip(*out, strict=True)) or [()] * n
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(i + 1).type) for i, c in enumerate(columns)], names=[group, *key])

    types = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in [group, *key])
    losers = dealt.select("_group", group, *left, *right).mapInArrow(beaten, types)
    return items.join(losers, [group, *key], "left_anti")
