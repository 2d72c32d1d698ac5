"""Exact nearest neighbours by pivots and triangle inequality (J19), and standardised vectors.

Known items are dealt to the cells of their nearest pivots (a bounded sample of them), with their distance to it. A
query first searches the block of cells of its own nearest pivot. Its kth distance there, or a bound from the cells' sizes and
radii, rules out every cell that is too far: by the cell's radius, and by the plane half-way between the cell's pivot
and the query's own. Queries go to blocks, once for all near cells of one, and meet a cell's items by matrix products.
Small cells share a block, large ones are cut into several; neither side is held whole or sent to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.operators.core import checkpoint, runs, written

#: Pivots at most, items of a block, and queries that meet a block at once: either side is sent as often as the other has such parts.
PIVOTS, BLOCK, ASKED = 1024, 32_768, 32_768
#: Pairs of a task that wait to be computed in full.
WAITING = 1_000_000


def _clean(df: DataFrame, name: str) -> DataFrame:
    """Items with a vector of finite numbers; others have no distances."""
    x = F.col("x").cast("array<double>")
    broken = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    cols = [F.col("id").alias(name), x.alias("x"), *(["label"] if "label" in df.columns and name == "id" else [])]
    return df.where(F.col("id").isNotNull() & F.col("x").isNotNull()).select(*cols).where(~broken & (F.size("x") > 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


class _Nearest:
    """The k nearest of ``points`` for each of ``wanted``: spans of points are ruled out by matrix products, what is left is
    computed in full.

    A point is left while its squared distance by the product, good to ``tol``, is at most that of the kth so far.
    """

    def __init__(self, points: np.ndarray, wanted: np.ndarray, bound: np.ndarray, loose: np.ndarray, k: int, names: np.ndarray, place: np.ndarray, own: np.ndarray):
        self.points, self.wanted, self.k, self.names, self.place, self.own = points, wanted, k, names, place, own
        self.p2, self.w2 = (points * points).sum(1), (wanted * wanted).sum(1)
        self.tol = 1e-8 * (1 + self.w2 + self.p2.max())
        self.most = (bound + loose) ** 2 + self.tol
        self.top = np.full((len(wanted), k), np.inf)
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []
        self.settled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting = self.compared = 0

    def limit(self) -> np.ndarray:
        """Distance within which the k nearest lie."""
        return np.sqrt(self.most)

    def search(self, rows: np.ndarray, lo: int, hi: int) -> None:
        for a in range(lo, hi if len(rows) else lo, 2048):
            b = min(hi, a + 2048)
            self.compared += len(rows) * (b - a)
            d2 = self.wanted[rows] @ self.points[a:b].T
            d2 *= -2
            d2 += self.p2[a:b]
            i, j = np.nonzero(d2 <= (self.most - self.w2)[rows, None])
            v, i, j = d2[i, j] + self.w2[rows[i]], rows[i], j + a
            other = self.names[j] != self.own[i]
            i, j, v = i[other], j[other], v[other]
            if not len(i):
                continue
            self.hits.append((i, j))
            self.waiting += len(i)
            order = np.lexsort((v, i))
            i, v = i[order], v[order]
            new = np.append(0, np.flatnonzero(np.diff(i)) + 1)
            rank = np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i))))
            few, at = rank < self.k, i[new]
            best = np.full((len(at), self.k), np.inf)
            best[np.searchsorted(at, i[few]), rank[few]] = v[few]
            self.top[at] = np.sort(np.concatenate([self.top[at], best], 1), 1)[:, : self.k]
            self.most[at] = np.minimum(self.most[at], np.maximum(self.top[at, -1], 0) + 2 * self.tol[at])
            if self.waiting > WAITING:  # many equal points
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, squared distance) of the k nearest of what was searched, ties to the smaller id."""
        if self.hits:
            i, j = (np.concatenate(c) for c in zip(*self.hits, strict=True))
            d2 = np.empty(len(i))
            for a in range(0, len(i), 65536):
                gap = self.points[j[a : a + 65536]] - self.wanted[i[a : a + 65536]]
                d2[a : a + 65536] = np.round((gap * gap).sum(1), 9)
            i, j, d2 = (np.concatenate(c) for c in zip(self.settled, (i, j, d2), strict=True))
            order = np.lexsort((self.place[j], d2, i))
            i, j, d2 = i[order], j[order], d2[order]
            new = np.append(0, np.flatnonzero(np.diff(i)) + 1)
            few = np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i)))) < self.k
            self.settled, self.hits, self.waiting = (i[few], j[few], d2[few]), [], 0
        return self.settled


def k_nearest(queries: DataFrame, known: DataFrame, k: int, compared: Accumulator | None = None) -> DataFrame:
    """``(query_id, rank, id, label, d2)``: the k nearest known items of each query but itself, ties to the smaller id.

    Queries: id, x; known: id, x, label; x are vectors of one length. Squared distances are rounded to nine places.
    ``compared``, an accumulator, counts the pairs whose distance is computed.
    """
    spark = known.sparkSession
    label = known.schema["label"].dataType.simpleString()
    id_type, query_type = known.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    items, asks = _clean(known, "id"), _clean(queries, "query_id")
    n = items.count()
    if not n:
        return spark.createDataFrame([], f"query_id {query_type}, rank int, id {id_type}, label {label}, d2 double")
    sample = items.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, int(n**0.5) + 1)).collect()
    pivots = spark.sparkContext.broadcast(np.unique(np.array([r["x"] for r in sample]), axis=0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                d = _to_pivots(_matrix(part.column("x")), pivots.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=[*part.schema.names, "cell", "r"])

    dealt = written(items.mapInArrow(deal, f"id {id_type}, x array<double>, label {label}, cell int, r double"))
    # a row for each pivot
    stats = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("far"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("norm")).collect()}
    cells = np.array(sorted(stats))
    size, far = (np.array([stats[c][f] for c in cells.tolist()]) for f in ("n", "far"))
    norm = max(r["norm"] for r in stats.values()) ** 0.5
    # blocks of cells: small cells share one, a large one has several of its own
    parts, start, held, last = -(-size // BLOCK), np.zeros(len(cells), np.int64), BLOCK, -1
    for c, (m, own) in enumerate(zip(size.tolist(), parts.tolist(), strict=True)):
        if own > 1 or held + m > BLOCK:
            last, held = last + 1, 0
        start[c] = last
        last, held = last + own - 1, BLOCK if own > 1 else held + m
    shared = spark.sparkContext.broadcast((cells, size, far, norm, parts, start))

    def slack(x: np.ndarray, norm: float) -> np.ndarray:
        return 1e-6 * (1 + norm + np.sqrt((x * x).sum(1)))

    def near_cells(x: np.ndarray, own: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether a cell may hold items within the bound of a query, whose own cell is left out."""
        cells, _, far, norm, *_ = shared.value
        own_pivots = pivots.value[cells]
        d, loose = _to_pivots(x, own_pivots), slack(x, norm)[:, None]
        near = d - far <= bound[:, None] + loose
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - (d[np.arange(len(x)), own] ** 2)[:, None]) / (2 * _to_pivots(own_pivots, own_pivots)[own])
        near &= ~(plane > bound[:, None] + loose)
        near[np.arange(len(x)), own] = False
        return near

    def own_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, size, far, norm, *_ = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = _matrix(part.column("x"))
                d = _to_pivots(x, pivots.value[cells])
                own = d.argmin(1)
                # k + 1 items lie within the reach of the nearest cells that hold so many
                reach = d + far
                order = reach.argsort(1)
                enough = (size[order].cumsum(1) > k).argmax(1)
                bound = np.take_along_axis(reach, order, 1)[np.arange(len(x)), enough] + slack(x, norm)
                bound[size.sum() <= k] = np.inf
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.astype(np.int32)), pa.array(bound)], names=["query_id", "x", "cell", "bound"])

    def asked_blocks(first: bool):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            *_, parts, start = shared.value
            total = int(start[-1] + parts[-1])
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    own = part.column("cell").to_numpy()
                    mine = (np.arange(total) >= start[own, None]) & (np.arange(total) < (start + parts)[own, None])
                    if not first:
                        near = near_cells(_matrix(part.column("x")), own, part.column("bound").to_numpy())
                        hit = np.zeros((len(own), total), bool)
                        for c in np.flatnonzero(near.any(0)).tolist():
                            hit[:, start[c] : start[c] + parts[c]] |= near[:, c, None]
                        mine = hit & ~mine
                    i, j = np.nonzero(mine)
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(i)) for c in part.columns] + [pa.array(j.astype(np.int32))], names=[*part.schema.names, "block"])

        return ask

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = shared.value[3]
        for table, marks in runs(batches, ["block", "crowd"]):
            ask, cell, bound = table["ask"].to_numpy(zero_copy_only=False), table["cell"].to_numpy(), table["bound"].to_numpy()
            ids, query_ids, x = table["id"].combine_chunks(), table["query_id"].combine_chunks(), table["x"].combine_chunks()
            for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                middle = lo + int((~ask[lo:hi]).sum())
                if middle in (lo, hi):
                    continue
                points, names = _matrix(x.slice(lo, middle - lo)), ids.slice(lo, middle - lo).to_numpy(zero_copy_only=False)
                order = np.empty(len(names), np.int64)
                order[np.argsort(names, kind="stable")] = np.arange(len(names))
                at = np.append(lo, np.flatnonzero(np.diff(cell[lo:middle])) + lo + 1)
                spans = [(int(cell[a]), int(a) - lo, int(b) - lo) for a, b in zip(at, np.append(at[1:], middle), strict=True)]
                for begin in range(middle, hi, 2048):
                    n = min(2048, hi - begin)
                    wanted, own = _matrix(x.slice(begin, n)), query_ids.slice(begin, n).to_numpy(zero_copy_only=False)
                    near = _Nearest(points, wanted, bound[begin : begin + n], slack(wanted, norm), k, names, order, own)
                    home = cell[begin : begin + n]
                    for c, a, b in spans:
                        near.search(np.flatnonzero(home == c), a, b)
                    others = near_cells(wanted, home, near.limit())
                    for c, a, b in spans:
                        near.search(np.flatnonzero(others[:, c]), a, b)
                    if compared is not None:
                        compared.add(near.compared)
                    q, p, d2 = near.best()
                    right = pa.array(p + lo)
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q + begin)), ids.take(right), table["label"].combine_chunks().take(right), pa.array(d2)], names=["query_id", "id", "label", "d2"])

    lookup = lambda v: F.element_at(F.array(*[F.lit(int(n)) for n in v]), F.col("cell") + 1)
    place = {int(c): i for i, c in enumerate(cells.tolist())}
    # from here on a cell is its place among the cells that hold items
    pool_all = dealt.withColumn("cell", F.element_at(F.create_map(*[F.lit(v) for kv in place.items() for v in kv]), F.col("cell")))
    pool_all = pool_all.withColumn("block", (lookup(start) + F.pmod(F.xxhash64("id"), lookup(parts))).cast("int"))

    def search(asked: DataFrame) -> DataFrame:
        """Asked: (query_id, x, cell, bound, block). Blocks meet crowds of the queries that ask them."""
        asked = written(asked)
        crowd = {r["block"]: -(-r["n"] // ASKED) for r in asked.groupBy("block").agg(F.count("*").alias("n")).collect()}
        if not crowd:
            return spark.createDataFrame([], f"query_id {query_type}, id {id_type}, label {label}, d2 double")
        crowds = F.element_at(F.create_map(*[F.lit(v) for kv in crowd.items() for v in kv]), F.col("block"))
        pool = pool_all.where(F.col("block").isin(list(crowd))).withColumn("crowd", F.explode(F.sequence(F.lit(0), crowds - 1)))
        pool = pool.select("block", "crowd", "cell", F.lit(False).alias("ask"), "x", "id", "label", F.lit(None).cast(query_type).alias("query_id"), F.lit(0.0).alias("bound"))
        asking = asked.withColumn("crowd", F.pmod(F.xxhash64("query_id"), crowds).cast("int"))
        asking = asking.select("block", "crowd", "cell", F.lit(True).alias("ask"), "x", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast(label).alias("label"), "query_id", "bound")
        met = pool.unionByName(asking).repartition("block", "crowd").sortWithinPartitions("block", "crowd", "ask", "cell")
        return met.mapInArrow(meet, f"query_id {query_type}, id {id_type}, label {label}, d2 double")

    ranked = F.row_number().over(W.partitionBy("query_id").orderBy("d2", "id"))
    plain = f"query_id {query_type}, x array<double>, cell int, bound double"
    begun = written(asks.mapInArrow(own_blocks, plain))
    own = checkpoint(search(begun.mapInArrow(asked_blocks(True), plain + ", block int")))
    kth = own.withColumn("rank", ranked).where(F.col("rank") == k).select("query_id", F.sqrt("d2").alias("kth"))
    bounded = begun.join(kth, "query_id", "left").select("query_id", "x", "cell", F.least("bound", F.coalesce("kth", F.lit(float("inf")))).alias("bound"))
    rest = search(bounded.mapInArrow(asked_blocks(False), plain + ", block int"))
    return own.unionByName(rest).withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "id", "label", "d2")


def standardised(items: DataFrame, model: DataFrame | None = None, least: float = 1e-6) -> DataFrame:
    """``items`` (id, x, ...) with every dimension of x less its median, over its interquartile range.

    A range of at most ``least`` gives way to the standard deviation, 0.001 at least. ``model``: items to take the medians and
    ranges from, if not ``items``.
    """
    from canopy.operators.stats import quantiles

    of = (items if model is None else model).where("x IS NOT NULL").select(F.posexplode(F.col("x").cast("array<double>")).alias("dim", "v"))
    q = quantiles(of, ["dim"], F.col("v"), [0.25, 0.5, 0.75]).join(of.groupBy("dim").agg(F.stddev_pop("v").alias("sd")), "dim")
    spread = F.col("q")[2] - F.col("q")[0]
    scale = F.when(spread > least, spread).otherwise(F.greatest("sd", F.lit(1e-3)))
    # one row: a centre and a scale for each dimension
    one = q.groupBy().agg(F.array_sort(F.collect_list(F.struct("dim", F.col("q")[1].alias("centre"), scale.alias("scale")))).alias("_m"))
    z = F.zip_with(F.col("x").cast("array<double>"), "_m", lambda v, m: (v - m["centre"]) / m["scale"])
    return items.crossJoin(F.broadcast(one)).withColumn("x", z).drop("_m")
