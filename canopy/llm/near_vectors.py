"""Near-duplicate vectors by sorted projection passes (operator 1).

1. Equal vectors of a group become one node with a count.
2. The number of passes and the window are planned for each group from all its nodes: dealt to blocks and hashed about
   the group's centre, they tell how many leading bits two nodes must share to be within a window, and so what share
   of pairs at the threshold all passes miss. The cheapest plan that misses at most ``miss`` is taken (the one
   that misses least, if none does). A group that fits into the smallest window needs one pass and no plan.
3. Each pass hashes every node, less its group's centre, to a string of random sign bits. Nodes are
   range-partitioned and sorted by (pass, group, bits), and each is compared with the next nodes of its window
   in that order, on vectors quantised to bytes and with a margin below the threshold. A window is also closed
   over the border of two partitions. Linked nodes are united over all passes to candidate components.
4. Within a candidate component all pairs are compared exactly in double precision, in blocks of
   ``block`` nodes (a component of m nodes is spread over (m / block)^2 / 2 tasks' groups), and only
   link counts and a spanning set of links leave a block, never the pairs.

The passes decide which nodes come together (each has an independent chance); the links and counts within what
came together are exact. As an option, off by default, groups of up to ``exact`` nodes are compared whole.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors
with a null group, have no links and are their own component; vectors of different lengths never link;
repeated rows (also under one id) are vectors of their own and link with each other; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm._spark import checkpoint, components, local_roots, runs, small_enough

#: Screening works on bytes; a cosine is off by less than this.
_MARGIN = 0.03
#: Plans to choose from, the nodes of a block that plans, and what sending a node counts in comparisons.
_PASSES = np.array([4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 256])
_WINDOWS = np.array([64, 128, 256, 512, 1024])
_PLANNED = 4096
_SEND = 500


def _hashes(dim: int, at: int, bits: int, seed: int) -> np.ndarray:
    """The projections of pass ``at``."""
    return np.random.default_rng([seed, dim, at]).standard_normal((dim, bits)).astype(np.float32)


def _keys(centred: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = centred @ hashes > 0
    return (bit.astype(np.int64) << np.arange(hashes.shape[1] - 1, -1, -1)).sum(1)


def _units(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _choices(size: int) -> np.ndarray:
    """Windows for a group of ``size`` nodes."""
    return _WINDOWS[_WINDOWS < max(size / 2, _WINDOWS[0] + 1)]


def misses(unit: np.ndarray, centre: np.ndarray, size: int, threshold: float, bits: int, seed: int) -> np.ndarray:
    """Expected misses by window and passes, summed over a block of nodes dealt by chance from a group of ``size``.

    A pair that shares k leading bits is within a window of w if at most w nodes share them: k is read from the
    block's neighbours in sorted order, node by node, so denser parts of a group count with their density. The
    chance to share k bits follows from the angle of a pair at the threshold, seen from the centre. Nodes most
    of whose neighbours in the block are links come together by chains and do not count.
    """
    r = unit - centre
    n, reach, trials = len(r), 8, 4
    with np.errstate(divide="ignore"):
        cosine = np.clip(1 - (1 - threshold) / (r * r).sum(1), -1, 1)
    same = 1 - np.arccos(cosine) / np.pi
    least, chance, chained = [], [], []
    for t in range(trials):
        key = _keys(r.astype(np.float32), _hashes(unit.shape[1], t, bits, seed + 1))
        order = np.argsort(key, kind="stable")
        key, x = key[order], unit[order].astype(np.float32)
        shared, linked = np.zeros(n), np.zeros(n)
        far = bits - np.frexp((key[reach:] ^ key[:-reach]).astype(float))[1]
        shared[reach:] = far
        shared[:-reach] = np.maximum(shared[:-reach], far)
        for d in range(1, reach + 1):
            hit = (x[d:] * x[:-d]).sum(1) >= threshold
            linked[d:] += hit
            linked[:-d] += hit
        least.append(shared + 1)
        chance.append(same[order])
        chained.append(linked >= reach)
    k, p, chain = (np.concatenate(a) for a in (least, chance, chained))
    out = []
    for w in _choices(size).tolist():
        need = np.maximum(k + np.log2(reach * size / (n * w)), 0)
        lost = 1 - np.where(need > bits, 0.0, p**need)
        out.append([float(np.where(chain, 0.0, lost**passes).sum()) / trials for passes in _PASSES.tolist()])
    return np.array(out)


def cheapest(missed: np.ndarray, size: int, miss: float) -> tuple[int, int, float]:
    """Passes, window and expected miss of a group of ``size`` nodes, from its nodes' mean of ``misses``."""
    windows = _choices(size)
    cost = _PASSES[None, :] * (_SEND + windows[:, None])
    fits = missed <= miss
    at = np.where(fits, cost, np.inf).argmin() if fits.any() else missed.argmin()
    w, passes = np.unravel_index(at, missed.shape)
    return int(_PASSES[passes]), int(windows[w]), float(missed[w, passes])


def plan_groups(nodes: DataFrame, big: DataFrame, threshold: float, miss: float, bits: int, seed: int) -> DataFrame:
    """(g, passes, w, centre) of the groups (g, m) of ``big`` from all their nodes (node, g, x)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum of the unit vectors of each group, or of such sums."""
        for table, marks in runs(batches, ["g"]):
            g, m = table["g"].to_numpy(), table["m"].to_numpy()
            vectors, weight = table["x"].combine_chunks(), table["k"].to_numpy()
            total, count = [], []
            for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                x = _matrix(vectors.slice(lo, hi - lo))
                total.append((_units(x) if weight[lo] == 0 else x).sum(0).tolist())
                count.append(int(np.maximum(weight[lo:hi], 1).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(g[marks[:-1]]), pa.array(m[marks[:-1]]), pa.array(count, pa.int64()), pa.array(total, pa.list_(pa.float64()))], names=["g", "m", "k", "x"])

    def batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from sums(iter([batch.sort_by("g")]))

    def block_misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, marks in runs(batches, ["g", "block"]):
            g, m, vectors, centres = table["g"].to_numpy(), table["m"].to_numpy(), table["x"].combine_chunks(), table["centre"].combine_chunks()
            for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                lost = misses(_units(_matrix(vectors.slice(lo, hi - lo))), _matrix(centres.slice(lo, 1))[0], int(m[lo]), threshold, bits, seed)
                yield pa.RecordBatch.from_arrays([pa.array(g[lo : lo + 1]), pa.array(m[lo : lo + 1]), pa.array([lost.ravel().tolist()], pa.list_(pa.float64()))], names=["g", "m", "lost"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, marks in runs(batches, ["g"]):
            g, m, lost = table["g"].to_numpy(), table["m"].to_numpy(), table["lost"].combine_chunks()
            plans = [cheapest(_matrix(lost.slice(lo, hi - lo)).sum(0).reshape(-1, len(_PASSES)) / m[lo], int(m[lo]), miss) for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(g[marks[:-1]]), pa.array([p for p, *_ in plans], pa.int32()), pa.array([w for _, w, _ in plans], pa.int32())], names=["g", "passes", "w"])

    own = nodes.join(small_enough(big), "g").select("g", "m", "node", "x")
    shape = "g long, m long, k long, x array<double>"
    # a group leaves a row for each batch that has some of it
    part = own.select("g", "m", F.lit(0).cast("long").alias("k"), "x").mapInArrow(batch_sums, shape)
    centres = part.repartition("g").sortWithinPartitions("g", "k", F.xxhash64("x")).mapInArrow(sums, shape)
    centres = checkpoint(centres.select("g", F.transform("x", lambda v: (v / F.col("k")).cast("float")).alias("centre")))
    blocks = F.ceil(F.col("m") / _PLANNED)
    dealt = own.join(small_enough(centres), "g").select("g", F.pmod(F.xxhash64("node", F.lit(3)), blocks).alias("block"), "m", "x", "centre")
    lost = dealt.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(block_misses, "g long, m long, lost array<double>")
    chosen = lost.repartition("g").sortWithinPartitions("g").mapInArrow(choose, "g long, passes int, w int")
    return chosen.join(small_enough(centres), "g")


def _matrix(column: pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _window_links(block: np.ndarray, window: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j <= i + window, whose unit vectors have a product of at least ``floor``."""
    left, right = [], []
    step = 256
    for at in range(0, len(block), step):
        part = block[at : at + step]
        near = block[at : at + step + window]
        i, j = np.nonzero(part @ near.T >= floor)
        keep = (j > i) & (j - i <= window)
        left.append(i[keep] + at)
        right.append(j[keep] + at)
    return np.concatenate(left), np.concatenate(right)


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", threshold: float = 0.93,
    bits: int = 48, block: int = 2048, seed: int = 7, miss: float = 0.005, exact: int = 0,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each input row."""
    vector = F.col(vector_col).cast("array<double>")
    # adding 0.0 turns -0.0 into 0.0, so that equal vectors have equal hashes
    plain = df.select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x + F.lit(0.0)).alias("x"), F.col(group_col).alias("g"))
    broken = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = F.coalesce(F.col("g").isNotNull() & F.col("x").isNotNull() & ~broken & F.exists("x", lambda x: x != 0), F.lit(False))
    plain = plain.withColumn("node", F.when(valid, F.xxhash64("g", "x")))
    nodes = plain.where("node IS NOT NULL").groupBy("node").agg(F.first("x").alias("x"), F.first(F.xxhash64("g", F.size("x"))).alias("g"), F.count("*").alias("n"), F.min("id").alias("low"))
    nodes = checkpoint(nodes)

    spark = df.sparkSession
    sizes = checkpoint(nodes.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > exact))
    big = sizes.where(F.col("m") > int(_WINDOWS[0]) + 1)
    # a row for each group of more nodes than the smallest window
    plans = checkpoint(plan_groups(nodes, big, threshold, miss, bits, seed))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            node, group, vectors, centres = batch.column(0), batch.column(1).to_numpy(), batch.column(2), batch.column(5)
            passes, window = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            lengths = vectors.value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                at = pa.array(rows)
                unit = _units(_matrix(vectors.take(at)))
                small = np.rint(unit / np.abs(unit).max(1, keepdims=True) * 127).astype(np.int8)
                raw = pa.array([r.tobytes() for r in small], pa.binary())
                own = centres.take(at)
                planned = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
                if len(planned):
                    unit[planned] -= _matrix(own.take(pa.array(planned)))
                unit = unit.astype(np.float32)
                for p in range(int(passes[rows].max())):
                    if (dim, p) not in hashes:
                        hashes[dim, p] = _hashes(dim, p, bits, seed)
                    go = np.flatnonzero(passes[rows] > p)
                    take = pa.array(go)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), p, np.int32)), pa.array(group[rows[go]]), pa.array(_keys(unit[go], hashes[dim, p])), node.take(at).take(take), pa.array(window[rows[go]]), raw.take(take)], names=["pass", "g", "key", "node", "w", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside a sorted partition as (root, node), and its first and last rows as fringes."""
        part = TaskContext.get().partitionId()
        names = ["kind", "a", "b", "border", "pass", "g", "key", "w", "v"]
        held: pa.Table | None = None
        first: pa.Table | None = None

        def fringe(t: pa.Table, border: int) -> pa.RecordBatch:
            n = t.num_rows
            nothing = pa.array(np.zeros(n, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), t["node"].combine_chunks(), nothing, pa.array(np.full(n, border, np.int64)), t["pass"].combine_chunks(), t["g"].combine_chunks(), t["key"].combine_chunks(), t["w"].combine_chunks(), t["v"].combine_chunks()], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            window = (table if first is None else first)["w"][0].as_py()
            first = table.slice(0, window) if first is None else first if first.num_rows >= window else pa.concat_tables([first, table.slice(0, window - first.num_rows)])
            table = pa.concat_tables([held, table]) if held is not None else table
            a, b = link(table)
            n = len(a)
            none = pa.nulls(n, pa.binary())
            zero = pa.array(np.zeros(n, np.int64))
            small = pa.array(np.zeros(n, np.int32))
            yield pa.RecordBatch.from_arrays([small, pa.array(a), pa.array(b), zero, small, zero, zero, small, none], names=names)
            held = table.slice(max(0, table.num_rows - table["w"][-1].as_py())).combine_chunks()
        if held is not None:
            yield fringe(first.combine_chunks(), part - 1)
            yield fringe(held, part)

    def link(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        raw, node, window = table["v"].to_pylist(), table["node"].to_numpy(), table["w"].to_numpy()
        marks = np.zeros(table.num_rows, bool)
        marks[0] = True
        for k in ("pass", "g"):
            x = table[k].to_numpy()
            marks[1:] |= x[1:] != x[:-1]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        bounds = np.append(np.flatnonzero(marks), len(node))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            x = np.frombuffer(b"".join(raw[lo:hi]), np.int8).reshape(hi - lo, -1).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            i, j = _window_links(x, int(window[lo]), threshold - _MARGIN)
            if len(i):
                root = local_roots(hi - lo, i, j)
                member = np.flatnonzero(root != np.arange(hi - lo))
                left.append(node[lo + root[member]])
                right.append(node[lo + member])
        return np.concatenate(left), np.concatenate(right)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, marks in runs(batches, ["border"]):
            for lo, hi in zip(marks[:-1], marks[1:], strict=True):
                a, b = link(table.slice(int(lo), int(hi - lo)).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    planned = nodes.select("node", "g", "x").join(small_enough(sizes.select("g")), "g").join(small_enough(plans), "g", "left")
    planned = planned.select("node", "g", "x", F.coalesce("passes", F.lit(1)).alias("passes"), F.coalesce("w", F.lit(int(_WINDOWS[0]))).alias("w"), "centre")
    keyed = planned.mapInArrow(keys, "pass int, g long, key long, node long, w int, v binary")
    # partitions hold several windows, so that a window meets one border at most
    sent, widest = sizes.join(plans, "g", "left").agg(F.sum(F.col("m") * F.coalesce("passes", F.lit(1))), F.max(F.coalesce("w", F.lit(int(_WINDOWS[0]))))).first()
    most = (sent or 0) // (8 * (widest or 1)) + 1
    order = ["pass", "g", "key", "node"]
    dealt = keyed.repartitionByRange(*order) if most >= int(spark.conf.get("spark.sql.shuffle.partitions")) else keyed.repartitionByRange(most, *order)
    found = checkpoint(dealt.sortWithinPartitions(*order).mapInArrow(scan, "kind int, a long, b long, border long, pass int, g long, key long, w int, v binary"))
    fringes = found.where("kind = 1").select("border", "pass", "g", "key", F.col("a").alias("node"), "w", "v").dropDuplicates(["border", "pass", "node"])
    across = fringes.repartition("border").sortWithinPartitions("border", "pass", "g", "key", "node").mapInArrow(borders, "a long, b long")
    candidates = components(found.where("kind = 0").select("a", "b").union(across))
    if exact:
        whole = nodes.select("node", "g").join(small_enough(sizes.select("g")), "g", "left_anti")
        candidates = candidates.union(whole.select(F.col("node").alias("v"), F.col("g").alias("c")))

    sized = candidates.groupBy("c").agg(F.count("*").alias("m")).where("m > 1").select("c", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    own = candidates.join(sized, "c").select(F.col("v").alias("node"), "c", "blocks", F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks")).cast("int").alias("own"))
    spread = own.join(nodes.select("node", "n", "x"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("c", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "n", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, marks in runs(batches, ["c", "lo", "hi"]):
            node, n, own = table["node"].to_numpy(), table["n"].to_numpy(), table["own"].to_numpy()
            low, vectors = table["lo"].to_numpy(), table["x"].combine_chunks()
            out: list[tuple[np.ndarray, ...]] = []
            for lo, hi in zip(marks[:-1], marks[1:], strict=True):
                x = _matrix(vectors.slice(int(lo), int(hi - lo)))
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                links, weight, left, right = np.zeros(hi - lo, np.int64), n[lo:hi], [], []
                split = len(np.unique(own[lo:hi])) > 1
                cols = np.flatnonzero(own[lo:hi] != low[lo]) if split else np.arange(hi - lo)
                rows = np.flatnonzero(own[lo:hi] == low[lo]) if split else cols
                if not split and table["hi"][int(lo)].as_py() != low[lo]:
                    continue  # one of the two blocks is empty
                for at in range(0, len(rows), 512):
                    part = rows[at : at + 512]
                    hit = x[part] @ x[cols].T >= threshold
                    if split:
                        links[cols] += weight[part] @ hit
                    else:
                        hit[np.arange(len(part)), at + np.arange(len(part))] = False
                    links[part] += hit @ weight[cols]
                    i, j = np.nonzero(hit)
                    left.append(part[i])
                    right.append(cols[j])
                root = local_roots(hi - lo, np.concatenate(left), np.concatenate(right))
                out.append((node[lo:hi], links, node[lo + root]))
            if out:
                a, k, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(k), pa.array(b)], names=["a", "links", "b"])

    exact = checkpoint(spread.repartition("c", "lo", "hi").sortWithinPartitions("c", "lo", "hi").mapInArrow(compare, "a long, links long, b long"))
    counts = exact.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    member = components(exact.select("a", "b")).withColumnRenamed("v", "node")
    lowest = nodes.join(member, "node").groupBy("c").agg(F.min("low").alias("component"))
    answer = nodes.select("node", "n", "low").join(member.join(lowest, "c").select("node", "component"), "node", "left").join(counts, "node", "left")
    answer = answer.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "low").alias("component"))
    joined = plain.select("id", "node").join(answer, "node", "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (
  SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON vec_id = counts.a LEFT JOIN low ON vec_id = low.a
"""
