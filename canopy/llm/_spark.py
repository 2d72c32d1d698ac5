"""Spark helpers shared by the operators: checkpoints, components, runs of equal keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task may settle (at most 8 MB of longs).
FEW_EDGES = 500_000
#: Rows of two longs up to which a side may be sent to every executor (about 32 MB).
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, ``spark.checkpoint.dir``; a temporary folder only in local mode, where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="canopy-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    For loops of joins: a checkpoint keeps the size estimate of its plan, and a join multiplies those of its
    sides, so that the estimate's digits would grow threefold a round. A table's estimate is its size.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to hold at most ``limit`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_hot(rows: DataFrame, answers: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``answers``, which holds a key once; ``sizes(key, n)``: rows of each key.

    Keys of more than a thousandth of the rows, at most 1,000 of them whatever the data's size, are answered by a
    broadcast, so that no key's rows meet in one task. Rows with a null key are not joined.
    """
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(checkpoint(sizes.where(F.col("n") > total // 1000).select(key)))
    few, rest = F.broadcast(answers.join(hot, key, "left_semi")), answers.join(hot, key, "left_anti")
    known = rows.where(F.col(key).isNotNull())
    out = known.join(hot, key, "left_semi").join(few, key, "left").unionByName(known.join(hot, key, "left_anti").join(rest, key, "left"))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of an undirected edge table of longs: ``(v, c)``, one row per vertex.

    Each round every vertex hooks to its neighbour of smallest random rank and the edge list is
    contracted, so vertices shrink by a constant factor and no long path is walked step by step. When at most
    ``few`` edges are left, one task settles them. ``c`` is one vertex of the component, the same for all its members.
    """
    level = written(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if level.count() <= few:
            break
        both = level.union(level.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))), F.col(c))  # noqa: B023, E731
        hook = written(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.when(F.col("m") < rank("a"), F.col("m")["b"]).otherwise(F.col("a")).alias("c")))
        maps.append(hook)
        left, right = hook.select(F.col("v").alias("a"), F.col("c").alias("ca")), hook.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        level = written(level.join(left, "a").join(right, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = written(level.repartition(1).mapInArrow(_settle, "v long, c long"))
    for hook in reversed(maps):
        up = out.select(F.col("v").alias("c"), F.col("c").alias("top"))
        out = hook.join(up, "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    return written(out) if maps else out


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(ids), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["v", "c"])


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal ``keys`` from batches sorted by them, with the runs' offsets.

    A run may span batches; at most one unfinished run is carried over.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        marks = _bounds(table, keys)
        last = int(marks[-2])
        if last:
            yield table.slice(0, last), marks[:-1]
        held = table.slice(last).combine_chunks() if last else table
    if held is not None and held.num_rows:
        yield held, _bounds(held, keys)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    n = table.num_rows
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        x = table[k].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change), n)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable position for each of ``n`` positions under the links (i, j)."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        live = a != b
        if not live.any():
            return label
        i, j = i[live], j[live]
        np.minimum.at(label, np.maximum(a, b)[live], np.minimum(a, b)[live])
        while not np.array_equal(label, up := label[label]):
            label = up
