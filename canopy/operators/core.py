"""Spark helpers shared by the operators: checkpoints, broadcasts of counted size, runs of equal keys, components."""

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
#: Rows that a task sorts or groups at once where they are dealt by ``dealt``.
TASK_ROWS = 1_000_000
#: Bytes in memory for a byte of a Parquet file, for estimates.
PACKED = "10.0"


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


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    For loops of joins: a checkpoint keeps the size estimate of its plan, and a join multiplies those of its
    sides, so that the estimate's digits would grow threefold a round. A table's estimate is the size of its files, times
    ``PACKED`` (unless the session says otherwise): taken as it is, tables of millions of small numbers would be broadcast.
    A VARIANT is kept as it is: to infer columns for its fields takes longer than to write it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    infer = "spark.sql.variant.inferShreddingSchema"
    before = spark.conf.get(infer)
    spark.conf.set(infer, "false")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(infer, before)
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor", "1.0")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", PACKED)
    return spark.read.schema(df.schema).parquet(path)


def compiled(spark: SparkSession) -> None:
    """Has operators run one by one where their joint code is longer than the JVM compiles.

    HotSpot interprets methods of more than 8,000 bytes, which a join whose condition compares two boxes easily reaches. A limit
    that the session has set itself stays.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to hold at most ``limit`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, which has ``rows`` rows, dealt by ``keys`` to so many tasks that one gets about ``TASK_ROWS``.

    A shuffle whose number of partitions is Spark's choice has them joined to a size in compressed bytes, so that a task of small
    rows gets millions of them, and hash tables and sorts of what they grow into.
    """
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def against(rows: DataFrame, table: DataFrame, limit: int = 20_000) -> DataFrame:
    """Every row of ``rows`` with every row of ``table``: sent to all executors up to ``limit`` rows (counted), beyond that in
    blocks of so many, each met by all rows in tasks of its own."""
    blocks = -(-table.count() // limit)
    if blocks <= 1:
        return rows.join(F.broadcast(table))
    dealt = table.withColumn("_block", F.pmod(F.xxhash64(*table.columns), F.lit(blocks)).cast("int"))
    # a block is met in several parts of the rows, so that no task holds all rows
    parts = 64
    spread = rows.withColumns({"_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "_part": F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")})
    dealt = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread.join(dealt, ["_block", "_part"]).drop("_block", "_part")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal ``keys`` from batches sorted by them, with the runs' offsets.

    A run may span batches; one unfinished run is carried over, and a batch that only goes on with it is put by as it is.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held and _same(held[0], table, keys):
            held.append(table)
            continue
        table = pa.concat_tables([*held, table]) if held else table
        marks = _bounds(table, keys)
        last = int(marks[-2])
        if last:
            yield table.slice(0, last), marks[:-1]
        held = [table.slice(last).combine_chunks() if last else table]
    if held:
        table = pa.concat_tables(held).combine_chunks()
        yield table, _bounds(table, keys)


def _same(first: pa.Table, table: pa.Table, keys: list[str]) -> bool:
    """Whether all rows of a sorted ``table`` have the keys of the first table's last row."""
    return all(first[k][-1] == table[k][0] and table[k][0] == table[k][-1] for k in keys)


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


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(v, c)``, c the smallest vertex, for all edges of one task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(ids), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["v", "c"])


def components(edges: DataFrame, few: int = FEW_EDGES, max_rounds: int = 60) -> DataFrame:
    """``(v, component)``: smallest vertex reachable over the undirected edges (a, b) of longs.

    While there are more than ``few`` edges, every vertex hooks to its neighbour of smallest random rank and the edges
    are contracted, so vertices shrink by a constant factor a round and no long path is walked step by step.
    What is left is settled in one task.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    level = written(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while level.count() > few:
        if len(maps) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        both = level.union(level.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))), F.col(c))  # noqa: B023, E731
        hook = written(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.when(F.col("m") < rank("a"), F.col("m")["b"]).otherwise(F.col("a")).alias("c")))
        maps.append(hook)
        left, right = hook.select(F.col("v").alias("a"), F.col("c").alias("ca")), hook.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        level = written(level.join(left, "a").join(right, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    out = written(level.repartition(1).mapInArrow(_settle, "v long, c long"))
    for hook in reversed(maps):
        up = out.select(F.col("v").alias("c"), F.col("c").alias("top"))
        out = hook.join(up, "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    if maps:
        low = out.groupBy("c").agg(F.min("v").alias("component"))
        out = written(out.join(low, "c").select("v", F.col("component").alias("c")))
    alone = e.where("a = b").select(F.col("a").alias("v")).distinct().join(out, "v", "left_anti")
    return out.select("v", F.col("c").alias("component")).unionByName(alone.withColumn("component", F.col("v")))
