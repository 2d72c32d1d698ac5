"""Operators on node tables of trees: (id, parent, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.operators.core import written


def ancestors(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """``(id, ancestor, distance)`` by one join a level, each cut from its lineage."""
    step = written(nodes.where("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    # the first level is every node's parent, so the nodes are read only once
    up = step.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
    out = step
    for d in range(2, max_depth + 1):
        step = written(step.join(up, "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(d).alias("distance")))
        if step.isEmpty():
            return out
        out = out.union(step)
    raise RuntimeError(f"tree deeper than {max_depth}")


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    return nodes.join(nodes.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct(), "id", "left_anti")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """Number of nodes in each node's subtree, itself included."""
    up = ancestors(nodes).select(F.col("ancestor").alias("id"))
    return nodes.select("id").union(up).groupBy("id").agg(F.count("*").alias("size"))


def parents(nodes: DataFrame) -> DataFrame:
    """Each node with its parent's name."""
    p = nodes.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return nodes.join(p, "parent", "left").select("id", "parent", "name", "parent_name")


def common_ancestor(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Deepest common ancestor of each (a, b); a node counts as its own."""
    up = ancestors(nodes).select("id", "ancestor", "distance").union(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0)))
    a = pairs.join(up.withColumnRenamed("id", "a").withColumnRenamed("distance", "da"), "a")
    both = a.join(up.withColumnRenamed("id", "b").withColumnRenamed("distance", "db"), ["b", "ancestor"])
    return both.groupBy("a", "b").agg(F.min_by("ancestor", F.struct("da", "ancestor")).alias("ancestor"))


def reading_order(boxes: DataFrame, row: int = 8) -> DataFrame:
    """Rank of each box in its case: rows of ``row`` pixels, then x."""
    order = W.partitionBy("case_id").orderBy(F.floor((F.col("y") + row / 2) / row), "x", "node")
    return boxes.select("case_id", "node", F.row_number().over(order).alias("rank"))


def bands(boxes: DataFrame) -> DataFrame:
    """Horizontal bands of boxes that overlap in y."""
    order = W.partitionBy("case_id").orderBy("y", "node")
    top = F.max(F.col("y") + F.col("h")).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(top.isNull() | (F.col("y") >= top), 1).otherwise(0)
    return boxes.withColumn("fresh", fresh).select("case_id", "node", F.sum("fresh").over(order).alias("band"))


def repeated_runs(boxes: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` boxes of one type in one column, each at most a row's height apart."""
    order = W.partitionBy("case_id", "type", "col").orderBy("y", "node")
    b = boxes.withColumn("col", F.floor(F.col("x") / 40))
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(order)
    b = b.withColumn("fresh", F.when(gap.isNull() | (gap > 2 * F.col("h")), 1).otherwise(0))
    b = b.withColumn("run", F.sum("fresh").over(order))
    return b.groupBy("case_id", "type", "col", "run").agg(F.count("*").alias("n"), F.min("y").alias("top")).where(F.col("n") >= least)


def row_layout(boxes: DataFrame) -> DataFrame:
    """Per case: median gap and drift of the boxes as a column, and whether they are one."""
    order = W.partitionBy("case_id").orderBy("y", "node")
    g = boxes.withColumn("gap", F.lead("y").over(order) - F.col("y") - F.col("h"))
    m = g.groupBy("case_id").agg(F.count("*").alias("n"), F.median("gap").alias("gap"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.min("x").alias("left"), F.max("x").alias("right"))
    return m.select("case_id", "n", "gap", (F.col("high") - F.col("low")).cast("double").alias("drift"), F.when((F.col("n") > 1) & (F.col("low") >= 0), "column").otherwise("none").alias("direction"), (F.col("left") == F.col("right")).alias("aligned"))


def type_histogram(boxes: DataFrame) -> DataFrame:
    """Number of boxes of each type in each case."""
    return boxes.groupBy("case_id", "type").agg(F.count("*").alias("n"))


def preorder_ids(nodes: DataFrame) -> DataFrame:
    """Position of each child below its parent, in name order."""
    return nodes.select("id", F.row_number().over(W.partitionBy("parent").orderBy("name", "k")).alias("position"))
