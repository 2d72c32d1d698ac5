"""Snapping of node properties to a design system's tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import color as C
from canopy.operators.core import against


def snap_colors(colors: DataFrame, tokens: DataFrame, limit: float = 10.0, tie: float = 0.05) -> DataFrame:
    """Nearest colour token by CIE76 (J07): among those within ``tie`` of the nearest, the first by priority.

    Distances are computed once for each distinct colour.
    """
    distinct = colors.select("r", "g", "b").distinct()
    t = tokens.select("token", "priority", F.col("r").alias("tr"), F.col("g").alias("tg"), F.col("b").alias("tb"))
    pairs = against(distinct, t)
    de = C.delta76(C.lab(*map(F.col, ("r", "g", "b"))), C.lab(*map(F.col, ("tr", "tg", "tb"))))
    pairs = pairs.withColumn("de", F.round(de, 6))
    near = pairs.withColumn("least", F.min("de").over(W.partitionBy("r", "g", "b"))).where(F.col("de") <= F.col("least") + tie)
    best = near.groupBy("r", "g", "b").agg(F.min_by(F.struct("token", "de"), F.struct("priority", "token")).alias("t"))
    best = best.select("r", "g", "b", F.when(F.col("t.de") <= limit, F.col("t.token")).alias("token"), F.col("t.de").alias("de"))
    return colors.join(best, ["r", "g", "b"]).select("id", "token", "de")


def snap_radius(nodes: DataFrame, tokens: DataFrame, tol: float = 2.0, pill: float = 0.45) -> DataFrame:
    """Nearest corner token within ``tol``, ``full`` for pills."""
    t = tokens.select(F.col("radius").alias("tr")).distinct()
    pairs = against(nodes.select("id", "radius", "w", "h"), t).withColumn("d", F.abs(F.col("tr") - F.col("radius")))
    best = pairs.groupBy("id", "radius", "w", "h").agg(F.min(F.struct("d", "tr")).alias("m"))
    round_ = F.col("radius") >= F.greatest(F.lit(1), F.least("w", "h")) * pill
    return best.select("id", F.when(round_, "full").when(F.col("m.d") <= tol, F.concat(F.lit("corner."), F.col("m.tr").cast("string"))).alias("token"))


def snap_spacing(values: DataFrame, grid: int = 4, tol: float = 1.0) -> DataFrame:
    """Nearest multiple of the grid (halves to the even one) within ``tol``."""
    snapped = F.bround(F.col("value") / grid) * grid
    return values.select("id", F.when(F.abs(snapped - F.col("value")) <= tol, snapped.cast("double")).alias("snapped"))


def calibrated(candidates: DataFrame, full: float = 0.2, tie: float = 0.5) -> DataFrame:
    """Best candidate of each node, its confidence shrunk by a small margin to the runner-up."""
    order = W.partitionBy("id").orderBy(F.col("score").desc(), "component")
    c = candidates.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("r = 1")
    margin = F.col("score") - F.coalesce("second", F.lit(0.0))
    factor = F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin) / full) * (1 - tie) + tie
    return c.select("id", "component", "score", margin.alias("margin"), (F.col("score") * factor).alias("confidence"))
