"""Components, nearest neighbours, null models and novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.operators.core import checkpoint, components, local_roots, written  # noqa: F401
from canopy.operators.metric import k_nearest  # noqa: F401


def quantiles(df: DataFrame, keys: list[str], value: Column, qs: list[float]) -> DataFrame:
    """(keys, q array): exact quantiles by linear interpolation, nulls left out; keys of nulls only are left out.

    Equal values are counted first, then dealt to ranges of (keys, value); a value's place is the counts of the ranges
    before plus those in its range, so few keys with many values are no large tasks.
    """
    n = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    s = checkpoint(n.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    part = s.groupBy(*keys, "_part").agg(F.sum("_n").alias("_k"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    base = part.select(*keys, "_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(W.partitionBy(*keys)).alias("_all"))
    inside = W.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    v = s.join(base, [*keys, "_part"]).withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    # places count from 0; a value holds those from _end - _n to _end - 1
    at = lambda p: F.max(F.when((p < F.col("_end")) & (p >= F.col("_end") - F.col("_n")), F.col("_v")))
    places = [((F.col("_all") - 1) * q) for q in qs]
    g = v.groupBy(*keys).agg(F.first("_all").alias("_all"), *[f.alias(f"_{n}{i}") for i, p in enumerate(places) for n, f in (("lo", at(F.floor(p))), ("hi", at(F.ceil(p))))])
    out = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p - F.floor(p)) for i, p in enumerate(places)]
    return g.select(*keys, F.array(*out).alias("q"))


def purity(neighbours: DataFrame) -> DataFrame:
    """Most frequent label among each query's neighbours (ties to the smaller) and its share."""
    v = neighbours.groupBy("query_id", "label").agg(F.count("*").alias("n"))
    t = v.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return t.select("query_id", "label", (F.col("n") / F.col("all")).alias("purity"))


def conformal(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """p-value of each score: (1 + reference scores as large) / (1 + reference scores).

    Equal scores are counted, then dealt to ranges of falling score; a score has the reference scores of the ranges before its
    own and those down to it in its range.
    """
    both = scores.select("id", "score", F.lit(0).alias("ref")).union(reference.select(F.lit(None), "score", F.lit(1)))
    dealt = checkpoint(both.repartitionByRange(F.col("score").desc()).withColumn("range", F.spark_partition_id()))
    per = dealt.groupBy("range").agg(F.sum("ref").alias("n"))
    above = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    base = per.select("range", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("all"))
    counted = dealt.groupBy("range", "score").agg(F.sum("ref").alias("n"))
    inside = W.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    large = counted.withColumn("n", F.sum("n").over(inside)).join(F.broadcast(base), "range")
    j = dealt.where("ref = 0").join(large.select("range", "score", (F.col("n0") + F.col("n")).alias("as_large"), "all"), ["range", "score"])
    return j.select("id", "score", ((F.col("as_large") + 1) / (F.col("all") + 1)).alias("p"))


def stratum_summary(tiles: DataFrame, top: int = 20) -> DataFrame:
    """By stratum and over all: count, mean, variance, maximum of the values and mean of the top ones."""
    agg = tiles.groupingSets([["stratum"], []], "stratum").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.max("value").alias("max"))
    rank = F.row_number().over(W.partitionBy("stratum").orderBy(F.col("value").desc(), "id"))
    tail = tiles.withColumn("r", rank).where(F.col("r") <= top).groupBy("stratum").agg(F.avg("value").alias("tail_mean"))
    return agg.join(tail, "stratum", "left").select("stratum", "n", "mean", "var", "max", "tail_mean")


def histogram(tiles: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts by stratum and equal bins, values outside in the outer bins."""
    b = F.least(F.lit(bins), F.greatest(F.lit(1), F.floor((F.col("value") - low) / ((high - low) / bins)) + 1)).cast("int")
    return tiles.groupBy("stratum", b.alias("bin")).agg(F.count("*").alias("n"))


def survival(hist: DataFrame) -> DataFrame:
    """Share of values in a bin or above, by stratum."""
    up = W.partitionBy("stratum").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    return hist.select("stratum", "bin", (F.sum("n").over(up) / F.sum("n").over(W.partitionBy("stratum"))).alias("p"))


def robust_scale(values: DataFrame) -> DataFrame:
    """Values by stratum less the median, over the interquartile range (deviation if that is 0)."""
    q = quantiles(values, ["stratum"], F.col("value"), [0.25, 0.5, 0.75])
    s = q.select("stratum", F.col("q")[1].alias("m"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")).join(values.groupBy("stratum").agg(F.stddev_samp("value").alias("sd")), "stratum")
    scale = F.when(F.col("iqr") > 0, F.col("iqr")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return values.join(s, "stratum").select("id", "stratum", ((F.col("value") - F.col("m")) / scale).alias("z"))
