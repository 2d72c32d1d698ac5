"""Matching quality, detection reports, metric roll-ups and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.operators.core import checkpoint
from canopy.operators.stats import quantiles

#: Metric, higher is better, value of goodness 0 (null: 1), weight, stage: the composite's definition (fixed values).
SPEC = [
    ("node_precision", True, None, 1.0, "perceive"), ("node_recall", True, None, 1.5, "perceive"), ("mean_iou", True, None, 1.0, "perceive"),
    ("color_de", False, 20.0, 1.0, "perceive"), ("text_cer", False, None, 1.0, "perceive"), ("text_recall", True, None, 1.5, "perceive"),
    ("radius_mae", False, 8.0, 0.5, "perceive"), ("type_acc", True, None, 0.5, "perceive"), ("component_acc", True, None, 1.5, "map"),
    ("token_acc", True, None, 0.5, "map"), ("mean_de", False, 20.0, 1.5, "render"), ("frac_bad", False, 0.3, 1.0, "render"),
    ("ssim", True, None, 0.5, "render"), ("layout_consistency", True, None, 0.5, "perceive"), ("jnd_frac_nontext", False, 0.3, 1.0, "render"),
    ("chamfer_tile_max", False, 128.0, 0.5, "render"), ("edge_within1", True, None, 1.0, "render"),
]


def spec(df: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    return df.sparkSession.createDataFrame(rows or SPEC, "metric string, higher boolean, norm double, weight double, stage string")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(tp: Column, pred: Column, truth: Column) -> Column:
    return ratio(tp * 2, pred + truth)


def goodness(value: Column, higher: Column, norm: Column) -> Column:
    """[0, 1], 1 is perfect; null stays null, non-finite is 0."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / F.coalesce(norm, F.lit(1.0))))
    finite = ~(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))
    return F.when(value.isNotNull(), F.when(finite, F.when(higher, v).otherwise(1 - v)).otherwise(0.0))


def with_goodness(metrics: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """Metrics with their definition (``SPEC``, or rows like it) and goodness."""
    return metrics.join(F.broadcast(spec(metrics, rows)), "metric").withColumn("goodness", goodness(F.col("value"), F.col("higher"), F.col("norm")))


def composites(metrics: DataFrame) -> DataFrame:
    """Weighted mean goodness of each case over its defined metrics."""
    g = with_goodness(metrics).where("goodness IS NOT NULL")
    return g.groupBy("case_id").agg((F.sum(F.col("weight") * F.col("goodness")) / F.sum("weight")).alias("composite"))


def roll_up(metrics: DataFrame) -> DataFrame:
    """Mean, median, worst, best, count and goodness of each metric."""
    v = F.col("value")
    g = with_goodness(metrics)
    r = g.groupBy("metric").agg(F.avg(v).alias("mean"), F.when(F.first("higher"), F.min(v)).otherwise(F.max(v)).alias("worst"), F.when(F.first("higher"), F.max(v)).otherwise(F.min(v)).alias("best"), F.count(v).alias("n"), F.avg("goodness").alias("goodness"))
    p = quantiles(metrics, ["metric"], F.col("value"), [0.5]).select("metric", F.col("q")[0].alias("p50"))
    return r.join(p, "metric", "left").select("metric", "mean", "p50", "worst", "best", "n", "goodness")


def worst(metrics: DataFrame, k: int) -> DataFrame:
    """The k (case, metric) entries of largest weighted deficit."""
    g = with_goodness(metrics).where("goodness IS NOT NULL").withColumn("deficit", F.col("weight") * (1 - F.col("goodness")))
    return g.orderBy(F.col("deficit").desc(), "case_id", "metric").limit(k).select("case_id", "metric", "value", "deficit", "stage")


def detection_report(matches: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, pred, gt, precision, recall and F1 by type and over all (A03), one grouped pass a side."""
    sides = [matches.select(F.col("r_type").alias("type"), F.lit(1).alias("tp"), F.lit(0).alias("p"), F.lit(0).alias("g"))]
    sides.append(pred.select("type", F.lit(0).alias("tp"), F.lit(1).alias("p"), F.lit(0).alias("g")))
    sides.append(truth.select("type", F.lit(0).alias("tp"), F.lit(0).alias("p"), F.lit(1).alias("g")))
    all_ = sides[0].union(sides[1]).union(sides[2])
    t = all_.groupingSets([["type"], []], "type").agg(F.sum("tp").alias("tp"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gt"))
    tp, p, g = F.col("tp"), F.col("n_pred"), F.col("n_gt")
    return t.select("type", "tp", "n_pred", "n_gt", ratio(tp, p).alias("precision"), ratio(tp, g).alias("recall"), f1(tp, p, g).alias("f1"))


def average_precision(scored: DataFrame, n_truth: int) -> DataFrame:
    """Non-interpolated AP of (confidence, case_id, fid, hit), ranked by confidence.

    Rows are dealt to ranges of the whole order, so equal confidences share no task; ranks are those in a range plus the
    rows of the ranges before.
    """
    order = [F.col("confidence").desc(), F.col("case_id"), F.col("fid")]
    s = checkpoint(scored.select("confidence", "case_id", "fid", F.col("hit").cast("int").alias("hit")).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sums = s.groupBy("range").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    before = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    base = sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"))
    inside = W.partitionBy("range").orderBy(*order)
    ranked = s.join(F.broadcast(base), "range").withColumn("k", F.col("n0") + F.row_number().over(inside))
    ranked = ranked.withColumn("hits", F.col("h0") + F.sum("hit").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.agg((F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("k"))), F.lit(0.0)) / F.lit(max(1, n_truth))).alias("ap"))


def gate(current: DataFrame, baseline: DataFrame, eps: float) -> DataFrame:
    """Failures by metric: missing, or goodness lower than the baseline's by more than ``eps``."""
    j = current.select("metric", F.col("goodness").alias("now")).join(baseline.select("metric", F.col("goodness").alias("was")), "metric", "full_outer")
    reason = F.when(F.col("now").isNull() & F.col("was").isNotNull(), "missing").when(F.col("now") < F.col("was") - eps, "worse")
    return j.select("metric", "was", "now", reason.alias("reason")).where("reason IS NOT NULL")


def judge_criteria(measured: DataFrame, criteria: DataFrame) -> DataFrame:
    """Pass and margin of each (case, criterion); an undefined value fails at -1."""
    j = measured.join(F.broadcast(criteria), "metric")
    room = F.when(F.col("op") == ">=", F.col("value") - F.col("threshold")).otherwise(F.col("threshold") - F.col("value"))
    margin = F.coalesce(room / F.greatest(F.abs("threshold"), F.lit(1e-9)), F.lit(-1.0))
    return j.select("case_id", "family", "criterion", margin.alias("margin"), (margin >= 0).alias("passed"))


def worst_cases(judged: DataFrame, k: int = 6) -> DataFrame:
    """(family, case_id, passed, margin_min, margin_mean, rank): the k worst cases of each family.

    A case passes if all its criteria do; cases are ranked by their least margin, then their mean margin (clipped to one either way), then the id.
    """
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("margin")))
    c = judged.groupBy("family", "case_id").agg(F.bool_and("passed").alias("passed"), F.min("margin").alias("margin_min"), F.round(F.avg(clipped), 9).alias("margin_mean"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("family").orderBy("margin_min", "margin_mean", "case_id"))).where(F.col("rank") <= k)


def generalisation(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_before, n_after, before, after, delta) of mean goodness; a side without values is null, as is then the change."""
    side = lambda df, p: df.groupBy(*keys).agg(F.count("goodness").alias(f"n_{p}"), F.avg("goodness").alias(p))
    j = side(before, "before").join(side(after, "after"), keys, "full_outer")
    zero = [F.coalesce(f"n_{p}", F.lit(0)).alias(f"n_{p}") for p in ("before", "after")]
    return j.select(*keys, *zero, "before", "after", (F.col("after") - F.col("before")).alias("delta"))
