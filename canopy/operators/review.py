"""Error reports, gates by rules, record checks, threshold and detector choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import geometry as G
from canopy.operators import spatial
from canopy.operators.core import checkpoint
from canopy.operators.quality import f1, ratio
from canopy.operators.stats import quantiles


def runtime(rows: DataFrame, by: str, seconds: str) -> DataFrame:
    """Mean, 95 % point, largest and total of the seconds."""
    p = quantiles(rows, [by], F.col(seconds), [0.95]).select(by, F.col("q")[0].alias("p95_s"))
    return rows.groupBy(by).agg(F.avg(seconds).alias("mean_s"), F.max(seconds).alias("max_s"), F.sum(seconds).alias("total_s")).join(p, by, "left")


def magnitude_error(pairs: DataFrame, by: str, predicted: Column, truth: Column) -> DataFrame:
    """Mean absolute and median relative error of matched magnitudes."""
    err = F.abs(predicted - truth)
    m = quantiles(pairs, [by], err / F.greatest(F.lit(1), F.abs(truth)), [0.5]).select(by, F.col("q")[0].alias("median_relative"))
    return pairs.groupBy(by).agg(F.count("*").alias("n"), F.avg(err).alias("mae")).join(m, by, "left")


def noise_report(cases: DataFrame, spurious: DataFrame, by: str) -> DataFrame:
    """Share of cases with a false finding and false findings a case; cases without any count."""
    n = spurious.groupBy("case_id").agg(F.count("*").alias("false"))
    c = cases.join(n, "case_id", "left").withColumn("false", F.coalesce("false", F.lit(0)))
    return c.groupBy(by).agg(F.count("*").alias("cases"), F.avg((F.col("false") > 0).cast("double")).alias("false_case_rate"), F.avg("false").alias("per_case"))


def ladder(metrics: DataFrame, runs: list[int]) -> DataFrame:
    """Mean of each metric in each run of a ladder, and the rung after which it falls most (first on ties)."""
    p = metrics.groupBy("metric").pivot("run", runs).agg(F.avg("value"))
    p = p.select("metric", *[F.col(str(r)).alias(f"run{r}") for r in runs])
    falls = F.array(*[F.struct((F.col(f"run{a}") - F.col(f"run{b}")).alias("cost"), F.lit(-b).alias("rung")) for a, b in zip(runs, runs[1:], strict=False)])
    top = F.array_max(falls)
    return p.withColumn("rung", -top["rung"]).withColumn("cost", top["cost"])


def paired_modes(runs: DataFrame, default: str) -> DataFrame:
    """Each mode against the default on the same cases: renders as a ratio, cases better and worse."""
    d = runs.where(F.col("mode") == default).select("case_id", F.col("renders").alias("d_renders"), F.col("loss").alias("d_loss"))
    j = runs.join(d, "case_id")
    count = lambda c: F.sum(c.cast("long"))
    return j.groupBy("mode").agg(F.count("*").alias("n"), (F.sum("renders") / F.sum("d_renders")).alias("render_ratio"), count(F.col("loss") < F.col("d_loss")).alias("better"), count(F.col("loss") > F.col("d_loss")).alias("worse"))


def scenario_gate(now: DataFrame, was: DataFrame, keys: list[str], slack: float) -> DataFrame:
    """Pass rates against a baseline's; what is missing on either side is a verdict of its own."""
    a, b = now.select(*keys, F.col("rate").alias("now")), was.select(*keys, F.col("rate").alias("was"))
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("now") < F.col("was") - slack, "regressed").otherwise("ok")
    return a.join(b, keys, "full_outer").withColumn("verdict", verdict)


def rule_gates(measures: DataFrame, rules: DataFrame) -> DataFrame:
    """By case and tier: passed, number of failed rules and their metrics in order; a null value fails."""
    ok = F.coalesce(F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")), F.lit(False))
    j = measures.join(F.broadcast(rules), "metric").withColumn("ok", ok)  # rules are a constant table
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("metric"))))
    return j.groupBy("case_id", "tier").agg(F.bool_and("ok").alias("passed"), failed.alias("f")).select("case_id", "tier", "passed", F.size("f").alias("n_failed"), F.array_join("f", ",").alias("failed"))


def decision_queue(candidates: DataFrame, below: float, cap: int) -> DataFrame:
    """Uncertain candidates of each case by kind, then larger area, at most ``cap`` a case."""
    rank = F.row_number().over(W.partitionBy("case_id").orderBy("kind", F.col("area").desc(), "id"))
    return candidates.where(F.col("confidence") < below).withColumn("rank", rank).where(F.col("rank") <= cap)


def record_errors(records: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each broken rule of each record."""
    errors = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return records.select(*key, F.explode(errors).alias("error"))


def tercile_policy(records: DataFrame, least: int = 6) -> DataFrame:
    """Counts by type, operator and tercile of the magnitude within the type; one tercile for small types."""
    e = quantiles(records, ["type"], F.col("magnitude"), [1 / 3, 2 / 3]).withColumnRenamed("q", "e").join(records.groupBy("type").agg(F.count("*").alias("m")), "type")
    third = F.when(F.col("m") < least, 0).when(F.col("magnitude") <= F.col("e")[0], 0).when(F.col("magnitude") <= F.col("e")[1], 1).otherwise(2)
    return records.join(e, "type").groupBy("type", "operator", third.alias("third")).agg(F.count("*").alias("n"), F.sum(F.col("fixed").cast("long")).alias("k"))


def threshold_sweep(scored: DataFrame, step: int, top: int, n_truth: int) -> DataFrame:
    """Kept findings, hits and F1 at each threshold 0, step, ... below ``top``; the first best is marked.

    One count by step, then sums from above: the findings are not repeated for each threshold.
    """
    spark = scored.sparkSession
    counts = scored.groupBy((F.floor(F.col("confidence") / step) * step).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("tp"))
    grid = spark.range(0, top, step).select(F.col("id").alias("threshold")).join(counts, "threshold", "left")
    up = W.partitionBy(F.lit(0)).orderBy(F.col("threshold").desc()).rowsBetween(W.unboundedPreceding, 0)  # one row a threshold
    s = grid.select("threshold", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(c) for c in ("n", "tp")])
    s = s.withColumn("f1", f1(F.col("tp"), F.col("n"), F.lit(n_truth)))
    return s.withColumn("best", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("f1").desc(), "threshold")) == 1)


def route(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """The detector to trust for each type: best F1, then precision, then the smaller detector."""
    s = scored.groupBy("type", "detector").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("tp"))
    s = s.join(truth.groupBy("type").agg(F.count("*").alias("n_gt")), "type")
    s = s.withColumn("f1", f1(F.col("tp"), F.col("n"), F.col("n_gt"))).withColumn("precision", ratio(F.col("tp"), F.col("n")))
    rank = F.row_number().over(W.partitionBy("type").orderBy(F.col("f1").desc(), F.col("precision").desc(), "detector"))
    return s.withColumn("r", rank).where("r = 1").select("type", "detector", "f1", "precision")


def apply_route(findings: DataFrame, routes: DataFrame, page_area: float, iou: float = 0.5, loc_iou: float = 0.3, centre_share: float = 0.25, touch: float = 0.1) -> DataFrame:
    """Findings of each type's detector, without those that an emitted one stands for.

    They are emitted by falling precision of their route, then confidence, then the smaller fid. One is dropped if an emitted one of
    its case overlaps it with an IoU of ``iou``, or is localised by it (IoU of ``loc_iou``, or its centre in the emitted box of at
    most a quarter of the page) with an IoU above ``touch``. Findings: case_id, fid, detector, type, confidence, x, y, w, h.
    """
    f = checkpoint(findings.join(F.broadcast(routes.select("type", "detector", "precision")), ["type", "detector"]).withColumns({"_p": -F.col("precision"), "_c": -F.col("confidence")}))
    first = lambda p: F.struct(F.col(f"{p}_p"), F.col(f"{p}_c"), F.col(f"{p}fid"))
    o = G.iou("l_", "r_")
    at = (o >= loc_iou) | ((G.area("l_") <= page_area * centre_share) & G.contains_centre("l_", "r_"))
    pairs = spatial.spatial_join(f, f, condition=(first("l_") < first("r_")) & ((o >= iou) | (at & (o > touch))))
    return spatial.without_beaten(f, pairs, ["fid"], ["_p", "_c"]).drop("_p", "_c")


def leave_one_out(values: DataFrame, fold: str, value: str) -> DataFrame:
    """Mean of all folds but one, for each fold, from sums: rows are not repeated."""
    s = values.groupBy(fold).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    whole = W.partitionBy(F.lit(0))  # one row a fold
    rest = (F.sum("s").over(whole) - F.col("s")) / F.nullif(F.sum("n").over(whole) - F.col("n"), F.lit(0))
    return s.select(fold, (F.col("s") / F.col("n")).alias("held_out"), rest.alias("others"))
