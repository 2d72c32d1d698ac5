"""Verdicts on proposed changes: families left out by subtraction, sweeps with guards, gates before rebaselining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.operators import benchmark
from canopy.operators.core import shared_folder, written

_COUNTS = ["tp", "n_pred", "n_gt", "noise_cases", "false_cases"]


def _f1(p: str = "") -> Column:
    total = F.col(f"{p}n_pred") + F.col(f"{p}n_gt")
    return F.round(F.when(total > 0, 2 * F.col(f"{p}tp") / total).otherwise(0.0), 9)


def change_verdicts(
    counts: DataFrame, changes: DataFrame, violations: DataFrame, min_gain: float = 0.003, noise_tol: float = 0.0, lofo_tol: float = 0.01, seed_tol: float = 0.005, meta_tol: float = 0.05,
) -> DataFrame:
    """One row a change: what it gains, what it risks, the reasons against it, and whether it is accepted.

    Counts: change, split (calibration or fresh), family, cut, tp, n_pred, n_gt, noise_cases, false_cases: what each setting
    of the change's cut finds. Changes: change, params (number of parameters it sets), cut (the current one). Violations:
    change, before, after. A change moves to the cut of best F1 on calibration, ties to the smaller one. Its gain is
    priced by parameter. Every family is left out once: the others' counts are the totals less its own, so no cut is
    fitted anew from cases, and the cut they choose is judged on the family. Accepted: the gain is reached, the false-case rate
    on noise does not rise, no left-out family and not the fresh split lose, and violations hardly grow.
    """
    per = written(counts.groupBy("change", "split", "family", "cut").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    total = per.groupBy("change", "split", "cut").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    rate = F.when(F.col("noise_cases") > 0, F.col("false_cases") / F.col("noise_cases")).otherwise(0.0)
    scored = written(total.select("change", "split", "cut", _f1().alias("f1"), rate.alias("rate")))
    best = lambda df, *keys: df.groupBy(*keys).agg(F.min_by("cut", F.struct(-F.col("f1"), F.col("cut"))).alias("cut"))
    chosen = best(scored.where("split = 'calibration'"), "change").withColumnRenamed("cut", "new_cut")
    plan = written(changes.withColumnRenamed("cut", "old_cut").join(chosen, "change"))
    at = lambda split, cut, p: scored.where(F.col("split") == split).select("change", F.col("cut").alias(cut), F.col("f1").alias(f"{p}_f1"), F.col("rate").alias(f"{p}_rate"))
    j = plan.join(at("calibration", "old_cut", "was"), ["change", "old_cut"], "left").join(at("calibration", "new_cut", "now"), ["change", "new_cut"], "left")
    j = j.join(at("fresh", "old_cut", "fresh_was"), ["change", "old_cut"], "left").join(at("fresh", "new_cut", "fresh_now"), ["change", "new_cut"], "left")
    own = per.where("split = 'calibration'")
    cuts = own.select("change", "cut").distinct().join(own.select("change", "family").distinct(), "change")
    rest = cuts.join(own.select("change", "family", "cut", *_COUNTS[:3]), ["change", "family", "cut"], "left").join(total.where("split = 'calibration'").select("change", "cut", *[F.col(c).alias(f"all_{c}") for c in _COUNTS[:3]]), ["change", "cut"])
    rest = rest.select("change", "family", "cut", *[(F.col(f"all_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in _COUNTS[:3]]).withColumn("f1", _f1())
    family = own.select("change", "family", "cut", _f1().alias("f1"))
    held = best(rest, "change", "family").join(plan.select("change", "old_cut"), "change")
    held = held.join(family, ["change", "family", "cut"], "left").join(family.select("change", "family", F.col("cut").alias("old_cut"), F.col("f1").alias("was")), ["change", "family", "old_cut"], "left")
    delta = F.round(F.coalesce("f1", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)), 9)
    worst = held.withColumn("delta", delta).groupBy("change").agg(F.min(F.struct("delta", "family")).alias("w"), F.count("*").alias("families"))
    j = j.join(worst, "change", "left").join(violations, "change", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # a single family leaves nothing to learn from without it
    lost = F.when(F.col("families") > 1, F.least(F.lit(0.0), F.col("w.delta"))).otherwise(0.0)
    j = j.select("change", "old_cut", "new_cut", "params", F.round(zero(F.col("now_f1")) - zero(F.col("was_f1")), 9).alias("gain"), F.round(F.greatest("params", F.lit(1)) * min_gain, 9).alias("required"), F.round(zero(F.col("now_rate")) - zero(F.col("was_rate")), 9).alias("noise_change"),
                 lost.alias("worst"), F.when(F.col("families") > 1, F.col("w.family")).alias("worst_family"), F.round(zero(F.col("fresh_now_f1")) - zero(F.col("fresh_was_f1")), 9).alias("fresh_change"),
                 (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("more_violations"), F.greatest(F.lit(1), F.ceil(F.coalesce("before", F.lit(0)) * meta_tol)).alias("allowed"))
    against = {"gain": F.col("gain") < F.col("required"), "noise": F.col("noise_change") > noise_tol + 1e-12, "family": F.col("worst") < -lofo_tol, "fresh": F.col("fresh_change") < -seed_tol, "violations": F.col("more_violations") > F.col("allowed")}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in against.items()]))
    return j.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def seed_stability(counts: DataFrame) -> DataFrame:
    """(name, seeds, mean, sd, low, high) of the F1 of each name over its seeds (L13). Counts: name, seed, tp, n_pred, n_gt."""
    per = counts.groupBy("name", "seed").agg(*[F.sum(c).alias(c) for c in _COUNTS[:3]]).withColumn("f1", _f1())
    return per.groupBy("name").agg(F.count("*").alias("seeds"), F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("sd"), F.min("f1").alias("low"), F.max("f1").alias("high"))


def sweep(scores: DataFrame, base: int, improve: float = 0.0) -> DataFrame:
    """(candidate, train, holdout, rank, kept): all candidates of a sweep in one grouped pass.

    Scores: candidate, split (train or holdout), score. Candidates are ranked by their train mean, the base before equal ones, then
    the smaller; the first is kept if it is not the base and its holdout mean beats the base's by more than ``improve``
    (its train mean, where nothing is held out).
    """
    mean = lambda split: F.round(F.avg(F.when(F.col("split") == split, F.col("score"))), 9)
    m = written(scores.groupBy("candidate").agg(mean("train").alias("train"), mean("holdout").alias("holdout")))
    ranked = m.withColumn("rank", F.row_number().over(W.orderBy(F.col("train").desc_nulls_last(), F.when(F.col("candidate") == base, 0).otherwise(1), "candidate")))  # one row a candidate
    was = m.where(F.col("candidate") == base).select(F.coalesce("holdout", "train").alias("was"))
    better = F.coalesce("holdout", "train") > F.col("was") + improve
    return ranked.crossJoin(F.broadcast(was)).select("candidate", "train", "holdout", "rank", ((F.col("rank") == 1) & (F.col("candidate") != base) & better).alias("kept"))


def accept_by_family(current: DataFrame, baseline: DataFrame, eps: float = 0.003) -> DataFrame:
    """(family, was, now, passed, kept): a family's composite becomes its baseline only if it is not lower by more than ``eps``.

    Both: family, composite. A new family is accepted; one without a current composite fails and keeps what it has.
    """
    j = current.select("family", F.col("composite").alias("now")).join(baseline.select("family", F.col("composite").alias("was")), "family", "full_outer")
    passed = F.col("now").isNotNull() & (F.col("was").isNull() | (F.col("now") >= F.col("was") - eps))
    return j.select("family", "was", "now", passed.alias("passed"), F.when(passed, F.col("now")).otherwise(F.col("was")).alias("kept"))


def gate_then_rebaseline(current: DataFrame, path: str, assert_gate: bool = True, **tolerances: float) -> DataFrame:
    """The gate's failures against the baseline at ``path``; ``current`` replaces it there only if there are none.

    Both are (case_id, metric, goodness, composite). Without a baseline ``current`` becomes the first one. With
    ``assert_gate`` false failures are reported and the baseline is replaced all the same.
    """
    spark = current.sparkSession
    now = written(current)
    known = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = known.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(known)
    shared_folder(spark)
    was = spark.read.parquet(path) if exists else now
    failures = written(benchmark.gate_failures(now, was, **tolerances))
    if not exists or not assert_gate or failures.isEmpty():
        now.write.mode("overwrite").parquet(path)
    return failures
