"""Learning from users: observations, promotion, checks of corrections, evaluation, ledger changes and reverts, mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import text as X
from canopy.operators import learning, spatial


def observations(items: DataFrame) -> DataFrame:
    """(signature, screen, answer) from corrections and confirmations.

    Items: (bundle, signature, kind, predicted, value, confirmed). A confirmation repeats the prediction; only component
    answers count, and a deleted component is the answer ``none``.
    """
    answer = F.when(F.col("kind") == "component", F.col("value")).when(F.col("kind") == "deleted", "none").when(F.col("confirmed"), F.col("predicted"))
    o = items.withColumn("answer", answer).where("answer IS NOT NULL AND signature IS NOT NULL")
    return o.select("signature", F.col("bundle").alias("screen"), "answer").distinct()


def promotion(local: DataFrame, shared: DataFrame, least: int = 3, confidence: float = 0.67) -> DataFrame:
    """Rules to promote: local ones seen on ``least`` screens or more, with what they change (L17): added or changed."""
    good = local.where((F.col("support") >= least) & (F.col("confidence") >= confidence)).select("signature", "answer", "support")
    j = good.join(shared.select("signature", F.col("answer").alias("old_answer")), "signature", "left")
    return j.where("old_answer IS NULL OR old_answer <> answer").select("signature", "answer", "old_answer", "support", F.when(F.col("old_answer").isNull(), "added").otherwise("changed").alias("change"))


def check_corrections(corrections: DataFrame, prediction: DataFrame, geom_tol: float = 2.0) -> DataFrame:
    """(case_id, node, kind, ok): whether a prediction now agrees; null where that cannot be checked.

    Corrections: (case_id, node, kind, value); prediction: nodes found for them (case_id, node, text, component, glyph,
    x, y, w, h).
    """
    j = corrections.join(prediction.withColumn("found", F.lit(True)), ["case_id", "node"], "left")
    seen, kind, value = F.coalesce("found", F.lit(False)), F.col("kind"), F.col("value")
    at = F.split(value, ",")
    near = lambda a, b: F.greatest(F.abs(at[0].try_cast("double") - F.col(a)), F.abs(at[1].try_cast("double") - F.col(b))) <= geom_tol
    same = lambda c: F.coalesce(X.normalize(F.col(c)) == X.normalize(value), F.lit(False))
    ok = F.when(kind == "deleted", ~seen).when(kind == "added", seen).when(kind == "text", seen & same("text")).when(kind == "component", seen & same("component")).when(kind == "icon", seen & same("glyph"))
    ok = ok.when(kind == "move", seen & near("x", "y")).when(kind == "resize", seen & near("w", "h"))
    return j.select("case_id", "node", "kind", ok.alias("ok"))


def user_evaluation(checks: DataFrame) -> DataFrame:
    """(run, kind, n, accuracy, before): share of checkable corrections met, by kind and over all, and the run before's."""
    g = checks.where("ok IS NOT NULL").groupingSets([["run", "kind"], ["run"]], "run", "kind").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
    g = g.withColumn("kind", F.coalesce("kind", F.lit("all")))
    return g.withColumn("before", F.lag("accuracy").over(W.partitionBy("kind").orderBy("run")))


def accepted_rules(candidates: DataFrame, rejected: DataFrame, active: DataFrame) -> DataFrame:
    """Candidate rules to put to the gates (L20): those that change behaviour and were not rejected on the same evidence.

    Candidates: (signature, answer, evidence); rejected: the same; active: (signature, answer).
    """
    new = candidates.join(rejected, ["signature", "answer", "evidence"], "left_anti")
    return new.join(active.select("signature", "answer"), ["signature", "answer"], "left_anti")


def status(bundles: DataFrame, rules: DataFrame) -> DataFrame:
    """(what, name, n): items by kind, bundles, rules by state."""
    row = lambda df, what, name: df.groupBy(F.lit(what).alias("what"), name.alias("name")).agg(F.count("*").alias("n"))
    b = bundles.select("bundle").distinct()
    return row(bundles, "items", F.col("kind")).unionByName(row(b, "bundles", F.lit("all"))).unionByName(row(rules, "rules", F.when(F.col("active"), "active").otherwise("inactive")))


def ledger_entries(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid entries with their content ids, ready to append, and broken ones with the reason.

    Changes: (kind, key, old, new, ts, accepted).
    """
    kinds = ("param", "rule", "token", "baseline", "prior")
    reason = F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "unknown kind").when(F.col("key").isNull(), "no key").when(F.col("accepted").isNull(), "accepted must be set").when(F.col("new").isNull() & F.col("old").isNull(), "no change")
    c = changes.withColumn("reason", reason)
    id_ = F.concat(F.col("kind"), F.lit("-"), F.substring(F.sha1(F.concat_ws("\x1f", "key", F.col("old").cast("string"), F.col("new").cast("string"), F.col("ts").cast("string"))), 1, 10))
    return c.where("reason IS NULL").drop("reason").withColumn("id", id_), c.where("reason IS NOT NULL")


def reverts(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, verdict, key, old, new) of entries to take back (L28): the inverse change, or why it cannot be.

    unknown, rejected, already reverted, or drifted: the key's state is no longer what the entry made it. Ledger: (id,
    k, old_value, new_value, ts, accepted, reverts).
    """
    undone = ledger.where("accepted AND reverts IS NOT NULL").select(F.col("reverts").alias("id"), F.lit(True).alias("undone")).distinct()
    now = learning.state(ledger).select("k", F.col("value").alias("now"))
    j = wanted.select("id").join(ledger, "id", "left").join(undone, "id", "left").join(now, "k", "left")
    verdict = F.when(F.col("accepted").isNull(), "unknown").when(~F.col("accepted"), "rejected").when(F.col("undone"), "already reverted").when(~F.col("now").eqNullSafe(F.col("new_value")), "drifted").otherwise("ok")
    ok = lambda c: F.when(verdict == "ok", F.col(c))
    return j.select("id", verdict.alias("verdict"), ok("k").alias("key"), ok("new_value").alias("old"), ok("old_value").alias("new"))


def mined_failures(boxes: DataFrame, known: DataFrame, gate: float, pad: int = 24, per_run: int = 4, iou: float = 0.3) -> DataFrame:
    """Worst boxes over the gate of each run, at most ``per_run`` that do not overlap, with crop box and a lasting index.

    Boxes: (case_id (the run), fid, error, x, y, w, h); known: (case_id, fid, index). New ones are numbered behind the
    largest index, in order of run and box.
    """
    bad = boxes.where(F.col("error") > gate)
    kept = spatial.suppress(bad, ["fid"], ["error"], iou)
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.col("error").desc(), "fid"))
    top = kept.withColumn("rank", rank).where(F.col("rank") <= per_run)
    crop = {"crop_x": F.greatest(F.lit(0), F.col("x") - pad), "crop_y": F.greatest(F.lit(0), F.col("y") - pad), "crop_w": F.col("w") + 2 * pad, "crop_h": F.col("h") + 2 * pad}
    new = spatial.checkpoint(top.join(known.select("case_id", "fid"), ["case_id", "fid"], "left_anti").withColumns(crop).select("case_id", "fid", "error", *crop))
    # numbers within ranges of runs, then behind the ranges before: no task sorts all rows
    ranged = spatial.checkpoint(new.repartitionByRange("case_id", "fid").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = known.agg(F.coalesce(F.max("index"), F.lit(-1)).alias("last"))
    number = F.col("last") + F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("case_id", "fid"))
    return ranged.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").crossJoin(F.broadcast(base)).withColumn("index", number).drop("part", "before", "last")
