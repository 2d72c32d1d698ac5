"""Models learned by counting: move priors, policies, rules from corrections, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions.geometry import size_bucket


def credited(moves: DataFrame) -> DataFrame:
    """Gain of each move: 0 unless accepted, a batch's gain in equal shares."""
    gain = F.when(F.col("accepted"), F.greatest(F.lit(0.0), F.col("gain") / F.greatest(F.lit(1), F.col("batch")))).otherwise(F.lit(0.0))
    return moves.withColumn("gain", gain).withColumn("promised", F.greatest(F.lit(0.0), F.coalesce("promised", F.lit(0.0))))


def move_summary(moves: DataFrame) -> DataFrame:
    """Tries, acceptances and gains by kind, and each kind's share of the gain."""
    s = credited(moves).groupBy("kind").agg(F.count("*").alias("tried"), F.sum(F.col("accepted").cast("long")).alias("accepted"), F.sum("gain").alias("gain"))
    total = F.sum("gain").over(W.partitionBy(F.lit(0)))  # one row a kind
    return s.select("kind", "tried", "accepted", "gain", (F.col("accepted") / F.col("tried")).alias("accept_rate"), (F.col("gain") / F.col("tried")).alias("gain_per_try"), F.when(total > 0, F.col("gain") / total).otherwise(0.0).alias("gain_share"))


def move_priors(moves: DataFrame, smooth: float = 20.0, min_tries: int = 30, dead: float = 0.05) -> DataFrame:
    """Realised over promised gain by (kind, node type, size), smoothed to the kind and the whole."""
    m = credited(moves).withColumn("size", size_bucket(F.col("area")))
    sets = m.groupingSets([["kind", "node_type", "size"], ["kind"], []], "kind", "node_type", "size")
    g = sets.agg(F.grouping_id("kind", "node_type", "size").alias("level"), F.count("*").alias("tried"), F.sum("gain").alias("gain"), F.sum("promised").alias("promised"))
    whole = g.where("level = 7").select(F.when(F.col("promised") > 0, F.col("gain") / F.col("promised")).otherwise(1.0).alias("rate"), (F.col("gain") / F.col("tried")).alias("per_try"))
    mean = F.col("promised") / F.col("tried")

    def rate(parent: Column) -> Column:
        return F.when(F.col("promised") > 0, (F.col("gain") + mean * smooth * parent) / (F.col("promised") + mean * smooth)).otherwise(parent)

    kinds = g.where("level = 3").crossJoin(F.broadcast(whole)).select("kind", rate(F.col("rate")).alias("kind_rate"))
    b = g.where("level = 0").crossJoin(F.broadcast(whole)).join(kinds, "kind")
    per_try = F.col("gain") / F.col("tried")
    return b.select("kind", "node_type", "size", "tried", "gain", "promised", F.when(F.col("rate") > 0, rate(F.col("kind_rate")) / F.col("rate")).otherwise(1.0).alias("prior"), ((F.col("tried") >= min_tries) & (per_try < F.col("per_try") * dead)).alias("deprioritised"))


def prior_lookup(wanted: DataFrame, priors: DataFrame, kinds: DataFrame, floor: float = 0.1) -> DataFrame:
    """Prior of each wanted (kind, node_type, size), else its kind's, else 1; never below ``floor``."""
    j = wanted.join(priors.select("kind", "node_type", "size", "prior", "deprioritised"), ["kind", "node_type", "size"], "left")
    j = j.join(kinds.select("kind", F.col("prior").alias("kind_prior")), "kind", "left")
    return j.withColumn("prior", F.greatest(F.lit(floor), F.coalesce("prior", "kind_prior", F.lit(1.0)))).drop("kind_prior").withColumn("deprioritised", F.coalesce("deprioritised", F.lit(False)))


def policy_estimates(records: DataFrame, smooth: float = 4.0) -> DataFrame:
    """Beta-smoothed P(fix) of each (type, operator) towards the operator's rate, ranked in each type."""
    t = records.groupBy("type", "operator").agg(F.count("*").alias("n"), F.sum(F.col("fixed").cast("long")).alias("k"))
    o = records.groupBy("operator").agg((F.sum(F.col("fixed").cast("long")) / F.count("*")).alias("rate"))
    j = t.join(F.broadcast(o), "operator").withColumn("p_fix", (F.col("k") + F.col("rate") * smooth) / (F.col("n") + smooth))
    return j.select("type", "operator", "n", "k", "p_fix", F.row_number().over(W.partitionBy("type").orderBy(F.col("p_fix").desc(), "operator")).alias("rank"))


def confusion(records: DataFrame, classes: int, alpha: float = 1.0) -> DataFrame:
    """Dirichlet-smoothed P(truth | predicted) over the dense grid of classes."""
    spark = records.sparkSession
    grid = spark.range(classes).select(F.col("id").alias("pred")).join(F.broadcast(spark.range(classes).select(F.col("id").alias("truth"))))
    n = records.groupBy("pred", "truth").agg(F.count("*").alias("n"))
    full = grid.join(n, ["pred", "truth"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("pred", "truth", "n", ((F.col("n") + alpha) / (F.sum("n").over(W.partitionBy("pred")) + alpha * classes)).alias("p"))


def derive_rules(observations: DataFrame, min_support: int = 2, min_confidence: float = 0.6) -> DataFrame:
    """The winning answer of each signature, voted by distinct screens.

    A screen that gave several answers counts on both sides. Ties go to the larger answer text.
    """
    votes = observations.groupBy("signature", "answer").agg(F.countDistinct("screen").alias("support"))
    best = F.row_number().over(W.partitionBy("signature").orderBy(F.col("support").desc(), F.col("answer").desc()))
    winner = votes.withColumn("r", best).where("r = 1").drop("r")
    against = observations.join(winner.select("signature", F.col("answer").alias("won")), "signature").where("answer <> won").groupBy("signature").agg(F.countDistinct("screen").alias("against"))
    j = winner.join(against, "signature", "left").withColumn("against", F.coalesce("against", F.lit(0)))
    conf = F.col("support") / (F.col("support") + F.col("against"))
    return j.select("signature", "answer", "support", "against", conf.alias("confidence"), ((F.col("support") >= min_support) & (conf >= min_confidence)).alias("active"))


def state(ledger: DataFrame) -> DataFrame:
    """Value of each key after all accepted changes that no accepted entry reverts."""
    undone = ledger.where("accepted AND reverts IS NOT NULL").select(F.col("reverts").alias("id")).distinct()
    live = ledger.where("accepted AND reverts IS NULL").join(undone, "id", "left_anti")
    return live.groupBy("k").agg(F.max_by("new_value", F.struct("ts", "id")).alias("value"))


def value_changes(ledger: DataFrame) -> DataFrame:
    """[old, new] of each accepted entry by key, old from the entry before it."""
    order = W.partitionBy("k").orderBy("ts", "id")
    return ledger.where("accepted").withColumn("old_value", F.lag("new_value").over(order)).where("old_value IS NULL OR old_value <> new_value").select("id", "k", "old_value", "new_value")


def rule_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and changed rules by signature."""
    a, b = old.select("signature", F.col("answer").alias("old_answer")), new.select("signature", F.col("answer").alias("new_answer"))
    change = F.when(F.col("old_answer").isNull(), "added").when(F.col("new_answer").isNull(), "removed").when(F.col("old_answer") != F.col("new_answer"), "changed")
    return a.join(b, "signature", "full_outer").withColumn("change", change).where("change IS NOT NULL").select("signature", "old_answer", "new_answer", "change")


def signatures(roots: DataFrame, atoms: DataFrame) -> DataFrame:
    """(case_id, signature): hash of type, corner class, shadow and the kinds of the atoms in order, runs collapsed."""
    order = W.partitionBy("case_id").orderBy("position")
    a = atoms.withColumn("before", F.lag("kind").over(order)).where(~F.col("kind").eqNullSafe(F.col("before")))
    kinds = a.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("position", "kind"))).alias("k")).select("case_id", F.array_join("k.kind", ",").alias("kinds"))
    corner = F.when(F.col("radius") < 2, "square").when(F.col("radius") * 2 >= F.least("w", "h"), "pill").otherwise("round")
    parts = F.concat_ws("\x1f", "type", corner, F.when(F.col("shadow") > 0, "shadow").otherwise("flat"), "kinds")
    return roots.join(kinds, "case_id").select("case_id", F.substring(F.sha1(parts), 1, 16).alias("signature"))


def compatible(pairs: DataFrame, a: str, b: str, groups: list[list]) -> DataFrame:
    """Pairs of equal types, or of types in one group."""
    same = F.col(a) == F.col(b)
    for g in groups:
        same = same | (F.col(a).isin(g) & F.col(b).isin(g))
    return pairs.where(same)


#: Leaf types of findings with the unit of their magnitude; null where it is not scored (fixed values).
TAXONOMY = [
    ("geometry.shift", "px"), ("geometry.size", "px"), ("geometry.radius", "px"), ("color.fill", "dE"), ("color.stroke", "dE"), ("color.tint_global", "dE"),
    ("structure.missing", None), ("structure.extra", None), ("structure.split", "px"), ("structure.merge", "px"), ("text.content", "CER"), ("text.style", "steps"),
    ("text.position", "px"), ("icon.glyph", None), ("icon.missing", None), ("effect.shadow", "px"), ("effect.opacity", "share"), ("layout.spacing", "px"),
    ("noise.antialias", None), ("noise.subpixel", None), ("noise.compression", None), ("noise.browser", None),
]


def with_taxonomy(findings: DataFrame) -> DataFrame:
    """Findings with parent, unit and is_error of their type, null for unknown types except the parent."""
    t = findings.sparkSession.createDataFrame(TAXONOMY, "type string, unit string").withColumn("is_error", ~F.col("type").startswith("noise."))
    return findings.join(F.broadcast(t), "type", "left").withColumn("parent", F.split_part("type", F.lit("."), F.lit(1)))


def canonical_values(corrections: DataFrame) -> DataFrame:
    """Correction values in one form for each kind, null with a reason where malformed.

    Texts lose surplus white space, colours become lower-case #rrggbb, places and sizes numbers joined by commas.
    """
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    color = F.lower(F.trim("value"))
    box = F.regexp_replace("value", r"\s", "")
    kind = F.col("kind")
    texts, boxes = kind.isin("text", "icon", "component"), kind.isin("move", "resize")
    reason = F.when(texts & (text == ""), "empty text").when((kind == "recolour") & ~color.rlike("^#[0-9a-f]{6}$"), "no colour").when(boxes & ~box.rlike(r"^-?[0-9.]+(,-?[0-9.]+){1,3}$"), "no box").when(~(texts | boxes | (kind == "recolour")), "unknown kind")
    value = F.when(texts, text).when(kind == "recolour", color).when(boxes, box)
    return corrections.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), value))
