"""Class-weighted decision trees by exact split search, level by level.

All models of a call (folds, bagged trees) and all nodes of a level are searched at once: equal values are counted by class, the
counts are dealt to ranges of (model, node, feature, value), and prefix sums over ranges and inside them give both sides
of every split. No node's values have to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.operators.core import small_enough, written

#: Cumulated probabilities of 0, 1, ... draws of a row in a bootstrap sample as large as the data (Poisson, mean 1).
_DRAWS = [0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941]


def bagged(items: DataFrame, trees: int, seed: int = 7) -> DataFrame:
    """``items`` once for each of ``trees`` models, drawn ``times`` times each by a hash of the id."""
    at = F.pmod(F.xxhash64("id", "model", F.lit(seed)), F.lit(100_000)) / 100_000
    times = sum((F.when(at >= p, 1).otherwise(0) for p in _DRAWS), F.lit(0))
    return items.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("times", times).where("times > 0")


def _classes(items: DataFrame) -> list[str]:
    """The labels: a vocabulary of types."""
    return sorted(r["label"] for r in items.select("label").where("label IS NOT NULL").distinct().collect())


def _squares(counts: list[Column], weights: list[str]) -> tuple[Column, Column]:
    """Weighted total, and the sum of squares over it, of class counts."""
    q = [k / F.col(n) for k, n in zip(counts, weights, strict=True)]
    total = sum(q[1:], q[0])
    square = sum((x * x for x in q[1:]), q[0] * q[0])
    return total, F.when(total > 0, square / total).otherwise(0.0)


def fit(items: DataFrame, features: list[str], depth: int = 8, least: int = 1, gain: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Splits ``(model, node, feature, threshold, gain)`` and leaves ``(model, node, label, probability)``.

    Items: model, id, label, the features, and ``times`` if rows count more than once. Every class of a model weighs the same in
    total. A node's split is the one of largest decrease of the Gini impurity (rounded to nine places) with ``least``
    items a side, ties to the feature's name, then the smaller threshold; values up to the threshold go to node 2n, others and
    nulls to 2n + 1. A leaf's label is its most probable one, ties to the smaller name.
    """
    names = _classes(items)
    if not names:
        empty = items.sparkSession
        return empty.createDataFrame([], "model int, node long, feature string, threshold double, gain double"), empty.createDataFrame([], "model int, node long, label string, probability double")
    k, n = [f"_k{i}" for i in range(len(names))], [f"_n{i}" for i in range(len(names))]
    times = F.col("times") if "times" in items.columns else F.lit(1)
    base = items.where("label IS NOT NULL").select("model", "id", "label", times.alias("times"), *[F.col(f).cast("double").alias(f) for f in features])
    of = lambda name: F.coalesce(F.sum(F.when(F.col("label") == name, F.col("times"))), F.lit(0))
    weights = written(base.groupBy("model").agg(*[F.greatest(of(c), F.lit(1)).alias(w) for c, w in zip(names, n, strict=True)]))
    at = written(base.withColumn("node", F.lit(1).cast("long")))
    splits: DataFrame | None = None
    for _ in range(depth):
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]))
        long = at.select("model", "node", "label", "times", pairs.alias("p")).select("model", "node", "label", "times", "p.*").where("value IS NOT NULL AND NOT isnan(value)")
        counted = long.groupBy("model", "node", "feature", "value").agg(*[of(c).alias(x) for c, x in zip(names, k, strict=True)])
        dealt = written(counted.repartitionByRange("model", "node", "feature", "value").withColumn("part", F.spark_partition_id()))
        place = ["model", "node", "feature"]
        ranges = dealt.groupBy(*place, "part").agg(*[F.sum(x).alias(x) for x in k])
        before = W.partitionBy(*place).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
        ranges = ranges.select(*place, "part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}b") for x in k])
        total = at.groupBy("model", "node").agg(*[of(c).alias(f"{x}t") for c, x in zip(names, k, strict=True)])
        inside = W.partitionBy(*place, "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
        s = dealt.select(*place, "part", "value", *[F.sum(x).over(inside).alias(x) for x in k]).join(ranges, [*place, "part"]).join(total, ["model", "node"]).join(F.broadcast(weights), "model")
        left, whole = [F.col(x) + F.col(f"{x}b") for x in k], [F.col(f"{x}t") for x in k]
        right = [t - x for t, x in zip(whole, left, strict=True)]
        better = F.round(_squares(left, n)[1] + _squares(right, n)[1] - _squares(whole, n)[1], 9)
        count = lambda side: sum(side[1:], side[0])
        s = s.withColumns({"gain": better, "nl": count(left), "nr": count(right)}).where((F.col("gain") > gain) & (F.col("nl") >= least) & (F.col("nr") >= least))
        best = s.groupBy("model", "node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "value")).alias("m"))
        best = written(best.select("model", "node", F.col("m.feature").alias("feature"), F.col("m.value").alias("threshold"), (-F.col("m.loss")).alias("gain")))
        splits = best if splits is None else splits.unionByName(best)
        if best.isEmpty():
            break
        at = written(_down(at, best, features))
    leaves = at.groupBy("model", "node").agg(*[of(c).alias(x) for c, x in zip(names, k, strict=True)]).join(F.broadcast(weights), "model")
    q = [F.col(x) / F.col(w) for x, w in zip(k, n, strict=True)]
    shares = F.array(*[F.struct((-x).alias("q"), F.lit(c).alias("label")) for c, x in zip(names, q, strict=True)])
    leaves = leaves.withColumn("top", F.array_min(shares)).withColumn("all", sum(q[1:], q[0]))
    return splits, leaves.select("model", "node", F.col("top.label").alias("label"), (-F.col("top.q") / F.col("all")).alias("probability"))


def _down(at: DataFrame, splits: DataFrame, features: list[str]) -> DataFrame:
    """Items one level further down; those of unsplit nodes stay."""
    s = small_enough(splits.select("model", "node", "feature", "threshold"))
    j = at.join(s, ["model", "node"], "left")
    value = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in features])
    to = F.when(F.col("feature").isNull(), F.col("node")).when(value <= F.col("threshold"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
    return j.withColumn("node", to).drop("feature", "threshold")


def apply(items: DataFrame, splits: DataFrame, leaves: DataFrame, features: list[str], depth: int = 8) -> DataFrame:
    """``items`` (model, id, features, ...) with ``predicted`` and ``probability`` of their model's leaf."""
    at = items.withColumn("node", F.lit(1).cast("long"))
    for d in range(depth):
        level = splits.where((F.col("node") >= 2**d) & (F.col("node") < 2 ** (d + 1)))
        at = _down(at, level, features)
    named = small_enough(leaves.select("model", "node", F.col("label").alias("predicted"), "probability"))
    return at.join(named, ["model", "node"], "left").drop("node")


def vote(predictions: DataFrame) -> DataFrame:
    """(id, label, predicted, probability) of bagged trees: the label of greatest mean probability, ties to the smaller name."""
    trees = predictions.select("model").distinct().count()
    v = predictions.groupBy("id", "label", "predicted").agg((F.sum("probability") / trees).alias("p"))
    return v.groupBy("id", "label").agg(F.min(F.struct((-F.col("p")).alias("q"), "predicted")).alias("m")).select("id", "label", "m.predicted", (-F.col("m.q")).alias("probability"))


def cross_validated(items: DataFrame, features: list[str], fold: Column, folds: int = 3, depth: int = 6, least: int = 1, sure: float = 0.5) -> DataFrame:
    """(fold, n, accuracy, macro_f1, abstained), each fold's documents held out of its model.

    A prediction of a probability under ``sure`` is an abstention: it counts as wrong in the accuracy, and as no prediction in
    the F1, which is averaged over the classes that the fold holds.
    """
    f = written(items.withColumn("_fold", fold))
    train = f.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("model") != F.col("_fold"))
    splits, leaves = fit(train, features, depth, least)
    t = apply(f.withColumn("model", F.col("_fold")), splits, leaves, features, depth)
    t = written(t.select(F.col("model").alias("fold"), "label", F.when(F.col("probability") >= sure, F.col("predicted")).alias("said")))
    hit = (F.col("label") == F.col("said")) & F.col("said").isNotNull()
    whole = t.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("accuracy"), F.avg(F.when(F.col("said").isNull(), 1.0).otherwise(0.0)).alias("abstained"))
    truth = t.groupBy("fold", F.col("label").alias("c")).agg(F.count("*").alias("g"), F.count_if(hit).alias("tp"))
    said = t.where("said IS NOT NULL").groupBy("fold", F.col("said").alias("c")).agg(F.count("*").alias("p"))
    f1 = truth.join(said, ["fold", "c"], "left").groupBy("fold").agg(F.avg(2 * F.col("tp") / (F.col("g") + F.coalesce("p", F.lit(0)))).alias("macro_f1"))
    return whole.join(f1, "fold").select("fold", "n", "accuracy", "macro_f1", "abstained")
