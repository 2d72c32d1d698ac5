"""Trees against a recursive search, bagging and folds."""

import random
from collections import Counter

from pyspark.sql import functions as F

from canopy.operators import cart


def brute_tree(rows, weights, depth, node=1):
    """{node: (feature, threshold)} over rows of (features, label)."""
    def square(part):
        q = [n / weights[c] for c, n in sorted(Counter(c for _, c in part).items())]
        return sum(x * x for x in q) / sum(q) if q else 0.0

    best = None
    for f in ("a", "b"):
        for t in sorted({x[f] for x, _ in rows if x[f] is not None}):
            left = [r for r in rows if r[0][f] is not None and r[0][f] <= t]
            right = [r for r in rows if not (r[0][f] is not None and r[0][f] <= t)]
            gain = round(square(left) + square(right) - square(rows), 9)
            if left and right and gain > 1e-9 and (best is None or (-gain, f, t) < best[:3]):
                best = (-gain, f, t, left, right)
    if depth == 0 or best is None:
        return {}
    return {node: best[1:3]} | brute_tree(best[3], weights, depth - 1, 2 * node) | brute_tree(best[4], weights, depth - 1, 2 * node + 1)


def rows_of(spark, seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.randrange(12), rnd.choice([None, *range(8)])
        label = "x" if a > 7 and (b or 0) > 2 else "y" if a < 3 else "z"
        rows.append((0, i, rnd.choice("xyz") if rnd.random() < 0.1 else label, float(a), None if b is None else float(b)))
    return rows, spark.createDataFrame(rows, "model int, id long, label string, a double, b double").repartition(4)


def test_tree_equals_recursive_search(spark):
    rows, df = rows_of(spark, 1, 160)
    splits, leaves = cart.fit(df, ["a", "b"], 3)
    weights = Counter(r[2] for r in rows)
    want = brute_tree([({"a": r[3], "b": r[4]}, r[2]) for r in rows], weights, 3)
    assert {r["node"]: (r["feature"], r["threshold"]) for r in splits.collect()} == want
    said = cart.apply(df, splits, leaves, ["a", "b"], 3).collect()
    assert len(said) == 160 and all(r["predicted"] in "xyz" and 1 / 3 <= r["probability"] <= 1 for r in said)
    assert sum(r["predicted"] == r["label"] for r in said) > 120


def test_bagged_trees_and_folds(spark):
    _, df = rows_of(spark, 2, 200)
    bag = cart.bagged(df.drop("model"), 5)
    drawn = bag.agg(F.sum("times")).first()[0]
    assert 0.8 * 1000 < drawn < 1.2 * 1000
    model = cart.fit(bag, ["a", "b"], 3)
    everywhere = df.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(4))))
    votes = cart.vote(cart.apply(everywhere, *model, ["a", "b"], 3)).collect()
    assert len(votes) == 200 and sum(r["label"] == r["predicted"] for r in votes) > 150
    folds = cart.cross_validated(df.drop("model"), ["a", "b"], (F.col("id") % 3).cast("int"), depth=3).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2] and sum(r["n"] for r in folds) == 200
    assert all(0.5 < r["accuracy"] <= 1 and 0.4 < r["macro_f1"] <= 1 for r in folds)
    assert cart.fit(df.where("false"), ["a", "b"], 2)[1].count() == 0
