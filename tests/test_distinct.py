"""Repeated places and sizes are compared once."""

import random

from canopy.operators import matcher, novelty


def joined_rows(df):
    """Most rows that a join of an executed plan (without adaptive stages) gave."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if "Join" in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
    return most


def test_copies_of_a_place_meet_once(spark, monkeypatch):
    kept, real = [], novelty.spatial.checkpoint
    monkeypatch.setattr(novelty.spatial, "checkpoint", lambda df: kept.append(real(df)) or kept[-1])
    rows = [(k, 0.0 if k % 2 else 5.0, 0.0) for k in range(2, 302)] + [(1, 14.0, 0.0), (900, 90.0, 0.0), (901, 90.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in novelty.dbscan(points, 10.0, 3).collect()}
    # (14, 0) is near 150 points, a core itself; the two at (90, 0) are too few
    assert got == {**dict.fromkeys(range(1, 302), 1), 900: None, 901: None}
    assert max(df.count() for df in kept) <= 4 * 4


def test_sizes_meet_the_best_rule_of_a_kind_once(spark):
    rnd = random.Random(3)
    nodes = [(k, rnd.randrange(2), rnd.choice((20, 26, 27)), rnd.choice((20, 30, 60))) for k in range(300)]
    rules = [(k, rnd.randrange(2), f"a{k % 7}", float(rnd.choice((14, 20, 26, 33))), rnd.choice((1.0, 1.35, 2.0)), rnd.randrange(3) / 4, rnd.randrange(3), k % 2 == 0, k % 9 > 0) for k in range(300)]
    want = {}
    for i, s, h, w in nodes:
        near = [r for r in rules if r[8] and r[1] == s and abs(h - r[3]) <= 6 and abs(w / h - r[4]) <= 0.35]
        if near:
            r = min(near, key=lambda r: (-r[5], -r[6], not r[7], r[0]))
            want[i] = (r[0], r[2], r[5])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = matcher.rule_lookup(spark.createDataFrame(nodes, "id long, signature int, h int, w int"), spark.createDataFrame(rules, "rule long, signature int, answer string, height double, aspect double, confidence double, support int, local boolean, active boolean"))
        got = {r["id"]: (r["rule"], r["answer"], r["confidence"]) for r in df.collect()}
        assert got == want and len(want) > 100
        assert joined_rows(df) <= len(nodes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
