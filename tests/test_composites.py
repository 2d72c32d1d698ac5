"""Brute-force twins of operators that SQL cannot express."""

import random

from pyspark.sql import functions as F

from canopy.functions import color as C
from canopy.operators import differ, fusion, nesting

NODE = "case_id int, node int, parent int, x int, y int, w int, h int, type int, r int, g int, b int, stroke int, radius int, opacity int, shadow int, text string, size int, weight int, glyph string, component string, variant string, gap int"


def node(k, parent=1, x=0, y=0, w=60, h=40, type_=1, rgb=(200, 30, 30), text="", glyph="g", **more):
    base = {"stroke": 0, "radius": 0, "opacity": 100, "shadow": 0, "text": text, "size": 12, "weight": 400, "glyph": glyph, "component": None, "variant": "v", "gap": 0} | more
    return (1, k, parent, x, y, w, h, type_, *rgb, *(base[c] for c in ("stroke", "radius", "opacity", "shadow", "text", "size", "weight", "glyph", "component", "variant", "gap")))


def test_tree_diff_of_planted_changes(spark):
    root = node(1, None, 0, 0, 2000, 2000, rgb=(255, 255, 255))
    tree = [root, node(2, x=100, y=100), node(3, 2, x=110, y=110, w=20, h=20, type_=3), node(4, x=300, y=100, type_=2, text="hello there"), node(5, x=500, y=100, w=100), node(6, x=800, y=100), node(7, 6, x=805, y=105, w=20, h=20), node(8, x=100, y=400, rgb=(40, 40, 200)), node(9, x=300, y=400, radius=10)]
    seen = [root, node(2, x=106, y=100), node(3, 2, x=116, y=110, w=20, h=20, type_=3), node(4, x=300, y=100, type_=2, text="hello where"), node(5, x=500, y=100, w=58), node(55, x=562, y=100, w=38), node(8, x=100, y=400, rgb=(148, 148, 228)), node(9, x=300, y=400, radius=2), node(10, x=900, y=900)]
    got = differ.tree_diff(spark.createDataFrame(tree, NODE), spark.createDataFrame(seen, NODE)).collect()
    found = {(r["type"], r["node"], r["actual"]) for r in got}
    # the child moved along, the inner missing node goes with its parent, the half-faded node is one opacity finding
    assert found == {("geometry.shift", 2, 2), ("text.content", 4, 4), ("structure.split", 5, 5), ("structure.missing", 6, None), ("effect.opacity", 8, 8), ("geometry.radius", 9, 9), ("structure.extra", None, 10)}
    same = spark.createDataFrame(tree, NODE)
    assert differ.tree_diff(same, same).count() == 0


def iou(a, b):
    w, h = min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]), min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5])
    i = max(0, w) * max(0, h)
    return i / (a[6] * a[7] + b[6] * b[7] - i)


def test_clusters_hold_one_vote_of_each_detector(spark):
    rnd = random.Random(5)
    rows = [(c, k, k % 3, rnd.randrange(2), rnd.randrange(0, 120, 10), rnd.randrange(0, 60, 10), 30, 20, rnd.randrange(100)) for c in (1, 2) for k in range(45)]
    df = spark.createDataFrame(rows, "case_id int, fid int, detector int, type int, x int, y int, w int, h int, confidence int")
    got = {(r["case_id"], r["fid"]): (r["cluster"], r["role"]) for r in fusion.clusters(df, [0, 1, 2]).collect()}
    by = {(r[0], r[1]): (r[0], r[1], r[2], r[3], *r[4:8]) for r in rows}
    assert set(got) == set(by)
    votes = {}
    for k, (cluster, role) in got.items():
        if role == "vote":
            assert (k[0], cluster, by[k][2]) not in votes
            votes[k[0], cluster, by[k][2]] = k
    for k, (cluster, role) in got.items():
        mates = [v for (case, c, _), v in votes.items() if (case, c) == (k[0], cluster) and v != k]
        if role == "fragment":  # beside a vote of its own detector and type
            assert any(by[v][2:4] == by[k][2:4] and iou(by[k], by[v]) >= 0.3 for v in mates)
        elif cluster != k[1]:
            assert any(iou(by[k], by[v]) >= 0.3 for v in mates)
    opened = [k for k, (c, role) in got.items() if role == "vote" and c == k[1]]
    for a in opened:  # two of one detector and type that open clusters do not overlap
        for b in opened:
            assert a == b or a[0] != b[0] or by[a][2:4] != by[b][2:4] or iou(by[a], by[b]) < 0.3


def test_palette_equals_greedy_scan(spark):
    rnd = random.Random(2)
    rows = [(c, k, rnd.randrange(40, 70), rnd.randrange(40, 70), rnd.randrange(40, 70)) for c in (1, 2) for k in range(60)]
    df = spark.createDataFrame(rows, "case_id int, node int, r int, g int, b int")
    lab = {tuple(x): tuple(v) for *x, v in df.select("r", "g", "b", F.array(*C.lab(F.col("r"), F.col("g"), F.col("b")))).collect()}
    want = set()
    for case in (1, 2):
        kept = []
        for _, _, *c in sorted(x for x in rows if x[0] == case):
            if all(sum((p - q) ** 2 for p, q in zip(lab[tuple(c)], lab[k], strict=True)) > 25 for k in kept):
                kept.append(tuple(c))
        want |= {(case, *k) for k in kept}
    assert {(r["case_id"], r["r"], r["g"], r["b"]) for r in nesting.palette(df, 5.0).collect()} == want
