"""Structural similarity and edges against array code on random rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import raster


def table(spark, a, b):
    h, w = a.shape
    rows = [(1, x, y, *[int(a[y, x])] * 3, *[int(b[y, x])] * 3) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "case_id int, x int, y int, ar int, ag int, ab int, br int, bg int, bb int").repartition(4)


def test_similarity_equals_windows(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (13, 11))
    b = np.clip(a + rng.integers(-30, 30, a.shape), 0, 255)
    want = {}
    for y in range(3, 10):
        for x in range(3, 8):
            p, q = (v[y - 3 : y + 4, x - 3 : x + 4].astype(float).ravel() for v in (a, b))
            cov = np.cov(p, q)
            want[x, y] = (2 * p.mean() * q.mean() + 6.5025) * (2 * cov[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (cov[0, 0] + cov[1, 1] + 58.5225))
    df = table(spark, a, b)
    got = {(r["x"], r["y"]): r["ssim"] for r in raster.ssim_map(df).collect()}
    assert got == pytest.approx(want)
    r = raster.ssim(df).first()
    assert r["windows"] == len(want) and r["ssim"] == pytest.approx(np.mean(list(want.values())))
    small = raster.ssim(df.where("x < 5")).first()
    assert (small["windows"], small["ssim"]) == (0, 1.0)


def array_edges(v, low, high):
    p = np.pad(v.astype(int), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    m = np.pad(np.abs(gx) + np.abs(gy), 1)
    weak = set()
    for y, x in np.ndindex(*v.shape):
        c, ax, ay = m[y + 1, x + 1], abs(gx[y, x]), abs(gy[y, x]) * 32768
        if ay < ax * 13573:
            keep = c > m[y + 1, x] and c >= m[y + 1, x + 2]
        elif ay > ax * 13573 + ax * 65536:
            keep = c > m[y, x + 1] and c >= m[y + 2, x + 1]
        else:
            s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
            keep = c > m[y, x + 1 - s] and c > m[y + 2, x + 1 + s]
        if keep and c > low:
            weak.add((x, y))
    todo = [p for p in weak if m[p[1] + 1, p[0] + 1] > high]
    found = set(todo)
    while todo:
        x, y = todo.pop()
        for n in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
            if n in weak and n not in found:
                found.add(n)
                todo.append(n)
    return found


def test_edges_equal_array_code(spark):
    rng = np.random.default_rng(2)
    a = np.zeros((24, 30), int)
    a[4:15, 5:20] = 120
    a[8:22, 12:27] = 70
    a = np.clip(a + rng.integers(0, 14, a.shape), 0, 255)
    df = table(spark, a, a)
    got = {(r["x"], r["y"]) for r in raster.edges(df, raster.gray("a")).collect()}
    assert got == array_edges(a, 40, 120) and len(got) > 40
    assert raster.edges(df.where("false"), raster.gray("a")).count() == 0
    flat = raster.edges(df.withColumns({c: F.lit(9) for c in ("ar", "ag", "ab")}), raster.gray("a"))
    assert flat.count() == 0


def test_ridge_sees_diagonal_neighbours_of_ragged_rows(spark):
    # (1, 1) has no neighbour on its left; the one above that place outdoes it along the gradient
    g = spark.createDataFrame([(1, 0, 0, 60, 60), (1, 1, 0, 10, 10), (1, 1, 1, 25, 25)], "case_id int, x int, y int, gx int, gy int")
    assert [(r["x"], r["y"]) for r in raster.thin_ridges(g, 30).collect()] == [(0, 0)]


def test_marks_of_pixels_are_not_broadcast(spark, monkeypatch):
    plans, real = [], raster.written
    monkeypatch.setattr(raster, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    pixels = spark.createDataFrame([(1, x, y, *[(x * 20 + c) % 256 for c in range(6)]) for x in range(12) for y in range(12)], "case_id long, x int, y int, ar int, ag int, ab int, br int, bg int, bb int")
    boxes = spark.createDataFrame([(1, 1, 2, 2, 6, 6, "text"), (1, 2, 4, 4, 5, 5, "icon")], "case_id long, node long, x int, y int, w int, h int, kind string")
    assert raster.region_features(pixels, boxes.drop("kind"), boxes.drop("node")).count() == 2
    marked = next(p for p in plans if "et#" in p)
    assert marked.count("Join LeftOuter") >= 4 and marked.count("rightHint=(strategy=merge)") >= 4


def test_edges_go_on_across_tiles(spark):
    rng = np.random.default_rng(5)
    a = np.zeros((37, 45), int)
    a[6:30, 5:40] = 90
    a[12:22, 14:33] = 30
    b = np.clip(a + rng.integers(0, 40, a.shape), 0, 255)
    a = np.clip(a + rng.integers(0, 14, a.shape), 0, 255)
    df = table(spark, a, b)
    for low, high in ((40, 120), (20, 340)):
        want = {(s, x, y) for s, v in (("t", a), ("r", b)) for x, y in array_edges(v, low, high)}
        for tile in (8, 128):
            got = [(r["side"], r["x"], r["y"]) for r in raster.side_edges(df, {"t": raster.gray("a"), "r": raster.gray("b")}, low, high, tile).collect()]
            assert set(got) == want and len(got) == len(want) > 100


def test_edges_deal_their_pixels_once(spark, monkeypatch):
    plans, real = [], raster.written
    monkeypatch.setattr(raster, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    a = np.zeros((9, 9), int)
    a[3:6, 2:7] = 200
    found = raster.edges(table(spark, a, a), raster.gray("a"))
    assert {(r["x"], r["y"]) for r in found.collect()} == array_edges(a, 40, 120)
    assert "Window" not in plans[0] and plans[0].count("Exchange hashpartitioning") == 1
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_repeated_pixels_and_of_none(spark):
    """Of pixels of one place the largest counts beside them, each gives its own row; without a case only strong ones stay."""
    rows = [(1, x, y, 200 if x > 2 else 0) for x in range(6) for y in range(4)] + [(1, 2, 1, 90), (1, 3, 1, 200)] + [(None, x, y, 200 if x > 2 else 8 * y) for x in range(6) for y in range(4)]
    got = raster.edges(spark.createDataFrame(rows, "case_id long, x int, y int, v int"), F.col("v"), 40, 700)
    window = raster.thin_ridges(raster.gradients(spark.createDataFrame(rows, "case_id long, x int, y int, v int"), F.col("v")), 40)
    key = lambda df: sorted((r["case_id"] or 0, r["x"], r["y"]) for r in df.collect())
    assert key(got) == key(window.where("case_id IS NOT NULL OR m > 700"))
    assert {c for c, _, _ in key(got)} == {0, 1} and len(key(got)) > len(set(key(got)))


def test_shifts_of_boxes_across_tiles(spark):
    rng = np.random.default_rng(7)
    h, w = 12, 140
    a, b = rng.integers(0, 256, (h, w)), rng.integers(0, 256, (h, w))
    b[1:9, 118:136] = a[2:10, 120:138]  # this part lies two to the left and one up
    boxes = [(1, 1, 121, 4, 14, 5), (1, 2, 3, 2, 5, 4), (1, 3, -2, 0, 9, 4), (1, 4, 40, 3, 6, 6), (1, 4, 40, 3, 6, 6), (1, 5, 139, 0, 9, 9)]
    df = table(spark, a, b)
    items = spark.createDataFrame(boxes, "case_id int, node int, x int, y int, w int, h int")
    features = raster.region_features(df, items, items.limit(0).withColumn("kind", F.lit("text")))
    # a pixel is not listed under every shift
    assert "[-3,-2,-1,0,1,2,3]" not in features._jdf.queryExecution().optimizedPlan().toString()
    found = {r["node"]: r["shift_gain"] for r in features.collect()}

    def lightness(v):
        u = v / 255
        u = np.where(u <= 0.04045, u / 12.92, ((u + 0.055) / 1.055) ** 2.4)
        return np.where(u > 216 / 24389, np.cbrt(u), (u * (24389 / 27) + 16) / 116) * 116 - 16

    p, q = lightness(a), lightness(b)
    for _, node, x, y, bw, bh in boxes[:5]:
        x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + bw, w), min(y + bh, h)
        gap = lambda dx, dy: np.abs(p[y0:y1, x0:x1] - q[y0 + dy : y1 + dy, x0 + dx : x1 + dx]).sum()  # noqa: B023, E731
        best = min(gap(dx, dy) for dx in range(-3, 4) for dy in range(-3, 4) if x0 + dx >= 0 and y0 + dy >= 0 and x1 + dx <= w and y1 + dy <= h)
        assert found[node] == pytest.approx(max(0, 1 - best / gap(0, 0)), abs=1e-3)
    assert found[1] > 0.99 and set(found) == {1, 2, 3, 4}
