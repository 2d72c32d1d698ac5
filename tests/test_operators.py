"""Hand-made cases and brute-force twins for operators that SQL cannot express."""

import itertools

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from canopy.functions import color, geometry, text
from canopy.operators import learning, quality, spatial, stats
from tests.conftest import SF

BOX = "case_id int, node int, x int, y int, w int, h int, type int"


def iou(a, b):
    w = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    h = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    both = a[4] * a[5] + b[4] * b[5] - w * h
    return w * h / both if both else 0.0


def test_spatial_join_meets_every_pair_once_and_handles_large_boxes(spark):
    boxes = [(1, k, (k * 37) % 300, (k * 53) % 300, 10 + (k * 29) % 90, 10 + (k * 17) % 70, k % 3) for k in range(60)]
    boxes += [(1, 60, 0, 0, 5000, 4000, 0), (1, 61, 10, 10, 0, 0, 0), (2, 0, 0, 0, 10, 10, 0), (1, 62, -70, -70, 100, 100, 1)]
    df = spark.createDataFrame(boxes, BOX)
    want = [(a[1], b[1], a[0]) for a, b in itertools.product(boxes, boxes) if a[0] == b[0] and iou(a, b) > 0]
    for crowded in (256, 8):
        got = [(r["l_node"], r["r_node"], r["case_id"]) for r in spatial.spatial_join(df, df, crowded=crowded).collect()]
        assert sorted(got) == sorted(want)


def test_matching_is_one_to_one_and_locally_dominant(spark):
    boxes = [(1, k, 4 * k, 0, 20, 20, 0) for k in range(8)]
    m = spatial.match_nodes(spark.createDataFrame(boxes, BOX), spark.createDataFrame([(c, n, x + 1, y, w, h, t) for c, n, x, y, w, h, t in boxes], BOX)).collect()
    assert len({r["l_node"] for r in m}) == len({r["r_node"] for r in m}) == len(m) == 8
    empty = spark.createDataFrame([], BOX)
    assert spatial.match_nodes(empty, spark.createDataFrame(boxes, BOX)).count() == 0


def greedy(pairs):
    used_l, used_r, out = set(), set(), set()
    for score, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in used_l and b not in used_r:
            used_l.add(a)
            used_r.add(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_matching_of_a_chain_and_of_random_pairs(spark, limit):
    chain = [(1, a, b, 1.0 - 0.001 * (a + b)) for a in range(300) for b in (a, a + 1)]
    other = [(2, k % 17, (k * 7) % 13, ((k * 31) % 50) / 50) for k in range(17 * 13)]
    df = spark.createDataFrame(chain + other, "case_id int, l_node int, r_node int, s double")
    got = spatial.match_one_to_one(df, ["case_id", "l_node"], ["case_id", "r_node"], "s", limit=limit).collect()
    for case, rows in ((1, chain), (2, other)):
        assert {(r["l_node"], r["r_node"]) for r in got if r["case_id"] == case} == greedy([(s, a, b) for _, a, b, s in rows])


def test_suppression_of_a_chain(spark):
    rows = [(1, k, 8 * k, 0, 20, 20, 1000 - k) for k in range(300)]
    df = spark.createDataFrame(rows, "case_id int, fid int, x int, y int, w int, h int, confidence int")
    for limit in (1_000_000, 10):
        got = {r["fid"] for r in spatial.suppress(df, ["fid"], ["confidence"], 0.4, limit).collect()}
        assert got == set(range(0, 300, 2))


def test_suppression_equals_greedy_scan(spark):
    rows = [(1, k, (k * 31) % 90, (k * 17) % 60, 30, 20, (k * 7) % 10) for k in range(40)]
    df = spark.createDataFrame(rows, "case_id int, fid int, x int, y int, w int, h int, confidence int")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(iou(r, k) < 0.5 for k in kept):
            kept.append(r)
    got = {r["fid"] for r in spatial.suppress(df, ["fid"], ["confidence"], 0.5).collect()}
    assert got == {r[1] for r in kept}


def test_colours(spark):
    one = spark.createDataFrame([("#6750A4",), ("#fff",), ("#11223380",), ("red",), (None,)], "c string").select(color.parse_hex(F.col("c")).alias("p")).collect()
    assert [tuple(r["p"])[:3] if r["p"] else None for r in one] == [(103, 80, 164), (255, 255, 255), (17, 34, 51), None, None]
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    # published CIEDE2000 test pairs
    pairs = [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((50, -1, 2), (50, 0, 0), 2.3669)]
    got = spark.range(1).select(*[color.delta2000(lit(*a), lit(*b)).alias(f"d{i}") for i, (a, b, _) in enumerate(pairs)]).first()
    assert [round(v, 4) for v in got] == [d for *_, d in pairs]


def test_text(spark):
    rows = [("kitten", "sitting", 3 / 7), ("Hello  world", "Hello world", 0.0), ("x", "", 1.0), ("", None, 0.0), (None, "ab", 1.0), ("abcdef", "x", 1.0)]
    got = spark.createDataFrame([r[:2] for r in rows], "p string, g string").select(text.cer(F.col("p"), F.col("g")).alias("c")).collect()
    assert [r["c"] for r in got] == pytest.approx([r[2] for r in rows])
    r = spark.createDataFrame([("Ab1 é-Z", "12px", "1.5rem", "auto", "СOPE", "да")], "a string, b string, c string, d string, e string, f string")
    r = r.select(text.redact(F.col("a")), text.parse_px(F.col("b")), text.parse_px(F.col("c")), text.parse_px(F.col("d")), text.fold_look_alikes(F.col("e")), text.fold_look_alikes(F.col("f"))).first()
    assert tuple(r) == ("Xx0 x-X", 12.0, 24.0, None, "COPE", "да")


def test_goodness_edges(spark):
    df = spark.createDataFrame([(0.3, True, None), (0.25, False, None), (0.25, False, 0.5), (None, True, None), (float("inf"), True, None), (float("nan"), False, None)], "v double, hi boolean, norm double")
    got = [r[0] for r in df.select(quality.goodness(F.col("v"), F.col("hi"), F.col("norm"))).collect()]
    assert got == [0.3, 0.75, 0.5, None, 0.0, 0.0]


def test_batch_gains_are_shared(spark):
    df = spark.createDataFrame([("a", 0.2, True, 2, 0.1), ("a", 0.2, True, 2, 0.1), ("a", 0.2, False, 1, None)], "kind string, gain double, accepted boolean, batch int, promised double")
    r = learning.move_summary(df).first()
    assert (r["tried"], r["accepted"], r["gain"], r["gain_share"]) == (3, 2, pytest.approx(0.2), 1.0)


def test_components_on_a_long_path_and_star(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 230)] + [(5, 5)], "a long, b long")
    assert {tuple(r) for r in stats.components(e).collect()} == {tuple(r) for r in stats.components(e, few=4).collect()}
    got = {r["v"]: r["component"] for r in stats.components(e).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(200, 230)} == {7} and got[5] == 5


def test_entry_and_soft_range(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() == 6
    r = spark.createDataFrame([(5.0,), (12.0,), (30.0,)], "v double").select(geometry.soft_range(F.col("v"), F.lit(0.0), F.lit(10.0), F.lit(4.0))).collect()
    assert [x[0] for x in r] == [1.0, 0.5, 0.0]
    assert __spark_entry__.queries()["j23_suppress"](spark, SF).count() > 0
