"""Optimal one-to-one matching against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import spatial


def brute(pairs, most):
    """(number, total) of the best matching of {(l, r): score}: by total score, or by number first."""
    lefts = sorted({a for a, _ in pairs})
    best = {frozenset(): (0, 0)}
    for a in lefts:
        new = dict(best)
        for used, (n, total) in best.items():
            for (x, r), s in pairs.items():
                if x == a and r not in used:
                    key, got = used | {r}, (n + 1, total + s)
                    if key not in new or rank(got, most) > rank(new[key], most):
                        new[key] = got
        best = new
    return max(best.values(), key=lambda v: rank(v, most))


def rank(v, most):
    return v if most else v[1]


def test_assignment_equals_permutations():
    rnd = random.Random(1)
    for _ in range(400):
        n, m = rnd.randrange(1, 7), rnd.randrange(1, 7)
        edges = {(i, j): rnd.randrange(-5, 30) for i, j in itertools.product(range(n), range(m)) if rnd.random() < 0.6}
        got = spatial.assignment(n, [(i, j, w) for (i, j), w in edges.items()])
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert sum(edges[p] for p in got) == brute(edges, False)[1]


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_assign_is_optimal_on_contested_cases(spark, limit):
    rnd, rows = random.Random(2), {}
    for case in range(60):
        for a, b in itertools.product(range(rnd.randrange(1, 6)), range(rnd.randrange(1, 6))):
            if rnd.random() < 0.55:
                rows[case, a, b] = rnd.randrange(-200, 1000) / 1000
    rows |= {(99, 1, 1): 0.60, (99, 1, 2): 0.59, (99, 2, 1): 0.59, (98, 5, 5): 0.4, (97, 5, 5): -0.4}
    df = spark.createDataFrame([(c, a, b, s, "x") for (c, a, b), s in rows.items()], "case_id int, l_node int, r_node int, s double, _group string").drop("_group").repartition(5)
    for most in (False, True):
        got = spatial.assign(df, ["case_id", "l_node"], ["case_id", "r_node"], "s", most=most, limit=limit).collect()
        for case in {c for c, _, _ in rows}:
            own = {(r["l_node"], r["r_node"]): r for r in got if r["case_id"] == case}
            pairs = {(a, b): round(s * 1000) for (c, a, b), s in rows.items() if c == case}
            assert len({a for a, _ in own}) == len({b for _, b in own}) == len(own)
            number, total = brute(pairs, most)
            assert sum(pairs[p] for p in own) == total and (not most or len(own) == number), case
            for (a, b), r in own.items():
                assert r["contested"] == (sum(a == x for x, _ in pairs) > 1 or sum(b == y for _, y in pairs) > 1)
    assert spatial.assign(df.where("false"), ["case_id", "l_node"], ["case_id", "r_node"], "s").count() == 0


def test_two_good_pairs_beat_the_single_best(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.60), (1, 1, 2, 0.59), (1, 2, 1, 0.59)], "case_id int, l_node int, r_node int, iou double")
    got = spatial.assign(df, ["case_id", "l_node"], ["case_id", "r_node"], "iou").collect()
    assert sorted((r["l_node"], r["r_node"]) for r in got) == [(1, 2), (2, 1)]
    assert len(spatial.match_one_to_one(df, ["case_id", "l_node"], ["case_id", "r_node"], "iou").collect()) == 1


def test_ties_go_to_the_tie_column_and_chains_of_any_length_are_solved(spark):
    square = [(1, a, b, 0.5, 10 * (a == b)) for a in range(3) for b in range(3)]
    chain = [(2, a, b, 0.5 if a == b else 0.51, 0) for a in range(400) for b in (a, a + 1)]
    df = spark.createDataFrame(square + chain, "case_id int, l_node int, r_node int, s double, t int")
    got = spatial.assign(df, ["case_id", "l_node"], ["case_id", "r_node"], "s", tie="t").collect()
    assert {(r["l_node"], r["r_node"]) for r in got if r["case_id"] == 1} == {(0, 0), (1, 1), (2, 2)}
    assert {(r["l_node"], r["r_node"]) for r in got if r["case_id"] == 2} == {(a, a + 1) for a in range(400)}


def test_glyphs_match_by_their_ink_box(spark):
    box = "case_id int, node int, x int, y int, w int, h int, type int"
    pred = spark.createDataFrame([(1, 1, 10, 10, 10, 10, 0), (1, 2, 100, 100, 10, 10, 0)], box)
    truth = spark.createDataFrame([(1, 1, 0, 0, 30, 30, 0, 10, 10, 10, 11), (1, 2, 100, 100, 10, 11, 0, None, None, None, None)], box + ", ix int, iy int, iw int, ih int")
    got = {(r["l_node"], r["r_node"]): round(r["iou"], 6) for r in spatial.match_nodes(pred, truth).collect()}
    assert got == {(1, 1): round(10 / 11, 6), (2, 2): round(10 / 11, 6)}
    assert spatial.match_nodes(pred, truth.drop("ix", "iy", "iw", "ih")).select(F.count("*")).first()[0] == 1
