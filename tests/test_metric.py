"""Nearest neighbours by pivots against all pairs."""

import numpy as np
import pytest

from canopy.operators import metric, stats


def items(spark, x, labels=None):
    return spark.createDataFrame([(k, [float(v) for v in row], int(labels[k]) if labels is not None else k % 3) for k, row in enumerate(x)], "id long, x array<double>, label int").repartition(4)


def brute(x, queries, k):
    out = set()
    for q in queries:
        d2 = np.round(((x - x[q]) ** 2).sum(1), 9)
        order = sorted((v, i) for i, v in enumerate(d2.tolist()) if i != q)[:k]
        out |= {(q, rank, i, v) for rank, (v, i) in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_neighbours_equal_all_pairs(spark, small, monkeypatch):
    if small:  # cells and crowds of several blocks
        monkeypatch.setattr(metric, "BLOCK", 7)
        monkeypatch.setattr(metric, "ASKED", 5)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 4)) * 8
    x = np.round(centres[rng.integers(0, 6, 400)] + rng.standard_normal((400, 4)), 1)
    x[50:60] = x[49]
    df = items(spark, x)
    got = metric.k_nearest(df.where("id % 3 = 0"), df, 5).collect()
    assert {(r["query_id"], r["rank"], r["id"], r["d2"]) for r in got} == brute(x, range(0, 400, 3), 5)
    assert all(r["label"] == r["id"] % 3 for r in got)
    few = metric.k_nearest(df, df.where("id < 4"), 5).collect()
    assert len(few) == 4 * 3 + 396 * 4
    assert metric.k_nearest(df, df.where("false"), 5).count() == 0 and metric.k_nearest(df.where("false"), df, 5).count() == 0


def test_broken_vectors_take_no_part(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, None, 1), (3, [float("nan"), 0.0], 1), (4, [None, 1.0], 1), (5, [], 1), (6, [3.0, 4.0], None)], "id long, x array<double>, label int")
    assert [tuple(r) for r in metric.k_nearest(df, df, 2).orderBy("query_id").collect()] == [(1, 1, 6, None, 25.0), (6, 1, 1, 1, 25.0)]


def test_far_cells_are_not_compared(spark):
    rng = np.random.default_rng(6)
    n = 6000
    centres = rng.standard_normal((60, 8)) * 30
    x = centres[rng.integers(0, 60, n)] + rng.standard_normal((n, 8))
    df = items(spark, x)
    compared = spark.sparkContext.accumulator(0)
    got = metric.k_nearest(df.where("id % 10 = 0"), df, 5, compared).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(q, i) for q, _, i, _ in brute(x, range(0, n, 10), 5)}
    print(f"compared {compared.value} of {n * n // 10} pairs")
    assert compared.value < 0.1 * n * n / 10


def test_queries_go_to_blocks_and_copies_stay_few(spark, monkeypatch):
    """A query is sent once for all near cells of a block; of many equal items the smallest ids are the nearest."""
    rng = np.random.default_rng(8)
    n = 3000
    x = np.round(rng.standard_normal((n, 24)), 3)
    x[500:1500] = x[500]
    sent = []
    monkeypatch.setattr(metric, "written", lambda df, f=metric.written: sent.append(f(df)) or sent[-1])
    monkeypatch.setattr(metric, "WAITING", 2000, raising=False)
    df = items(spark, x)
    got = metric.k_nearest(df, df, 3).collect()
    assert {(r["query_id"], r["rank"], r["id"], r["d2"]) for r in got} == brute(x, range(n), 3)
    assert sum(t.count() for t in sent if "bound" in t.columns) <= 3 * n


def test_conformal_counts_reference_scores_as_large(spark):
    rng = np.random.default_rng(7)
    ref, own = rng.integers(0, 50, 300) / 10, rng.integers(0, 60, 80) / 10
    one = lambda v: spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "id long, score double").repartition(3)
    got = {r["id"]: r["p"] for r in stats.conformal(one(own), one(ref).select("score")).collect()}
    assert got == pytest.approx({k: (1 + (ref >= v).sum()) / 301 for k, v in enumerate(own)})
