"""Change verdicts with planted counts, sweeps, and gates before rebaselining."""

import pytest

from canopy.operators import verdict

COUNTS = "change int, split string, family int, cut int, tp long, n_pred long, n_gt long, noise_cases long, false_cases long"


def counts(rows):
    return [(c, s, f, cut, tp, p, g, 10, false) for c, s, f, cut, tp, p, g, false in rows]


def test_a_change_is_accepted_or_refused_for_its_reasons(spark):
    good = [(1, s, f, cut, tp, 10, 10, 2) for s in ("calibration", "fresh") for f in (1, 2) for cut, tp in ((0, 5), (1, 8))]
    # change 2 gains on the whole but its second family loses once it is left out
    split = [(2, "calibration", f, cut, tp, 10, 10, 2) for f, cut, tp in ((1, 0, 2), (1, 1, 9), (2, 0, 6), (2, 1, 3))] + [(2, "fresh", 1, cut, 5, 10, 10, 2) for cut in (0, 1)]
    noisy = [(3, s, f, cut, tp, 10, 10, 2 + 3 * cut) for s in ("calibration", "fresh") for f in (1, 2) for cut, tp in ((0, 5), (1, 8))]
    df = spark.createDataFrame(counts(good + split + noisy), COUNTS).repartition(3)
    changes = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, 1, 0)], "change int, params int, cut int")
    violations = spark.createDataFrame([(1, 40, 42), (3, 40, 43)], "change int, before long, after long")
    got = {r["change"]: r for r in verdict.change_verdicts(df, changes, violations).collect()}
    assert got[1]["accepted"] and got[1]["gain"] == pytest.approx(0.3) and got[1]["required"] == pytest.approx(0.006) and got[1]["new_cut"] == 1
    assert got[2]["reasons"] == ["family"] and got[2]["worst_family"] == 2 and got[2]["worst"] == pytest.approx(-0.3)
    assert got[3]["reasons"] == ["noise", "violations"] and not got[3]["accepted"]
    dear = {r["change"]: r for r in verdict.change_verdicts(df, changes, violations, min_gain=0.2).collect()}
    assert dear[1]["reasons"] == ["gain"]


def test_sweep_keeps_the_best_on_train_only_if_holdout_agrees(spark):
    rows = [(0, "train", 0.5), (0, "holdout", 0.5), (1, "train", 0.9), (1, "holdout", 0.4), (2, "train", 0.8), (2, "holdout", 0.9)]
    df = lambda r: spark.createDataFrame(r, "candidate int, split string, score double")
    assert not any(r["kept"] for r in verdict.sweep(df(rows), 0).collect())
    assert [r["candidate"] for r in verdict.sweep(df(rows[:2] + rows[4:]), 0).collect() if r["kept"]] == [2]
    assert not any(r["kept"] for r in verdict.sweep(df([(0, "train", 0.5), (1, "train", 0.5)]), 0).collect())
    assert [r["candidate"] for r in verdict.sweep(df([(0, "train", 0.5), (1, "train", 0.6)]), 0).collect() if r["kept"]] == [1]


def test_the_baseline_is_written_only_behind_the_gate(spark, tmp_path):
    path = str(tmp_path / "baseline")
    run = lambda v: spark.createDataFrame([(k, "m", v, v) for k in range(4)], "case_id int, metric string, goodness double, composite double")
    held = lambda: spark.read.parquet(path).first()["composite"]
    assert verdict.gate_then_rebaseline(run(0.8), path).count() == 0 and held() == 0.8
    assert verdict.gate_then_rebaseline(run(0.5), path).count() > 0 and held() == 0.8
    assert verdict.gate_then_rebaseline(run(0.9), path).count() == 0 and held() == 0.9
    assert verdict.gate_then_rebaseline(run(0.6), path, assert_gate=False).count() > 0 and held() == 0.6
