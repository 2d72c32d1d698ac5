"""Matching shuffles each side once; closures read their nodes once."""

import pytest

from canopy.operators import benchmark, core, differ, fusion, matcher, pixels, spatial
from canopy.plans import design_queries
from canopy.plans.views import view
from canopy.sources import design_files
from tests.conftest import SF

BOX = "case_id int, node int, x int, y int, w int, h int, type int"


def test_matching_by_type_stays_dealt_by_case(spark, monkeypatch):
    plans = []
    for name in ("written", "checkpoint"):
        real = getattr(spatial, name, None)
        monkeypatch.setattr(spatial, name, lambda df, real=real: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df), raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(c, n, 50 * n, 0, 40, 40, n % 2) for c in range(20) for n in range(3)]
        a, b = spark.createDataFrame(rows, BOX), spark.createDataFrame(rows[1:], BOX)
        assert spatial.match_nodes(a, b).count() == 59
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    marked = next(p for p in plans if "Window" in p)
    assert marked.count("Exchange hashpartitioning") == 2


def test_contested_pairs_are_settled_where_the_join_has_dealt_them(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    rows = [(c, n, 50 * (n // 2) + n, 0, 40, 40, 0) for c in range(20) for n in range(4)]
    a, b = spark.createDataFrame(rows, BOX), spark.createDataFrame(rows[1:], BOX)
    found = spatial.match_nodes(a, b)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 79 and found.where("contested").count() == 79
    # longer methods than HotSpot compiles were interpreted
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_findings_meet_once_and_are_clustered_where_they_met(spark):
    finding = "case_id int, fid int, detector int, type int, x int, y int, w int, h int, confidence int"
    rows = [(c, 3 * k + d, d, 0, 60 * k + 5 * d, 0, 40, 40, d) for c in (1, 2) for k in range(4) for d in range(3)] + [(1, 90, 0, 0, 0, 0, 0, 40, 9), (1, 91, 0, 0, 4, 0, 40, 40, 9)]
    got = fusion.clusters(spark.createDataFrame(rows, finding), [0, 1, 2])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Join LeftAnti" not in plan
    assert {(r["case_id"], r["fid"], r["cluster"], r["role"]) for r in got.collect()} == {(c, 3 * k + d, 91 if (c, k) == (1, 0) else 3 * k, "fragment" if (c, k, d) == (1, 0, 0) else "vote") for c in (1, 2) for k in range(4) for d in range(3)} | {(1, 90, 90, "vote"), (1, 91, 91, "vote")}


def test_moves_take_only_their_findings(spark):
    pairs = spatial.match_nodes(view(spark, SF, "nodes_pred"), view(spark, SF, "nodes_gt"))
    every, some = (differ.pair_findings(pairs, *t) for t in ((), (differ.MOVED,)))
    assert "color" not in some._jdf.queryExecution().optimizedPlan().toString()
    assert some.count() == every.where(differ.F.col("type").isin(*differ.MOVED)).count() > 0


def test_tint_deals_its_pairs_once(spark):
    pairs = spatial.match_nodes(view(spark, SF, "nodes_pred"), view(spark, SF, "nodes_gt"))
    plan = differ.global_tint(pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_scores_count_true_nodes_by_case(spark, monkeypatch):
    pred, gt = (view(spark, SF, n) for n in ("nodes_pred", "nodes_gt"))
    roi = gt.selectExpr("case_id", "0 AS node", "0 AS x", "0 AS y", "200 AS w", "150 AS h").distinct()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan(benchmark.scoped_measures(pred, gt, roi))
    assert "node#" not in plan(benchmark.structural_metrics(pred, gt)).split("Join LeftOuter")[1].split("\n")[0]


def test_equality_as_bounds(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, None)], "a int, b int").withColumn("s", spatial.same(spatial.F.col("a"), spatial.F.col("b")))
    assert [r["s"] for r in df.collect()] == [True, False, None, None]


def test_closure_reads_its_nodes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(1, n, n // 2 if n > 1 else None) for n in range(1, 16)]
    nodes = spark.createDataFrame(rows, "case_id int, node int, parent int").mapInArrow(count, "case_id int, node int, parent int")
    got = {(r["node"], r["ancestor"], r["distance"]) for r in differ.closure(nodes).collect()}
    assert got == {(n, n >> d, d) for n in range(2, 16) for d in range(1, 4) if n >> d}
    assert seen.value == 15


def test_design_files_are_packed_and_levels_kept_parsed(spark, monkeypatch):
    tables, real = [], design_files.written
    monkeypatch.setattr(design_files, "written", lambda df, *a: tables.append(df.schema["node"].dataType.typeName()) or real(df, *a))
    files = design_queries._files(spark, SF)
    assert all(f.endswith(".gz") for f in files.inputFiles())
    n = design_files.design_nodes(design_files.walk(files))
    assert set(tables) == {"variant"}
    # only what is read of a node meets its children's fills
    plan = n._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_get" not in plan[: plan.index("Join LeftOuter")] and n.count() > 0


def test_large_inputs_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    """Sums of boxes and posteriors: tasks by the number of rows, not by compressed bytes."""
    monkeypatch.setattr(core, "TASK_ROWS", 50, raising=False)
    plan = lambda df: df._jdf.queryExecution().toString()
    pixel = spark.range(400).selectExpr("id % 4 AS case_id", "id div 40 AS y", "id % 40 AS x", "1.0D AS de")
    boxes = spark.createDataFrame([(0, 1, None, 0, 0, 40, 10), (0, 2, 1, 0, 0, 8, 2)], "case_id long, node long, parent long, x long, y long, w long, h long")
    errors = pixels.node_errors(pixel, boxes)
    assert "RepartitionByExpression [case_id#" in plan(errors) and sorted((r["node"], r["error"]) for r in errors.collect()) == [(1, 1.0), (2, 1.0)]
    samples = spark.range(300).selectExpr("id div 3 AS cluster", "IF(id % 2 = 0, 'a', 'none') AS label", "id % 3 AS detector", "IF(id % 5 = 0, 'a', NULL) AS type", "id / 300 AS confidence")
    model = fusion.fit_fusion(samples, spark.createDataFrame([("a", "x"), ("none", None)], "label string, parent string"))
    post = fusion.posterior(samples, model)
    assert "RepartitionByExpression [cluster#" in plan(post) and post.count() == 200


def test_pairs_of_nodes_and_signatures_are_not_shuffled(spark):
    nodes = spark.range(40).selectExpr("id", "0 AS type", "20 AS w", "20 AS h", "4 AS radius", "10 AS r", "20 AS g", "30 AS b", "0 AS stroke", "1 AS texts").repartition(3)
    signs = spark.range(6).selectExpr("concat('c', id % 3) AS component", "concat('v', id) AS variant", "0 AS type", "16D AS low", "24D AS high", "'any' AS rule", "10 AS sr", "20 AS sg", "30 AS sb", "false AS stroked", "1 AS least", "1 AS most")
    found = matcher.match_catalog(nodes, signs, 2)
    assert {(r["component"], r["variant"], r["score"], r["rank"]) for r in found.collect()} == {("c0", "v0", 1.0, 1), ("c1", "v1", 1.0, 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


def test_closure_deals_its_cases_once(spark, monkeypatch):
    plans, real = [], differ.written if hasattr(differ, "written") else core.written
    monkeypatch.setattr(differ, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df), raising=False)
    rows = [(1, n, n - 1 if n else None) for n in range(6)] + [(2, 0, None), (2, 1, 0), (2, 1, 7), (2, 7, 0), (2, 7, 0), (None, 1, 0), (None, 0, 5), (3, 4, 9)]
    got = sorted((r["case_id"] or 0, r["node"], r["ancestor"], r["distance"]) for r in differ.closure(spark.createDataFrame(rows, "case_id long, node int, parent int").repartition(3)).collect())
    # rows of one node each go up, and nodes without a case hang together
    assert got == sorted([(1, n, k, n - k) for n in range(6) for k in range(n)] + [(2, 1, 0, 1), (2, 1, 7, 1), (2, 1, 0, 2), (2, 1, 0, 2), (2, 7, 0, 1), (2, 7, 0, 1), (0, 1, 0, 1), (0, 1, 5, 2), (0, 0, 5, 1), (3, 4, 9, 1)])
    assert len(plans) == 1 and "Join" not in plans[0] and plans[0].count("Exchange hashpartitioning") == 1


def test_closure_refuses_cycles(spark):
    rows = [(1, 1, 2), (1, 2, 1)]
    with pytest.raises(Exception, match="tree deeper than 64"):
        differ.closure(spark.createDataFrame(rows, "case_id int, node int, parent int")).collect()


def test_opacity_groups_match_only_what_they_read(spark, monkeypatch):
    sides, real = [], spatial.match_nodes
    monkeypatch.setattr(spatial, "match_nodes", lambda a, b, *more: sides.extend([set(a.columns), set(b.columns)]) or real(a, b, *more))
    assert __import__("__spark_entry__").queries()["d03_opacity_groups"](spark, SF).count() > 0
    assert all(s <= {"case_id", "node", "parent", "x", "y", "w", "h", "type", "r", "g", "b"} for s in sides) and len(sides) == 2


def test_differences_put_their_nodes_together_once(spark, monkeypatch):
    plans, real = [], core.written
    keep = lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a)
    for name in ("written", "checkpoint"):
        monkeypatch.setattr(differ, name, keep, raising=False)
        monkeypatch.setattr(spatial, name, keep, raising=False)
    found = differ.tree_diff(view(spark, SF, "nodes_gt"), view(spark, SF, "nodes_pred"))
    last = found._jdf.queryExecution().optimizedPlan().toString()
    # the pairs' two sides, their crowded cases, and one table of each side
    assert found.count() > 0 and sum(p.count("l_extendedprice") > 0 for p in [*plans, last]) <= 4
