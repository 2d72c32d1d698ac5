"""Design files: a file is parsed once, whatever its nodes hold and however deep it is."""

import json

import pytest

from canopy.plans import source_queries
from canopy.sources import design_files


def _files(spark, path, *docs):
    spark.createDataFrame([(json.dumps(d) if isinstance(d, dict) else d,) for d in docs], "value string").coalesce(1).write.text(str(path))
    return design_files.read_design_files(spark, str(path))


def _deep(n, **more):
    node = {"id": f"n{n - 1}", "type": "FRAME"}
    for k in range(n - 2, -1, -1):
        node = {"id": f"n{k}", "type": "FRAME", "children": [{"id": f"t{k}", "type": "TEXT", "characters": "a"}, node]}
    return {"name": "deep", "document": node} | more


def test_files_are_parsed_once(spark, tmp_path, monkeypatch):
    plans, real = [], design_files.written
    monkeypatch.setattr(design_files, "written", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a))
    files = _files(spark, tmp_path / "f", _deep(3), "no json")
    assert design_files.walk(files).count() == 5
    design_files.variable_tokens(files)
    design_files.component_sets(design_files.walk(files))
    # each expression that read a field of a file parsed it anew
    assert all(p.count("parseJson") <= 1 for p in plans) and sum(p.count("parseJson") for p in plans) == 3
    assert "Join" not in plans[0] + plans[1]


def test_levels_beyond_one_pass(spark, tmp_path):
    files = _files(spark, tmp_path / "f", _deep(15))
    walked = design_files.walk(files)
    paths = {(r["id"], r["parent_id"]): tuple(r["path"]) for r in walked.selectExpr("try_variant_get(node, '$.id', 'string') AS id", "parent_id", "path").collect()}
    assert paths == {(f"n{k}", f"n{k - 1}" if k else None): (0, *[1] * k) for k in range(15)} | {(f"t{k}", f"n{k}"): (0, *[1] * k, 0) for k in range(14)}
    assert [r["node_id"] for r in design_files.design_nodes(walked).orderBy("preorder").collect()] == [x for k in range(14) for x in (f"n{k}", f"t{k}")] + ["n14"]
    assert design_files.walk(files, 16).count() == 29
    with pytest.raises(ValueError, match="deeper than 15"):
        design_files.walk(files, 15)


def test_odd_nodes(spark, tmp_path):
    paint = {"type": "SOLID", "color": {"r": 1, "g": 0, "b": 0}}
    kids = [{"id": 5, "type": "VECTOR", "name": "Icon/Star", "children": [{"id": "x"}, {"id": "y", "fills": [paint]}]}, None, 7, {"id": "h", "visible": False, "children": [{"id": "u"}]}]
    files = _files(spark, tmp_path / "f", {"name": "a", "document": {"id": "r", "absoluteBoundingBox": {"x": 3, "y": "4"}, "children": kids}}, {"name": "b", "document": {"id": "r", "children": {"q": {"id": "c"}}}}, {"name": "c"}, {"document": {"id": "r"}})
    walked = design_files.walk(files)
    assert {(r["doc_id"], tuple(r["path"]), r["shown"]) for r in walked.collect()} == {
        ("a", (0,), True), ("a", (0, 0), True), ("a", (0, 0, 0), False), ("a", (0, 0, 1), False), ("a", (0, 1), True), ("a", (0, 2), True), ("a", (0, 3), False), ("a", (0, 3, 0), False), ("b", (0,), True), ("b", (0, 0), True), (None, (0,), True),
    }
    rows = {(r["doc_id"], r["preorder"]): r for r in design_files.design_nodes(walked).collect()}
    star = rows["a", 1]
    assert (star["node_id"], star["type"], star["glyph"], star["fill"], star["x"], star["y"]) == ("5", "icon", "star", "#ff0000", -3.0, -4.0)
    assert rows["b", 1]["parent_id"] == "r" and (None, 0) in rows and len(rows) == 7


def test_variables_by_file(spark, tmp_path):
    alias = lambda to: {"type": "VARIABLE_ALIAS", "id": to}
    var = lambda name, kind, values, c="c": {"name": name, "resolvedType": kind, "variableCollectionId": c, "valuesByMode": values}
    variables = {
        "a": var("Row Gap", "FLOAT", {"x": 1, "y": 8}), "b": var("Ink", "COLOR", {"x": alias("d"), "y": alias("c")}), "c": var("Red", "COLOR", {"y": {"r": 1, "g": 0.5, "b": 0}}), "d": var("Loop", "FLOAT", {"y": alias("e")}), "e": var("Loop", "FLOAT", {"y": alias("d")}),
        "f": var("No mode", "FLOAT", {"x": 3, "y": 4}, "gone"), "g": var("List", "FLOAT", [6, 7], "gone"), "h": var("Other", "STRING", {"z": "w"}), "i": var("Lost", "FLOAT", {"y": alias("gone")}),
    }
    files = _files(spark, tmp_path / "f", {"name": "a", "variables": variables, "variableCollections": {"c": {"defaultModeId": "y"}}}, {"name": "b"}, {"variables": variables})
    got = {(r["doc_id"], r["variable_id"]): (r["name"], r["category"], r["value"]) for r in design_files.variable_tokens(files).collect()}
    assert got == {("a", "a"): ("var.row-gap", "spacing", "8.0"), ("a", "b"): ("var.ink", "color", "#ff8000"), ("a", "c"): ("var.red", "color", "#ff8000"), ("a", "f"): ("var.no-mode", "dimension", "3.0"), ("a", "g"): ("var.list", "dimension", "6.0")}


def test_trees_are_written_where_their_case_was_dealt(spark):
    rows = [(c, n, json.dumps({"id": n})) for c, last in ((1, 1), (2, 13), (3, 6)) for n in range(1, last + 1)]
    trees = source_queries.nested(spark.createDataFrame(rows, "case_id int, node int, own string").repartition(5))
    tree = lambda n, last: {"id": n} | ({"children": [tree(k, last) for k in (2 * n, 2 * n + 1) if k <= last]} if 2 * n <= last else {})
    assert {r["case_id"]: json.loads(r["tree"]) for r in trees.collect()} == {1: tree(1, 1), 2: tree(1, 13), 3: tree(1, 6)}
    plan = trees._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
