"""Readers on hand-made files."""

import json

from pyspark.sql import functions as F

from canopy.sources import readers

TREE = {"width": 320, "height": 200, "meta": {"a": 1}, "design_system": "ds", "root": {"id": "r", "type": "frame", "box": {"x": 0, "y": 0, "w": 320, "h": 200}, "children": [
    {"id": "a", "type": "frame", "box": {"x": 1, "y": 2, "w": 3, "h": 4}, "children": [{"id": "b", "type": "text", "text": "hi", "box": {"x": 1, "y": 2, "w": 3, "h": 4}, "opacity": 0.5}]},
    {"id": "c", "type": "icon", "box": {"x": 5, "y": 6, "w": 7, "h": 8}, "visible": False, "component": {"name": "Button"}},
]}}


def preorder(node, parent=None, depth=0):
    yield node["id"], parent, depth
    for c in node.get("children", []):
        yield from preorder(c, node["id"], depth + 1)


def test_trees_and_flattening(spark, tmp_path):
    (tmp_path / "one.gt.json").write_text(json.dumps(TREE, indent=2))
    (tmp_path / "bare.json").write_text('{"width": 3}')
    (tmp_path / "broken.json").write_text("{not json")
    docs = readers.read_trees(spark, str(tmp_path))
    assert {(r["doc_id"], r["width"], r["dpr"]) for r in docs.collect()} == {("one", 320, 1.0), ("bare", 3, 1.0)}
    n = readers.flatten_trees(docs).orderBy("preorder").collect()
    assert [(r["node_id"], r["parent_id"], r["depth"]) for r in n] == list(preorder(TREE["root"]))
    assert [r["preorder"] for r in n] == [0, 1, 2, 3]
    assert (n[2]["text"], n[2]["opacity"], n[3]["visible"], n[3]["component"], n[3]["x"]) == ("hi", 0.5, False, "Button", 5.0)
    assert readers.flatten_trees(docs.where("false")).count() == 0


def flat(o, prefix=""):
    return {k: v for key, x in o.items() for k, v in (flat(x, f"{prefix}{key}.") if isinstance(x, dict) else {f"{prefix}{key}": x}).items()}


def test_flatten_json(spark):
    o = {"a": 1, "b": {"c": {"d": 2.5, "e": None}, "f": [1, 2]}, "g": {}}
    df = spark.createDataFrame([(1, json.dumps(o)), (2, "{}")], "k int, t string").select("k", F.expr("parse_json(t)").alias("v"))
    got = {(r["k"], r["name"]): r["value"] for r in readers.flatten_json(df, ["k"], "v").collect()}
    assert set(got) == {(1, k) for k in flat(o)} and got[1, "b.c.d"] == "2.5" and got[1, "b.f"] == "[1,2]"


def test_ledger_and_codepoints(spark, tmp_path):
    one, two, c = tmp_path / "a.jsonl", tmp_path / "b.jsonl", tmp_path / "c.txt"
    entry = lambda i, ts, v: json.dumps({"id": i, "ts": ts, "kind": "param", "accepted": True, "v": v})
    one.write_text("\n".join([entry("p-1", "2024-02", 1), "{broken", "", "[1]", entry("p-2", "2024-01", 2), entry("p-1", "2023", 9)]))
    two.write_text("\n".join([entry("p-2", "2020", 7), entry("p-3", "2024-03", 3)]))
    got = [(r["id"], r["ts"]) for r in readers.read_ledger(spark, [str(one), str(two)]).collect()]
    assert got == [("p-2", "2024-01"), ("p-1", "2024-02"), ("p-3", "2024-03")]
    c.write_text("home e88a\n\nbad line here\nmenu  5d2\n")
    assert {tuple(r) for r in readers.read_codepoints(spark, str(c)).collect()} == {("home", 0xE88A), ("menu", 0x5D2)}


def test_design_tokens(spark):
    doc = {"$type": "color", "a": {"$value": "#123456"}, "b": {"c": {"$value": "{a}"}, "d": {"$value": "{b/c}"}}, "e": {"$value": "{nothing}"}, "s": {"$type": "dimension", "x": {"$value": "1.5rem"}, "y": {"$value": "wide"}}}
    plain = {"u": {"$value": "12px"}, "w": {"$value": "#fff"}, "v": {"$value": "Roboto"}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(plain))], "doc_id int, t string").select("doc_id", F.expr("parse_json(t)").alias("doc"))
    got = {(r["doc_id"], r["name"]): (r["category"], r["value"]) for r in readers.design_tokens(df).collect()}
    assert got == {(1, "a"): ("color", "#123456"), (1, "b.c"): ("color", "#123456"), (1, "b.d"): ("color", "#123456"), (1, "s.x"): ("dimension", "24.0"), (2, "u"): ("dimension", "12.0"), (2, "w"): ("color", "#fff"), (2, "v"): ("other", "Roboto")}


def test_corpus_scan_names_everything(spark, tmp_path):
    for c, name in (("k", "1.png"), ("k", "1.gt.json"), ("k", "2.gt.json"), ("k", "3.png"), ("k", "9.gt.json"), ("m", "5.png"), ("m", "5.gt.json"), ("m", "6.gt.json")):
        (tmp_path / c).mkdir(exist_ok=True)
        (tmp_path / c / name).write_text("x")
    files = readers.list_files(spark, str(tmp_path))
    manifest = spark.createDataFrame([("k", "1", 0), ("k", "2", 1), ("k", "3", 2), ("k", "4", 3)], "corpus string, id string, position int")
    got = {(r["corpus"], r["id"]): r["reason"] for r in readers.scan_corpus(manifest, files).collect()}
    assert got == {("k", "1"): None, ("k", "2"): "missing 2.png", ("k", "3"): "missing 3.gt.json", ("k", "4"): "missing 4.gt.json, 4.png", ("k", "9"): "not listed in the manifest", ("m", "5"): None, ("m", "6"): "missing 6.png"}


def test_catalog_merges_signatures(spark, tmp_path):
    c = {"name": "ds", "tokens": [{"name": "t", "category": "color", "value": "#fff"}], "components": [{"name": "Button", "signature": {"height": [40, 48], "radius": 20}, "variants": [{"name": "plain", "signature": {"radius": 4}}, {"name": "round"}], "slots": [{"name": "label", "kind": "text", "multiple": False}]}]}
    (tmp_path / "ds.json").write_text(json.dumps(c, indent=1))
    tokens, variants, slots = readers.read_catalog(spark, str(tmp_path))
    assert tokens.count() == 1 and slots.first()["name"] == "label"
    assert {(r["variant"], r["radius"], tuple(r["height"])) for r in variants.collect()} == {("plain", 4.0, (40.0, 48.0)), ("round", 20.0, (40.0, 48.0))}
