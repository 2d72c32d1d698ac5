"""A level's assignment is input of its parents; joins with tables beyond what is broadcast."""

from pyspark.sql import functions as F

from canopy.operators import core, mapping

NODE = "case_id long, node long, parent long, kind string, type int, x int, y int, w int, h int, radius int, r int, g int, b int, stroke int, shadow int, text string, signature int"
SIGN = "component string, variant string, type int, low double, high double, rule string, sr int, sg int, sb int, stroked boolean, least int, most int, needs string"
RULE = "rule long, signature int, answer string, height int, aspect double, confidence double, support int, local boolean, active boolean"


def test_levels_feed_their_parents(spark):
    grey, none = (100, 100, 100), (None, None, None)
    node = lambda k, up, kind, type_, w, h, fill, text=None: (1, k, up, kind, type_, 10 * k, 0, w, h, 0, *fill, 0, 0, text, 0)
    nodes = spark.createDataFrame([
        node(1, None, "frame", 0, 400, 400, grey), node(2, 1, "frame", 1, 100, 60, grey), node(3, 2, "frame", 9, 90, 50, none),
        node(4, 3, "frame", 2, 40, 20, grey), node(5, 4, "text", 3, 20, 10, none, "OK"), node(6, 3, "text", 3, 20, 10, none, "Side"), node(7, 1, "frame", 1, 100, 60, grey),
    ], NODE)
    signatures = spark.createDataFrame([
        ("Button", "plain", 2, 20.0, 20.0, "any", *grey, False, 1, 1, None), ("Card", "full", 1, 60.0, 60.0, "any", *grey, False, 1, 1, "Button"), ("Panel", "bare", 1, 60.0, 60.0, "any", *grey, False, 0, 0, None),
    ], SIGN)
    slots = spark.createDataFrame([(c, p, s, k, m) for c in ("Button", "Card", "Panel") for p, s, k, m in ((1, "label", "text", False), (2, "parts", "instance", True))], "component string, position int, slot string, kind string, multiple boolean")
    got = {r["node"]: r for r in mapping.map_documents(nodes, signatures, slots, spark.createDataFrame([], RULE)).collect()}
    assert set(got) == set(range(1, 8))
    # the wrapper 3 is seen through: the card's content is the button and the text beside it
    assert got[4]["component"] == "Button" and got[4]["props"] == {"label": "OK"}
    assert got[2]["component"] == "Card" and got[2]["props"] == {"label": "Side", "parts": "Button"}
    assert got[7]["component"] == "Panel" and got[3]["component"] is None and got[1]["component"] is None
    rules = spark.createDataFrame([(1, 0, "none", 20, 2.0, 1.0, 3, True, True)], RULE)
    held = {r["node"]: r for r in mapping.map_documents(nodes, signatures, slots, rules).collect()}
    # a vetoed rule leaves the button; the same rule on a closer race would reject it
    assert held[4]["effect"] in ("veto", "reject")
    assert mapping.map_documents(nodes.where("false"), signatures, slots, rules).count() == 0


def test_tables_beyond_the_broadcast_bound_meet_in_blocks(spark):
    rows, table = spark.range(30).withColumnRenamed("id", "a"), spark.range(23).withColumnRenamed("id", "b")
    for limit in (5, 100):
        got = core.against(rows, table, limit)
        assert {tuple(r) for r in got.collect()} == {(a, b) for a in range(30) for b in range(23)} and got.count() == 690
    assert core.against(rows, table.where("false"), 5).count() == 0
    assert core.against(rows, table, 5).where(F.col("b") == 3).count() == 30
