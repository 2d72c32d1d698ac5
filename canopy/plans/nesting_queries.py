"""Registered queries of nesting, rows, paragraphs, paint order and rewrites of trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import differ, nesting
from canopy.plans.differ_queries import _UP
from canopy.plans.views import view
from canopy.registry import _lab, query, read

_UPD = "up(case_id, node, ancestor, distance) AS (SELECT case_id, node, parent, 1 FROM nodes_gt WHERE parent IS NOT NULL UNION ALL SELECT up.case_id, up.node, n.parent, distance + 1 FROM up JOIN nodes_gt n ON up.case_id = n.case_id AND up.ancestor = n.node WHERE n.parent IS NOT NULL)"
_OV = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


@query("t08_containment", f"""WITH j AS (SELECT a.case_id, a.node, b.node AS parent, row_number() OVER (PARTITION BY a.case_id, a.node ORDER BY b.w * b.h, -b.node) AS k FROM regions a JOIN regions b ON a.case_id = b.case_id AND b.type NOT IN (2, 3) AND (b.w * b.h > a.w * a.h OR (b.w * b.h = a.w * a.h AND b.node < a.node)) AND {_OV} > 0 AND {_OV} >= a.w * a.h * CASE WHEN a.type = 2 THEN 0.6 ELSE 0.9 END)
  SELECT r.case_id, r.node, coalesce(j.parent, -1) AS parent FROM regions r LEFT JOIN j ON r.case_id = j.case_id AND r.node = j.node AND k = 1""")
def t08(spark, d):
    b = view(spark, d, "regions").drop("parent", "text")
    return nesting.contained(b).withColumn("parent", F.coalesce("parent", F.lit(-1)))


@query("t10_frame_layout", """WITH k AS (SELECT n.*, f.y AS fy, f.x AS fx, lead(n.y) OVER w - n.y - n.h AS gp, row_number() OVER w - 1 AS place, coalesce(sum(n.h) OVER (PARTITION BY n.case_id, n.parent ORDER BY n.y, n.x, n.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nodes_gt n JOIN nodes_gt f ON n.case_id = f.case_id AND n.parent = f.node WINDOW w AS (PARTITION BY n.case_id, n.parent ORDER BY n.y, n.x, n.node)),
  g AS (SELECT case_id, parent, count(*) AS n, median(gp) AS gap, min(gp) AS least_gap, min(y) AS f, max(x) - min(x) AS s FROM k GROUP BY 1, 2), d AS (SELECT k.case_id, k.parent, max(abs(y - f - before - place * coalesce(g.gap, 0))) AS drift FROM k JOIN g ON k.case_id = g.case_id AND k.parent = g.parent GROUP BY 1, 2)
  SELECT g.case_id, g.parent, n, CASE WHEN n > 1 AND least_gap >= -1 AND drift <= 1.5 THEN 'column' ELSE 'none' END AS direction FROM g JOIN d ON g.case_id = d.case_id AND g.parent = d.parent""")
def t10f(spark, d):
    # the rows of the view lie below each other, so no frame is a row
    f = nesting.frame_layout(view(spark, d, "nodes_gt"))
    return f.select("case_id", "parent", "n", F.when(F.col("direction") == "column", "column").otherwise("none").alias("direction"))


@query("t12_column_cut", """WITH s AS (SELECT *, max(x + w) OVER (PARTITION BY case_id ORDER BY x, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rgt FROM boxes_gt), c AS (SELECT case_id, arg_max(rgt, (x - rgt) * 100000 - x) AS cut FROM s WHERE x - rgt >= 16 GROUP BY 1)
  SELECT b.case_id, node, CASE WHEN x < cut THEN 0 ELSE 1 END AS side, cut FROM boxes_gt b JOIN c ON b.case_id = c.case_id""")
def t12(spark, d):
    return nesting.column_cut(view(spark, d, "boxes_gt"))


@query("t13_icon_labels", """SELECT case_id, node AS icon, node + 500 AS label FROM nodes_gt WHERE type = 3 AND length(text) <= 8""")
def t13(spark, d):
    icons = view(spark, d, "nodes_gt").where("type = 3")
    labels = icons.withColumns({"node": F.col("node") + 500, "y": F.col("y") + F.col("h") + 1, "h": F.lit(6)})
    return nesting.icon_labels(icons, labels, 4, 8)


@query("t14_glyph_clusters", """WITH RECURSIVE p AS (SELECT case_id, node, x, y, least(w, 9) AS w, h FROM regions), e AS (SELECT a.case_id, a.node AS a, b.node AS b FROM p a JOIN p b ON a.case_id = b.case_id AND greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) < 1 AND greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) < 1),
  reach(case_id, a, b) AS (SELECT case_id, a, b FROM e UNION SELECT r.case_id, r.a, e.b FROM reach r JOIN e ON r.case_id = e.case_id AND r.b = e.a), c AS (SELECT case_id, a AS node, min(b) AS c FROM reach GROUP BY 1, 2)
  SELECT p.case_id, min(p.node) AS cluster, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, max(x + w) - min(x) <= 9 AND max(y + h) - min(y) <= 9 AS merged FROM p JOIN c ON p.case_id = c.case_id AND p.node = c.node GROUP BY p.case_id, c""")
def t14(spark, d):
    p = view(spark, d, "regions").select("case_id", "node", "x", "y", F.least("w", F.lit(9)).alias("w"), "h")
    return nesting.glyph_clusters(p, 1, 9)


@query("t15_paragraphs", """WITH l AS (SELECT *, round((x % 40) / 20.0) AS lft, lag(y + h) OVER w AS above, y - lag(y) OVER w AS step FROM nodes_gt WINDOW w AS (PARTITION BY case_id, size, weight, round((x % 40) / 20.0) ORDER BY y, node)), f AS (SELECT *, CASE WHEN y - above <= h * 2.5 THEN 0 ELSE 1 END AS fresh FROM l), r AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id, size, weight, lft ORDER BY y, node) AS run FROM f)
  SELECT case_id, size, weight, min(node) AS paragraph, count(*) AS n, string_agg(text, chr(10) ORDER BY y, node) AS text, coalesce(median(step) FILTER (fresh = 0), -1) AS line_height, min(y) AS y, max(y + h) - min(y) AS h FROM r GROUP BY case_id, size, weight, lft, run""")
def t15(spark, d):
    lines = view(spark, d, "nodes_gt").withColumn("x", F.col("x") % 40)
    return nesting.paragraphs(lines, 2.5, 20.0).withColumn("line_height", F.coalesce("line_height", F.lit(-1.0)))


@query("t18_list_runs", """WITH i AS (SELECT case_id, node, y, h, lag(y + h) OVER (PARTITION BY case_id ORDER BY y, node) AS above FROM (SELECT case_id, node, (node - 1) * 48 AS y, 40 + node % 9 AS h FROM boxes_gt)), f AS (SELECT *, CASE WHEN y - above >= 0 AND y - above <= 5 AND NOT (node % 4 = 0) THEN 0 ELSE 1 END AS fresh FROM i), r AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY y, node) AS run FROM f)
  SELECT case_id, min(node) AS list, count(*) AS n, min(y) AS y, max(y + h) - min(y) AS h FROM r GROUP BY case_id, run HAVING count(*) >= 2""")
def t18(spark, d):
    i = view(spark, d, "boxes_gt").select("case_id", "node", F.lit(10).alias("x"), ((F.col("node") - 1) * 48).alias("y"), F.lit(100).alias("w"), (F.col("node") % 9 + 40).alias("h"))
    # a divider above every item, a thick blocker above every fourth
    above = i.withColumn("y", F.col("y") - 2)
    blockers = above.where("node % 4 <> 0").withColumn("h", F.lit(2)).unionByName(above.where("node % 4 = 0").withColumn("h", F.lit(3)))
    return nesting.list_runs(i, blockers.withColumn("node", F.col("node") + 100), 3.0, least=2)


_COVER = f"""cv AS (SELECT a.case_id, a.node, b.node AS cover, b.opacity AS alpha FROM nd a JOIN nd b ON a.case_id = b.case_id AND (b.layer > a.layer OR (b.layer = a.layer AND b.node > a.node)) AND a.x >= b.x - 0.5 AND a.y >= b.y - 0.5 AND a.x + a.w <= b.x + b.w + 0.5 AND a.y + a.h <= b.y + b.h + 0.5 AND NOT EXISTS (SELECT 1 FROM up WHERE up.case_id = a.case_id AND up.node = b.node AND up.ancestor = a.node)),
  oc AS (SELECT case_id, node, bool_or(alpha >= 100) AS occluded, max(CASE WHEN alpha < 100 THEN alpha END) AS veil FROM cv GROUP BY 1, 2)"""
_LAYERED = "nd AS (SELECT case_id, node, parent, x, node * 3 AS y, w, h, r, g, b, opacity, radius % 3 AS layer FROM nodes_gt)"


def _layered(spark, d):
    return view(spark, d, "nodes_gt").select("case_id", "node", "parent", "x", (F.col("node") * 3).alias("y"), "w", "h", "r", "g", "b", "opacity", (F.col("radius") % 3).alias("layer"))


@query("t19_occluded", f"WITH RECURSIVE {_UP}, {_LAYERED}, {_COVER} SELECT nd.case_id, nd.node, coalesce(occluded, false) AS occluded, coalesce(veil, -1) AS veil FROM nd LEFT JOIN oc ON nd.case_id = oc.case_id AND nd.node = oc.node")
def t19o(spark, d):
    n = _layered(spark, d)
    return nesting.occlusion(n, differ.closure(n)).withColumn("veil", F.coalesce("veil", F.lit(-1)))


@query("t24_discounted", f"WITH RECURSIVE {_UP}, {_LAYERED}, {_COVER} SELECT nd.case_id, nd.node, CASE WHEN veil IS NOT NULL OR opacity < 99 THEN -1 ELSE r END AS r FROM nd LEFT JOIN oc ON nd.case_id = oc.case_id AND nd.node = oc.node WHERE NOT coalesce(occluded, false)")
def t24(spark, d):
    n = _layered(spark, d)
    return nesting.discounted(n, nesting.occlusion(n, differ.closure(n))).select("case_id", "node", F.coalesce("r", F.lit(-1)).alias("r"))


@query("t20_paint_order", f"WITH RECURSIVE {_UP}, {_LAYERED}, l AS (SELECT case_id, node, layer FROM nd UNION ALL SELECT up.case_id, up.ancestor, nd.layer FROM up JOIN nd ON up.case_id = nd.case_id AND up.node = nd.node), m AS (SELECT case_id, node, min(layer) AS low FROM l GROUP BY 1, 2) SELECT nd.case_id, nd.node, row_number() OVER (PARTITION BY nd.case_id, parent ORDER BY low, nd.node)::INTEGER AS rank FROM nd JOIN m ON nd.case_id = m.case_id AND nd.node = m.node")
def t20(spark, d):
    n = _layered(spark, d)
    return nesting.paint_order(n, differ.closure(n))


@query("t21_adopted", f"""WITH RECURSIVE {_UPD}, r AS (SELECT case_id, node, CASE WHEN node = 1 THEN 0 ELSE x END AS x, CASE WHEN node = 1 THEN 0 ELSE y END AS y, CASE WHEN node = 1 THEN 700 WHEN node % 5 = 2 THEN 0 WHEN node % 3 = 0 THEN 600 ELSE w END AS w, CASE WHEN node <= 3 THEN 700 ELSE h END AS h FROM nodes_gt), l AS (SELECT * FROM r WHERE w > 0 AND x < 500),
  k AS (SELECT up.case_id, up.node, up.ancestor, row_number() OVER (PARTITION BY up.case_id, up.node ORDER BY distance) AS k FROM up JOIN l a ON up.case_id = a.case_id AND up.node = a.node JOIN l b ON up.case_id = b.case_id AND up.ancestor = b.node WHERE a.x >= b.x - 0.5 AND a.y >= b.y - 0.5 AND a.x + a.w <= b.x + b.w + 0.5 AND a.y + a.h <= b.y + b.h + 0.5)
  SELECT l.case_id, l.node, coalesce(k.ancestor, -1) AS parent FROM l LEFT JOIN k ON l.case_id = k.case_id AND l.node = k.node AND k = 1""")
def t21(spark, d):
    n = view(spark, d, "nodes_gt")
    k = F.col("node")
    r = n.select("case_id", "node", F.when(k == 1, 0).otherwise(F.col("x")).alias("x"), F.when(k == 1, 0).otherwise(F.col("y")).alias("y"), F.when(k == 1, 700).when(k % 5 == 2, 0).when(k % 3 == 0, 600).otherwise(F.col("w")).alias("w"), F.when(k <= 3, 700).otherwise(F.col("h")).alias("h"))
    return nesting.adopted(r, differ.closure(n), 500, 100000).withColumn("parent", F.coalesce("parent", F.lit(-1)))


@query("t22_collapsed", f"WITH RECURSIVE {_UPD}, a AS (SELECT up.case_id, up.node, max(distance) AS m FROM up JOIN nodes_gt n ON up.case_id = n.case_id AND up.ancestor = n.node AND n.component IS NOT NULL GROUP BY 1, 2) SELECT n.case_id, n.node, coalesce(up.ancestor, -1) AS instance FROM nodes_gt n LEFT JOIN a ON n.case_id = a.case_id AND n.node = a.node LEFT JOIN up ON up.case_id = a.case_id AND up.node = a.node AND up.distance = a.m")
def t22(spark, d):
    n = view(spark, d, "nodes_gt")
    outer, inner = nesting.collapsed(n, differ.closure(n))
    return outer.select("case_id", "node", F.lit(-1).alias("instance")).unionByName(inner.select("case_id", "node", "instance"))


@query("t23_content_atoms", f"WITH RECURSIVE {_UPD}, k AS (SELECT up.case_id, up.node, up.ancestor, row_number() OVER (PARTITION BY up.case_id, up.node ORDER BY distance) AS k FROM up JOIN nodes_gt a ON up.case_id = a.case_id AND up.ancestor = a.node AND a.type <> 0) SELECT n.case_id, k.ancestor AS node, string_agg(n.node::VARCHAR, ',' ORDER BY y, x, n.node) AS atoms FROM nodes_gt n JOIN k ON n.case_id = k.case_id AND n.node = k.node AND k = 1 WHERE n.type <> 0 GROUP BY 1, 2")
def t23(spark, d):
    n = view(spark, d, "nodes_gt")
    return nesting.content_atoms(n, differ.closure(n)).select("case_id", "node", F.array_join("atoms.atom", ",").alias("atoms"))


@query("t25_renumbered", "WITH n AS (SELECT case_id, node, row_number() OVER (PARTITION BY case_id ORDER BY node) - 1 AS new FROM nodes_pred), f AS (SELECT case_id, node AS fid, [node, node + 1, node + 2] AS ids FROM nodes_gt), e AS (SELECT case_id, fid, unnest(ids) AS node, generate_subscripts(ids, 1) AS place FROM f) SELECT e.case_id, fid, coalesce(string_agg(new::VARCHAR, ',' ORDER BY place) FILTER (new IS NOT NULL), '') AS nodes FROM e LEFT JOIN n ON e.case_id = n.case_id AND e.node = n.node GROUP BY 1, 2")
def t25(spark, d):
    f = view(spark, d, "nodes_gt").select("case_id", F.col("node").alias("fid"), F.array("node", F.col("node") + 1, F.col("node") + 2).alias("nodes"))
    return nesting.renumbered(view(spark, d, "nodes_pred"), f)[1].withColumn("nodes", F.array_join("nodes", ","))


@query("t28_host_components", "SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'Button' ELSE 'Chip' END AS component, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS disabled, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'filled' END AS style FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')")
def t28(spark, d):
    p = read(spark, d, "part")
    attributes = F.map_filter(F.create_map(F.lit("disabled"), F.when(F.col("p_size") % 2 == 0, ""), F.lit("style"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))), lambda _, v: v.isNotNull())
    lookup = spark.createDataFrame([("ECONOMY", "Button"), ("STANDARD", "Chip")], "tag string, component string")
    c = nesting.host_components(p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("tag"), attributes.alias("attributes")), lookup, {"disabled": "false", "style": "filled"})
    return c.select("id", "component", F.col("variant")["disabled"].alias("disabled"), F.col("variant")["style"].alias("style"))


@query("t29_lifted_paint", "WITH n AS (SELECT case_id, node, parent, r, g, b, node % 2 = 0 AS painted FROM nodes_gt), k AS (SELECT case_id, parent AS node, min(node) AS kid FROM n WHERE painted AND parent IS NOT NULL GROUP BY 1, 2) SELECT n.case_id, n.node, CASE WHEN n.painted THEN n.r ELSE coalesce(c.r, -1) END AS r, CASE WHEN n.painted THEN -1 ELSE coalesce(k.kid, -1) END AS source FROM n LEFT JOIN k ON n.case_id = k.case_id AND n.node = k.node AND NOT n.painted LEFT JOIN n c ON c.case_id = k.case_id AND c.node = k.kid")
def t29(spark, d):
    n = view(spark, d, "nodes_gt").withColumns({"painted": F.col("node") % 2 == 0, "x": F.lit(0), "y": F.lit(0), "w": F.lit(10), "h": F.lit(10)})
    return nesting.lifted_paint(n).select("case_id", "node", F.coalesce("r", F.lit(-1)).alias("r"), F.coalesce("source", F.lit(-1)).alias("source"))


@query("t30_palette")
def t30(spark, d):
    return nesting.palette(view(spark, d, "nodes_gt"), 20.0)


@query("t31_refitted", f"""WITH RECURSIVE {_UP}, b AS (SELECT up.case_id, ancestor AS node, min(x) AS bx, min(y) AS by_, max(x + w) AS bx2, max(y + h) AS by2 FROM up JOIN nodes_gt n ON up.case_id = n.case_id AND up.node = n.node GROUP BY 1, 2),
  j AS (SELECT n.case_id, n.node, CASE WHEN type = 0 AND bx IS NOT NULL THEN least(x, bx) ELSE x END AS x1, CASE WHEN type = 0 AND bx IS NOT NULL THEN least(y, by_) ELSE y END AS y1, CASE WHEN type = 0 AND bx IS NOT NULL THEN greatest(x + w, bx2) ELSE x + w END AS x2, CASE WHEN type = 0 AND bx IS NOT NULL THEN greatest(y + h, by2) ELSE y + h END AS y2 FROM nodes_gt n LEFT JOIN b ON n.case_id = b.case_id AND n.node = b.node),
  c AS (SELECT case_id, node, greatest(0, x1) AS x, greatest(0, y1) AS y, least(300, x2) - greatest(0, x1) AS w, least(200, y2) - greatest(0, y1) AS h FROM j) SELECT * FROM c WHERE w > 0 AND h > 0""")
def t31r(spark, d):
    n = view(spark, d, "nodes_gt").withColumn("inferred", F.col("type") == 0)
    return nesting.refitted(n, differ.closure(n), 300, 200)


@query("t32_unit_kinds", "SELECT case_id, node, CASE WHEN type = 2 AND w <= 28 AND h <= 28 AND length(text) <= 8 THEN 'glyph' WHEN type = 2 THEN 'text' WHEN w < 20 AND h < 20 THEN 'speck' WHEN w <= 28 AND h <= 28 THEN 'glyph' WHEN w <= 64 AND h <= 56 THEN 'control' ELSE 'painted' END AS kind FROM nodes_gt")
def t32(spark, d):
    return nesting.unit_kinds(view(spark, d, "nodes_gt"), speck=20, chars=8)
