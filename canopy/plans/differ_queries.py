"""Registered queries of typed differences, over ``lineitem`` read as two versions of node tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import differ, spatial
from canopy.plans.views import view
from canopy.registry import _lab, query


def _both(spark, d):
    return view(spark, d, "nodes_gt"), view(spark, d, "nodes_pred")


def _pairs(spark, d):
    """Pairs of equal type and an IoU of a half or more, actual nodes on the left."""
    gt, pred = _both(spark, d)
    return spatial.match_nodes(pred, gt)


_COLUMNS = ("x", "y", "w", "h", "type", "r", "g", "b", "stroke", "radius", "opacity", "shadow", "text", "size", "weight", "glyph", "component", "variant", "gap")
_I = "greatest(least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x), 0) * greatest(least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y), 0)"
_M = f"""m0 AS (SELECT g.case_id, g.node, g.parent, {", ".join(f"p.{c} AS l_{c}, g.{c} AS r_{c}" for c in _COLUMNS)}, p.r AS lr, p.g AS lg, p.b AS lb, g.r AS rr, g.g AS rg, g.b AS rb, p.stroke AS sr, p.stroke AS sg, p.stroke AS sb, g.stroke AS tr, g.stroke AS tg, g.stroke AS tb
    FROM nodes_gt g JOIN nodes_pred p ON g.case_id = p.case_id AND g.node = p.node WHERE {_I} * 3 >= p.w * p.h + g.w * g.h),
  m1 AS (SELECT *, {_lab('l')}, {_lab('r')}, {_lab('s')}, {_lab('t')} FROM m0),
  m AS (SELECT *, sqrt((ll - rl) * (ll - rl) + (la - ra) * (la - ra) + (lbb - rbb) * (lbb - rbb)) AS de, sqrt((sl - tl) * (sl - tl) + (sa - ta) * (sa - ta) + (sbb - tbb) * (sbb - tbb)) AS ds, r_type NOT IN (2, 3) AS shape, r_type = 2 AS txt,
    l_x - r_x AS dl, l_y - r_y AS dt, l_x + l_w - r_x - r_w AS dr, l_y + l_h - r_y - r_h AS db FROM m1)"""
_STYLED = "(l_text <> r_text OR abs(l_size - r_size) > 1 OR abs(l_weight - r_weight) >= 100)"
_EDGE = "greatest(abs(dl), abs(dt), abs(dr), abs(db))"
_SLACK = "CASE WHEN txt THEN 2 ELSE 0 END"
_MOVED = f"(NOT (txt AND {_STYLED}) AND {_EDGE} > 1 + {_SLACK})"
_SAME = f"(abs(l_w - r_w) <= 1.5 + {_SLACK} AND abs(l_h - r_h) <= 1.5 + {_SLACK})"
_WAY = "sqrt((dl + dr) * (dl + dr) / 4.0 + (dt + db) * (dt + db) / 4.0)"
_CHECKS = [
    ("text.content", "txt AND l_text <> r_text", "least(1.0, levenshtein(l_text, r_text)::DOUBLE / length(r_text))"),
    ("text.style", f"txt AND l_text = r_text AND {_STYLED}", "abs(l_size - r_size) + abs(l_weight - r_weight) / 100.0"),
    ("text.position", f"txt AND {_MOVED} AND {_SAME}", _WAY),
    ("geometry.shift", f"NOT txt AND {_MOVED} AND {_SAME}", _WAY),
    ("geometry.size", f"{_MOVED} AND NOT {_SAME}", _EDGE),
    ("color.fill", "de > 6", "de"),
    ("color.stroke", "shape AND ds > 6", "ds"),
    ("geometry.radius", "shape AND least(r_w, r_h) >= 8 AND abs(l_radius - r_radius) > 2", "abs(l_radius - r_radius)"),
    ("effect.opacity", "abs(l_opacity - r_opacity) > 5", "abs(l_opacity - r_opacity) / 100.0"),
    ("effect.shadow", "shape AND (((l_shadow > 0) <> (r_shadow > 0) AND greatest(l_shadow, r_shadow) > 2) OR abs(l_shadow - r_shadow) > 4)", "abs(l_shadow - r_shadow)"),
    ("icon.glyph", "r_type = 3 AND l_glyph IS DISTINCT FROM r_glyph", "NULL"),
    ("layout.spacing", "abs(l_gap - r_gap) > 3", "abs(l_gap - r_gap)"),
    ("component.identity", "l_component IS DISTINCT FROM r_component OR (l_component IS NOT NULL AND l_variant <> r_variant)", "NULL"),
]
_F = f"{_M}, f AS ({' UNION ALL '.join(f'''SELECT case_id, node, '{n}' AS type, ({v})::DOUBLE AS magnitude, least(l_x, r_x) AS x, least(l_y, r_y) AS y FROM m WHERE {c}''' for n, c, v in _CHECKS)})"


@query("d01_pair_findings", f"WITH {_F} SELECT case_id, node, type, round(magnitude, 6) AS magnitude, x, y FROM f")
def d01(spark, d):
    return differ.pair_findings(_pairs(spark, d)).select("case_id", "node", "type", F.round("magnitude", 6).alias("magnitude"), "x", "y")


def _halves(spark, d):
    """Expected nodes, and an actual table in which every third node is cut in two with a gap of two pixels."""
    gt = view(spark, d, "nodes_gt")
    cut = (F.col("node") + F.col("case_id")) % 3 == 0
    left = gt.withColumn("w", F.when(cut, F.floor(F.col("w") * 6 / 10)).otherwise(F.col("w")))
    right = gt.where(cut).withColumn("x", F.col("x") + F.floor(F.col("w") * 6 / 10) + 2).withColumn("w", F.col("w") - F.floor(F.col("w") * 6 / 10) - 2).withColumn("node", F.col("node") + 1000)
    return gt, left, right


@query("d02_splits", "SELECT case_id, node, node AS actual, node + 1000 AS part, 'structure.split' AS type, 2.0::DOUBLE AS magnitude FROM nodes_gt WHERE (node + case_id) % 3 = 0 AND type <> 2 AND w - floor(w * 6 / 10) - 2 > 0 AND floor(w * 6 / 10) * 2 >= w")
def d02(spark, d):
    gt, left, right = _halves(spark, d)
    return differ.splits(spatial.match_nodes(left, gt), right.where("w > 0")).select("case_id", "node", "actual", "part", "type", F.col("magnitude").cast("double").alias("magnitude"))


@query("d02_merges", "SELECT case_id, node AS actual, node + 1000 AS part, 'structure.merge' AS type FROM nodes_gt WHERE (node + case_id) % 3 = 0 AND type <> 2 AND w - floor(w * 6 / 10) - 2 > 0 AND floor(w * 6 / 10) * 2 >= w")
def d02m(spark, d):
    gt, left, right = _halves(spark, d)
    return differ.splits(differ.swapped(spatial.match_nodes(gt, left)), right.where("w > 0"), "structure.merge").select("case_id", F.col("node").alias("actual"), "part", "type")


_FADE = f"""{_M.replace("m0 AS (SELECT", "k AS (SELECT case_id, node, r AS kr, g AS kg, b AS kb FROM nodes_gt), faded AS (SELECT g.* REPLACE (CASE WHEN (g.node + g.case_id) % 4 < 2 THEN floor((g.r + kr) / 2)::BIGINT ELSE g.r END AS r, CASE WHEN (g.node + g.case_id) % 4 < 2 THEN floor((g.g + kg) / 2)::BIGINT ELSE g.g END AS g, CASE WHEN (g.node + g.case_id) % 4 < 2 THEN floor((g.b + kb) / 2)::BIGINT ELSE g.b END AS b) FROM nodes_gt g JOIN k ON g.case_id = k.case_id AND g.parent = k.node), m0 AS (SELECT").replace("JOIN nodes_pred p", "JOIN faded p")},
  v AS (SELECT m.*, kr, kg, kb, (rr - kr) * (rr - kr) + (rg - kg) * (rg - kg) + (rb - kb) * (rb - kb) AS norm FROM m JOIN k ON m.case_id = k.case_id AND m.parent = k.node WHERE de > 6),
  a AS (SELECT *, ((lr - kr) * (rr - kr) + (lg - kg) * (rg - kg) + (lb - kb) * (rb - kb))::DOUBLE / norm AS alpha FROM v WHERE norm >= 400),
  fades AS (SELECT case_id, node, parent, alpha FROM a WHERE alpha BETWEEN 0.05 AND 0.95 AND sqrt(pow(lr - kr - alpha * (rr - kr), 2) + pow(lg - kg - alpha * (rg - kg), 2) + pow(lb - kb - alpha * (rb - kb), 2)) / sqrt(norm) <= 0.15)"""


def _faded(spark, d):
    """Actual nodes half of which are blended evenly with their parent's colour; roots are left out."""
    gt = view(spark, d, "nodes_gt").select("case_id", "node", "parent", *"xywh", "type", *"rgb")
    k = gt.select("case_id", F.col("node").alias("parent"), *[F.col(c).alias(f"k{c}") for c in "rgb"])
    cut = (F.col("node") + F.col("case_id")) % 4 < 2
    pred = gt.join(k, ["case_id", "parent"])
    pred = pred.withColumns({c: F.when(cut, F.floor((F.col(c) + F.col(f"k{c}")) / 2)).otherwise(F.col(c)) for c in "rgb"}).drop("kr", "kg", "kb")
    return gt, spatial.match_nodes(pred, gt)


@query("d03_fades", f"WITH {_FADE} SELECT case_id, node, parent, round(alpha, 9) AS alpha FROM fades")
def d03(spark, d):
    gt, pairs = _faded(spark, d)
    return differ.fades(pairs, gt).select("case_id", "node", "parent", F.round("alpha", 9).alias("alpha"))


@query("d03_opacity_groups", f"""WITH RECURSIVE {_FADE}, up(case_id, node, ancestor, distance) AS (SELECT case_id, node, parent, 1 FROM nodes_gt WHERE parent IS NOT NULL UNION ALL SELECT up.case_id, up.node, n.parent, distance + 1 FROM up JOIN nodes_gt n ON up.case_id = n.case_id AND up.ancestor = n.node WHERE n.parent IS NOT NULL),
  near AS (SELECT f.case_id, f.node, g.node AS root, row_number() OVER (PARTITION BY f.case_id, f.node ORDER BY distance) AS k FROM fades f JOIN up ON f.case_id = up.case_id AND f.node = up.node JOIN fades g ON g.case_id = f.case_id AND g.node = up.ancestor AND abs(g.alpha - f.alpha) <= 0.2),
  r AS (SELECT f.*, root FROM fades f LEFT JOIN near n ON f.case_id = n.case_id AND f.node = n.node AND k = 1),
  u AS (SELECT case_id, root AS key, 'a' AS how, NULL::DOUBLE AS band, node, alpha FROM r WHERE root IS NOT NULL UNION ALL SELECT DISTINCT h.case_id, r.root, 'a', NULL::DOUBLE, h.node, h.alpha FROM r JOIN r h ON r.case_id = h.case_id AND r.root = h.node UNION ALL SELECT case_id, parent, 'b', round(alpha * 5), node, alpha FROM r WHERE root IS NULL)
  SELECT case_id, min(node) AS node, round(1 - avg(alpha), 6) AS magnitude, count(*) AS nodes FROM u GROUP BY case_id, key, how, band""")
def d03g(spark, d):
    gt, pairs = _faded(spark, d)
    return differ.opacity_groups(differ.fades(pairs, gt), differ.closure(gt)).select("case_id", "node", F.round("magnitude", 6).alias("magnitude"), "nodes")


_TINT = _M.replace("JOIN nodes_pred p", "JOIN (SELECT * REPLACE (least(255, r + CASE WHEN case_id % 2 = 0 THEN 25 ELSE 0 END) AS r, least(255, stroke + CASE WHEN case_id % 2 = 0 THEN 12 ELSE 0 END) AS stroke) FROM nodes_gt) p")


@query("d04_global_tint", f"""WITH {_TINT}, c AS (SELECT case_id, shape, de, ll - rl AS l, la - ra AS a, lbb - rbb AS b FROM m UNION ALL SELECT case_id, shape, ds, sl - tl, sa - ta, sbb - tbb FROM m),
  q AS (SELECT case_id, count(*) AS n, count(*) FILTER (de > 3) AS k, count(*) FILTER (shape) AS s, count(*) FILTER (shape AND de > 3) AS sk, avg(de) FILTER (de > 3) AS magnitude, avg(l) FILTER (de > 3) AS ml, avg(a) FILTER (de > 3) AS ma, avg(b) FILTER (de > 3) AS mb FROM c GROUP BY 1),
  o AS (SELECT q.case_id, avg(sqrt(pow(l - ml, 2) + pow(a - ma, 2) + pow(b - mb, 2))) AS off FROM c JOIN q ON c.case_id = q.case_id WHERE de > 3 GROUP BY 1)
  SELECT q.case_id, round(magnitude, 6) AS magnitude, n AS pairs, k AS changed FROM q JOIN o ON q.case_id = o.case_id WHERE n >= 4 AND k >= n * 0.6 AND sk > 0 AND sk >= s * 0.5 AND sqrt(ml * ml + ma * ma + mb * mb) > 3 AND off / sqrt(ml * ml + ma * ma + mb * mb) <= 0.9""")
def d04(spark, d):
    gt = view(spark, d, "nodes_gt").select("case_id", "node", "x", "y", "w", "h", "type", "r", "g", "b", "stroke")
    even = F.col("case_id") % 2 == 0
    tinted = gt.withColumns({"r": F.least(F.lit(255), F.col("r") + F.when(even, 25).otherwise(0)), "stroke": F.least(F.lit(255), F.col("stroke") + F.when(even, 12).otherwise(0))})
    return differ.global_tint(spatial.match_nodes(tinted, gt), spread=0.9).withColumn("magnitude", F.round("magnitude", 6))


_UP = "up(case_id, node, ancestor) AS (SELECT case_id, node, parent FROM nodes_gt WHERE parent IS NOT NULL UNION ALL SELECT up.case_id, up.node, n.parent FROM up JOIN nodes_gt n ON up.case_id = n.case_id AND up.ancestor = n.node WHERE n.parent IS NOT NULL)"
_MOVES = f"{_M}, mv AS (SELECT case_id, node, parent, CASE WHEN txt THEN 'text.position' ELSE 'geometry.shift' END AS type, (dl + dr) / 2.0 AS dx, (dt + db) / 2.0 AS dy, r_x AS ex, r_y AS ey, least(l_x, r_x) AS x, least(l_y, r_y) AS y, greatest(l_x + l_w, r_x + r_w) AS x2, greatest(l_y + l_h, r_y + r_h) AS y2 FROM m WHERE {_MOVED} AND {_SAME})"
_FOLDED = f"{_MOVES}, folded AS (SELECT * FROM mv WHERE NOT EXISTS (SELECT 1 FROM up JOIN mv a ON a.case_id = up.case_id AND a.node = up.ancestor WHERE up.case_id = mv.case_id AND up.node = mv.node AND abs(a.dx - mv.dx) <= 2 AND abs(a.dy - mv.dy) <= 2))"


def _moves(spark, d):
    pairs = _pairs(spark, d)
    return differ.fold_moves(differ.moves(pairs, differ.pair_findings(pairs)), differ.closure(view(spark, d, "nodes_gt")))


@query("d05_folded_moves", f"WITH RECURSIVE {_UP}, {_FOLDED} SELECT case_id, node, type, round(dx, 6) AS dx, round(dy, 6) AS dy FROM folded")
def d05(spark, d):
    return _moves(spark, d).select("case_id", "node", "type", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query("d05_merged_moves", f"""WITH RECURSIVE {_UP}, {_FOLDED}, e AS (SELECT a.case_id, a.node AS a, b.node AS b FROM folded a JOIN folded b ON a.case_id = b.case_id AND a.parent IS NOT DISTINCT FROM b.parent AND a.type = b.type AND round(a.dx) = round(b.dx) AND round(a.dy) = round(b.dy) AND greatest(a.x, b.x) - least(a.x2, b.x2) < 40 AND greatest(a.y, b.y) - least(a.y2, b.y2) < 40),
  reach(case_id, a, b) AS (SELECT case_id, a, b FROM e UNION SELECT r.case_id, r.a, e.b FROM reach r JOIN e ON r.case_id = e.case_id AND r.b = e.a), c AS (SELECT case_id, a AS node, min(b) AS c FROM reach GROUP BY 1, 2)
  SELECT f.case_id, count(*) AS nodes, min(x) AS x, min(y) AS y, max(x2) - min(x) AS w, max(y2) - min(y) AS h FROM folded f JOIN c ON f.case_id = c.case_id AND f.node = c.node GROUP BY f.case_id, c""")
def d05m(spark, d):
    return differ.merge_neighbours(_moves(spark, d), 40).select("case_id", "nodes", "x", "y", "w", "h")


_DRIFT = _MOVES.replace("JOIN nodes_pred p", "JOIN (SELECT * REPLACE (y + CASE WHEN node <= 5 THEN 2 * (node - 1) ELSE 0 END AS y) FROM nodes_gt) p").replace(f"{_I} * 3 >=", f"{_I} * 4 >=")


@query("d06_spacing_drift", f"""WITH {_DRIFT}, s AS (SELECT case_id, parent, node, 'x' AS axis, abs(dx) AS way, ex AS place FROM mv WHERE abs(dy) <= 2 AND abs(dx) > 1 UNION ALL SELECT case_id, parent, node, 'y', abs(dy), ey FROM mv WHERE abs(dx) <= 2 AND abs(dy) > 1),
  t AS (SELECT *, coalesce(way < lag(way) OVER (PARTITION BY case_id, axis ORDER BY place, node) - 2, false) AS back, min(round(way)) OVER (PARTITION BY case_id, axis) AS step FROM s)
  SELECT case_id, axis, any_value(step)::DOUBLE AS step, count(*) AS n FROM t GROUP BY case_id, axis HAVING count(*) >= 2 AND count(DISTINCT round(way)) >= 2 AND max(abs(round(way) / step - round(round(way) / step))) <= 0.25 AND NOT bool_or(back)""")
def d06(spark, d):
    gt = view(spark, d, "nodes_gt").select("case_id", "node", "parent", "x", "y", "w", "h", "type", "text", "size", "weight")
    late = gt.withColumn("y", F.col("y") + F.when(F.col("node") <= 5, (F.col("node") - 1) * 2).otherwise(0))
    pairs = spatial.match_nodes(late, gt, 1, 3)
    m = differ.moves(pairs, differ.pair_findings(pairs, differ.MOVED)).withColumn("parent", F.lit(0))  # every node beside the others
    return differ.spacing_drift(m).select("case_id", "axis", F.col("step").cast("double").alias("step"), "n")


@query("d07_tree_diff")
def d07(spark, d):
    gt, pred = _both(spark, d)
    return differ.tree_diff(gt, pred).withColumn("magnitude", F.round("magnitude", 6))


@query("j04_match_elements", f"WITH {_M} SELECT case_id, node AS actual, node, round(1 - i::DOUBLE / (l_w * l_h + r_w * r_h - i) + {_EDGE} / 40.0 + 0.6 * least(1.0, de / 50) + CASE WHEN txt THEN 0.8 * least(1.0, levenshtein(l_text, r_text)::DOUBLE / length(r_text)) ELSE 0 END + CASE WHEN r_type = 3 AND l_glyph <> r_glyph THEN 0.3 ELSE 0 END, 6) AS cost FROM (SELECT *, (least(l_x + l_w, r_x + r_w) - greatest(l_x, r_x)) * (least(l_y + l_h, r_y + r_h) - greatest(l_y, r_y)) AS i FROM m) q WHERE {_EDGE} <= 20")
def j04(spark, d):
    gt, pred = _both(spark, d)
    # a reach below the rows' distance, and pairs as near as those of the other queries
    m = differ.match_elements(gt, pred, max_shift=20.0)
    m = m.withColumn("shift", F.greatest(*[F.abs(F.col(f"l_{a}") + (F.col(f"l_{b}") if b else 0) - F.col(f"r_{a}") - (F.col(f"r_{b}") if b else 0)) for a, b in (("x", ""), ("y", ""), ("x", "w"), ("y", "h"))]))
    near = (F.least(F.col("l_x") + F.col("l_w"), F.col("r_x") + F.col("r_w")) - F.greatest("l_x", "r_x")) * (F.least(F.col("l_y") + F.col("l_h"), F.col("r_y") + F.col("r_h")) - F.greatest("l_y", "r_y"))
    m = m.where(near * 3 >= F.col("l_w") * F.col("l_h") + F.col("r_w") * F.col("r_h"))
    return m.select("case_id", F.col("l_node").alias("actual"), F.col("r_node").alias("node"), F.round(F.col("cost") - F.col("shift") / 40.0, 6).alias("cost"))


@query("j05_pair_items", f"""WITH c AS (SELECT g.case_id, g.node, p.node AS actual, sqrt(pow(p.x + p.w / 2.0 - g.x - g.w / 2.0, 2) + pow(p.y + p.h / 2.0 - g.y - g.h / 2.0, 2)) AS d, {_I} AS i, p.w * p.h + g.w * g.h AS s, least(p.w, g.w)::DOUBLE / greatest(p.w, g.w) * least(p.h, g.h) / greatest(p.h, g.h) AS alike, 1 - least(1.0, levenshtein(p.text, g.text)::DOUBLE / length(g.text)) AS ts, g.type
    FROM nodes_gt g JOIN nodes_pred p ON g.case_id = p.case_id AND g.node = p.node)
  SELECT case_id, node, actual, round(i::DOUBLE / (s - i) + 0.5 * exp(-d / 8) + 0.3 * alike + 0.2 + CASE WHEN type = 2 THEN 0.6 * ts ELSE 0 END, 6) AS score FROM c WHERE i::DOUBLE / (s - i) >= 0.05 OR d <= 8""")
def j05(spark, d):
    gt, pred = _both(spark, d)
    # a reach below the rows' distance of 48
    return differ.pair_items(gt, pred, 8.0).select("case_id", F.col("r_node").alias("node"), F.col("l_node").alias("actual"), F.round("score", 6).alias("score"))


@query("j16_subtree_roots", f"""WITH RECURSIVE {_UP}, un AS (SELECT case_id, node FROM nodes_gt WHERE (case_id * 7 + node) % 11 = 0 OR (case_id + node) % 5 = 0)
  SELECT case_id, node FROM un WHERE NOT EXISTS (SELECT 1 FROM up JOIN un a ON a.case_id = up.case_id AND a.node = up.ancestor WHERE up.case_id = un.case_id AND up.node = un.node)""")
def j16r(spark, d):
    gt = view(spark, d, "nodes_gt")
    return differ.subtree_roots(gt.where("(case_id * 7 + node) % 11 = 0 OR (case_id + node) % 5 = 0").select("case_id", "node"), differ.closure(gt))


@query("d10_mirrored_crop", """WITH m AS (SELECT case_id, node, 600 - (x + 5) - w AS x, y - 3 AS y, w, h, b AS r, g, r AS b FROM nodes_gt), c AS (SELECT *, greatest(100, x) AS l, greatest(40, y) AS t, greatest(0, least(500, x + w) - greatest(100, x)) AS cw, greatest(0, least(340, y + h) - greatest(40, y)) AS ch FROM m)
  SELECT case_id, node, l - 100 AS x, t - 40 AS y, cw AS w, ch AS h, r, g, b FROM c WHERE cw * ch >= w * h * 0.5""")
def d10(spark, d):
    n = differ.swap_channels(differ.mirror(differ.translate(view(spark, d, "nodes_gt"), 5, -3), 600))
    return differ.crop(n, 100, 40, 400, 300).select("case_id", "node", "x", "y", "w", "h", "r", "g", "b")


@query("d10_row_removed", "SELECT case_id, node, CASE WHEN y >= 96 THEN y - 48 ELSE y END AS y FROM nodes_gt WHERE NOT (y >= 48 AND y < 96)")
def d10r(spark, d):
    gt = view(spark, d, "nodes_gt")
    rows = gt.select("case_id").distinct().withColumns({"top": F.lit(48), "bottom": F.lit(96)})
    return differ.without_row(gt, rows).select("case_id", "node", "y")


@query("d11_relations", f"WITH {_F} SELECT r.relation, type, count(*) AS n FROM f CROSS JOIN (SELECT 'mirror' AS relation UNION ALL SELECT 'translate') r GROUP BY 1, 2")
def d11(spark, d):
    gt, pred = _both(spark, d)
    check = lambda change: differ.pair_findings(spatial.match_nodes(change(pred), change(gt)))
    return differ.relation_summary({"mirror": check(lambda n: differ.mirror(n, 700)), "translate": check(lambda n: differ.translate(n, 3, 2))})


@query("d12_parts_found", f"""WITH {_M}, p AS (SELECT g.case_id, count(*) AS parts, count(m.node) AS found FROM nodes_gt g LEFT JOIN m ON g.case_id = m.case_id AND g.node = m.node WHERE g.type IN (2, 3) GROUP BY 1) SELECT *, parts = found AS complete FROM p""")
def d12(spark, d):
    gt, pred = _both(spark, d)
    return differ.parts_found(gt.where("type IN (2, 3)"), pred)


@query("d13_boundaries", """WITH h AS (SELECT l_returnflag || l_linestatus AS component, l_linenumber AS axis, l_quantity AS value, avg(l_discount) > 0.055 - l_quantity / 3000 AS hit FROM lineitem GROUP BY 1, 2, 3),
  t AS (SELECT *, bool_and(hit) OVER (PARTITION BY component, axis ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stable FROM h)
  SELECT component, axis, min(CASE WHEN stable THEN value END) AS start, sum((hit AND NOT stable)::INT)::BIGINT AS islands, sum((hit AND NOT stable)::INT) = 0 AS monotone FROM t GROUP BY 1, 2""")
def d13(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    h = t.groupBy(F.concat("l_returnflag", "l_linestatus").alias("component"), F.col("l_linenumber").alias("axis"), F.col("l_quantity").alias("value")).agg((F.avg("l_discount") > 0.055 - F.first("l_quantity") / 3000).alias("hit"))
    return differ.boundaries(h)


@query("d14_round_trip", """WITH j AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, a.node AS an, b.node AS bn, greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.w - b.w), abs(a.h - b.h)) AS drift, a.text AS ta, b.text AS tb FROM nodes_gt a FULL JOIN nodes_pred b ON a.case_id = b.case_id AND a.node = b.node),
  g AS (SELECT case_id, count(an) AS before, count(bn) AS after, count(*) FILTER (bn IS NULL) AS lost, count(*) FILTER (an IS NULL) AS new, max(CASE WHEN an IS NOT NULL AND bn IS NOT NULL THEN drift END) AS max_drift, avg(CASE WHEN an IS NOT NULL AND bn IS NOT NULL THEN drift END) AS mean_drift, count(*) FILTER (an IS NOT NULL AND bn IS NOT NULL AND ta <> tb) AS texts FROM j GROUP BY 1)
  SELECT case_id, before, after, lost, new, coalesce(max_drift, -1) AS max_drift, round(coalesce(mean_drift, -1), 6) AS mean_drift, texts, lost > 0 OR new > 0 OR texts > 0 OR coalesce(max_drift, 0) > 0.5 AS lossy FROM g""")
def d14(spark, d):
    return differ.round_trip(*_both(spark, d)).fillna(-1, ["max_drift", "mean_drift"]).withColumn("mean_drift", F.round("mean_drift", 6))


_REGIONS = "rg AS (SELECT case_id, fid AS id, CASE WHEN fid % 2 = 0 THEN floor(fid / 6)::INT END AS node, type, (magnitude % 3) AS dx, (confidence % 2) AS dy, confidence AS mass, x, y, w, h FROM findings)"


@query("d15_cause_groups", f"""WITH RECURSIVE {_REGIONS}, e AS (SELECT a.case_id, a.id AS a, b.id AS b FROM rg a JOIN rg b ON a.case_id = b.case_id AND ((a.node = b.node AND a.type = b.type) OR (abs(a.dx - b.dx) <= 0.5 AND abs(a.dy - b.dy) <= 0.5 AND greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) < 4 AND greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) < 4) OR a.id = b.id)),
  reach(case_id, a, b) AS (SELECT case_id, a, b FROM e UNION SELECT r.case_id, r.a, e.b FROM reach r JOIN e ON r.case_id = e.case_id AND r.b = e.a), c AS (SELECT case_id, a AS id, min(b) AS c FROM reach GROUP BY 1, 2),
  k AS (SELECT rg.*, c, row_number() OVER (PARTITION BY rg.case_id, c ORDER BY mass DESC, rg.id) AS r FROM rg JOIN c ON rg.case_id = c.case_id AND rg.id = c.id)
  SELECT case_id, min(id) AS id, count(*) AS n, max(CASE WHEN r = 1 THEN type END) AS type, sum(mass)::BIGINT AS mass FROM k GROUP BY case_id, c""")
def d15(spark, d):
    f = view(spark, d, "findings")
    r = f.select("case_id", F.col("fid").alias("id"), F.when(F.col("fid") % 2 == 0, F.floor(F.col("fid") / 6)).alias("node"), "type", (F.col("magnitude") % 3).alias("dx"), (F.col("confidence") % 2).alias("dy"), F.col("confidence").alias("mass"), "x", "y", "w", "h")
    return differ.cause_groups(r, 4, 0.5)


@query("d16_blind_spots", f"WITH {_F} SELECT type AS relation, magnitude IS NULL AS type, count(*) AS n, count(*) FILTER (NOT coalesce(magnitude > 4, false)) AS unseen, round(count(*) FILTER (NOT coalesce(magnitude > 4, false))::DOUBLE / count(*), 9) AS share FROM f GROUP BY 1, 2")
def d16(spark, d):
    f = differ.pair_findings(_pairs(spark, d)).select(F.col("type").alias("relation"), F.col("magnitude").isNull().alias("type"), F.coalesce(F.col("magnitude") > 4, F.lit(False)).alias("flagged"))
    return differ.blind_spots(f).withColumn("share", F.round("share", 9))
