"""Registered queries of null models, novelty and typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import cart, novelty
from canopy.plans.views import view
from canopy.registry import embedding_items, query, read

_TILES = "tl AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS id, l_suppkey % 3 AS page_bin, l_linenumber % 2 AS content_bin, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_extendedprice / 2000 END AS value FROM lineitem)"


def _tiles(spark, d):
    t = read(spark, d, "lineitem")
    return t.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("id"), (F.col("l_suppkey") % 3).alias("page_bin"), (F.col("l_linenumber") % 2).alias("content_bin"), F.when(F.col("l_partkey") % 4 == 0, 0.0).otherwise(F.col("l_extendedprice") / 2000).alias("value"))


_BIN = "CASE WHEN value <= 1e-7 THEN 0 ELSE least(540, greatest(1, floor((log10(value) + 7) / (9.0 / 540)) + 1)) END"
_HIST = f"{_TILES}, hs AS (SELECT page_bin, content_bin, ({_BIN})::INTEGER AS bin, count(*) AS n FROM tl GROUP BY GROUPING SETS ((page_bin, content_bin, 3), (page_bin, 3), (content_bin, 3), (3)))".replace("(page_bin, content_bin, 3), (page_bin, 3), (content_bin, 3), (3)", f"(page_bin, content_bin, {_BIN}), (page_bin, {_BIN}), (content_bin, {_BIN}), ({_BIN})")
_POOL = "pl AS (SELECT id, value, page_bin, content_bin FROM tl UNION ALL SELECT id, value, page_bin, NULL FROM tl UNION ALL SELECT id, value, NULL, content_bin FROM tl UNION ALL SELECT id, value, NULL, NULL FROM tl)"
_TAIL = f"""{_HIST}, {_POOL}, rk AS (SELECT *, row_number() OVER (PARTITION BY page_bin, content_bin ORDER BY value DESC, id) AS r FROM pl WHERE value > 1e-7), g0 AS (SELECT page_bin, content_bin, count(*) AS k, min(value) AS u, avg(value) - min(value) AS m, var_pop(value) AS v FROM rk WHERE r <= 100 GROUP BY 1, 2),
  g1 AS (SELECT *, least(0.5, greatest(0.1, 0.5 * (1 - m * m / CASE WHEN v > 0 THEN v ELSE 1e-12 END))) AS xi FROM g0), gp AS (SELECT page_bin, content_bin, k, u, xi, greatest(m * (1 - xi), 1e-12) * (1 + 2 / sqrt(k)) AS beta FROM g1),
  nn AS (SELECT page_bin, content_bin, sum(n) AS n, sum(CASE WHEN bin > 0 THEN n ELSE 0 END) AS positive FROM hs GROUP BY 1, 2), tt AS (SELECT nn.*, u, beta, xi, k FROM nn LEFT JOIN gp ON nn.page_bin IS NOT DISTINCT FROM gp.page_bin AND nn.content_bin IS NOT DISTINCT FROM gp.content_bin)"""


@query("n01_null_histogram", f"WITH {_HIST} SELECT coalesce(page_bin, -1) AS page_bin, coalesce(content_bin, -1) AS content_bin, bin, n FROM hs")
def n01h(spark, d):
    return novelty.null_model(_tiles(spark, d), 100)[0].select(F.coalesce("page_bin", F.lit(-1)).alias("page_bin"), F.coalesce("content_bin", F.lit(-1)).alias("content_bin"), "bin", "n")


@query("n01_null_tail", f"WITH {_TAIL} SELECT coalesce(page_bin, -1) AS page_bin, coalesce(content_bin, -1) AS content_bin, n::BIGINT AS n, positive::BIGINT AS positive, round(u, 6) AS u, round(beta, 6) AS beta, round(xi, 6) AS xi, k FROM tt")
def n01t(spark, d):
    t = novelty.null_model(_tiles(spark, d), 100)[1]
    return t.select(F.coalesce("page_bin", F.lit(-1)).alias("page_bin"), F.coalesce("content_bin", F.lit(-1)).alias("content_bin"), "n", "positive", *[F.round(c, 6).alias(c) for c in ("u", "beta", "xi")], "k")


@query("n02_p_values", f"""WITH {_TAIL}, ab AS (SELECT page_bin, content_bin, bin, sum(n) OVER (PARTITION BY page_bin, content_bin ORDER BY bin DESC) AS above FROM hs WHERE bin > 0), pr AS (SELECT DISTINCT page_bin, content_bin FROM tl),
  ch AS (SELECT page_bin, content_bin, 0 AS o, page_bin AS p, content_bin AS c FROM pr UNION ALL SELECT page_bin, content_bin, 1, page_bin, NULL FROM pr UNION ALL SELECT page_bin, content_bin, 2, NULL, content_bin FROM pr UNION ALL SELECT page_bin, content_bin, 3, NULL, NULL FROM pr),
  ow AS (SELECT ch.page_bin, ch.content_bin, p, c, n, positive, u, beta, xi, k, row_number() OVER (PARTITION BY ch.page_bin, ch.content_bin ORDER BY o) AS r FROM ch JOIN tt ON ch.p IS NOT DISTINCT FROM tt.page_bin AND ch.c IS NOT DISTINCT FROM tt.content_bin WHERE n >= (SELECT count(*) / 4 FROM tl) OR o = 3),
  b AS (SELECT *, ({_BIN})::INTEGER AS bin FROM tl), j AS (SELECT b.id, b.value, b.bin, ow.*, (SELECT max(above) FROM ab WHERE ab.page_bin IS NOT DISTINCT FROM ow.p AND ab.content_bin IS NOT DISTINCT FROM ow.c AND ab.bin >= b.bin) AS above FROM b JOIN ow ON b.page_bin = ow.page_bin AND b.content_bin = ow.content_bin AND r = 1)
  SELECT id, round(CASE WHEN bin = 0 THEN 1 ELSE (positive + 1.0) / (n + 1) * least(1.0, CASE WHEN k >= 10 AND value > u THEN k / (positive + 1.0) * pow(1 + xi * (value - u) / beta, -1 / xi) ELSE greatest(coalesce(above, 0), 1) / (positive + 1.0) END) END, 9) AS p FROM j""")
def n02p(spark, d):
    t = _tiles(spark, d)
    return novelty.p_values(t, *novelty.null_model(t, 100), least=t.count() // 4).withColumn("p", F.round("p", 9))


@query("n03_page_normalised", """WITH t AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS id, l_suppkey AS page, l_linenumber % 3 AS content_bin, l_quantity AS value FROM lineitem), b AS (SELECT page, content_bin, quantile_cont(value, 0.9) AS own, count(*) AS n FROM t GROUP BY 1, 2), w AS (SELECT page, quantile_cont(value, 0.9) AS al FROM t GROUP BY 1)
  SELECT id, round(value / greatest(0.05, CASE WHEN n >= 200 THEN own ELSE al END), 6) AS value FROM t JOIN b ON t.page = b.page AND t.content_bin = b.content_bin JOIN w ON t.page = w.page""")
def n03(spark, d):
    t = read(spark, d, "lineitem").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("id"), F.col("l_suppkey").alias("page"), (F.col("l_linenumber") % 3).alias("content_bin"), F.col("l_quantity").alias("value"))
    return novelty.page_normalised(t, least=200).withColumn("value", F.round("value", 6))


@query("n16_null_tiles", "SELECT case_id, node AS tile FROM boxes_pred p WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.detector = 0 AND f.case_id = p.case_id AND f.x - 4 < p.x + p.w AND p.x < f.x + f.w + 4 AND f.y - 4 < p.y + p.h AND p.y < f.y + f.h + 4)")
def n16(spark, d):
    t = view(spark, d, "boxes_pred").select("case_id", F.col("node").alias("tile"), "x", "y", "w", "h")
    return novelty.null_tiles(t, view(spark, d, "findings").where("detector = 0")).select("case_id", "tile")


@query("n15_regions", """WITH RECURSIVE t AS (SELECT case_id, fid AS tile, confidence / 500.0 AS nfa, type AS fired, x, y, w, h FROM findings WHERE confidence < 500), e AS (SELECT a.case_id, a.tile AS a, b.tile AS b FROM t a JOIN t b ON a.case_id = b.case_id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h),
  reach(case_id, a, b) AS (SELECT case_id, a, b FROM e UNION SELECT r.case_id, r.a, e.b FROM reach r JOIN e ON r.case_id = e.case_id AND r.b = e.a), c AS (SELECT case_id, a AS tile, min(b) AS c FROM reach GROUP BY 1, 2), k AS (SELECT t.*, c, row_number() OVER (PARTITION BY t.case_id, c ORDER BY nfa, t.tile) AS r FROM t JOIN c ON t.case_id = c.case_id AND t.tile = c.tile)
  SELECT case_id, count(*) AS tiles, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, round(min(nfa), 6) AS nfa, max(CASE WHEN r = 1 THEN fired END) AS fired FROM k GROUP BY case_id, c""")
def n15(spark, d):
    t = view(spark, d, "findings").select("case_id", F.col("fid").alias("tile"), (F.col("confidence") / 500.0).alias("nfa"), F.col("type").alias("fired"), "x", "y", "w", "h")
    return novelty.meaningful_regions(t).withColumn("nfa", F.round("nfa", 6))


@query("n18_item_table", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY w * h DESC, node) AS r FROM boxes_gt) SELECT case_id, node AS id, 'residual' AS source, '' AS type FROM r WHERE r <= 3 AND w * h >= 900 UNION ALL SELECT case_id, fid, 'finding', 't' || type FROM findings WHERE type <> 0 AND w * h >= 900""")
def n18(spark, d):
    f = view(spark, d, "findings").select("case_id", F.col("fid").alias("id"), F.when(F.col("type") == 0, "noise.x").otherwise(F.concat(F.lit("t"), F.col("type").cast("string"))).alias("type"), "x", "y", "w", "h")
    r = view(spark, d, "boxes_gt").select("case_id", F.col("node").alias("id"), "x", "y", "w", "h")
    return novelty.item_table(r, f, 3, 900.0).select("case_id", "id", "source", F.coalesce("type", F.lit("")).alias("type"))


@query("n11_known_labels", """WITH fi AS MATERIALIZED (SELECT case_id, fid, x, y, w, h FROM findings), bo AS MATERIALIZED (SELECT case_id, node, type, x, y, w, h FROM boxes_gt), hit AS MATERIALIZED (SELECT f.case_id, f.fid AS id, g.type, g.node, greatest(least(f.x + f.w, g.x + g.w) - greatest(f.x, g.x), 0) * greatest(least(f.y + f.h, g.y + g.h) - greatest(f.y, g.y), 0) AS i, f.w * f.h + g.w * g.h AS s FROM fi f JOIN bo g ON f.case_id = g.case_id),
  j AS (SELECT case_id, id, type, node, i::DOUBLE / (s - i) AS o FROM hit WHERE i > 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY case_id, id ORDER BY round(o, 12) DESC, node) AS r FROM j WHERE o >= 0.7) SELECT f.case_id, f.fid AS id, coalesce(k.type::VARCHAR, 'noise') AS label FROM fi f LEFT JOIN (SELECT * FROM k WHERE r = 1) k ON f.case_id = k.case_id AND f.fid = k.id""")
def n11(spark, d):
    i = view(spark, d, "findings").select("case_id", F.col("fid").alias("id"), "x", "y", "w", "h")
    return novelty.known_labels(i, view(spark, d, "boxes_gt").withColumn("fid", F.col("node")), 0.7)


_VECTORS = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
_D2 = "round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"


@query("n07_leave_one_out", f"WITH {_VECTORS}, q AS (SELECT * FROM v), p AS (SELECT a.id, b.id AS o, {_D2} AS d2 FROM q a JOIN q b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, o) AS k FROM p) SELECT id, round(sqrt(d2), 6) AS d FROM r WHERE k = 5")
def n07l(spark, d):
    v = embedding_items(spark, d)
    return novelty.leave_one_out_distances(v).withColumn("d", F.round("d", 6))


@query("n08_novelty", f"""WITH {_VECTORS}, kn AS (SELECT * FROM v WHERE id % 2 = 0), it AS (SELECT * FROM v WHERE id % 2 = 1), lp AS (SELECT a.id, b.id AS o, {_D2} AS d2 FROM kn a JOIN kn b ON a.id <> b.id), lr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, o) AS k FROM lp), rf AS (SELECT sqrt(d2) AS d FROM lr WHERE k = 5),
  p AS (SELECT a.id, b.id AS o, b.label, {_D2} AS d2 FROM it a JOIN kn b ON true), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, o) AS k FROM p), n AS (SELECT * FROM r WHERE k <= 5), c AS (SELECT id, label, count(*) AS m, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS q FROM n WHERE label IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT n.id, sqrt(d2) AS d, (1.0 + (SELECT count(*) FROM rf WHERE rf.d >= sqrt(n.d2))) / (1 + (SELECT count(*) FROM rf)) AS p FROM n WHERE k = 5)
  SELECT s.id, round(d, 6) AS d, round(p, 9) AS p, c.label, round(m / 5.0, 9) AS purity, p < 0.3 OR (m / 5.0 < 0.6 AND p < 0.6) AS candidate FROM s JOIN c ON s.id = c.id AND q = 1""")
def n08n(spark, d):
    v = embedding_items(spark, d)
    known = v.where("id % 2 = 0")
    n = novelty.novelty(v.where("id % 2 = 1"), known, novelty.leave_one_out_distances(known), alpha=0.3)
    return n.withColumns({"d": F.round("d", 6), "p": F.round("p", 9), "purity": F.round("purity", 9)})


_DB = """pt AS (SELECT id, r AS x, g AS y FROM colors), ne AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pt a JOIN pt b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100), co AS (SELECT a FROM ne GROUP BY a HAVING count(*) >= 4), li AS (SELECT a, b FROM ne WHERE a IN (SELECT a FROM co) AND b IN (SELECT a FROM co)),
  reach(a, b) AS (SELECT a, b FROM li UNION SELECT r.a, li.b FROM reach r JOIN li ON r.b = li.a), cm AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1), bo AS (SELECT ne.a AS id, cluster, row_number() OVER (PARTITION BY ne.a ORDER BY d2, b) AS r FROM ne JOIN cm ON ne.b = cm.id WHERE ne.a NOT IN (SELECT a FROM co)),
  db AS (SELECT id, cluster FROM cm UNION ALL SELECT id, cluster FROM bo WHERE r = 1)"""


@query("n09_dbscan", f"WITH RECURSIVE {_DB} SELECT pt.id, coalesce(cluster, -1) AS cluster FROM pt LEFT JOIN db ON pt.id = db.id")
def n09(spark, d):
    return novelty.dbscan(view(spark, d, "colors").select("id", F.col("r").alias("x"), F.col("g").alias("y")), 10.0, 4).withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


@query("n10_cluster_report", f"""WITH RECURSIVE {_DB}, m AS (SELECT db.cluster, c.id, c.radius % 5 AS page, c.w AS f, 't' || (c.h % 3) AS nearest FROM db JOIN colors c ON db.id = c.id), k AS (SELECT cluster, nearest, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, nearest) AS r FROM m GROUP BY 1, 2)
  SELECT m.cluster, count(*) AS n, count(DISTINCT page) AS pages, count(DISTINCT page) >= 2 AS promotable, max(k.nearest) AS nearest, round(avg(f), 6) AS f_mean, min(f) AS f_low, max(f) AS f_high FROM m JOIN k ON m.cluster = k.cluster AND r = 1 GROUP BY 1""")
def n10(spark, d):
    c = view(spark, d, "colors")
    m = novelty.dbscan(c.select("id", F.col("r").alias("x"), F.col("g").alias("y")), 10.0, 4).where("cluster IS NOT NULL").join(c.select("id", (F.col("radius") % 5).alias("page"), F.col("w").alias("f"), F.concat(F.lit("t"), (F.col("h") % 3).cast("string")).alias("nearest")), "id")
    return novelty.cluster_report(m, ["f"]).drop("exemplars").withColumn("f_mean", F.round("f_mean", 6))


def _typing_items(spark, d):
    size = F.col("w") * F.col("h")
    label = F.when(size > 3000, "large").when((F.col("radius") > 12) & (F.col("w") > 60), "round").otherwise("plain")
    label = F.when((F.col("case_id") + F.col("node")) % 17 == 0, "round").otherwise(label)
    return view(spark, d, "nodes_gt").select((F.col("case_id") * 100 + F.col("node")).alias("id"), F.col("case_id").alias("page"), label.alias("label"), *[F.col(c).cast("double").alias(c) for c in ("w", "h", "radius")])


_ITEMS = """it AS (SELECT case_id * 100 + node AS id, case_id AS page, CASE WHEN (case_id + node) % 17 = 0 THEN 'round' WHEN w * h > 3000 THEN 'large' WHEN radius > 12 AND w > 60 THEN 'round' ELSE 'plain' END AS label, w::DOUBLE AS w, h::DOUBLE AS h, radius::DOUBLE AS radius FROM nodes_gt)"""
_CLASSES = ("large", "plain", "round")


def _tree_sql(train: str, levels: int, least: int) -> str:
    """Split search of every model's tree over ``train`` (model, id, label, w, h, radius): s0, s1, ... and leaves ``lf``."""
    of = lambda c: f"(count(*) FILTER (label = '{c}'))"
    total = lambda p: "(" + " + ".join(f"{p}{c} / n{c}" for c in _CLASSES) + ")"
    square = lambda p: f"CASE WHEN {total(p)} > 0 THEN (" + " + ".join(f"pow({p}{c} / n{c}, 2)" for c in _CLASSES) + f") / {total(p)} ELSE 0 END"
    parts = [f"a0 AS (SELECT model, id, label, w, h, radius, 1::BIGINT AS node FROM {train})", "cw AS (SELECT model, " + ", ".join(f"greatest({of(c)}, 1)::DOUBLE AS n{c}" for c in _CLASSES) + " FROM a0 GROUP BY model)"]
    for d in range(levels):
        parts.append(f"""v{d} AS (SELECT model, node, feature, value, {", ".join(f"{of(c)} AS k{c}" for c in _CLASSES)} FROM (SELECT model, node, label, unnest(['w', 'h', 'radius']) AS feature, unnest([w, h, radius]) AS value FROM a{d}) GROUP BY 1, 2, 3, 4),
  t{d} AS (SELECT model, node, {", ".join(f"{of(c)} AS t{c}" for c in _CLASSES)} FROM a{d} GROUP BY 1, 2),
  c{d} AS (SELECT *, {", ".join(f"t{c} - l{c} AS r{c}" for c in _CLASSES)} FROM (SELECT model, node, feature, value, {", ".join(f"sum(k{c}) OVER (PARTITION BY model, node, feature ORDER BY value) AS l{c}" for c in _CLASSES)} FROM v{d}) JOIN t{d} USING (model, node) JOIN cw USING (model)),
  s{d} AS (SELECT model, node, feature, value AS threshold, round({square("l")} + {square("r")} - {square("t")}, 9) AS gain FROM c{d} WHERE {" + ".join(f"l{c}" for c in _CLASSES)} >= {least} AND {" + ".join(f"r{c}" for c in _CLASSES)} >= {least} QUALIFY gain > 1e-9 AND row_number() OVER (PARTITION BY model, node ORDER BY round({square("l")} + {square("r")} - {square("t")}, 9) DESC, feature, value) = 1),
  a{d + 1} AS (SELECT a.* EXCLUDE (node), CASE WHEN feature IS NULL THEN node WHEN CASE feature WHEN 'w' THEN w WHEN 'h' THEN h ELSE radius END <= threshold THEN node * 2 ELSE node * 2 + 1 END AS node FROM a{d} a LEFT JOIN s{d} s USING (model, node))""")
    parts.append(f"""lq AS (SELECT model, node, {", ".join(f"{of(c)} / any_value(n{c}) AS q{c}" for c in _CLASSES)} FROM a{levels} JOIN cw USING (model) GROUP BY 1, 2),
  lf AS (SELECT model, node, CASE WHEN qlarge >= qplain AND qlarge >= qround THEN 'large' WHEN qplain >= qround THEN 'plain' ELSE 'round' END AS predicted, greatest(qlarge, qplain, qround) / (qlarge + qplain + qround) AS probability FROM lq)""")
    return ",\n  ".join(parts)


def _down_sql(items: str, levels: int) -> str:
    """``p{levels}``: items (model, ...) with the node they end in."""
    parts = [f"p0 AS (SELECT *, 1::BIGINT AS node FROM {items})"]
    parts += [f"p{d + 1} AS (SELECT a.* EXCLUDE (node), CASE WHEN feature IS NULL THEN node WHEN CASE feature WHEN 'w' THEN w WHEN 'h' THEN h ELSE radius END <= threshold THEN node * 2 ELSE node * 2 + 1 END AS node FROM p{d} a LEFT JOIN s{d} s USING (model, node))" for d in range(levels)]
    return ", ".join(parts)


@query("n12_typing_model", f"WITH {_ITEMS}, tr AS (SELECT 0 AS model, * FROM it), {_tree_sql('tr', 2, 5)} SELECT node, feature, threshold, gain FROM s0 UNION ALL SELECT node, feature, threshold, gain FROM s1")
def n12(spark, d):
    splits, _ = cart.fit(_typing_items(spark, d).withColumn("model", F.lit(0)), ["w", "h", "radius"], 2, 5)
    return splits.drop("model")


@query("n17_typed_regions", f"WITH {_ITEMS}, tr AS (SELECT 0 AS model, * FROM it WHERE page % 2 = 0), {_tree_sql('tr', 3, 5)}, te AS (SELECT 0 AS model, * FROM it WHERE page % 2 = 1), {_down_sql('te', 3)} SELECT id, label, predicted, round(probability, 6) AS probability FROM p3 JOIN lf USING (model, node)")
def n17(spark, d):
    items, features = _typing_items(spark, d).withColumn("model", F.lit(0)), ["w", "h", "radius"]
    model = cart.fit(items.where("page % 2 = 0"), features, 3, 5)
    return cart.apply(items.where("page % 2 = 1"), *model, features, 3).select("id", "label", "predicted", F.round("probability", 6).alias("probability"))


@query("n13_cross_validation", f"""WITH {_ITEMS}, tr AS (SELECT model::INT AS model, it.* FROM it JOIN (SELECT unnest([0, 1, 2]) AS model) ON page % 3 <> model), {_tree_sql('tr', 3, 5)}, te AS (SELECT (page % 3)::INT AS model, * FROM it), {_down_sql('te', 3)},
  x AS (SELECT model AS fold, label, CASE WHEN probability >= 0.5 THEN predicted END AS said FROM p3 LEFT JOIN lf USING (model, node)), g AS (SELECT fold, label AS c, count(*) AS g, count(*) FILTER (label = said) AS tp FROM x GROUP BY 1, 2), s AS (SELECT fold, said AS c, count(*) AS p FROM x WHERE said IS NOT NULL GROUP BY 1, 2),
  f AS (SELECT fold, avg(2.0 * tp / (g + coalesce(p, 0))) AS macro_f1 FROM g LEFT JOIN s USING (fold, c) GROUP BY 1)
  SELECT fold, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(abstained, 6) AS abstained FROM (SELECT fold, count(*) AS n, avg(coalesce(label = said, false)::INT) AS accuracy, avg((said IS NULL)::INT) AS abstained FROM x GROUP BY 1) JOIN f USING (fold)""")
def n13(spark, d):
    v = cart.cross_validated(_typing_items(spark, d), ["w", "h", "radius"], (F.col("page") % 3).cast("int"), depth=3, least=5)
    return v.select("fold", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "abstained")])
