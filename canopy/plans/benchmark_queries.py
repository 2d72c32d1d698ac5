"""Registered queries of scoring, gates and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import geometry as G
from canopy.operators import benchmark, quality, spatial
from canopy.plans.differ_queries import _M
from canopy.plans.views import view
from canopy.registry import _GOOD, _lab, query, read

_I = "greatest(least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x), 0) * greatest(least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y), 0)"


@query("a01_structure", f"""WITH {_M}, i AS (SELECT m.*, (least(l_x + l_w, r_x + r_w) - greatest(l_x, r_x)) * (least(l_y + l_h, r_y + r_h) - greatest(l_y, r_y)) AS i FROM m), o AS (SELECT case_id, count(*) AS k, avg(i::DOUBLE / (l_w * l_h + r_w * r_h - i)) AS iou, avg(de) AS de, avg(CASE WHEN txt THEN least(1.0, levenshtein(l_text, r_text)::DOUBLE / length(r_text)) END) AS cer, avg(CASE WHEN NOT txt THEN abs(l_radius - r_radius) END) AS mae, avg((l_type = r_type)::INT) AS types FROM i GROUP BY 1),
  t AS (SELECT g.case_id, count(*) AS n, avg(CASE WHEN g.type = 2 THEN EXISTS (SELECT 1 FROM nodes_pred p WHERE p.case_id = g.case_id AND p.type = 2 AND {_I} > 0 AND least(1.0, levenshtein(p.text, g.text)::DOUBLE / length(g.text)) <= 0.2)::INT END) AS text_recall, avg(CASE WHEN g.component IS NOT NULL THEN coalesce(l_component = g.component AND l_variant = g.variant, false)::INT END) AS component, avg(CASE WHEN g.component IS NOT NULL THEN coalesce(l_component = g.component, false)::INT END) AS name, avg(coalesce(q.token = g.token, false)::INT) AS token
    FROM nodes_gt g LEFT JOIN m ON g.case_id = m.case_id AND g.node = m.node LEFT JOIN nodes_pred q ON m.case_id = q.case_id AND m.node = q.node GROUP BY 1), p AS (SELECT case_id, count(*) AS n FROM nodes_pred GROUP BY 1)
  SELECT t.case_id, round(coalesce(coalesce(k, 0)::DOUBLE / p.n, -1), 6) AS precision, round(coalesce(k, 0)::DOUBLE / t.n, 6) AS recall, round(coalesce(iou, -1), 6) AS mean_iou, round(coalesce(de, -1), 6) AS color_de, round(coalesce(cer, -1), 6) AS text_cer, round(coalesce(text_recall, -1), 6) AS text_recall, round(coalesce(mae, -1), 6) AS radius_mae, round(coalesce(types, -1), 6) AS type_acc, round(coalesce(component, -1), 6) AS component_acc, round(coalesce(name, -1), 6) AS component_name_acc, round(coalesce(token, -1), 6) AS token_acc
  FROM t LEFT JOIN p ON t.case_id = p.case_id LEFT JOIN o ON t.case_id = o.case_id""")
def a01s(spark, d):
    m = benchmark.structural_metrics(view(spark, d, "nodes_pred"), view(spark, d, "nodes_gt"))
    return m.select("case_id", *[F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in m.columns[1:]])


def _detections(spark, d):
    up = F.floor(F.col("type") / 2).alias("parent")
    pred = view(spark, d, "boxes_pred").select("*", F.col("node").alias("fid"), up)
    truth = view(spark, d, "boxes_gt").select("*", F.col("node").alias("fid"), up)
    return pred, truth


def _located(spark, d):
    """Pairs by an IoU of a half, whatever their types."""
    pred, truth = _detections(spark, d)
    j = spatial.spatial_join(pred, truth, condition=G.overlap("l_", "r_") * 2 >= G.union_area("l_", "r_")).withColumn("iou", G.iou("l_", "r_"))
    return spatial.assign(j, ["case_id", "l_fid"], ["case_id", "r_fid"], "iou")


_LOC = f"loc AS (SELECT p.case_id, p.node AS l_fid, g.node AS r_fid, p.type AS l_type, g.type AS r_type FROM boxes_pred p JOIN boxes_gt g ON p.case_id = g.case_id AND {_I} * 3 >= p.w * p.h + g.w * g.h)"
_LEVELS = f"""{_LOC}, u AS (SELECT 'all' AS level, 'all' AS name, 1 AS tp, 0 AS p, 0 AS g FROM loc UNION ALL SELECT 'all', 'all', 0, 1, 0 FROM boxes_pred UNION ALL SELECT 'all', 'all', 0, 0, 1 FROM boxes_gt
    UNION ALL SELECT 'leaf', r_type::VARCHAR, 1, 0, 0 FROM loc WHERE l_type = r_type UNION ALL SELECT 'leaf', type::VARCHAR, 0, 1, 0 FROM boxes_pred UNION ALL SELECT 'leaf', type::VARCHAR, 0, 0, 1 FROM boxes_gt
    UNION ALL SELECT 'parent', (r_type // 2)::VARCHAR, 1, 0, 0 FROM loc WHERE l_type // 2 = r_type // 2 UNION ALL SELECT 'parent', (type // 2)::VARCHAR, 0, 1, 0 FROM boxes_pred UNION ALL SELECT 'parent', (type // 2)::VARCHAR, 0, 0, 1 FROM boxes_gt),
  t AS (SELECT level, name, sum(tp)::BIGINT AS tp, sum(p)::BIGINT AS n_pred, sum(g)::BIGINT AS n_gt, sum(tp)::DOUBLE / sum(p) AS precision, sum(tp)::DOUBLE / sum(g) AS recall, 2.0 * sum(tp) / (sum(p) + sum(g)) AS f1 FROM u GROUP BY 1, 2), lv AS (SELECT * FROM t UNION ALL SELECT 'macro ' || level, 'mean', sum(tp)::BIGINT, sum(n_pred)::BIGINT, sum(n_gt)::BIGINT, avg(precision), avg(recall), avg(f1) FROM t WHERE level <> 'all' GROUP BY level)"""


def _levels(spark, d):
    return benchmark.detection_levels(spatial.checkpoint(_located(spark, d)), *_detections(spark, d))


@query("a03_detection_levels", f"WITH {_LEVELS} SELECT level, name, tp, n_pred, n_gt, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM lv")
def a03l(spark, d):
    return _levels(spark, d).select("level", "name", "tp", "n_pred", "n_gt", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("a04_confusion_matrix", f"""WITH {_LOC} SELECT r_type::VARCHAR AS truth, l_type::VARCHAR AS pred, count(*) AS n FROM loc GROUP BY 1, 2 UNION ALL SELECT type::VARCHAR, '(missed)', count(*) FROM boxes_gt g WHERE NOT EXISTS (SELECT 1 FROM loc WHERE loc.case_id = g.case_id AND r_fid = node) GROUP BY 1
  UNION ALL SELECT '(spurious)', type::VARCHAR, count(*) FROM boxes_pred p WHERE NOT EXISTS (SELECT 1 FROM loc WHERE loc.case_id = p.case_id AND l_fid = node) GROUP BY 2""")
def a04m(spark, d):
    return benchmark.confusion_matrix(spatial.checkpoint(_located(spark, d)), *_detections(spark, d))


@query("a05_recall_by_family", f"WITH {_LOC} SELECT g.case_id % 7 AS family, count(r_fid) AS found, count(*) AS n, round(count(r_fid)::DOUBLE / count(*), 9) AS recall FROM boxes_gt g LEFT JOIN loc ON g.case_id = loc.case_id AND g.node = r_fid GROUP BY 1")
def a05f(spark, d):
    truth = _detections(spark, d)[1].withColumn("family", F.col("case_id") % 7)
    return benchmark.recall_by(_located(spark, d), truth, "family").withColumn("recall", F.round("recall", 9))


@query("a10_headline", f"""WITH {_LEVELS}, q AS (SELECT 1 - avg((o_custkey % 6 = 0)::INT) AS quiet FROM orders WHERE o_orderkey % 4 = 0), h AS (SELECT max(f1) FILTER (level = 'all') AS det, max(recall) FILTER (level = 'all') AS rec, max(f1) FILTER (level = 'macro leaf') AS macro FROM lv)
  SELECT round(0.4 * det + 0.3 * macro + 0.3 * quiet * rec, 9) AS headline, round(det, 9) AS det, round(macro, 9) AS macro, round(quiet, 9) AS quiet FROM h, q""")
def a10(spark, d):
    noise = read(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_custkey") % 6 == 0, 2).otherwise(0).alias("false"))
    h = benchmark.headline(_levels(spark, d), noise)
    return h.select(*[F.round(c, 9).alias(c) for c in h.columns])


@query("j03_match_findings", f"SELECT p.case_id, p.fid AS l_fid, g.fid AS r_fid, round(1 + i::DOUBLE / (p.w * p.h + g.w * g.h - i) + CASE WHEN p.type = g.type THEN 1 ELSE 0 END, 9) AS score FROM (SELECT *, node AS fid FROM boxes_pred) p JOIN (SELECT *, node AS fid FROM boxes_gt) g ON p.case_id = g.case_id AND p.fid = g.fid CROSS JOIN LATERAL (SELECT {_I} AS i) WHERE i > 0 AND (i * 1.3 >= 0.3 * (p.w * p.h + g.w * g.h) OR (p.x + p.w / 2.0 >= g.x AND p.x + p.w / 2.0 < g.x + g.w AND p.y + p.h / 2.0 >= g.y AND p.y + p.h / 2.0 < g.y + g.h AND g.w * g.h <= 57600))")
def j03(spark, d):
    pred, truth = _detections(spark, d)
    return benchmark.match_findings(pred, truth, 230400.0).where("l_fid = r_fid").select("case_id", "l_fid", "r_fid", F.round("score", 9).alias("score"))


_RUNS = f"""{_GOOD}, comp AS (SELECT case_id, sum(weight * goodness) / sum(CASE WHEN goodness IS NOT NULL THEN weight END) AS composite FROM good GROUP BY 1), bas AS (SELECT g.case_id, metric, goodness, composite FROM good g JOIN comp ON g.case_id = comp.case_id WHERE goodness IS NOT NULL AND g.case_id % 50 <> 1),
  cur AS (SELECT g.case_id, metric, goodness - CASE WHEN metric = 'text_cer' THEN 0.02 ELSE 0 END AS goodness, composite - CASE WHEN g.case_id % 40 = 0 THEN 0.06 ELSE 0.004 END AS composite FROM good g JOIN comp ON g.case_id = comp.case_id WHERE goodness IS NOT NULL AND metric <> 'ssim' AND g.case_id % 60 <> 2),
  cs AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, b.c AS was, a.c AS now FROM (SELECT case_id, any_value(composite) AS c FROM cur GROUP BY 1) a FULL JOIN (SELECT case_id, any_value(composite) AS c FROM bas GROUP BY 1) b ON a.case_id = b.case_id), ms AS (SELECT coalesce(a.metric, b.metric) AS metric, b.g AS was, a.g AS now FROM (SELECT metric, avg(goodness) AS g FROM cur GROUP BY 1) a FULL JOIN (SELECT metric, avg(goodness) AS g FROM bas GROUP BY 1) b ON a.metric = b.metric),
  fl AS (SELECT 'cases' AS scope, case_id::VARCHAR AS name, was, now, CASE WHEN now IS NULL THEN 'lost' ELSE 'new' END AS reason FROM cs WHERE (now IS NULL) <> (was IS NULL) UNION ALL SELECT 'case', case_id::VARCHAR, was, now, 'worse' FROM cs WHERE now < was - 0.05 UNION ALL SELECT 'composite', 'all', avg(was), avg(now), 'worse' FROM cs HAVING avg(now) < avg(was) - 0.003
    UNION ALL SELECT 'metric', metric, was, now, CASE WHEN now IS NULL THEN 'missing' ELSE 'worse' END FROM ms WHERE now IS NULL OR now < was - 0.01)"""


@query("a15_gate_failures", f"WITH {_RUNS} SELECT scope, name, round(coalesce(was, -1), 6) AS was, round(coalesce(now, -1), 6) AS now, reason FROM fl")
def a15f(spark, d):
    m = view(spark, d, "metrics")
    g = quality.with_goodness(m).where("goodness IS NOT NULL").join(quality.composites(m), "case_id").select("case_id", "metric", "goodness", "composite")
    g = spatial.checkpoint(g)
    cur = g.where("metric <> 'ssim' AND case_id % 60 <> 2").withColumn("goodness", F.col("goodness") - F.when(F.col("metric") == "text_cer", 0.02).otherwise(0.0)).withColumn("composite", F.col("composite") - F.when(F.col("case_id") % 40 == 0, 0.06).otherwise(0.004))
    f = benchmark.gate_failures(cur, g.where("case_id % 50 <> 1"))
    return f.select("scope", "name", F.round(F.coalesce("was", F.lit(-1.0)), 6).alias("was"), F.round(F.coalesce("now", F.lit(-1.0)), 6).alias("now"), "reason")


@query("a11_editable_composites", f"WITH {_GOOD}, c AS (SELECT case_id, sum(weight * goodness) / sum(CASE WHEN goodness IS NOT NULL THEN weight END) AS c FROM good GROUP BY 1 HAVING count(goodness) > 0) SELECT case_id, round(c * (1 - least(1.0, (case_id % 5) / 3.0)) * CASE WHEN case_id % 2 = 0 THEN 0.9 ELSE 1 END, 9) AS composite FROM c")
def a11e(spark, d):
    m = view(spark, d, "metrics")
    k = F.col("case_id")
    factors = m.select("case_id").distinct().select("case_id", ((k % 5) / 3.0).alias("raster_frac"), F.when(k % 2 == 0, 0.9).alias("frame_iou"))
    return benchmark.editable_composites(m, factors).withColumn("composite", F.round("composite", 9))


@query("a14_bench_report", """SELECT 'run' AS section, 'cases' AS name, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'run', 'errors', count(*) FILTER (o_orderkey % 11 = 0) FROM orders UNION ALL SELECT 'run', 'composite', round(avg(CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 10 END), 6) FROM orders
  UNION ALL SELECT 'seconds', 'map', sum(o_custkey % 3) FROM orders UNION ALL SELECT 'seconds', 'render', sum(o_custkey % 5) FROM orders UNION ALL SELECT 'error', 'crash', count(*) FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'dropped', o_orderstatus, count(*) FROM orders WHERE o_orderkey % 13 = 0 GROUP BY o_orderstatus""")
def a14(spark, d):
    o = read(spark, d, "orders")
    bad = F.col("o_orderkey") % 11 == 0
    c = o.select(F.col("o_orderkey").alias("case_id"), F.when(~bad, (F.col("o_custkey") % 10).cast("double")).alias("composite"), F.when(bad, "crash").alias("error"), F.create_map(F.lit("render"), (F.col("o_custkey") % 5).cast("double"), F.lit("map"), (F.col("o_custkey") % 3).cast("double")).alias("seconds"))
    lost = o.where("o_orderkey % 13 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("reason"))
    return benchmark.bench_report(c, lost).withColumn("value", F.round("value", 6))


@query("a17_failure_drafts", f"WITH {_GOOD} SELECT case_id, metric, case_id || ': ' || metric || ' = ' || printf('%.4f', value) || ' (suspected stage: ' || stage || ')' AS draft FROM good WHERE goodness IS NOT NULL ORDER BY weight * (1 - goodness) DESC, case_id, metric LIMIT 20")
def a17(spark, d):
    return benchmark.failure_drafts(quality.worst(view(spark, d, "metrics"), 20))


@query("a24_bounded_priors", """WITH c AS (SELECT l_orderkey AS change, CASE WHEN l_partkey % 9 = 0 THEN 'bench.' ELSE 'map.' END || (l_partkey % 30) AS key, min(l_quantity) AS old, max(l_quantity) + max(l_tax) * 200 AS new FROM lineitem GROUP BY 1, 2), r AS (SELECT 'map.' || n_nationkey AS key, 0.0 AS low, 50.0 AS high FROM nation UNION ALL SELECT 'bench.' || n_nationkey, 0, 50 FROM nation),
  j AS (SELECT c.*, low, high FROM c LEFT JOIN r ON c.key = r.key) SELECT change, key, 'forbidden' AS reason FROM j WHERE key LIKE 'bench.%' UNION ALL SELECT change, key, 'unregistered' FROM j WHERE low IS NULL UNION ALL SELECT change, key, 'out of range' FROM j WHERE new < low OR new > high UNION ALL SELECT change, key, 'step too large' FROM j WHERE abs(new - old) > (high - low) * 0.25 UNION ALL SELECT change, '*', 'too many keys' FROM c GROUP BY change HAVING count(*) > 5""")
def a24(spark, d):
    key = F.concat(F.when(F.col("l_partkey") % 9 == 0, "bench.").otherwise("map."), (F.col("l_partkey") % 30).cast("string"))
    c = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("change"), key.alias("key")).agg(F.min("l_quantity").alias("old"), (F.max("l_quantity") + F.max("l_tax") * 200).alias("new"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    r = n.select(F.concat(F.lit("map."), "k").alias("key")).union(n.select(F.concat(F.lit("bench."), "k"))).withColumns({"low": F.lit(0.0), "high": F.lit(50.0)})
    return benchmark.bounded_priors(c, r, ("bench.",))


@query("a25_invariance", f"WITH {_LOC}, m AS (SELECT * FROM loc WHERE l_type = r_type) SELECT r.relation, coalesce(l.n, 0) AS lost, coalesce(w.n, 0) AS new FROM (SELECT DISTINCT case_id % 3 AS relation FROM boxes_gt) r LEFT JOIN (SELECT g.case_id % 3 AS relation, count(*) AS n FROM boxes_gt g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.case_id = g.case_id AND m.r_fid = g.node) GROUP BY 1) l ON r.relation = l.relation LEFT JOIN (SELECT p.case_id % 3 AS relation, count(*) AS n FROM boxes_pred p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.case_id = p.case_id AND m.l_fid = p.node) GROUP BY 1) w ON r.relation = w.relation")
def a25(spark, d):
    pred, truth = _detections(spark, d)
    rel = lambda df: df.withColumn("relation", F.col("case_id") % 3)
    # by overlap alone, as the other queries do: centres off, an IoU of a half
    return benchmark.invariance(rel(truth), rel(pred), 0.0, loc_iou=0.5)


@query("a28_apply_decisions", """WITH q AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'zzz' ELSE c_mktsegment END AS answer FROM customer WHERE c_custkey % 3 <> 0)
  SELECT coalesce(q.id, a.id) AS id, CASE WHEN q.id IS NULL THEN 'unknown' WHEN answer IS NULL THEN 'skipped' WHEN answer IN ('BUILDING', 'MACHINERY') THEN 'applied' ELSE 'unknown' END AS status, CASE WHEN q.id IS NOT NULL AND answer IN ('BUILDING', 'MACHINERY') THEN answer ELSE '' END AS answer FROM q FULL JOIN a ON q.id = a.id""")
def a28(spark, d):
    c = read(spark, d, "customer")
    q = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.array(F.lit("BUILDING"), F.lit("MACHINERY")).alias("options"))
    a = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "zzz").otherwise(F.col("c_mktsegment")).alias("answer"))
    return benchmark.apply_decisions(q, a).withColumn("answer", F.coalesce("answer", F.lit("")))


@query("a29_plan_errors", """WITH p AS (SELECT l_orderkey AS case_id, l_linenumber AS node, l_partkey % 9 - 1 AS w, 3 AS h, (l_suppkey % 12) / 10.0 AS r, 0.5 AS g, 0.5 AS b, l_discount * 11 AS opacity, CASE l_partkey % 4 WHEN 0 THEN 'grid' ELSE 'row' END AS layout FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY case_id, node) AS n FROM p)
  SELECT case_id, node, 'negative size' AS error FROM n WHERE w < 0 UNION ALL SELECT case_id, node, 'colour out of range' FROM n WHERE r > 1 UNION ALL SELECT case_id, node, 'opacity out of range' FROM n WHERE opacity > 1 OR opacity < 0 UNION ALL SELECT case_id, node, 'unknown layout' FROM n WHERE layout = 'grid' UNION ALL SELECT case_id, node, 'id occurs twice' FROM n WHERE n > 1""")
def a29(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("node"), (F.col("l_partkey") % 9 - 1).alias("w"), F.lit(3).alias("h"), ((F.col("l_suppkey") % 12) / 10.0).alias("r"), F.lit(0.5).alias("g"), F.lit(0.5).alias("b"), (F.col("l_discount") * 11).alias("opacity"), F.when(F.col("l_partkey") % 4 == 0, "grid").otherwise("row").alias("layout"))
    return benchmark.plan_errors(p)


@query("a31_surfaces_found", f"""WITH a AS (SELECT *, {_lab('')} FROM nodes_gt WHERE type = 1), b AS (SELECT *, {_lab('')} FROM nodes_pred), k AS (SELECT g.case_id, g.node, min(sqrt(pow(p.l - g.l, 2) + pow(p.a - g.a, 2) + pow(p.bb - g.bb, 2))) AS de FROM a g JOIN b p ON g.case_id = p.case_id AND {_I} > 0 AND ({_I})::DOUBLE / (p.w * p.h + g.w * g.h - {_I}) >= 0.8 GROUP BY 1, 2)
  SELECT a.case_id, count(*) AS n, count(de) AS found, count(*) FILTER (de <= 1) AS filled FROM a LEFT JOIN k ON a.case_id = k.case_id AND a.node = k.node GROUP BY 1""")
def a31(spark, d):
    return benchmark.surfaces_found(view(spark, d, "nodes_gt").where("type = 1"), view(spark, d, "nodes_pred"))


@query("a32_promotion", "WITH b AS (SELECT c_custkey AS family, 0.5 AS rate FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT c_custkey AS family, CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE 0.75 END AS rate FROM customer WHERE c_custkey % 3 = 0) SELECT coalesce(b.family, s.family) AS family, coalesce(s.rate, b.rate)::DOUBLE AS rate, s.rate IS NOT NULL AND s.rate IS DISTINCT FROM b.rate AS logged FROM b FULL JOIN s ON b.family = s.family")
def a32(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("family"))
    s = c.where("family % 3 = 0").withColumn("rate", F.when(F.col("family") % 4 == 0, 0.5).otherwise(0.75))
    new, entry = benchmark.promoted(c.where("family % 2 = 0").withColumn("rate", F.lit(0.5)), s)
    return new.join(entry.select(F.col("key").cast("long").alias("family"), F.lit(True).alias("logged")), "family", "left").withColumn("logged", F.coalesce("logged", F.lit(False)))


@query("a33_scoped_measures", f"""WITH {_M}, s AS (SELECT case_id, node, 'full' AS scope FROM nodes_gt UNION ALL SELECT case_id, node, 'roi' FROM nodes_gt WHERE greatest(least(x + w, 200) - greatest(x, 0), 0) * greatest(least(y + h, 150) - greatest(y, 0), 0) * 2 >= w * h AND x < 200 AND y < 150)
  SELECT s.case_id, scope, count(*) AS n_gt, count(m.node) AS matched, round(count(m.node)::DOUBLE / count(*), 9) AS recall FROM s LEFT JOIN m ON s.case_id = m.case_id AND s.node = m.node GROUP BY 1, 2""")
def a33(spark, d):
    gt = view(spark, d, "nodes_gt")
    roi = gt.select("case_id").distinct().withColumns({"node": F.lit(0), "x": F.lit(0), "y": F.lit(0), "w": F.lit(200), "h": F.lit(150)})
    return benchmark.scoped_measures(view(spark, d, "nodes_pred"), gt, roi).withColumn("recall", F.round("recall", 9))
