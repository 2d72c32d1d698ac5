"""Registered queries of reports, gates, checks and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import geometry as G
from canopy.operators import quality, review, spatial
from canopy.plans.views import view
from canopy.registry import _GOOD, _HITS, _MARGINS, _MATCHED, _hits, a19, query, read


@query("a06_magnitude_error", f"""WITH {_MATCHED}, j AS (SELECT g.type, abs(p.x - g.x) AS e, g.x AS t FROM matched m JOIN boxes_pred p ON m.case_id = p.case_id AND m.l_node = p.node JOIN boxes_gt g ON m.case_id = g.case_id AND m.r_node = g.node)
  SELECT type, count(*) AS n, round(avg(e), 9) AS mae, round(median(e::DOUBLE / greatest(1, abs(t))), 9) AS median_relative FROM j GROUP BY type""")
def a06(spark, d):
    m = spatial.match_nodes(view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt"))
    e = review.magnitude_error(m, "r_type", F.col("l_x"), F.col("r_x"))
    return e.select(F.col("r_type").alias("type"), "n", F.round("mae", 9).alias("mae"), F.round("median_relative", 9).alias("median_relative"))


@query("a08_noise_report", f"""WITH {_HITS}, fp AS (SELECT case_id, count(*) AS n FROM h WHERE hit = 0 GROUP BY case_id)
  SELECT o_custkey % 10 AS family, count(*) AS cases, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 9) AS false_case_rate, round(avg(coalesce(n, 0)), 9) AS per_case FROM orders LEFT JOIN fp ON o_orderkey = fp.case_id GROUP BY 1""")
def a08(spark, d):
    cases = read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 10).alias("family"))
    r = review.noise_report(cases, _hits(spark, d).where("NOT hit"), "family")
    return r.select("family", "cases", F.round("false_case_rate", 9).alias("false_case_rate"), F.round("per_case", 9).alias("per_case"))


@query("a09_runtime", "SELECT event_type, round(avg(value), 9) AS mean_s, round(quantile_cont(value, 0.95), 9) AS p95_s, max(value) AS max_s, round(sum(value), 6) AS total_s FROM events GROUP BY event_type")
def a09(spark, d):
    r = review.runtime(read(spark, d, "events"), "event_type", "value")
    return r.select("event_type", F.round("mean_s", 9).alias("mean_s"), F.round("p95_s", 9).alias("p95_s"), "max_s", F.round("total_s", 6).alias("total_s"))


@query("a16_ladder", """WITH r AS (SELECT metric, avg(value) FILTER (WHERE family % 3 = 0) AS run0, avg(value) FILTER (WHERE family % 3 = 1) AS run1, avg(value) FILTER (WHERE family % 3 = 2) AS run2 FROM metrics GROUP BY metric)
  SELECT metric, round(run0, 9) AS run0, round(run1, 9) AS run1, round(run2, 9) AS run2, CASE WHEN run0 - run1 >= run1 - run2 THEN 1 ELSE 2 END AS rung, round(greatest(run0 - run1, run1 - run2), 9) AS cost FROM r""")
def a16(spark, d):
    r = review.ladder(view(spark, d, "metrics").withColumn("run", (F.col("family") % 3).cast("int")), [0, 1, 2])
    return r.select("metric", *[F.round(c, 9).alias(c) for c in ("run0", "run1", "run2")], "rung", F.round("cost", 9).alias("cost"))


@query("a18_paired_modes", """WITH m AS (SELECT user_id, event_type AS mode, count(*) AS renders, min(value) AS loss FROM events GROUP BY 1, 2)
  SELECT m.mode, count(*) AS n, round(sum(m.renders)::DOUBLE / sum(b.renders), 9) AS render_ratio, count(*) FILTER (WHERE m.loss < b.loss) AS better, count(*) FILTER (WHERE m.loss > b.loss) AS worse FROM m JOIN m b ON m.user_id = b.user_id AND b.mode = 'error' GROUP BY m.mode""")
def a18(spark, d):
    runs = read(spark, d, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("mode")).agg(F.count("*").alias("renders"), F.min("value").alias("loss"))
    return review.paired_modes(runs, "error").withColumn("render_ratio", F.round("render_ratio", 9))


@query("a21_scenario_gate", f"""WITH {_MARGINS}, a AS (SELECT family, criterion, avg(CASE WHEN margin >= 0 THEN 1.0 ELSE 0.0 END) AS rate FROM margins WHERE case_id % 3 = 0 AND family < 8 GROUP BY ALL), b AS (SELECT family, criterion, avg(CASE WHEN margin >= 0 THEN 1.0 ELSE 0.0 END) AS rate FROM margins WHERE case_id % 3 <> 0 AND family > 1 GROUP BY ALL)
  SELECT coalesce(a.family, b.family) AS family, coalesce(a.criterion, b.criterion) AS criterion, round(a.rate, 9) AS now, round(b.rate, 9) AS was, CASE WHEN a.rate IS NULL THEN 'missing' WHEN b.rate IS NULL THEN 'new' WHEN a.rate < b.rate - 0.01 THEN 'regressed' ELSE 'ok' END AS verdict FROM a FULL JOIN b ON a.family = b.family AND a.criterion = b.criterion""")
def a21(spark, d):
    m = a19(spark, d)
    rate = lambda where: m.where(where).groupBy("family", "criterion").agg(F.avg(F.col("passed").cast("double")).alias("rate"))
    g = review.scenario_gate(rate("case_id % 3 = 0 AND family < 8"), rate("case_id % 3 <> 0 AND family > 1"), ["family", "criterion"], 0.01)
    return g.withColumn("now", F.round("now", 9)).withColumn("was", F.round("was", 9))


_TIERS = [(1, "node_recall", ">=", 0.2), (1, "ssim", ">=", 0.1), (2, "node_recall", ">=", 0.5), (2, "text_cer", "<=", 0.6), (3, "mean_de", "<=", 0.5), (3, "text_cer", "<=", 0.3)]


@query("a23_fidelity_gates", f"""WITH rules(tier, metric, op, threshold) AS (VALUES {", ".join(str(t) for t in _TIERS)}),
  j AS (SELECT case_id, tier, m.metric, coalesce(CASE WHEN op = '>=' THEN value >= threshold ELSE value <= threshold END, false) AS ok FROM metrics m JOIN rules r ON m.metric = r.metric)
  SELECT case_id, tier, bool_and(ok) AS passed, count(*) FILTER (WHERE NOT ok)::INTEGER AS n_failed, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE NOT ok), '') AS failed FROM j GROUP BY case_id, tier""")
def a23(spark, d):
    rules = spark.createDataFrame(_TIERS, "tier int, metric string, op string, threshold double")
    return review.rule_gates(view(spark, d, "metrics"), rules)


@query("a27_decision_queue", "WITH r AS (SELECT case_id, detector AS kind, fid AS id, w * h AS area, row_number() OVER (PARTITION BY case_id ORDER BY detector, w * h DESC, fid) AS rank FROM findings WHERE confidence < 400) SELECT case_id, kind, id, area, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def a27(spark, d):
    c = view(spark, d, "findings").select("case_id", F.col("detector").alias("kind"), F.col("fid").alias("id"), (F.col("w") * F.col("h")).alias("area"), "confidence")
    return review.decision_queue(c, 400, 5).drop("confidence")


@query("a30_record_errors", "SELECT id, 'negative revert' AS error FROM ledger WHERE reverts < 0 UNION ALL SELECT id, 'rejected revert' FROM ledger WHERE reverts IS NOT NULL AND NOT accepted UNION ALL SELECT id, 'value out of range' FROM ledger WHERE new_value > 150")
def a30(spark, d):
    rules = {"negative revert": F.col("reverts") < 0, "rejected revert": F.col("reverts").isNotNull() & ~F.col("accepted"), "value out of range": F.col("new_value") > 150}
    return review.record_errors(view(spark, d, "ledger"), ["id"], rules)


@query("l03_tercile_policy", """WITH e AS (SELECT node_type, quantile_cont(area, 1.0 / 3) AS lo, quantile_cont(area, 2.0 / 3) AS hi, count(*) AS m FROM moves GROUP BY 1)
  SELECT v.node_type AS type, kind AS operator, CASE WHEN m < 6 OR area <= lo THEN 0 WHEN area <= hi THEN 1 ELSE 2 END AS third, count(*) AS n, sum(accepted::INT)::BIGINT AS k FROM moves v JOIN e ON v.node_type = e.node_type GROUP BY 1, 2, 3""")
def l03(spark, d):
    m = view(spark, d, "moves").select(F.col("node_type").alias("type"), F.col("kind").alias("operator"), F.col("area").alias("magnitude"), F.col("accepted").alias("fixed"))
    return review.tercile_policy(m)


@query("l11_threshold_sweep", f"""WITH {_HITS}, s AS (SELECT t.threshold, count(h.fid) AS n, coalesce(sum(h.hit), 0)::BIGINT AS tp FROM range(0, 1000, 100) t(threshold) LEFT JOIN h ON h.confidence >= t.threshold GROUP BY 1),
  g AS (SELECT *, 2.0 * tp / (n + (SELECT count(*) FROM boxes_gt)) AS f1 FROM s) SELECT threshold, n, tp, round(f1, 9) AS f1, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM g""")
def l11(spark, d):
    return review.threshold_sweep(_hits(spark, d), 100, 1000, view(spark, d, "boxes_gt").count()).withColumn("f1", F.round("f1", 9))


@query("l12_router", """WITH h AS (SELECT f.case_id, f.fid, f.detector, f.type, max(CASE WHEN f.type = g.type AND
    greatest(least(f.x + f.w, g.x + g.w) - greatest(f.x, g.x), 0) * greatest(least(f.y + f.h, g.y + g.h) - greatest(f.y, g.y), 0) * 3 >= f.w * f.h + g.w * g.h THEN 1 ELSE 0 END) AS hit FROM findings f LEFT JOIN boxes_gt g ON f.case_id = g.case_id GROUP BY ALL),
  s AS (SELECT type, detector, count(*) AS n, sum(hit) AS tp FROM h GROUP BY 1, 2), t AS (SELECT type, count(*) AS n_gt FROM boxes_gt GROUP BY 1),
  r AS (SELECT s.type, detector, 2.0 * tp / (n + n_gt) AS f1, tp::DOUBLE / n AS precision FROM s JOIN t ON s.type = t.type), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY f1 DESC, precision DESC, detector) AS i FROM r)
  SELECT type, detector, round(f1, 9) AS f1, round(precision, 9) AS precision FROM k WHERE i = 1""")
def l12(spark, d):
    f, truth = view(spark, d, "findings"), view(spark, d, "boxes_gt")
    near = (F.col("l_type") == F.col("r_type")) & (G.overlap("l_", "r_") * 3 >= G.area("l_") + G.area("r_"))
    hit = spatial.spatial_join(f, truth, condition=near).select("case_id", F.col("l_fid").alias("fid")).distinct().withColumn("hit", F.lit(True))
    scored = f.join(hit, ["case_id", "fid"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return review.route(scored, truth).withColumn("f1", F.round("f1", 9)).withColumn("precision", F.round("precision", 9))


@query("l12_routed_findings", """WITH RECURSIVE rt AS (SELECT unnest([0, 1, 2, 3, 4]) AS type, unnest([2, 0, 1, 0, 2]) AS detector, unnest([0.9, 0.5, 0.7, 0.7, 0.6]) AS precision),
  c AS (SELECT f.*, row_number() OVER (PARTITION BY case_id ORDER BY precision DESC, confidence DESC, fid) AS k FROM findings f JOIN rt USING (type, detector)),
  o AS (SELECT a.case_id, a.k AS i, b.k AS j, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS v, a.w * a.h + b.w * b.h AS s, a.w * a.h <= 25000 AND b.x + b.w / 2.0 >= a.x AND b.x + b.w / 2.0 < a.x + a.w AND b.y + b.h / 2.0 >= a.y AND b.y + b.h / 2.0 < a.y + a.h AS inside FROM c a JOIN c b ON a.case_id = b.case_id AND a.k < b.k),
  nb AS (SELECT case_id, j AS k, list(i) AS before FROM (SELECT *, v * 1.0 / (s - v) AS iou FROM o WHERE v > 0) WHERE iou >= 0.5 OR ((iou >= 0.3 OR inside) AND iou > 0.1) GROUP BY 1, 2), r AS (SELECT c.case_id, c.k, before FROM c LEFT JOIN nb USING (case_id, k)),
  scan AS (SELECT DISTINCT case_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM r UNION ALL SELECT s.case_id, r.k, CASE WHEN before IS NOT NULL AND list_has_any(kept, before) THEN kept ELSE list_append(kept, r.k) END FROM scan s JOIN r ON r.case_id = s.case_id AND r.k = s.k + 1),
  e AS (SELECT case_id, unnest(kept) AS k FROM scan s WHERE k = (SELECT max(k) FROM c WHERE c.case_id = s.case_id)) SELECT case_id, fid, type, detector FROM c JOIN e USING (case_id, k)""")
def l12_routed(spark, d):
    routes = spark.createDataFrame([(0, 2, 0.9), (1, 0, 0.5), (2, 1, 0.7), (3, 0, 0.7), (4, 2, 0.6)], "type long, detector int, precision double")
    return review.apply_route(view(spark, d, "findings"), routes, 100_000.0).select("case_id", "fid", "type", "detector")


@query("l13_leave_one_out", f"""WITH {_GOOD}, c AS (SELECT case_id, family, sum(weight * goodness) / sum(CASE WHEN goodness IS NOT NULL THEN weight END) AS v FROM good GROUP BY ALL HAVING count(goodness) > 0), s AS (SELECT family, sum(v) AS s, count(v) AS n FROM c GROUP BY family)
  SELECT family, round(s / n, 9) AS held_out, round((sum(s) OVER () - s) / (sum(n) OVER () - n), 9) AS others FROM s""")
def l13(spark, d):
    m = view(spark, d, "metrics")
    c = quality.composites(m).join(read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 10).alias("family")), "case_id")
    r = review.leave_one_out(c, "family", "composite")
    return r.withColumn("held_out", F.round("held_out", 9)).withColumn("others", F.round("others", 9))
