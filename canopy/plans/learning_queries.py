"""Registered queries of policies, fusion and learning from users."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import feedback, fusion, learning
from canopy.plans.views import view
from canopy.registry import _RULES, query, read

_REC = "rec AS (SELECT 't' || (user_id % 6) AS type, event_type AS operator, event_id % 4 <> 0 AS proposed, event_id % 4 <> 0 AND event_id % 3 = 0 AS fixed, value / 100 AS gain, 1 + event_id % 3 AS tries FROM events)"
_POL = f"""{_REC}, c AS (SELECT type, operator, count(*) AS n, sum(proposed::INT) AS proposed, sum(fixed::INT) AS fixed, sum(CASE WHEN fixed THEN gain ELSE 0 END) AS gs, sum(tries) AS tries FROM rec GROUP BY 1, 2), q AS (SELECT *, operator = 'click' AND type IN ('t0', 't1', 't2') AS listed FROM c),
  est0 AS (SELECT type, operator, n, (proposed + 2 * CASE WHEN listed THEN 0.7 ELSE 0.3 END) / (n + 2) AS p_proposed, (fixed + 4 * CASE WHEN listed THEN 0.5 ELSE 0.05 END) / (proposed + 4) AS p_fix, greatest(0, CASE WHEN fixed > 0 THEN gs / fixed ELSE 0 END) + 0.01 AS gain, CASE WHEN proposed > 0 THEN greatest(1, tries::DOUBLE / proposed) ELSE 1 END AS cost FROM q),
  est AS (SELECT *, round(p_proposed * p_fix * gain / cost, 12) AS value FROM est0)"""


def _policy(spark, d):
    e = read(spark, d, "events")
    proposed = F.col("event_id") % 4 != 0
    fixed = proposed & (F.col("event_id") % 3 == 0)
    rec = e.select(F.concat(F.lit("t"), (F.col("user_id") % 6).cast("string")).alias("type"), F.col("event_type").alias("operator"), proposed.alias("proposed"), fixed.alias("fixed"), F.when(fixed, F.col("value") / 100).otherwise(0.0).alias("gain"), (F.col("event_id") % 3 + 1).alias("tries"))
    listed = spark.createDataFrame([(f"t{i}", "click") for i in range(3)], "type string, operator string")
    return fusion.policy(rec, listed)


@query("l04_policy_values", f"WITH {_POL} SELECT type, operator, n, round(p_proposed, 9) AS p_proposed, round(p_fix, 9) AS p_fix, round(gain, 9) AS gain, round(cost, 9) AS cost, round(value, 9) AS value, row_number() OVER (PARTITION BY type ORDER BY value DESC, operator)::INTEGER AS rank FROM est")
def l04v(spark, d):
    return _policy(spark, d).select("type", "operator", "n", *[F.round(c, 9).alias(c) for c in ("p_proposed", "p_fix", "gain", "cost", "value")], "rank")


_CONF = "pr AS (SELECT 't' || (l_partkey % 6) AS type, CASE WHEN l_suppkey % 7 <> 0 THEN 't' || (l_suppkey % 6) ELSE '_none' END AS truth FROM lineitem), cf0 AS (SELECT type, truth, count(*)::DOUBLE AS n FROM pr GROUP BY 1, 2 UNION ALL SELECT DISTINCT type, type, 2.0 FROM pr), cf1 AS (SELECT type, truth, sum(n) AS n FROM cf0 GROUP BY 1, 2), cf AS (SELECT type, truth, n / sum(n) OVER (PARTITION BY type) AS p FROM cf1)"


def _confusion(spark, d):
    t = lambda c: F.concat(F.lit("t"), (F.col(c) % 6).cast("string"))
    p = read(spark, d, "lineitem").select(t("l_partkey").alias("type"), F.when(F.col("l_suppkey") % 7 != 0, t("l_suppkey")).alias("truth"))
    return fusion.finder_confusion(p, p.select("type").distinct())


@query("l05_finder_confusion_none", f"WITH {_CONF} SELECT type, truth, round(p, 9) AS p FROM cf")
def l05n(spark, d):
    return _confusion(spark, d).withColumn("p", F.round("p", 9))


_MARG = f"{_POL}, {_CONF}, mg AS (SELECT cf.type, operator, sum(p * p_proposed * p_fix) AS p_fix, sum(p * value) AS value FROM cf JOIN est ON cf.truth = est.type GROUP BY 1, 2)"


@query("l05_marginal_fix", f"WITH {_MARG} SELECT type, operator, round(p_fix, 9) AS p_fix, round(value, 9) AS value FROM mg")
def l05m(spark, d):
    return fusion.marginal_fix(_confusion(spark, d), _policy(spark, d)).withColumns({"p_fix": F.round("p_fix", 9), "value": F.round("value", 9)})


@query("l06_suggestions", f"""WITH {_MARG}, f AS (SELECT case_id, fid, 't' || type AS type, fid % 4 AS node, confidence / 1000.0 AS confidence, x, y, w, h FROM findings WHERE detector < 2), j AS (SELECT f.*, operator, p_fix, round(mg.value * confidence, 12) AS value, CASE WHEN operator <> 'view' THEN node END AS target FROM f JOIN mg ON f.type = mg.type WHERE p_fix >= 0.1),
  k AS (SELECT *, row_number() OVER (PARTITION BY case_id, operator, target, x, y, w, h ORDER BY value DESC, fid) AS r FROM j) SELECT case_id, operator, coalesce(target, -1) AS target, count(*) AS n, round(sum(value), 6) AS value FROM k WHERE r = 1 GROUP BY 1, 2, 3""")
def l06(spark, d):
    f = view(spark, d, "findings").where("detector < 2").select("case_id", "fid", F.concat(F.lit("t"), F.col("type").cast("string")).alias("type"), (F.col("fid") % 4).alias("node"), (F.col("confidence") / 1000.0).alias("confidence"), "x", "y", "w", "h")
    s = fusion.suggestions(f, fusion.marginal_fix(_confusion(spark, d), _policy(spark, d)), 0.1, "view")
    return s.groupBy("case_id", "operator", F.coalesce("target", F.lit(-1)).alias("target")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


@query("l07_clusters")
def l07(spark, d):
    return fusion.clusters(view(spark, d, "findings"), [0, 1, 2])


@query("l08_label_clusters", """WITH v AS (SELECT case_id, node AS cluster, type, x, y, w, h FROM boxes_pred), j AS (SELECT v.case_id, v.cluster, g.type FROM v JOIN boxes_gt g ON v.case_id = g.case_id AND v.cluster = g.node CROSS JOIN LATERAL (SELECT greatest(least(v.x + v.w, g.x + g.w) - greatest(v.x, g.x), 0) * greatest(least(v.y + v.h, g.y + g.h) - greatest(v.y, g.y), 0) AS i) WHERE i > 0 AND i * 3 >= v.w * v.h + g.w * g.h)
  SELECT v.case_id, v.cluster, coalesce(j.type::VARCHAR, 'none') AS label FROM v LEFT JOIN j ON v.case_id = j.case_id AND v.cluster = j.cluster""")
def l08(spark, d):
    votes = view(spark, d, "boxes_pred").select("case_id", F.col("node").alias("cluster"), "type", "x", "y", "w", "h")
    return fusion.label_clusters(votes, view(spark, d, "boxes_gt").withColumn("fid", F.col("node")), 0.5)


_SAMPLES = """smp AS (SELECT l_orderkey * 16 + l_linenumber AS cluster, CASE WHEN max(l_suppkey) % 5 = 4 THEN 'none' ELSE 't' || (max(l_suppkey) % 5) END AS label, max(l_partkey) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber), dt AS (SELECT * FROM (VALUES (0), (1), (2)) t(detector)),
  sv AS (SELECT cluster, label, detector, CASE WHEN (k + detector * 3) % 4 <> 0 THEN CASE WHEN (k + detector) % 3 = 0 OR label = 'none' THEN 't' || ((k + detector) % 4) ELSE label END END AS type, ((k * (detector + 3)) % 101) / 100.0::DOUBLE AS confidence FROM smp CROSS JOIN dt)"""
_FIT = f"""{_SAMPLES}, cl AS (SELECT * FROM (VALUES ('t0', 'a'), ('t1', 'a'), ('t2', 'b'), ('t3', 'b'), ('none', NULL)) t(label, parent)), pc AS (SELECT cl.label, count(smp.cluster) AS k FROM cl LEFT JOIN smp ON cl.label = smp.label GROUP BY 1), pri AS (SELECT label, (k + 1.0) / (sum(k) OVER () + 5) AS p FROM pc),
  bs AS (SELECT detector, label = 'none' AS is_none, (count(type) + 1.0) / (count(*) + 2) AS m FROM sv GROUP BY 1, 2), fi AS (SELECT dt.detector, cl.label, (count(sv.type) + 4 * any_value(bs.m)) / (count(sv.cluster) + 4) AS p FROM dt CROSS JOIN cl JOIN bs ON bs.detector = dt.detector AND bs.is_none = (cl.label = 'none') LEFT JOIN sv ON sv.detector = dt.detector AND sv.label = cl.label GROUP BY 1, 2),
  ed AS (SELECT detector, list_sort(list_distinct([quantile_cont(confidence, 0.25), quantile_cont(confidence, 0.5), quantile_cont(confidence, 0.75)])) AS edges FROM sv WHERE type IS NOT NULL GROUP BY 1), vb AS (SELECT sv.*, label = 'none' AS is_none, len(list_filter(edges, lambda e: e <= confidence)) AS bucket FROM sv JOIN ed ON sv.detector = ed.detector WHERE type IS NOT NULL),
  bg AS (SELECT ed.detector, f.is_none, unnest(range(0, len(edges) + 1)) AS bucket FROM ed CROSS JOIN (VALUES (true), (false)) f(is_none)), bk AS (SELECT bg.detector, bg.is_none, bg.bucket, (count(vb.cluster) + 1.0) / sum(count(vb.cluster) + 1) OVER (PARTITION BY bg.detector, bg.is_none) AS p FROM bg LEFT JOIN vb ON bg.detector = vb.detector AND bg.is_none = vb.is_none AND bg.bucket = vb.bucket GROUP BY 1, 2, 3),
  ac AS (SELECT detector, (count(*) FILTER (type = label) + 1.0) / (count(*) + 2) AS acc FROM vb WHERE NOT is_none GROUP BY 1), sp AS (SELECT detector, type, count(*) AS spur FROM vb WHERE is_none GROUP BY 1, 2), kk AS (SELECT detector, label, type, count(*) AS k FROM vb GROUP BY 1, 2, 3),
  cg AS (SELECT dt.detector, cl.label, ty.label AS type, acc, coalesce(spur, 0) AS spur, coalesce(k, 0) AS k, cl.parent = ty.parent AND cl.label <> ty.label AS peer FROM dt CROSS JOIN cl CROSS JOIN (SELECT * FROM cl WHERE label <> 'none') ty JOIN ac ON ac.detector = dt.detector LEFT JOIN sp ON sp.detector = dt.detector AND sp.type = ty.label LEFT JOIN kk ON kk.detector = dt.detector AND kk.label = cl.label AND kk.type = ty.label),
  cn AS (SELECT detector, label, type, (k + 4 * CASE WHEN label = 'none' THEN (spur + 1.0) / (sum(spur) OVER (PARTITION BY detector, label) + 4) WHEN label = type THEN acc WHEN peer THEN (1 - acc) * 0.6 ELSE (1 - acc) * 0.4 / 2 END) / (sum(k) OVER (PARTITION BY detector, label) + 4) AS p FROM cg)"""


def _samples(spark, d):
    t = read(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("cluster")).agg(F.max("l_suppkey").alias("s"), F.max("l_partkey").alias("k"))
    t = t.withColumn("label", F.when(F.col("s") % 5 == 4, "none").otherwise(F.concat(F.lit("t"), (F.col("s") % 5).cast("string")))).withColumn("detector", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    odd = ((F.col("k") + F.col("detector")) % 3 == 0) | (F.col("label") == "none")
    type_ = F.when((F.col("k") + F.col("detector") * 3) % 4 != 0, F.when(odd, F.concat(F.lit("t"), ((F.col("k") + F.col("detector")) % 4).cast("string"))).otherwise(F.col("label")))
    return t.select("cluster", "label", "detector", type_.alias("type"), (((F.col("k") * (F.col("detector") + 3)) % 101) / 100.0).alias("confidence"))


def _model(spark, d):
    classes = spark.createDataFrame([("t0", "a"), ("t1", "a"), ("t2", "b"), ("t3", "b"), ("none", None)], "label string, parent string")
    return fusion.fit_fusion(_samples(spark, d), classes)


@query("l09_fusion_fit", f"WITH {_FIT} SELECT 'prior' AS what, '' AS detector, label, '' AS type, round(p, 9) AS p FROM pri UNION ALL SELECT 'fire', detector::VARCHAR, label, '', round(p, 9) FROM fi UNION ALL SELECT 'bucket', detector::VARCHAR, is_none::VARCHAR, bucket::VARCHAR, round(p, 9) FROM bk UNION ALL SELECT 'confusion', detector::VARCHAR, label, type, round(p, 9) FROM cn")
def l09(spark, d):
    m = _model(spark, d)
    s = lambda c: F.col(c).cast("string")
    no = F.lit("")
    row = lambda df, what, a, b, c: df.select(F.lit(what).alias("what"), a.alias("detector"), b.alias("label"), c.alias("type"), F.round("p", 9).alias("p"))
    return row(m["prior"], "prior", no, s("label"), no).unionByName(row(m["fire"], "fire", s("detector"), s("label"), no)).unionByName(row(m["bucket"], "bucket", s("detector"), s("is_none"), s("bucket"))).unionByName(row(m["confusion"], "confusion", s("detector"), s("label"), s("type")))


_POST = f"""{_FIT}, sb AS (SELECT sv.cluster, sv.detector, sv.type, CASE WHEN type IS NOT NULL THEN len(list_filter(edges, lambda e: e <= confidence)) END AS bucket FROM sv JOIN ed ON sv.detector = ed.detector),
  ll AS (SELECT sb.cluster, fi.label, sum(CASE WHEN sb.type IS NULL THEN ln(1 - fi.p) ELSE ln(fi.p) + ln(bk.p) + ln(cn.p) END) + ln(any_value(pri.p)) AS l FROM sb JOIN fi ON sb.detector = fi.detector JOIN pri ON pri.label = fi.label LEFT JOIN bk ON bk.detector = sb.detector AND bk.is_none = (fi.label = 'none') AND bk.bucket = sb.bucket LEFT JOIN cn ON cn.detector = sb.detector AND cn.label = fi.label AND cn.type = sb.type GROUP BY 1, 2),
  ex AS (SELECT *, exp(l - max(l) OVER (PARTITION BY cluster)) AS e FROM ll), po AS (SELECT cluster, label, e / sum(e) OVER (PARTITION BY cluster) AS p FROM ex)"""


@query("l10_posterior", f"WITH {_POST} SELECT cluster, label, round(p, 6) AS p FROM po")
def l10(spark, d):
    return fusion.posterior(_samples(spark, d), _model(spark, d)).withColumn("p", F.round("p", 6))


@query("l10_emitted", f"WITH {_POST} SELECT cluster, round(1 - sum(CASE WHEN label = 'none' THEN p ELSE 0 END), 6) AS p_error, arg_max(label, CASE WHEN label <> 'none' THEN {{'p': round(p, 12), 'l': label}} END) AS type FROM po GROUP BY 1 HAVING 1 - sum(CASE WHEN label = 'none' THEN p ELSE 0 END) >= 0.5")
def l10e(spark, d):
    return fusion.emitted(fusion.posterior(_samples(spark, d), _model(spark, d))).withColumn("p_error", F.round("p_error", 6))


@query("l14_observations", "SELECT DISTINCT signature, screen, answer FROM (SELECT user_id % 40 AS signature, user_id AS screen, CASE WHEN event_type = 'click' THEN 'c' || (event_id % 3) WHEN event_type = 'view' THEN 'none' WHEN event_id % 2 = 0 THEN 'p' || (event_id % 5) END AS answer FROM events) WHERE answer IS NOT NULL")
def l14(spark, d):
    t = F.col("event_type")
    i = read(spark, d, "events").select(F.col("user_id").alias("bundle"), (F.col("user_id") % 40).alias("signature"), F.when(t == "click", "component").when(t == "view", "deleted").otherwise("confirm").alias("kind"), F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")).alias("predicted"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("value"), ((t != "click") & (t != "view") & (F.col("event_id") % 2 == 0)).alias("confirmed"))
    return feedback.observations(i)


@query("l17_promotion", f"WITH {_RULES}, r AS (SELECT w.signature, answer, support, support::DOUBLE / (support + coalesce(against, 0)) AS c FROM w LEFT JOIN g ON w.signature = g.signature WHERE r = 1) SELECT signature, answer, CASE WHEN signature % 2 = 0 THEN 'view' ELSE '' END AS old_answer, support, CASE WHEN signature % 2 = 0 THEN 'changed' ELSE 'added' END AS change FROM r WHERE support >= 2 AND c >= 0.1 AND NOT (signature % 2 = 0 AND answer = 'view')")
def l17(spark, d):
    rules = learning.derive_rules(view(spark, d, "corrections"))
    shared = rules.where("signature % 2 = 0").select("signature", F.lit("view").alias("answer"))
    return feedback.promotion(rules, shared, 2, 0.1).withColumn("old_answer", F.coalesce("old_answer", F.lit("")))


_CHECK = "ck AS (SELECT g.case_id, g.node, CASE g.node % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'move' WHEN 2 THEN 'deleted' ELSE 'sing' END AS kind, CASE g.node % 4 WHEN 0 THEN coalesce(p.text = g.text, false) WHEN 1 THEN coalesce(greatest(abs(p.x - g.x), abs(p.y - g.y)) <= 2, false) WHEN 2 THEN p.node IS NULL END AS ok FROM nodes_gt g LEFT JOIN nodes_pred p ON g.case_id = p.case_id AND g.node = p.node)"


def _checks(spark, d):
    k = F.col("node") % 4
    c = view(spark, d, "nodes_gt").select("case_id", "node", F.when(k == 0, "text").when(k == 1, "move").when(k == 2, "deleted").otherwise("sing").alias("kind"), F.when(k == 0, F.col("text")).otherwise(F.concat_ws(",", "x", "y")).alias("value"))
    return feedback.check_corrections(c, view(spark, d, "nodes_pred").select("case_id", "node", "text", "component", "glyph", "x", "y", "w", "h"))


@query("l18_check_corrections", f"WITH {_CHECK} SELECT case_id, node, kind, coalesce(ok::VARCHAR, 'unknown') AS ok FROM ck")
def l18(spark, d):
    return _checks(spark, d).withColumn("ok", F.coalesce(F.col("ok").cast("string"), F.lit("unknown")))


@query("l19_user_evaluation", f"WITH {_CHECK}, e AS (SELECT case_id % 4 AS run, kind, count(*) AS n, avg(ok::INT) AS accuracy FROM ck WHERE ok IS NOT NULL GROUP BY GROUPING SETS ((case_id % 4, kind), (case_id % 4))) SELECT run, coalesce(kind, 'all') AS kind, n, round(accuracy, 9) AS accuracy, round(coalesce(lag(accuracy) OVER (PARTITION BY kind ORDER BY run), -1), 9) AS before FROM e")
def l19(spark, d):
    e = feedback.user_evaluation(_checks(spark, d).withColumn("run", F.col("case_id") % 4))
    return e.select("run", "kind", "n", F.round("accuracy", 9).alias("accuracy"), F.round(F.coalesce("before", F.lit(-1.0)), 9).alias("before"))


@query("l20_accepted_rules", "WITH c AS (SELECT p_partkey AS signature, p_type AS answer, p_size AS evidence FROM part) SELECT signature, answer, evidence FROM c WHERE NOT (signature % 3 = 0 AND evidence % 2 = 0) AND signature % 5 <> 0")
def l20(spark, d):
    c = read(spark, d, "part").select(F.col("p_partkey").alias("signature"), F.col("p_type").alias("answer"), F.col("p_size").alias("evidence"))
    # rejected on other evidence counts for nothing
    rejected = c.where("signature % 3 = 0").withColumn("evidence", F.when(F.col("evidence") % 2 == 0, F.col("evidence")).otherwise(-1))
    return feedback.accepted_rules(c, rejected, c.where("signature % 5 = 0"))


@query("l21_status", "SELECT 'items' AS what, event_type AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'bundles', 'all', count(DISTINCT user_id) FROM events UNION ALL SELECT 'rules', CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'inactive' END, count(*) FROM part GROUP BY 2")
def l21(spark, d):
    b = read(spark, d, "events").select(F.col("user_id").alias("bundle"), F.col("event_type").alias("kind"))
    return feedback.status(b, read(spark, d, "part").select((F.col("p_size") % 2 == 0).alias("active")))


@query("l27_ledger_entries", "WITH c AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'song' ELSE 'param' END AS kind, CASE WHEN event_id % 7 <> 0 THEN 'k' || (user_id % 20) END AS key, event_id AS new FROM events) SELECT event_id, CASE WHEN kind = 'song' OR key IS NULL THEN '' ELSE 'param-' || substr(sha1(key || chr(31) || new || chr(31) || 'now'), 1, 10) END AS id, CASE WHEN kind = 'song' THEN 'unknown kind' WHEN key IS NULL THEN 'no key' ELSE '' END AS reason FROM c")
def l27(spark, d):
    e = read(spark, d, "events")
    c = e.select("event_id", F.when(F.col("event_id") % 9 == 0, "song").otherwise("param").alias("kind"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string"))).alias("key"), F.lit(None).cast("long").alias("old"), F.col("event_id").alias("new"), F.lit("now").alias("ts"), F.lit(True).alias("accepted"))
    good, bad = feedback.ledger_entries(c)
    return good.select("event_id", "id", F.lit("").alias("reason")).unionByName(bad.select("event_id", F.lit("").alias("id"), "reason"))


@query("l28_reverts", """WITH u AS (SELECT DISTINCT reverts AS id FROM ledger WHERE accepted AND reverts IS NOT NULL), s AS (SELECT k, new_value AS now, row_number() OVER (PARTITION BY k ORDER BY ts DESC, id DESC) AS n FROM ledger WHERE accepted AND reverts IS NULL AND id NOT IN (SELECT id FROM u)),
  w AS (SELECT id FROM ledger WHERE id % 2 = 0 UNION ALL SELECT -id - 1 FROM ledger WHERE id % 50 = 0)
  SELECT w.id, CASE WHEN accepted IS NULL THEN 'unknown' WHEN NOT accepted THEN 'rejected' WHEN u.id IS NOT NULL THEN 'already reverted' WHEN now IS DISTINCT FROM new_value THEN 'drifted' ELSE 'ok' END AS verdict FROM w LEFT JOIN ledger l ON w.id = l.id LEFT JOIN u ON w.id = u.id LEFT JOIN s ON l.k = s.k AND s.n = 1""")
def l28(spark, d):
    e = view(spark, d, "ledger").withColumn("old_value", F.lit(0))
    w = e.where("id % 2 = 0").select("id").union(e.where("id % 50 = 0").select(-F.col("id") - 1))
    return feedback.reverts(w, e).select("id", "verdict")


@query("l30_mined_failures", """WITH b AS (SELECT case_id, node AS fid, radius + node / 100.0 AS error, x, y, w, h FROM nodes_gt WHERE radius > 8), k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY error DESC, fid) AS rank FROM b), t AS (SELECT * FROM k WHERE rank <= 2 AND case_id % 5 <> 0)
  SELECT case_id, fid, greatest(0, x - 24) AS crop_x, h + 48 AS crop_h, 99 + row_number() OVER (ORDER BY case_id, fid) AS index FROM t""")
def l30(spark, d):
    b = view(spark, d, "nodes_gt").select("case_id", F.col("node").alias("fid"), (F.col("radius") + F.col("node") / 100.0).alias("error"), "radius", "x", "y", "w", "h").where("radius > 8").drop("radius")
    known = b.where("case_id % 5 = 0").select("case_id", "fid", F.lit(99).cast("long").alias("index"))
    return feedback.mined_failures(b, known, 8.0, per_run=2).select("case_id", "fid", "crop_x", "crop_h", "index")
