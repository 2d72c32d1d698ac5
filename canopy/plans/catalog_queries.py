"""Registered queries of tokens, parameters, aliases, nesting and tile statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import geometry as G
from canopy.operators import catalog, spatial
from canopy.plans.views import view
from canopy.registry import _HITS, _hits, query, read


@query("j18_layered_params", """WITH l AS (SELECT p_partkey AS key, p_size::BIGINT AS value, 0 AS o, 'default' AS layer FROM part UNION ALL SELECT s_suppkey, 100 + s_nationkey, 1, 'global' FROM supplier UNION ALL SELECT c_custkey, 1000 + c_nationkey, 2, 'local' FROM customer),
  r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o DESC) AS n FROM l) SELECT key, value, layer FROM r WHERE n = 1""")
def j18(spark, d):
    default = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("value"))
    whole = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_nationkey") + 100).cast("long").alias("value"))
    local = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") + 1000).cast("long").alias("value"))
    return catalog.layered([("default", default), ("global", whole), ("local", local)])


@query("j32_aliases", "WITH n AS (SELECT DISTINCT p_name AS name, p_size AS code FROM part), f AS (SELECT code, min(name) AS first FROM n GROUP BY code HAVING count(*) > 1) SELECT n.code, name, first FROM n JOIN f ON n.code = f.code")
def j32(spark, d):
    return catalog.aliases(read(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("code")))


@query("j33_retheme", """WITH t AS (SELECT 'theme.' || token AS token, r, g, b FROM tokens), c AS (SELECT CASE WHEN priority % 2 = 0 THEN token ELSE 'theme.' || token END AS token, b AS r, r AS g, g AS b FROM tokens WHERE priority % 3 = 0 UNION ALL SELECT r_name, r_regionkey, 7, 9 FROM region)
  SELECT t.token, coalesce(c.r, t.r) AS r, coalesce(c.g, t.g) AS g, coalesce(c.b, t.b) AS b, CASE WHEN c.token IS NULL THEN 'kept' ELSE 'replaced' END AS source FROM t LEFT JOIN c ON c.token = t.token OR 'theme.' || c.token = t.token
  UNION ALL SELECT token, r, g, b, 'added' FROM c WHERE token NOT IN (SELECT token FROM t) AND 'theme.' || token NOT IN (SELECT token FROM t)""")
def j33(spark, d):
    t = view(spark, d, "tokens")
    named = F.concat(F.lit("theme."), F.col("token"))
    long = lambda c: F.col(c).cast("long")
    old = t.select(named.alias("token"), long("r").alias("r"), long("g").alias("g"), long("b").alias("b"))
    new = t.where("priority % 3 = 0").select(F.when(F.col("priority") % 2 == 0, F.col("token")).otherwise(named).alias("token"), long("b").alias("r"), long("r").alias("g"), long("g").alias("b"))
    new = new.unionByName(read(spark, d, "region").select(F.col("r_name").alias("token"), long("r_regionkey").alias("r"), F.lit(7).cast("long").alias("g"), F.lit(9).cast("long").alias("b")))
    return catalog.retheme(old, new, ["r", "g", "b"])


@query("l15_height_clusters", """WITH n AS (SELECT type, h, count(*) AS n FROM boxes_gt GROUP BY 1, 2), f AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY type ORDER BY h) <= 1 THEN 0 ELSE 1 END AS fresh FROM n), c AS (SELECT *, sum(fresh) OVER (PARTITION BY type ORDER BY h) AS cluster FROM f)
  SELECT type AS signature, cluster::BIGINT AS cluster, min(h) AS lo, max(h) AS hi, sum(n)::BIGINT AS n FROM c GROUP BY type, cluster""")
def l15(spark, d):
    return catalog.height_clusters(view(spark, d, "boxes_gt").select(F.col("type").alias("signature"), "h"), 1)


@query("l23_typescale", """WITH g AS (SELECT p_size, p_brand, count(*) AS n, median(p_retailprice) AS line_height FROM part GROUP BY 1, 2), k AS (SELECT p_size, p_brand, p_type, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_size, p_brand, p_type)
  SELECT g.p_size AS size, g.p_brand AS weight, n, round(line_height, 6) AS line_height, p_type AS family FROM g JOIN k ON g.p_size = k.p_size AND g.p_brand = k.p_brand WHERE r = 1""")
def l23(spark, d):
    t = read(spark, d, "part").select(F.col("p_size").alias("size"), F.col("p_brand").alias("weight"), F.col("p_retailprice").alias("line_height"), F.col("p_type").alias("family"))
    return catalog.typescale(t).withColumn("line_height", F.round("line_height", 6))


@query("l24_shape_tokens", "SELECT radius, count(*) AS n, bool_or(radius * 2 >= least(w, h)) AS pill FROM colors GROUP BY radius")
def l24(spark, d):
    return catalog.shape_tokens(view(spark, d, "colors"))


@query("n04_tile_alarms", """WITH t AS (SELECT case_id, node AS tile, (x % 97 + 1) / 97.0E0 AS a, (w % 89 + 1) / 89.0E0 AS b FROM boxes_gt)
  SELECT case_id, tile, round(count(*) OVER (PARTITION BY case_id) * 2 * least(a, b), 9) AS nfa, CASE WHEN a <= b THEN 'area' ELSE 'width' END AS fired FROM t""")
def n04(spark, d):
    t = view(spark, d, "boxes_gt").withColumn("tile", F.col("node"))
    p = {"area": (F.col("x") % 97 + 1) / F.lit(97.0), "width": (F.col("w") % 89 + 1) / F.lit(89.0)}
    return catalog.tile_alarms(t, p).withColumn("nfa", F.round("nfa", 9))


@query("n05_alarm_curve", f"WITH {_HITS} SELECT e.eps::INTEGER AS eps, count(*) FILTER (WHERE 1000 - confidence <= e.eps) AS n FROM h CROSS JOIN (SELECT unnest([10, 50, 100, 200, 500]) AS eps) e WHERE hit = 0 GROUP BY 1")
def n05(spark, d):
    return catalog.alarm_curve(_hits(spark, d).where("NOT hit").select((F.lit(1000) - F.col("confidence")).alias("score")), [10, 50, 100, 200, 500])


@query("n14_fold_weak", """WITH j AS (SELECT *, magnitude < median(magnitude) OVER (PARTITION BY case_id) * 0.5 AS weak FROM findings)
  SELECT case_id, fid, 1::BIGINT AS n, 'finding' AS kind FROM j WHERE NOT weak UNION ALL SELECT case_id, -1, count(*), 'abstain' FROM j WHERE weak GROUP BY case_id""")
def n14(spark, d):
    return catalog.fold_weak(view(spark, d, "findings"), 0.5).withColumn("fid", F.coalesce("fid", F.lit(-1)))


@query("t05_fit_descendants", """WITH RECURSIVE up(id, ancestor) AS (SELECT id, id FROM tree UNION ALL SELECT up.id, tree.parent FROM up JOIN tree ON up.ancestor = tree.id WHERE tree.parent IS NOT NULL)
  SELECT ancestor AS id, min(x) AS x, min(y) AS y, max(x + w) AS x2, max(y + h) AS y2 FROM up JOIN boxes_gt ON up.id = 'o' || case_id GROUP BY ancestor""")
def t05(spark, d):
    b = view(spark, d, "boxes_gt").select(F.concat(F.lit("o"), F.col("case_id").cast("string")).alias("id"), "x", "y", (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return catalog.fit_descendants(view(spark, d, "tree"), b)


@query("t06_visibility", """WITH RECURSIVE o AS (SELECT id, parent, (k % 9) / 8.0E0 AS opacity FROM tree), down(id, shown) AS (SELECT id, opacity FROM o WHERE parent IS NULL UNION ALL SELECT o.id, down.shown * o.opacity FROM down JOIN o ON o.parent = down.id)
  SELECT id, round(shown, 9) AS shown, shown > 0.02 AS visible FROM down""")
def t06(spark, d):
    return catalog.visibility(view(spark, d, "tree").withColumn("opacity", (F.col("k") % 9) / F.lit(8.0))).withColumn("shown", F.round("shown", 9))


@query("t17_strict_sequences", """WITH s AS (SELECT case_id, type, coalesce(lead(y) OVER (PARTITION BY case_id, type ORDER BY y, node) >= y + h, true) AS clear FROM boxes_pred)
  SELECT case_id, type, count(*) AS n FROM s GROUP BY case_id, type HAVING count(*) >= 3 AND bool_and(clear)""")
def t17(spark, d):
    return catalog.strict_sequences(view(spark, d, "boxes_pred"), ["case_id", "type"])


@query("t19_occlusion", """SELECT a.case_id, a.node, count(*) AS covers, max(b.type) AS strongest FROM boxes_pred a JOIN boxes_pred b ON a.case_id = b.case_id AND b.node > a.node
  AND greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) * 10 >= a.w * a.h
  AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y) GROUP BY 1, 2""")
def t19(spark, d):
    p = view(spark, d, "boxes_pred")
    over = (F.col("r_node") > F.col("l_node")) & (G.overlap("l_", "r_") * 10 >= G.area("l_"))
    return spatial.spatial_join(p, p, condition=over).groupBy("case_id", F.col("l_node").alias("node")).agg(F.count("*").alias("covers"), F.max("r_type").alias("strongest"))


@query("t31_clamp", "WITH c AS (SELECT case_id, node, greatest(0, x) AS x, greatest(0, y) AS y, least(320, x + w) - greatest(0, x) AS w, least(200, y + h) - greatest(0, y) AS h FROM boxes_pred) SELECT * FROM c WHERE w > 0 AND h > 0")
def t31(spark, d):
    return catalog.clamp(view(spark, d, "boxes_pred"), 320, 200).select("case_id", "node", "x", "y", "w", "h")
