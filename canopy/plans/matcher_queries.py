"""Registered queries of catalog matching, learned rules, corrections and readings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import color as C
from canopy.functions import geometry as G
from canopy.functions import text as X
from canopy.operators import differ, learning, mapping, matcher, pixels, spatial, tokens
from canopy.plans.differ_queries import _M, _UP
from canopy.plans.pixel_queries import _DE, delta
from canopy.plans.views import view
from canopy.registry import _lab, query, read


@query("f01_box_predicates", """SELECT a.case_id, a.node AS l_node, b.node AS r_node, b.x >= a.x - 0.5 AND b.y >= a.y - 0.5 AND b.x + b.w <= a.x + a.w + 0.5 AND b.y + b.h <= a.y + a.h + 0.5 AS holds, b.x + b.w / 2.0 >= a.x AND b.x + b.w / 2.0 < a.x + a.w AND b.y + b.h / 2.0 >= a.y AND b.y + b.h / 2.0 < a.y + a.h AS centre
  FROM boxes_gt a JOIN boxes_gt b ON a.case_id = b.case_id AND b.node = a.node + 1""")
def f01p(spark, d):
    b = view(spark, d, "boxes_gt")
    left = b.select("case_id", *[F.col(c).alias(f"l_{c}") for c in ("node", *"xywh")])
    j = left.join(b.select("case_id", *[F.col(c).alias(f"r_{c}") for c in ("node", *"xywh")]).withColumn("l_node", F.col("r_node") - 1), ["case_id", "l_node"])
    return j.select("case_id", "l_node", "r_node", G.contains("l_", "r_").alias("holds"), G.contains_centre("l_", "r_").alias("centre"))


@query("f05_colour_classes", f"""WITH q AS (SELECT id, r, g, b, {_lab('')} FROM colors) SELECT id, CASE WHEN sqrt(a * a + bb * bb) < 12 THEN 'neutral-' ELSE 'accent-' END || CASE WHEN l >= 75 THEN 'light' WHEN l <= 35 THEN 'dark' ELSE 'mid' END AS class, round(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) ELSE 0 END, 9) AS saturation FROM q""")
def f05(spark, d):
    rgb = [F.col(c) for c in "rgb"]
    c = view(spark, d, "colors").withColumns(dict(zip(("l", "la", "lb"), C.lab(*rgb), strict=True)))
    return c.select("id", matcher.colour_class(F.col("l"), F.col("la"), F.col("lb")).alias("class"), F.round(matcher.saturation(*rgb), 9).alias("saturation"))


@query("f06_blend_fit", """WITH c AS (SELECT id, (r + 30) % 256 AS cr, g AS cg, b AS cb, r AS o1, g AS o2, b AS o3, radius * 10 AS k FROM colors), v AS (SELECT *, o1 - k AS v1, o2 - k AS v2, o3 - k AS v3 FROM c), a AS (SELECT *, v1 * v1 + v2 * v2 + v3 * v3 AS n FROM v),
  f AS (SELECT *, CASE WHEN n > 0 THEN greatest(0.0, least(1.0, ((cr - k) * v1 + (cg - k) * v2 + (cb - k) * v3)::DOUBLE / n)) ELSE 0.0 END AS alpha FROM a) SELECT id, round(alpha, 9) AS alpha, round(sqrt(pow(cr - k - v1 * alpha, 2) + pow(cg - k - v2 * alpha, 2) + pow(cb - k - v3 * alpha, 2)), 6) AS residual FROM f""")
def f06(spark, d):
    own = tuple(F.col(c) for c in "rgb")
    alpha, rest = C.blend_fit(((F.col("r") + 30) % 256, F.col("g"), F.col("b")), own, (F.col("radius") * 10,) * 3)
    return view(spark, d, "colors").select("id", F.round(alpha, 9).alias("alpha"), F.round(rest, 6).alias("residual"))


@query("f08_whole_and_lines", """WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents), u AS (SELECT doc_id, len(a) AS n, unnest(a) AS line, unnest(range(len(a))) AS k FROM t)
  SELECT doc_id, k::INTEGER AS k, round(k * 100.0 / n, 6) AS y0, round((k + 1) * 100.0 / n, 6) AS y1, length(line)::INTEGER AS chars FROM u WHERE n > 1 AND trim(line) <> '' UNION ALL SELECT doc_id, -1, 0, 100, length(text)::INTEGER FROM t WHERE trim(text, chr(32) || chr(10)) <> ''""")
def f08w(spark, d):
    return X.text_parts(read(spark, d, "documents"), ["doc_id"], "text").withColumns({"y0": F.round("y0", 6), "y1": F.round("y1", 6)})


@query("f10_fold_look_alikes", "SELECT p_partkey, 'COPE ' || p_name AS folded FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'да ' || p_name FROM part WHERE p_partkey % 2 = 1")
def f10(spark, d):
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("СОРЕ "), F.col("p_name"))).otherwise(F.concat(F.lit("да "), F.col("p_name")))
    return read(spark, d, "part").select("p_partkey", X.fold_look_alikes(mixed).alias("folded"))


@query("f11_lengths", "SELECT p_partkey, (p_size * CASE WHEN p_partkey % 3 = 0 THEN 16 ELSE 1 END)::DOUBLE AS px FROM part WHERE p_partkey % 4 <> 3 UNION ALL SELECT p_partkey, -1 FROM part WHERE p_partkey % 4 = 3")
def f11l(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 3, "auto").when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("rem"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" px")))
    return read(spark, d, "part").select("p_partkey", F.coalesce(X.parse_px(text), F.lit(-1.0)).alias("px"))


@query("f12_variant_names", "SELECT p_partkey, p_type AS style, CASE WHEN p_size % 2 = 0 THEN 'Enabled' ELSE 'Disabled' END AS state, 'Small' AS size FROM part")
def f12(spark, d):
    p = read(spark, d, "part")
    name = F.concat(F.lit("Style="), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, "").otherwise(", State=Disabled"), F.lit(", Junk=1"))
    v = X.project_variant(X.parse_variant(name), {"Style": ["ECONOMY"], "State": ["Enabled", "Disabled"], "Size": ["Small", "Large"]})
    return p.select("p_partkey", v["Style"].alias("style"), v["State"].alias("state"), v["Size"].alias("size"))


@query("f13_count_score", "SELECT id, greatest(0.0, 1 - 0.5 * greatest(3 - radius, radius - 9, 0)) AS score FROM colors")
def f13c(spark, d):
    return view(spark, d, "colors").select("id", matcher.count_score(F.col("radius"), F.lit(3), F.lit(9)).alias("score"))


_RULES = "CASE id % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'pill' WHEN 2 THEN 'none' ELSE '8' END"


@query("f14_scores", f"""WITH c AS (SELECT *, greatest(1, least(w, h)) AS short, {_RULES} AS rule FROM colors)
  SELECT id, round(CASE rule WHEN 'any' THEN 1 WHEN 'pill' THEN CASE WHEN radius >= short * 0.42 THEN 1 ELSE greatest(0, radius / (short / 2.0)) END WHEN 'none' THEN CASE WHEN radius <= 2 THEN 1 ELSE greatest(0, 1 - (radius - 2) / 4.0) END
    ELSE CASE WHEN radius >= short * 0.42 AND 8 < short / 2.0 - 2 THEN 0 ELSE greatest(0, 1 - greatest(6 - radius, radius - 10, 0) / 4.0) END END, 9) AS radius_score, round(CASE WHEN w <= 6 THEN 1 ELSE greatest(0, 1 - (w - 6) / 6.0) END, 9) AS color_score,
    round(abs(16 - radius) / 1.5 + abs(400 - w) / 150.0 + abs(20 - h) / 4.0, 9) AS type_distance FROM c""")
def f14(spark, d):
    k = F.col("id") % 4
    rule = F.when(k == 0, "any").when(k == 1, "pill").when(k == 2, "none").otherwise("8")
    c = view(spark, d, "colors")
    return c.select("id", F.round(matcher.radius_score(F.col("radius"), F.col("w"), F.col("h"), rule), 9).alias("radius_score"), F.round(matcher.color_score(F.col("w")), 9).alias("color_score"), F.round(matcher.type_distance(F.lit(16), F.lit(400), F.lit(20), F.col("radius"), F.col("w"), F.col("h")), 9).alias("type_distance"))


@query("f18_signatures", "SELECT case_id, substr(sha1('frame' || chr(31) || CASE WHEN radius < 2 THEN 'square' WHEN radius * 2 >= least(w, h) THEN 'pill' ELSE 'round' END || chr(31) || CASE WHEN shadow > 0 THEN 'shadow' ELSE 'flat' END || chr(31) || kinds), 1, 16) AS signature FROM (SELECT case_id, max(radius) FILTER (node = 1) AS radius, max(w) FILTER (node = 1) AS w, max(h) FILTER (node = 1) AS h, max(shadow) FILTER (node = 1) AS shadow FROM nodes_gt GROUP BY 1) r JOIN (SELECT case_id, string_agg(type::VARCHAR, ',' ORDER BY node) AS kinds FROM (SELECT *, lag(type) OVER (PARTITION BY case_id ORDER BY node) AS before FROM nodes_gt WHERE node > 1) WHERE before IS DISTINCT FROM type GROUP BY 1) k USING (case_id)")
def f18(spark, d):
    n = view(spark, d, "nodes_gt")
    root = n.where("node = 1").select("case_id", F.lit("frame").alias("type"), "radius", "w", "h", "shadow")
    atoms = n.where("node > 1").select("case_id", F.col("node").alias("position"), F.col("type").cast("string").alias("kind"))
    return learning.signatures(root, atoms)


@query("f20_type_gate", "SELECT t.type AS a, u.type AS b, count(*) AS n FROM boxes_gt t JOIN boxes_pred u ON t.case_id = u.case_id AND t.node = u.node AND (t.type = u.type OR (t.type IN (0, 1, 4) AND u.type IN (0, 1, 4))) GROUP BY 1, 2")
def f20(spark, d):
    a = view(spark, d, "boxes_gt").select("case_id", "node", F.col("type").alias("a"))
    j = a.join(view(spark, d, "boxes_pred").select("case_id", "node", F.col("type").alias("b")), ["case_id", "node"])
    return learning.compatible(j, "a", "b", [[0, 1, 4]]).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("f21_taxonomy", "SELECT CASE event_type WHEN 'click' THEN 'geometry.shift' WHEN 'view' THEN 'color.fill' WHEN 'error' THEN 'noise.antialias' ELSE 'other.thing' END AS type, CASE event_type WHEN 'click' THEN 'geometry' WHEN 'view' THEN 'color' WHEN 'error' THEN 'noise' ELSE 'other' END AS parent, CASE event_type WHEN 'error' THEN false WHEN 'click' THEN true WHEN 'view' THEN true END IS TRUE AS is_error, count(*) AS n FROM events GROUP BY ALL")
def f21(spark, d):
    e = read(spark, d, "events").select(F.when(F.col("event_type") == "click", "geometry.shift").when(F.col("event_type") == "view", "color.fill").when(F.col("event_type") == "error", "noise.antialias").otherwise("other.thing").alias("type"))
    return learning.with_taxonomy(e).groupBy("type", "parent", F.coalesce("is_error", F.lit(False)).alias("is_error")).agg(F.count("*").alias("n"))


@query("f22_correction_values", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN '' ELSE 'a b' END WHEN event_id % 4 = 1 THEN printf('#%06x', event_id) WHEN event_id % 4 = 2 THEN '1,2,3,4' ELSE '' END AS value, CASE WHEN event_id % 8 = 0 THEN 'empty text' WHEN event_id % 4 = 3 THEN 'unknown kind' ELSE '' END AS reason FROM events")
def f22(spark, d):
    k = F.col("event_id")
    e = read(spark, d, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in ("text", "recolour", "move", "dance")]), (k % 4 + 1).cast("int")).alias("kind"), F.when(k % 8 == 0, "  ").when(k % 4 == 0, "  a\n b ").when(k % 4 == 1, F.upper(F.format_string("#%06x", "event_id"))).otherwise("1, 2,3 ,4").alias("value"))
    c = learning.canonical_values(e)
    return c.select("event_id", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("j08_type_roles", """WITH s AS (SELECT DISTINCT node AS k, size, weight FROM nodes_gt), r AS (SELECT n_name AS role, n_nationkey AS priority, 11 + n_nationkey % 9 AS size, 400 + 100 * (n_nationkey % 4) AS weight FROM nation), p AS (SELECT s.size, s.weight, role, priority, round(abs(s.size - r.size) / 1.5 + abs(s.weight - r.weight) / 150.0, 9) AS d FROM (SELECT DISTINCT size, weight FROM s) s CROSS JOIN r),
  b AS (SELECT *, row_number() OVER (PARTITION BY size, weight ORDER BY d, priority, role) AS k FROM p) SELECT n.case_id, n.node, CASE WHEN d <= 1.5 THEN role ELSE '' END AS role, d AS distance FROM nodes_gt n JOIN b ON n.size = b.size AND n.weight = b.weight WHERE k = 1""")
def j08t(spark, d):
    roles = read(spark, d, "nation").select(F.col("n_name").alias("role"), F.col("n_nationkey").alias("priority"), (F.col("n_nationkey") % 9 + 11).alias("size"), ((F.col("n_nationkey") % 4) * 100 + 400).alias("weight"), F.lit(None).cast("double").alias("line"))
    texts = view(spark, d, "nodes_gt").select(F.struct("case_id", "node").alias("id"), "size", "weight", F.lit(None).cast("double").alias("line"))
    return matcher.nearest_role(texts, roles).select("id.case_id", "id.node", F.coalesce("role", F.lit("")).alias("role"), "distance")


@query("j08_elevation", "WITH l AS (SELECT r_name AS level, r_regionkey * 4 AS reach FROM region), p AS (SELECT c.id, level, abs(radius - reach) AS d, row_number() OVER (PARTITION BY c.id ORDER BY abs(radius - reach), reach, level) AS k FROM colors c CROSS JOIN l) SELECT id, CASE WHEN d <= 3 THEN level ELSE '' END AS level FROM p WHERE k = 1")
def j08e(spark, d):
    levels = read(spark, d, "region").select(F.col("r_name").alias("level"), (F.col("r_regionkey") * 4).alias("reach"))
    return matcher.nearest_level(view(spark, d, "colors").select("id", F.col("radius").alias("value")), levels).select("id", F.coalesce("level", F.lit("")).alias("level"))


@query("j09_token_maps", """WITH k AS (SELECT c.id, t.radius AS tr, row_number() OVER (PARTITION BY c.id ORDER BY abs(t.radius - c.radius), t.radius) AS k, abs(t.radius - c.radius) AS d, c.radius, w, h FROM colors c CROSS JOIN (SELECT DISTINCT radius FROM tokens) t),
  r AS (SELECT id, CASE WHEN radius >= greatest(1, least(w, h)) * 0.45 THEN 'full' WHEN d <= 2 THEN 'corner.' || tr END AS radius FROM k WHERE k = 1), g AS (SELECT id, CASE WHEN abs(round_even(w / 4.0, 0) * 4 - w) <= 1 THEN (round_even(w / 4.0, 0) * 4)::INTEGER::VARCHAR END AS gap FROM colors)
  SELECT r.id, coalesce(radius, '') AS radius, coalesce(gap, '') AS gap FROM r JOIN g ON r.id = g.id WHERE radius IS NOT NULL OR gap IS NOT NULL""")
def j09(spark, d):
    c = view(spark, d, "colors")
    radius = tokens.snap_radius(c, view(spark, d, "tokens"))
    gap = tokens.snap_spacing(c.select("id", F.col("w").alias("value"))).select("id", F.col("snapped").cast("int").alias("token"))
    m = matcher.token_map({"radius": radius, "gap": gap})
    return m.select("id", F.coalesce(F.col("tokens")["radius"], F.lit("")).alias("radius"), F.coalesce(F.col("tokens")["gap"], F.lit("")).alias("gap"))


_SIG = "sig AS (SELECT 'comp' || (n_nationkey % 6) AS component, n_name AS variant, n_nationkey % 5 AS type, 16.0 + n_nationkey AS low, 24.0 + n_nationkey AS high, CASE n_nationkey % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'none' ELSE '8' END AS rule, (n_nationkey * 61 + 5) % 256 AS sr, (n_nationkey * 113 + 40) % 256 AS sg, (n_nationkey * 17 + 90) % 256 AS sb, n_nationkey % 2 = 0 AS stroked, n_nationkey % 3 AS least, n_nationkey % 3 + 1 AS most FROM nation)"


def _signatures(spark, d):
    k = F.col("n_nationkey")
    return read(spark, d, "nation").select(F.concat(F.lit("comp"), (k % 6).cast("string")).alias("component"), F.col("n_name").alias("variant"), (k % 5).alias("type"), (k + 16.0).alias("low"), (k + 24.0).alias("high"), F.when(k % 3 == 0, "any").when(k % 3 == 1, "none").otherwise("8").alias("rule"), ((k * 61 + 5) % 256).alias("sr"), ((k * 113 + 40) % 256).alias("sg"), ((k * 17 + 90) % 256).alias("sb"), (k % 2 == 0).alias("stroked"), (k % 3).alias("least"), (k % 3 + 1).alias("most"))


_NODES = "nd AS (SELECT case_id * 100 + node AS id, type, w, h, radius, r, g, b, shadow AS stroke, gap % 5 AS texts FROM nodes_gt)"


def _match_nodes(spark, d):
    return view(spark, d, "nodes_gt").select((F.col("case_id") * 100 + F.col("node")).alias("id"), "type", "w", "h", "radius", "r", "g", "b", F.col("shadow").alias("stroke"), (F.col("gap") % 5).alias("texts"))


_SCORED = f"""{_SIG}, {_NODES}, ln AS (SELECT *, {_lab('')} FROM nd), ls AS (SELECT *, {_lab('s')} FROM sig), j AS (SELECT ln.id, component, variant, greatest(0, 1 - greatest(low - h, h - high, 0) / 6.0) AS ph, greatest(1, least(w, h)) AS short, radius, rule, sqrt(pow(l - sl, 2) + pow(a - sa, 2) + pow(bb - sbb, 2)) AS de, ((stroke > 0) = stroked)::INT AS ps, greatest(0.0, 1 - 0.5 * greatest(least - texts, texts - most, 0)) AS pt FROM ln JOIN ls ON ln.type = ls.type),
  k AS (SELECT *, CASE rule WHEN 'any' THEN 1 WHEN 'none' THEN CASE WHEN radius <= 2 THEN 1 ELSE greatest(0, 1 - (radius - 2) / 4.0) END ELSE CASE WHEN radius >= short * 0.42 AND 8 < short / 2.0 - 2 THEN 0 ELSE greatest(0, 1 - greatest(6 - radius, radius - 10, 0) / 4.0) END END AS pr, CASE WHEN de <= 6 THEN 1 ELSE greatest(0, 1 - (de - 6) / 6) END AS pf FROM j),
  s AS (SELECT id, component, variant, round((ph * 2 + pr * 1.5 + pf * 2 + ps * 1.5 + pt * 0.75) / 7.75 * CASE WHEN ph = 0 OR pf = 0 THEN 0.5 ELSE 1 END, 9) AS score FROM k), v AS (SELECT *, row_number() OVER (PARTITION BY id, component ORDER BY score DESC, variant) AS n FROM s),
  cand AS (SELECT id, component, variant, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, component)::INTEGER AS rank FROM v WHERE n = 1)"""


@query("j10_match_catalog", f"WITH {_SCORED} SELECT id, component, variant, round(score, 6) AS score, rank FROM cand WHERE rank <= 3")
def j10(spark, d):
    return matcher.match_catalog(_match_nodes(spark, d), _signatures(spark, d)).withColumn("score", F.round("score", 6))


@query("j12_fill_slots", """WITH a AS (SELECT l_orderkey AS id, l_linenumber % 2 AS component, l_linenumber AS position, CASE WHEN l_partkey % 3 = 0 THEN 'icon' ELSE 'text' END AS kind, l_partkey AS atom, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2, CASE WHEN l_partkey % 3 = 0 THEN 'icon' ELSE 'text' END ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem) q WHERE o = 1)
  SELECT id, component, CASE WHEN kind = 'icon' THEN 'leading' WHEN n = 1 THEN 'label' ELSE 'more' END AS slot, atom FROM a WHERE kind = 'text' OR n = 1""")
def j12(spark, d):
    t = read(spark, d, "lineitem")
    one = t.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("m"))
    kind = F.when(F.col("m.l_partkey") % 3 == 0, "icon").otherwise("text")
    a = one.select(F.struct("l_orderkey", (F.col("l_linenumber") % 2).alias("c")).alias("id"), (F.col("l_linenumber") % 2).alias("component"), F.col("l_linenumber").alias("position"), kind.alias("kind"), F.col("m.l_partkey").alias("atom"))
    slots = spark.createDataFrame([(c, p, s, k, m) for c in (0, 1) for p, s, k, m in ((1, "leading", "icon", False), (2, "label", "text", False), (3, "more", "text", True))], "component int, position int, slot string, kind string, multiple boolean")
    return matcher.fill_slots(a, slots).select(F.col("id.l_orderkey").alias("id"), F.col("id.c").alias("component"), "slot", "atom")


_LOOKUP = """rl AS (SELECT p_partkey AS rule, p_size % 20 AS signature, CASE WHEN p_partkey % 6 = 0 THEN 'none' ELSE 'comp' || (p_partkey % 6) END AS answer, 16 + p_partkey % 30 AS height, (p_size % 9)::DOUBLE AS aspect, round((p_partkey % 50 + 50) / 100.0, 2)::DOUBLE AS confidence, p_partkey % 4 AS support, p_partkey % 2 = 0 AS local FROM part WHERE p_partkey % 3 <> 0),
  lk AS (SELECT id, rule, answer, rl.confidence, row_number() OVER (PARTITION BY id ORDER BY rl.confidence DESC, support DESC, local DESC, rule) AS k FROM nd JOIN rl ON nd.radius % 20 = rl.signature AND abs(nd.h - height) <= 6 AND abs(nd.w::DOUBLE / nd.h - aspect) <= 0.35)"""


def _rules(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("rule"), (F.col("p_size") % 20).alias("signature"), F.when(k % 6 == 0, "none").otherwise(F.concat(F.lit("comp"), (k % 6).cast("string"))).alias("answer"), (k % 30 + 16).alias("height"), (F.col("p_size") % 9).cast("double").alias("aspect"), F.round((k % 50 + 50) / 100.0, 2).alias("confidence"), (k % 4).alias("support"), (k % 2 == 0).alias("local"), (k % 3 != 0).alias("active"))


@query("j13_rule_lookup", f"WITH {_NODES}, {_LOOKUP} SELECT id, rule, answer, confidence FROM lk WHERE k = 1")
def j13(spark, d):
    return matcher.rule_lookup(_match_nodes(spark, d).withColumn("signature", F.col("radius") % 20), _rules(spark, d))


@query("j14_rule_effect", f"""WITH {_SCORED}, {_LOOKUP}, c1 AS (SELECT id, component, score, score - coalesce(lead(score) OVER (PARTITION BY id ORDER BY rank), 0) AS margin, rank FROM cand), c AS (SELECT id, component, score, margin, score AS confidence FROM c1 WHERE rank = 1),
  e AS (SELECT c.*, answer, lk.confidence AS rc, CASE WHEN answer IS NULL THEN 'none' WHEN answer = component THEN 'boost' WHEN score >= 0.85 AND margin >= 0.4 THEN 'veto' WHEN answer = 'none' THEN 'reject' WHEN lk.confidence >= 0.75 THEN 'override' ELSE 'kept' END AS effect FROM c LEFT JOIN lk ON c.id = lk.id AND lk.k = 1)
  SELECT id, CASE effect WHEN 'override' THEN answer WHEN 'reject' THEN '' ELSE component END AS component, round(CASE effect WHEN 'boost' THEN greatest(confidence, least(0.9, confidence + 0.25)) WHEN 'override' THEN least(0.9, rc) WHEN 'reject' THEN 0 ELSE confidence END, 6) AS confidence, effect FROM e""")
def j14(spark, d):
    c = matcher.match_catalog(_match_nodes(spark, d), _signatures(spark, d), 2)
    second = F.lead("score").over(W.partitionBy("id").orderBy("rank"))
    best = c.withColumn("margin", F.col("score") - F.coalesce(second, F.lit(0.0))).where("rank = 1").withColumn("confidence", F.col("score"))
    r = matcher.rule_effect(best, j13(spark, d))
    return r.select("id", F.coalesce("component", F.lit("")).alias("component"), F.round("confidence", 6).alias("confidence"), "effect")


#: Levels of nodes_gt from its leaves (13 nodes a case at most, each the parent of two) to the roots' children.
_DEPTHS = (3, 2, 1)


def _mapping_sql() -> str:
    """Every level's matches from the atoms that the level below was given, one set of tables a level."""
    low = max(_DEPTHS) + 1
    parts = [f"""base AS (SELECT case_id, node, parent, CASE type WHEN 2 THEN 'text' WHEN 3 THEN 'icon' ELSE 'frame' END AS kind, type, x, y, w, h, radius, CASE WHEN node % 3 = 0 THEN NULL ELSE r END AS r, CASE WHEN node % 3 = 0 THEN NULL ELSE g END AS g, CASE WHEN node % 3 = 0 THEN NULL ELSE b END AS b,
    CASE WHEN node % 3 = 0 THEN 0 ELSE shadow END AS stroke, text, radius % 20 AS signature, CAST(floor(log2(node)) AS INT) AS depth, NOT (type NOT IN (2, 3) AND node % 3 = 0 AND EXISTS (SELECT 1 FROM nodes_gt k WHERE k.case_id = q.case_id AND k.parent = q.node)) AS atomic FROM nodes_gt q),
  {_SIG}, ls AS (SELECT *, {_lab('s')}, CASE WHEN variant < 'J' THEN 'comp' || (type % 6) END AS needs FROM sig), {_LOOKUP.split('lk AS')[0].rstrip().rstrip(',')},
  atoms{low} AS (SELECT case_id, parent AS host, node AS atom, kind, NULL::VARCHAR AS component, x, y, text FROM base WHERE false)"""]
    for d in _DEPTHS:
        up = d + 1
        parts.append(f"""lv{d} AS (SELECT b.*, {_lab('')}, coalesce(t, 0) AS texts, coalesce(parts, []) AS parts FROM base b LEFT JOIN (SELECT case_id, host, count(*) FILTER (kind = 'text') AS t, list(DISTINCT component) FILTER (component IS NOT NULL) AS parts FROM atoms{up} GROUP BY ALL) c ON c.case_id = b.case_id AND c.host = b.node
    JOIN (SELECT case_id, w AS pw, h AS ph FROM nodes_gt WHERE parent IS NULL) p ON p.case_id = b.case_id WHERE depth = {d} AND kind = 'frame' AND NOT (b.w >= pw * 0.98 AND b.h >= ph * 0.98)),
  j{d} AS (SELECT case_id, node, component, variant, greatest(0, 1 - greatest(low - h, h - high, 0) / 6.0) AS ph, greatest(1, least(w, h)) AS short, radius, rule, CASE WHEN v.r IS NULL THEN NULL ELSE sqrt(pow(l - sl, 2) + pow(a - sa, 2) + pow(bb - sbb, 2)) END AS de, ((stroke > 0) = stroked)::INT AS ps, greatest(0.0, 1 - 0.5 * greatest(least - texts, texts - most, 0)) AS pt, needs, parts FROM lv{d} v JOIN ls ON v.type = ls.type),
  k{d} AS (SELECT *, CASE rule WHEN 'any' THEN 1 WHEN 'none' THEN CASE WHEN radius <= 2 THEN 1 ELSE greatest(0, 1 - (radius - 2) / 4.0) END ELSE CASE WHEN radius >= short * 0.42 AND 8 < short / 2.0 - 2 THEN 0 ELSE greatest(0, 1 - greatest(6 - radius, radius - 10, 0) / 4.0) END END AS pr, CASE WHEN de IS NULL THEN 0 WHEN de <= 6 THEN 1 ELSE greatest(0, 1 - (de - 6) / 6) END AS pf FROM j{d}),
  s{d} AS (SELECT case_id, node, component, variant, round((ph * 2 + pr * 1.5 + pf * 2 + ps * 1.5 + pt * 0.75 + CASE WHEN list_contains(parts, needs) THEN 1.5 ELSE 0 END) / (7.75 + CASE WHEN needs IS NOT NULL THEN 1.5 ELSE 0 END) * CASE WHEN ph = 0 OR pf = 0 THEN 0.5 ELSE 1 END, 9) AS score FROM k{d}),
  v{d} AS (SELECT * FROM s{d} QUALIFY row_number() OVER (PARTITION BY case_id, node, component ORDER BY score DESC, variant) = 1),
  c{d} AS (SELECT *, row_number() OVER (PARTITION BY case_id, node ORDER BY score DESC, component) AS rank, lead(score) OVER (PARTITION BY case_id, node ORDER BY score DESC, component) AS second FROM v{d} QUALIFY rank <= 3),
  b{d} AS (SELECT case_id, node, component, variant, score, score - coalesce(second, 0) AS margin, score * (0.5 + 0.5 * least(1.0, greatest(0.0, score - coalesce(second, 0)) / 0.2)) AS confidence FROM c{d} WHERE rank = 1),
  r{d} AS (SELECT v.case_id, v.node, answer, rl.confidence AS rc FROM lv{d} v JOIN rl ON v.signature = rl.signature AND abs(v.h - height) <= 6 AND abs(v.w::DOUBLE / v.h - aspect) <= 0.35 QUALIFY row_number() OVER (PARTITION BY v.case_id, v.node ORDER BY rl.confidence DESC, support DESC, local DESC, rule) = 1),
  e{d} AS (SELECT b.*, answer, rc, CASE WHEN answer IS NULL THEN 'none' WHEN answer = component THEN 'boost' WHEN score >= 0.85 AND margin >= 0.4 THEN 'veto' WHEN answer = 'none' THEN 'reject' WHEN rc >= 0.75 THEN 'override' ELSE 'kept' END AS effect FROM b{d} b LEFT JOIN r{d} USING (case_id, node)),
  m{d} AS (SELECT case_id, node, effect, CASE WHEN effect <> 'reject' AND (score >= 0.36 OR effect = 'override') THEN CASE effect WHEN 'override' THEN answer ELSE component END END AS component, CASE WHEN effect NOT IN ('reject', 'override') AND score >= 0.36 THEN variant WHEN effect = 'override' AND answer = component THEN variant END AS variant,
    CASE WHEN effect <> 'reject' AND (score >= 0.36 OR effect = 'override') THEN CASE effect WHEN 'boost' THEN greatest(confidence, least(0.9, confidence + 0.25)) WHEN 'override' THEN least(0.9, rc) ELSE confidence END END AS confidence, effect NOT IN ('reject', 'override') AND score < 0.36 AND score >= 0.2 AS open FROM e{d}),
  o{d} AS (SELECT b.case_id, b.node, b.parent, b.kind, b.atomic, b.x, b.y, b.text, effect, m.component, m.variant, m.confidence, CASE WHEN open THEN (SELECT string_agg(c.component || ':' || c.variant, ',' ORDER BY rank) FROM c{d} c WHERE c.case_id = b.case_id AND c.node = b.node) END AS candidates FROM base b LEFT JOIN m{d} m USING (case_id, node) WHERE depth = {d}),
  w{d} AS (SELECT a.case_id, a.host AS node, kind, coalesce(a.component, text, atom::VARCHAR) AS value, row_number() OVER (PARTITION BY a.case_id, a.host, kind ORDER BY x, y, atom) AS n FROM atoms{up} a),
  p{d} AS (SELECT case_id, node, max(value) FILTER (kind = 'text' AND n = 1) AS label, string_agg(value, '|' ORDER BY n) FILTER (kind = 'instance') AS inner_parts FROM w{d} GROUP BY ALL),
  q{d} AS (SELECT o.*, CASE WHEN o.component IS NOT NULL THEN coalesce(label, '') ELSE '' END AS label, CASE WHEN o.component IS NOT NULL THEN coalesce(inner_parts, '') ELSE '' END AS inner_parts FROM o{d} o LEFT JOIN p{d} USING (case_id, node)),
  atoms{d} AS (SELECT case_id, parent AS host, node AS atom, CASE WHEN component IS NOT NULL THEN 'instance' ELSE kind END AS kind, component, x, y, text FROM o{d} WHERE atomic OR component IS NOT NULL
    UNION ALL SELECT a.case_id, o.parent, atom, a.kind, a.component, a.x, a.y, a.text FROM atoms{up} a JOIN o{d} o ON o.case_id = a.case_id AND o.node = a.host WHERE NOT o.atomic AND o.component IS NULL)""")
    rows = " UNION ALL ".join(f"SELECT case_id, node, coalesce(component, '') AS component, coalesce(variant, '') AS variant, round(coalesce(confidence, 0), 6) AS confidence, coalesce(effect, '') AS effect, label, inner_parts, coalesce(candidates, '') AS candidates FROM q{d}" for d in _DEPTHS)
    return "WITH " + ",\n  ".join(parts) + f" SELECT * FROM ({rows}) UNION ALL SELECT case_id, node, '', '', 0, '', '', '', '' FROM base WHERE depth = 0"


@query("j15_map_documents", _mapping_sql())
def j15(spark, d):
    kind = F.when(F.col("type") == 2, "text").when(F.col("type") == 3, "icon").otherwise("frame")
    bare = F.col("node") % 3 == 0
    n = view(spark, d, "nodes_gt").select("case_id", "node", "parent", kind.alias("kind"), "type", *"xywh", "radius", *[F.when(~bare, F.col(c)).alias(c) for c in "rgb"], F.when(bare, 0).otherwise(F.col("shadow")).alias("stroke"), F.lit(0).alias("shadow"), "text", (F.col("radius") % 20).alias("signature"))
    signatures = _signatures(spark, d).withColumn("needs", F.when(F.col("variant") < "J", F.concat(F.lit("comp"), (F.col("type") % 6).cast("string"))))
    components = signatures.select("component").distinct()
    slots = components.join(F.broadcast(spark.createDataFrame([(1, "label", "text", False), (2, "parts", "instance", True)], "position int, slot string, kind string, multiple boolean")))
    m = mapping.map_documents(n, signatures, slots, _rules(spark, d), assign=0.36, candidate=0.2)
    of = lambda k: F.coalesce(F.element_at("props", F.lit(k)), F.lit(""))
    said = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["component"], c["variant"])), ",")
    return m.select("case_id", "node", *[F.coalesce(c, F.lit("")).alias(c) for c in ("component", "variant", "effect")], F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"), of("label").alias("label"), of("parts").alias("inner_parts"), F.coalesce(said, F.lit("")).alias("candidates"))


@query("j34_signatures", "SELECT component, count(*) AS n, min(h) - 2.0 AS low, max(h) + 2.0 AS high, min(radius) AS radius_low, max(radius) AS radius_high, bool_or(shadow > 0) AS stroked, min(gap) AS least, max(gap) AS most FROM nodes_gt WHERE component IS NOT NULL GROUP BY component")
def j34(spark, d):
    return matcher.derived_signature(view(spark, d, "nodes_gt").where("component IS NOT NULL").select("component", "h", "radius", F.col("shadow").alias("stroke"), F.col("gap").alias("texts")))


_DIFF = f"""ra AS (SELECT n.*, n.x - coalesce(p.x, 0) AS px, n.y - coalesce(p.y, 0) AS py FROM nodes_gt n LEFT JOIN nodes_gt p ON n.case_id = p.case_id AND n.parent = p.node), rb AS (SELECT n.*, n.x - coalesce(p.x, 0) AS px, n.y - coalesce(p.y, 0) AS py FROM nodes_pred n LEFT JOIN nodes_pred p ON n.case_id = p.case_id AND n.parent = p.node),
  la AS (SELECT *, {_lab('')} FROM (SELECT * FROM ra)), lb AS (SELECT *, {_lab('')} FROM (SELECT * FROM rb)), b AS (SELECT a.case_id, a.node, a.text <> b.text AS t, b.text AS text, a.glyph <> b.glyph AS i, b.glyph AS glyph, a.component IS DISTINCT FROM b.component AS c, b.component AS component, greatest(abs(a.px - b.px), abs(a.py - b.py)) > 2 AS m, b.px || ',' || b.py AS place, greatest(abs(a.w - b.w), abs(a.h - b.h)) > 2 AS z, b.w || ',' || b.h AS size, sqrt(pow(a.l - b.l, 2) + pow(a.a - b.a, 2) + pow(a.bb - b.bb, 2)) > 3 AS k, b.r || ',' || b.g || ',' || b.b AS colour FROM la a JOIN lb b ON a.case_id = b.case_id AND a.node = b.node)"""


@query("j27_export_diff", f"""WITH {_DIFF} SELECT case_id, node, 'text' AS kind, text AS value FROM b WHERE t UNION ALL SELECT case_id, node, 'icon', glyph FROM b WHERE i UNION ALL SELECT case_id, node, 'component', component FROM b WHERE c UNION ALL SELECT case_id, node, 'move', place FROM b WHERE m UNION ALL SELECT case_id, node, 'resize', size FROM b WHERE z UNION ALL SELECT case_id, node, 'recolour', colour FROM b WHERE k
  UNION ALL SELECT case_id, node, 'deleted', '' FROM nodes_gt g WHERE NOT EXISTS (SELECT 1 FROM nodes_pred p WHERE p.case_id = g.case_id AND p.node = g.node)""")
def j27(spark, d):
    return matcher.export_diff(view(spark, d, "nodes_gt"), view(spark, d, "nodes_pred")).withColumn("value", F.coalesce("value", F.lit("")))


@query("j28_apply_corrections", f"""WITH RECURSIVE {_UP}, c AS (SELECT case_id, node, CASE (case_id + node) % 9 WHEN 0 THEN 'deleted' WHEN 1 THEN 'text' WHEN 2 THEN 'move' WHEN 3 THEN 'dance' END AS kind FROM nodes_gt WHERE (case_id + node) % 9 < 4), x AS (SELECT case_id, node FROM c WHERE kind = 'deleted')
  SELECT n.case_id, n.node, CASE WHEN c.kind = 'text' THEN 'new' ELSE text END AS text, CASE WHEN c.kind = 'move' THEN 7 ELSE x END AS x, '' AS reason FROM nodes_gt n LEFT JOIN c ON n.case_id = c.case_id AND n.node = c.node WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.case_id = n.case_id AND x.node = n.node) AND NOT EXISTS (SELECT 1 FROM up JOIN x ON x.case_id = up.case_id AND x.node = up.ancestor WHERE up.case_id = n.case_id AND up.node = n.node)
  UNION ALL SELECT case_id, node, '', 0, 'unknown kind' FROM c WHERE kind = 'dance' UNION ALL SELECT case_id, 99, '', 0, 'no such node' FROM nodes_gt WHERE node = 1""")
def j28(spark, d):
    n = view(spark, d, "nodes_gt")
    k = (F.col("case_id") + F.col("node")) % 9
    c = n.where(k < 4).select("case_id", "node", F.element_at(F.array(*[F.lit(x) for x in ("deleted", "text", "move", "dance")]), (k + 1).cast("int")).alias("kind")).withColumn("value", F.when(F.col("kind") == "text", "new").when(F.col("kind") == "move", "7,8").otherwise("z"))
    c = c.unionByName(n.where("node = 1").select("case_id", F.lit(99).alias("node"), F.lit("text").alias("kind"), F.lit("z").alias("value")))
    done, skipped = matcher.apply_corrections(n, c, differ.closure(n))
    return done.select("case_id", "node", "text", "x", F.lit("").alias("reason")).unionByName(skipped.select("case_id", "node", F.lit("").alias("text"), F.lit(0).cast("long").alias("x"), "reason"))


_LINES = "tl AS (SELECT case_id, node, text FROM regions WHERE type = 0), rt AS (SELECT case_id, CASE WHEN node % 4 = 0 THEN text ELSE replace(text, 'e', 'x') END AS text FROM regions WHERE type <> 1)"
_TERM = f"{_LINES}, bt AS (SELECT tl.case_id, tl.node, min(coalesce(least(1.0, levenshtein(rt.text, tl.text)::DOUBLE / length(tl.text)), 1.0)) AS e FROM tl LEFT JOIN rt ON tl.case_id = rt.case_id GROUP BY 1, 2), term AS (SELECT case_id, avg(e) AS text_term FROM bt GROUP BY 1)"


def _term(spark, d):
    r = view(spark, d, "regions")
    lines = r.where("type = 0").select("case_id", F.col("node").alias("line_id"), F.col("text").alias("line"))
    texts = r.where("type <> 1").select("case_id", F.when(F.col("node") % 4 == 0, F.col("text")).otherwise(F.regexp_replace("text", "e", "x")).alias("text"))
    return matcher.best_reading(lines, texts, X.cer(F.col("read"), F.col("line")))


@query("j21_best_reading", f"WITH {_TERM} SELECT case_id, round(text_term, 9) AS text_term FROM term")
def j21(spark, d):
    return _term(spark, d).withColumn("text_term", F.round("text_term", 9))


@query("p05_loss", f"""WITH {_DE}, {_TERM}, m AS (SELECT case_id, avg(de) AS mean_de, avg(CASE WHEN de > 6 THEN 1.0 ELSE 0.0 END) AS bad FROM px GROUP BY 1)
  SELECT m.case_id, round(least(1.0, mean_de / 50) + bad + 0.5 * coalesce(text_term, 0) + 1 - least(tw, rw) * least(th, rh) * 1.0 / (tw * th + rw * rh - least(tw, rw) * least(th, rh)), 6) AS loss FROM m LEFT JOIN term ON m.case_id = term.case_id JOIN frames f ON m.case_id = f.case_id""")
def p05(spark, d):
    return pixels.loss(pixels.metrics(delta(spark, d)), _term(spark, d), view(spark, d, "frames")).withColumn("loss", F.round("loss", 6))


@query("j20_nearest_lines", f"WITH {_M} SELECT case_id, node AS target, node AS line, round(sqrt(pow((dl + dr) / 2.0, 2) + pow((dt + db) / 2.0, 2)), 6) AS d FROM m")
def j20(spark, d):
    return matcher.nearest_lines(view(spark, d, "nodes_gt"), view(spark, d, "nodes_pred"), 8.0).select("case_id", "target", "line", F.round("d", 6).alias("d")).join(differ_pairs(spark, d), ["case_id", "target", "line"], "left_semi")


def differ_pairs(spark, d):
    """Pairs that overlap well, to which the SQL of other queries is limited too."""
    return spatial.match_nodes(view(spark, d, "nodes_pred"), view(spark, d, "nodes_gt")).select("case_id", F.col("r_node").alias("target"), F.col("l_node").alias("line"))


@query("j29_prior_lookup", """WITH p AS (SELECT event_type AS kind, user_id % 4 AS node_type, 's' AS size, avg(value) / 50 AS prior, avg(value) < 30 AS dead FROM events WHERE user_id % 4 < 3 GROUP BY 1, 2), k AS (SELECT event_type AS kind, avg(value) / 60 AS prior FROM events WHERE event_type <> 'view' GROUP BY 1)
  SELECT event_id, round(greatest(0.1, coalesce(p.prior, k.prior, 1.0)), 9) AS prior, coalesce(dead, false) AS deprioritised FROM events e LEFT JOIN p ON e.event_type = p.kind AND e.user_id % 4 = p.node_type AND CASE WHEN event_id % 2 = 0 THEN 's' ELSE 'm' END = p.size LEFT JOIN k ON e.event_type = k.kind""")
def j29(spark, d):
    e = read(spark, d, "events")
    p = e.where("user_id % 4 < 3").groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 4).alias("node_type")).agg((F.avg("value") / 50).alias("prior"), (F.avg("value") < 30).alias("deprioritised")).withColumn("size", F.lit("s"))
    k = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("kind")).agg((F.avg("value") / 60).alias("prior"))
    wanted = e.select("event_id", F.col("event_type").alias("kind"), (F.col("user_id") % 4).alias("node_type"), F.when(F.col("event_id") % 2 == 0, "s").otherwise("m").alias("size"))
    return learning.prior_lookup(wanted, p, k).select("event_id", F.round("prior", 9).alias("prior"), "deprioritised")


@query("j30_prior_knowledge", """WITH w AS (SELECT case_id, metric, CASE metric WHEN 'ssim' THEN 'render' ELSE 'perceive' END AS stage FROM metrics WHERE value > 0.95), k AS (SELECT p_partkey AS entry, CASE p_partkey % 3 WHEN 0 THEN 'ssim' WHEN 1 THEN 'text_cer' ELSE 'node_recall' END AS metric, CASE p_partkey % 3 WHEN 0 THEN 'render' ELSE 'perceive' END AS stage, p_size AS strength FROM part),
  r AS (SELECT *, row_number() OVER (PARTITION BY metric, stage ORDER BY strength DESC, entry)::INTEGER AS rank FROM k) SELECT case_id, w.metric, entry, rank FROM w JOIN r ON w.metric = r.metric AND w.stage = r.stage WHERE rank <= 3""")
def j30(spark, d):
    w = view(spark, d, "metrics").where("value > 0.95").select("case_id", "metric", F.when(F.col("metric") == "ssim", "render").otherwise("perceive").alias("stage"))
    m = F.col("p_partkey") % 3
    k = read(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.when(m == 0, "ssim").when(m == 1, "text_cer").otherwise("node_recall").alias("metric"), F.when(m == 0, "render").otherwise("perceive").alias("stage"), F.col("p_size").alias("strength"))
    # the best entries of a metric and stage are the same for all cases: rank them once
    top = k.withColumn("r", F.row_number().over(W.partitionBy("metric", "stage").orderBy(F.col("strength").desc(), "entry"))).where("r <= 3").drop("r")
    return matcher.prior_knowledge(w, top).select("case_id", "metric", "entry", "rank")


@query("j31_keyword_references", """WITH e AS (SELECT p_partkey AS entry, unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_name), ' ')) AS word FROM part), k AS (SELECT 1 AS cluster, unnest(['red', 'ring']) AS word UNION ALL SELECT 2, unnest(['small', 'economy']) UNION ALL SELECT 3, 'nothing'),
  h AS (SELECT cluster, entry, count(*) AS hits FROM k JOIN e ON k.word = e.word GROUP BY 1, 2) SELECT cluster, entry, hits, row_number() OVER (PARTITION BY cluster ORDER BY hits DESC, entry)::INTEGER AS rank FROM h QUALIFY rank <= 4""")
def j31(spark, d):
    c = spark.createDataFrame([(1, ["Red", "ring", "red"]), (2, ["small", "economy"]), (3, ["nothing"])], "cluster int, keywords array<string>")
    return matcher.keyword_references(c, read(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.concat_ws(" ", "p_name", "p_type", "p_name").alias("text")))
