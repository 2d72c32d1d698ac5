"""Registered queries of the engine's own operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import color as C
from canopy.functions import geometry as G
from canopy.functions import text as X
from canopy.operators import benchmark, learning, metric, quality, spatial, stats, tokens, tree
from canopy.plans.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def embedding_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


# SQL fragments shared by the oracles
_PAIRS = """p.case_id, p.node AS l_node, g.node AS r_node, p.type AS l_type, g.type AS r_type,
  greatest(least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x), 0) * greatest(least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y), 0) AS i,
  p.w * p.h + g.w * g.h AS s, p.w * p.h AS pa, g.w * g.h AS ga
  FROM boxes_pred p JOIN boxes_gt g ON p.case_id = g.case_id"""
_MATCHED = f"pairs AS (SELECT {_PAIRS}), matched AS (SELECT * FROM pairs WHERE i * 2 >= s - i AND l_type = r_type AND i > 0)"


def _lab(p: str) -> str:
    lin = lambda c: f"(CASE WHEN {p}{c} / 255.0 <= 0.04045 THEN {p}{c} / 255.0 / 12.92 ELSE pow(({p}{c} / 255.0 + 0.055) / 1.055, 2.4) END)"
    curve = lambda t: f"(CASE WHEN {t} > 216.0 / 24389 THEN cbrt({t}) ELSE ({t} * (24389.0 / 27) + 16) / 116 END)"
    r, g, b = lin("r"), lin("g"), lin("b")
    fx, fy, fz = (curve(f"(({r} * {a} + {g} * {c} + {b} * {d}) / {w})") for a, c, d, w in ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883)))
    return f"{fy} * 116 - 16 AS {p}l, ({fx} - {fy}) * 500 AS {p}a, ({fy} - {fz}) * 200 AS {p}bb"


# --------------------------------------------------------------------------------------- scalar functions
@query("f01_box_algebra", f"WITH pairs AS (SELECT {_PAIRS}) SELECT case_id, l_node, r_node, i AS overlap, round(i * 1.0 / (s - i), 9) AS iou FROM pairs WHERE i > 0")
def f01(spark, d):
    j = spatial.spatial_join(view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt"))
    return j.select("case_id", "l_node", "r_node", G.overlap("l_", "r_").alias("overlap"), F.round(G.iou("l_", "r_"), 9).alias("iou"))


@query("f02_color_format", "SELECT id, printf('#%02x%02x%02x', r, g, b) AS hex, r AS red, g AS green, b AS blue FROM colors")
def f02(spark, d):
    c = view(spark, d, "colors").withColumn("hex", C.to_hex(F.col("r"), F.col("g"), F.col("b")))
    p = C.parse_hex(F.col("hex"))
    return c.select("id", "hex", p["r"].cast("long").alias("red"), p["g"].cast("long").alias("green"), p["b"].cast("long").alias("blue"))


@query("f02_css_colors", """SELECT id, r AS red, g AS green, b AS blue, CASE id % 4 WHEN 1 THEN round((id % 101) / 100.0, 6) ELSE 1.0 END AS alpha FROM colors WHERE id % 4 < 3 UNION ALL SELECT id, -1, -1, -1, -1.0 FROM colors WHERE id % 4 = 3""")
def f02_css(spark, d):
    c = view(spark, d, "colors")
    kinds = [F.format_string("rgb(%d,%d, %d)", "r", "g", "b"), F.format_string(" RGBA( %d, %d,%d , %.2f )", "r", "g", "b", (F.col("id") % 101) / F.lit(100.0)), F.upper(C.to_hex(F.col("r"), F.col("g"), F.col("b"))), F.format_string("rgb(%d, %d)", "r", "g")]
    text = F.element_at(F.array(*kinds), (F.col("id") % 4 + 1).cast("int"))
    p = C.parse_css(text)
    of = lambda k, kind: F.coalesce(p[k].cast(kind), F.lit(-1).cast(kind))
    return c.select("id", of("r", "long").alias("red"), of("g", "long").alias("green"), of("b", "long").alias("blue"), F.round(of("a", "double"), 6).alias("alpha"))


@query("f03_lab", f"WITH q AS (SELECT id, {_lab('')} FROM colors) SELECT id, round(l, 6) AS l, round(a, 6) AS a, round(bb, 6) AS bb FROM q")
def f03(spark, d):
    lab = C.lab(F.col("r"), F.col("g"), F.col("b"))
    return view(spark, d, "colors").select("id", *[F.round(v, 6).alias(n) for v, n in zip(lab, ("l", "a", "bb"), strict=True)])


# on part names: DuckDB's levenshtein counts bytes, ours code points, and these names are ASCII
@query("f07_text_cer", """
  SELECT a.p_partkey AS k, round(least(1.0, levenshtein(b.p_name || ' ' || b.p_type, a.p_name || ' ' || a.p_type)::DOUBLE / length(a.p_name || ' ' || a.p_type)), 9) AS cer
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def f07(spark, d):
    t = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("  ", "p_name", "p_type").alias("g"))
    j = t.join(t.select((F.col("k") - 1).alias("k"), F.col("g").alias("p")), "k")
    return j.select("k", F.round(X.cer(F.col("p"), F.col("g")), 9).alias("cer"))


@query("f08_text_parts", """
  WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), u AS (SELECT doc_id, len(a) AS n, unnest(a) AS line, unnest(range(len(a))) AS k FROM t)
  SELECT doc_id, k::INTEGER AS k, round(k * 100.0 / n, 6) AS y0, round((k + 1) * 100.0 / n, 6) AS y1, length(line)::INTEGER AS chars FROM u WHERE n > 1 AND trim(line) <> ''""")
def f08(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("a")).select("doc_id", F.size("a").alias("n"), F.posexplode("a").alias("k", "line"))
    t = t.where((F.col("n") > 1) & (F.trim("line") != ""))
    return t.select("doc_id", "k", F.round(F.col("k") * 100.0 / F.col("n"), 6).alias("y0"), F.round((F.col("k") + 1) * 100.0 / F.col("n"), 6).alias("y1"), F.length("line").alias("chars"))


@query("f09_redact", r"SELECT item_id, regexp_replace(regexp_replace(regexp_replace(text, '\p{Lu}', 'X', 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]', 'x', 'g'), '\p{Nd}', '0', 'g') AS redacted FROM benchmark")
def f09(spark, d):
    return read(spark, d, "benchmark").select("item_id", X.redact(F.col("text")).alias("redacted"))


@query("f11_kebab", "SELECT p_partkey, regexp_replace(lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[\\s_]+', '-', 'g')), '-+', '-', 'g') AS slug FROM part")
def f11(spark, d):
    return read(spark, d, "part").select("p_partkey", X.kebab(F.col("p_name")).alias("slug"))


@query("f13_soft_range", "SELECT id, round(greatest(0.0, 1 - greatest(40.0 - w, w - 90.0, 0.0) / 25.0), 9) AS score FROM colors")
def f13(spark, d):
    return view(spark, d, "colors").select("id", F.round(G.soft_range(F.col("w").cast("double"), F.lit(40.0), F.lit(90.0), F.lit(25.0)), 9).alias("score"))


@query("f16_size_buckets", "SELECT CASE WHEN area < 400 THEN 'xs' WHEN area < 4000 THEN 's' WHEN area < 40000 THEN 'm' ELSE 'l' END AS size, count(*) AS n FROM moves GROUP BY 1")
def f16(spark, d):
    return view(spark, d, "moves").groupBy(G.size_bucket(F.col("area")).alias("size")).agg(F.count("*").alias("n"))


@query("f17_content_ids", "SELECT event_id, 'move-' || substr(sha1(user_id::VARCHAR || chr(31) || event_type), 1, 10) AS cid FROM events")
def f17(spark, d):
    return read(spark, d, "events").select("event_id", X.content_id("move", F.col("user_id"), F.col("event_type")).alias("cid"))


# --------------------------------------------------------------------------------------------- joins
@query("j02_match_nodes", f"WITH {_MATCHED} SELECT case_id, l_node, r_node, round(i * 1.0 / (s - i), 9) AS iou FROM matched")
def j02(spark, d):
    m = spatial.match_nodes(view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt"))
    return m.select("case_id", "l_node", "r_node", F.round("iou", 9).alias("iou"))


def _best_matching(pairs: str, value: str) -> str:
    """Of all matchings in each (case, slot) of at most three boxes a side the one with the greatest (value, tie)."""
    return f"""WITH RECURSIVE boxes AS (SELECT p.case_id, p.slot, p.node AS l_node, g.node AS r_node, p.type AS l_type, g.type AS r_type, p.x + p.w / 2.0 AS cx, p.y + p.h / 2.0 AS cy, g.x, g.y, g.w, g.h,
    greatest(least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x), 0) * greatest(least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y), 0) AS i, p.w * p.h + g.w * g.h AS s FROM rivals_pred p JOIN rivals_gt g ON p.case_id = g.case_id AND p.slot = g.slot),
  pairs AS (SELECT case_id, slot, l_node, r_node, round(i * 1.0 / (s - i), 9) AS iou, {value} AS score, (1 << ((l_node - 1) % 3 * 3 + (r_node - 1) % 3))::BIGINT AS tie FROM boxes WHERE {pairs}),
  lefts AS (SELECT case_id, slot, l_node, row_number() OVER (PARTITION BY case_id, slot ORDER BY l_node) AS k FROM (SELECT DISTINCT case_id, slot, l_node FROM pairs)),
  open AS (SELECT case_id, slot, l_node, k, r_node, score, tie FROM lefts JOIN pairs USING (case_id, slot, l_node) UNION ALL SELECT case_id, slot, l_node, k, NULL, 0, 0 FROM lefts),
  found AS (SELECT DISTINCT case_id, slot, 0::BIGINT AS k, []::BIGINT[] AS l, []::BIGINT[] AS r, 0::HUGEINT AS score, 0::BIGINT AS tie FROM lefts
    UNION ALL SELECT f.case_id, f.slot, o.k, CASE WHEN o.r_node IS NULL THEN f.l ELSE list_append(f.l, o.l_node) END, CASE WHEN o.r_node IS NULL THEN f.r ELSE list_append(f.r, o.r_node) END, f.score + o.score, f.tie + o.tie
    FROM found f JOIN open o ON o.case_id = f.case_id AND o.slot = f.slot AND o.k = f.k + 1 AND (o.r_node IS NULL OR NOT list_contains(f.r, o.r_node))),
  best AS (SELECT case_id, slot, unnest(l) AS l_node, unnest(r) AS r_node FROM (SELECT *, row_number() OVER (PARTITION BY case_id, slot ORDER BY score DESC, tie DESC) AS place FROM found f WHERE k = (SELECT max(k) FROM lefts o WHERE o.case_id = f.case_id AND o.slot = f.slot)) WHERE place = 1),
  l AS (SELECT case_id, l_node, count(*) AS nl FROM pairs GROUP BY ALL), r AS (SELECT case_id, r_node, count(*) AS nr FROM pairs GROUP BY ALL)
  SELECT b.case_id, b.l_node, b.r_node, p.iou, nl > 1 OR nr > 1 AS contested FROM best b JOIN pairs p USING (case_id, l_node, r_node) JOIN l USING (case_id, l_node) JOIN r USING (case_id, r_node)"""


def _tie(key: str):
    """A bit for each place of a slot of three boxes a side, so that no two matchings have equal totals."""
    at = lambda side: ((F.col(f"{side}_{key}") - 1) % 3).cast("int")
    return F.pow(F.lit(2), at("l") * 3 + at("r")).cast("long")


@query("j02_contested_nodes", _best_matching("i * 2 >= s - i AND i > 0 AND l_type = r_type", "round(i * 1.0 / (s - i) * 1000000000)::BIGINT"))
def j02_contested(spark, d):
    m = spatial.match_nodes(view(spark, d, "rivals_pred"), view(spark, d, "rivals_gt"), tie=_tie("node"))
    return m.select("case_id", "l_node", "r_node", F.round("iou", 9).alias("iou"), "contested")


@query("j03_contested_findings", _best_matching("i > 0 AND (i * 10 >= 3 * (s - i) OR (cx >= x AND cx < x + w AND cy >= y AND cy < y + h))", "100000000000 + round((1 + i * 1.0 / (s - i) + CASE WHEN l_type = r_type THEN 0.5 ELSE 0.0 END + CASE WHEN l_type = r_type THEN 0.5 ELSE 0.0 END) * 1000000000)::BIGINT"))
def j03_contested(spark, d):
    pred, truth = (view(spark, d, v).select("case_id", F.col("node").alias("fid"), "x", "y", "w", "h", "type") for v in ("rivals_pred", "rivals_gt"))
    m = benchmark.match_findings(pred, truth, 1e9, tie=_tie("fid"))
    return m.select("case_id", F.col("l_fid").alias("l_node"), F.col("r_fid").alias("r_node"), F.round(G.iou("l_", "r_"), 9).alias("iou"), "contested")


@query("j06_best_overlap", f"""WITH pairs AS (SELECT {_PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY case_id, l_node ORDER BY i * 1.0 / (s - i) DESC, r_node) AS k FROM pairs WHERE i > 0)
  SELECT case_id, l_node, r_node AS best, round(i * 1.0 / (s - i), 9) AS iou FROM r WHERE k = 1""")
def j06(spark, d):
    return spatial.best_overlap(view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt")).withColumn("iou", F.round("iou", 9))


@query("j07_snap_colors", f"""WITH c AS (SELECT id, {_lab('')} FROM colors), t0 AS (SELECT token, priority, r AS tr, g AS tg, b AS tb FROM tokens), t AS (SELECT token, priority, {_lab('t')} FROM t0),
  p AS (SELECT id, token, priority, round(sqrt((l - tl) * (l - tl) + (a - ta) * (a - ta) + (bb - tbb) * (bb - tbb)), 6) AS de FROM c CROSS JOIN t),
  m AS (SELECT *, min(de) OVER (PARTITION BY id) AS least_de FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, token) AS r FROM m WHERE de <= least_de + 0.05)
  SELECT id, CASE WHEN de <= 10 THEN token END AS token, de FROM k WHERE r = 1""")
def j07(spark, d):
    return tokens.snap_colors(view(spark, d, "colors"), view(spark, d, "tokens"))


@query("j08_snap_radius", """WITH p AS (SELECT c.id, c.radius, c.w, c.h, t.radius AS tr, abs(t.radius - c.radius) AS d FROM colors c CROSS JOIN (SELECT DISTINCT radius FROM tokens) t),
  k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, tr) AS r FROM p)
  SELECT id, CASE WHEN radius >= greatest(1, least(w, h)) * 0.45 THEN 'full' WHEN d <= 2 THEN 'corner.' || tr END AS token FROM k WHERE r = 1""")
def j08(spark, d):
    return tokens.snap_radius(view(spark, d, "colors"), view(spark, d, "tokens"))


@query("j08_snap_spacing", "SELECT id, CASE WHEN abs(round_even(w / 4.0, 0) * 4 - w) <= 1 THEN (round_even(w / 4.0, 0) * 4)::DOUBLE END AS snapped FROM colors")
def j08s(spark, d):
    return tokens.snap_spacing(view(spark, d, "colors").select("id", F.col("w").alias("value")))


@query("j11_calibrate", f"""WITH pairs AS (SELECT {_PAIRS}), s AS (SELECT case_id * 100 + l_node AS id, r_node AS component, i * 1.0 / (s - i) AS score FROM pairs WHERE i > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, component) AS k, lead(score) OVER (PARTITION BY id ORDER BY score DESC, component) AS second FROM s)
  SELECT id, component, round(score - coalesce(second, 0), 9) AS margin, round(score * (0.5 + 0.5 * least(1.0, (score - coalesce(second, 0)) / 0.2)), 9) AS confidence FROM r WHERE k = 1""")
def j11(spark, d):
    j = spatial.spatial_join(view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt"))
    c = tokens.calibrated(j.select((F.col("case_id") * 100 + F.col("l_node")).alias("id"), F.col("r_node").alias("component"), G.iou("l_", "r_").alias("score")))
    return c.select("id", "component", F.round("margin", 9).alias("margin"), F.round("confidence", 9).alias("confidence"))


@query("j16_unmatched", f"WITH {_MATCHED} SELECT case_id, node, 'missing' AS kind FROM boxes_gt g WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.case_id = g.case_id AND m.r_node = g.node) UNION ALL SELECT case_id, node, 'extra' FROM boxes_pred p WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.case_id = p.case_id AND m.l_node = p.node)")
def j16(spark, d):
    pred, truth = view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt")
    m = spatial.match_nodes(pred, truth)
    missing = truth.join(m.select("case_id", F.col("r_node").alias("node")), ["case_id", "node"], "left_anti").select("case_id", "node", F.lit("missing").alias("kind"))
    return missing.union(pred.join(m.select("case_id", F.col("l_node").alias("node")), ["case_id", "node"], "left_anti").select("case_id", "node", F.lit("extra")))


@query("j19_k_nearest", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d2 FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS k FROM p) SELECT query_id, k::INTEGER AS rank, id, d2 FROM r WHERE k <= 5""")
def j19(spark, d):
    items = embedding_items(spark, d)
    return stats.k_nearest(items.where("id % 50 = 0"), items, 5).select("query_id", "rank", "id", "d2")


@query("j19_standardised", """WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), e AS (SELECT unnest(x) AS v, unnest(generate_series(1, len(x))) AS dim FROM v),
  m AS (SELECT dim, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, stddev_pop(v) AS sd FROM e GROUP BY dim), o AS (SELECT list(c ORDER BY dim) AS c, list(CASE WHEN iqr > 1e-6 THEN iqr ELSE greatest(sd, 1e-3) END ORDER BY dim) AS s FROM m),
  z AS (SELECT id, label, list_transform(list_zip(x, c, s), lambda t: (t[1] - t[2]) / t[3]) AS x FROM v, o),
  p AS (SELECT a.id AS query_id, b.id, b.label, round(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9) AS d2 FROM z a JOIN z b ON a.id % 20 = 0 AND a.id <> b.id),
  n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, id) <= 5), g AS (SELECT query_id, label, count(*) AS n FROM n GROUP BY ALL)
  SELECT query_id, label, n / 5.0 AS purity FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1""")
def j19_standardised(spark, d):
    items = metric.standardised(embedding_items(spark, d))
    return stats.purity(metric.k_nearest(items.where("id % 20 = 0"), items, 5))


@query("j22_co_location", """WITH fi AS MATERIALIZED (SELECT detector, case_id, fid, x, y, w, h FROM findings), two AS MATERIALIZED (SELECT unnest([0, 0, 1]) AS d, unnest([1, 2, 2]) AS e),
  j AS MATERIALIZED (SELECT a.case_id, a.fid AS a, b.fid AS b, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s FROM fi a JOIN two ON two.d = a.detector JOIN fi b ON b.case_id = a.case_id AND b.detector = two.e)
  SELECT case_id, a, b FROM j WHERE i * 13 >= 3 * s""")
def j22(spark, d):
    f = view(spark, d, "findings")
    # IoU of 0.3 or more, in integers: i / (s - i) >= 3 / 10
    near = (F.col("l_detector") < F.col("r_detector")) & (G.overlap("l_", "r_") * 13 >= (G.area("l_") + G.area("r_")) * 3)
    return spatial.spatial_join(f, f, condition=near).select("case_id", F.col("l_fid").alias("a"), F.col("r_fid").alias("b"))


@query("j23_suppress")
def j23(spark, d):
    return spatial.suppress(view(spark, d, "findings"), ["fid"], ["confidence"], 0.5).select("case_id", "fid", "confidence")


@query("j24_covering_node", f"WITH pairs AS (SELECT {_PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY case_id, l_node ORDER BY ga, r_node) AS k FROM pairs WHERE i * 2 >= pa AND i > 0) SELECT case_id, l_node, r_node AS cover FROM r WHERE k = 1")
def j24(spark, d):
    return spatial.covering_node(view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt"), 0.5)


@query("j25_roi_nodes", f"WITH pairs AS (SELECT {_PAIRS}) SELECT case_id, l_node FROM pairs WHERE i > 0 AND i * 4 >= pa GROUP BY case_id, l_node")
def j25(spark, d):
    pairs = spatial.spatial_join(view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt"), condition=G.overlap("l_", "r_") * 4 >= G.area("l_"))
    return pairs.select("case_id", "l_node").distinct()


# ---------------------------------------------------------------------------------------------- trees
@query("t02_parents", "SELECT c.id, c.parent, c.name, p.name AS parent_name FROM tree c LEFT JOIN tree p ON c.parent = p.id")
def t02(spark, d):
    return tree.parents(view(spark, d, "tree"))


@query("t03_ancestors", "WITH RECURSIVE up(id, ancestor, distance) AS (SELECT id, parent, 1 FROM tree WHERE parent IS NOT NULL UNION ALL SELECT up.id, tree.parent, distance + 1 FROM up JOIN tree ON up.ancestor = tree.id WHERE tree.parent IS NOT NULL) SELECT id, ancestor, distance FROM up")
def t03(spark, d):
    return tree.ancestors(view(spark, d, "tree"))


@query("t04_leaves", "SELECT id, depth FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent = t.id)")
def t04(spark, d):
    return tree.leaves(view(spark, d, "tree")).select("id", "depth")


@query("t04_subtree_sizes", "WITH RECURSIVE up(id, ancestor) AS (SELECT id, id FROM tree UNION ALL SELECT up.id, tree.parent FROM up JOIN tree ON up.ancestor = tree.id WHERE tree.parent IS NOT NULL) SELECT ancestor AS id, count(*) AS size FROM up GROUP BY ancestor")
def t04s(spark, d):
    return tree.subtree_sizes(view(spark, d, "tree"))


@query("t03_common_ancestor", "WITH RECURSIVE up(id, ancestor, distance) AS (SELECT id, id, 0 FROM tree UNION ALL SELECT up.id, tree.parent, distance + 1 FROM up JOIN tree ON up.ancestor = tree.id WHERE tree.parent IS NOT NULL), pairs AS (SELECT id AS a, 'c' || (k + 1) AS b FROM tree WHERE depth = 2), r AS (SELECT a, b, x.ancestor, row_number() OVER (PARTITION BY a, b ORDER BY x.distance) AS n FROM pairs JOIN up x ON x.id = a JOIN up y ON y.id = b AND x.ancestor = y.ancestor) SELECT a, b, ancestor FROM r WHERE n = 1")
def t03c(spark, d):
    nodes = view(spark, d, "tree")
    pairs = nodes.where("depth = 2").select(F.col("id").alias("a"), F.concat(F.lit("c"), (F.col("k") + 1).cast("string")).alias("b"))
    return tree.common_ancestor(pairs, nodes)


@query("t07_child_positions", "SELECT id, row_number() OVER (PARTITION BY parent ORDER BY name, k)::INTEGER AS position FROM tree")
def t07(spark, d):
    return tree.preorder_ids(view(spark, d, "tree"))


@query("t09_reading_order", "SELECT case_id, node, row_number() OVER (PARTITION BY case_id ORDER BY floor((y + 4) / 8.0), x, node)::INTEGER AS rank FROM boxes_pred")
def t09(spark, d):
    return tree.reading_order(view(spark, d, "boxes_pred"))


@query("t10_layout", """WITH g AS (SELECT *, lead(y) OVER (PARTITION BY case_id ORDER BY y, node) - y - h AS gap FROM boxes_gt)
  SELECT case_id, count(*) AS n, median(gap) AS gap, (max(gap) - min(gap))::DOUBLE AS drift, CASE WHEN count(*) > 1 AND min(gap) >= 0 THEN 'column' ELSE 'none' END AS direction, min(x) = max(x) AS aligned FROM g GROUP BY case_id""")
def t10(spark, d):
    return tree.row_layout(view(spark, d, "boxes_gt"))


@query("t11_bands", """WITH b AS (SELECT *, max(y + h) OVER (PARTITION BY case_id ORDER BY y, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM boxes_pred)
  SELECT case_id, node, sum(CASE WHEN top IS NULL OR y >= top THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY y, node)::BIGINT AS band FROM b""")
def t11(spark, d):
    return tree.bands(view(spark, d, "boxes_pred"))


@query("t16_repeated_runs", """WITH b AS (SELECT *, x // 40 AS col FROM boxes_gt), g AS (SELECT *, y - lag(y + h) OVER (PARTITION BY case_id, type, col ORDER BY y, node) AS gap FROM b),
  r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 * h THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, type, col ORDER BY y, node) AS run FROM g)
  SELECT case_id, type, col::BIGINT AS col, run::BIGINT AS run, count(*) AS n, min(y) AS top FROM r GROUP BY case_id, type, col, run HAVING count(*) >= 2""")
def t16(spark, d):
    return tree.repeated_runs(view(spark, d, "boxes_gt"), 2)


@query("t26_type_histogram", "SELECT case_id, type, count(*) AS n FROM boxes_gt GROUP BY case_id, type")
def t26(spark, d):
    return tree.type_histogram(view(spark, d, "boxes_gt"))


# --------------------------------------------------------------------------------- quality and gates
@query("a01_structural_metrics", f"""WITH {_MATCHED}, m AS (SELECT case_id, count(*) AS k, avg(i * 1.0 / (s - i)) AS iou FROM matched GROUP BY case_id), p AS (SELECT case_id, count(*) AS n FROM boxes_pred GROUP BY case_id), g AS (SELECT case_id, count(*) AS n FROM boxes_gt GROUP BY case_id)
  SELECT g.case_id, round(coalesce(k, 0)::DOUBLE / p.n, 9) AS precision, round(coalesce(k, 0)::DOUBLE / g.n, 9) AS recall, round(iou, 9) AS mean_iou FROM g LEFT JOIN p ON g.case_id = p.case_id LEFT JOIN m ON g.case_id = m.case_id""")
def a01(spark, d):
    pred, truth = view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt")
    m = spatial.match_nodes(pred, truth).groupBy("case_id").agg(F.count("*").alias("k"), F.avg("iou").alias("iou"))
    j = truth.groupBy("case_id").agg(F.count("*").alias("g")).join(pred.groupBy("case_id").agg(F.count("*").alias("p")), "case_id", "left").join(m, "case_id", "left")
    k = F.coalesce("k", F.lit(0))
    return j.select("case_id", F.round(k / F.col("p"), 9).alias("precision"), F.round(k / F.col("g"), 9).alias("recall"), F.round("iou", 9).alias("mean_iou"))


_A03 = f"""WITH {_MATCHED}, u AS (SELECT r_type AS type, 1 AS tp, 0 AS p, 0 AS g FROM matched UNION ALL SELECT type, 0, 1, 0 FROM boxes_pred UNION ALL SELECT type, 0, 0, 1 FROM boxes_gt),
  t AS (SELECT type, sum(tp)::BIGINT AS tp, sum(p)::BIGINT AS n_pred, sum(g)::BIGINT AS n_gt FROM u GROUP BY GROUPING SETS ((type), ()))
  SELECT coalesce(type, -1) AS type, tp, n_pred, n_gt, round(tp::DOUBLE / n_pred, 9) AS precision, round(tp::DOUBLE / n_gt, 9) AS recall, round(2.0 * tp / (n_pred + n_gt), 9) AS f1 FROM t"""


@query("a03_detection_report", _A03)
def a03(spark, d):
    pred, truth = view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt")
    r = quality.detection_report(spatial.match_nodes(pred, truth), pred, truth)
    return r.select(F.coalesce("type", F.lit(-1)).alias("type"), "tp", "n_pred", "n_gt", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("a04_confusion", f"""WITH pairs AS (SELECT {_PAIRS}), loc AS (SELECT * FROM pairs WHERE i * 2 >= s - i AND i > 0)
  SELECT g.type AS truth, coalesce(CAST(l.l_type AS VARCHAR), '(missed)') AS pred, count(*) AS n FROM boxes_gt g LEFT JOIN loc l ON g.case_id = l.case_id AND g.node = l.r_node GROUP BY 1, 2""")
def a04(spark, d):
    pred, truth = view(spark, d, "boxes_pred"), view(spark, d, "boxes_gt")
    loc = spatial.spatial_join(pred, truth, condition=G.overlap("l_", "r_") * 2 >= G.union_area("l_", "r_")).select("case_id", F.col("r_node").alias("node"), "l_type")
    j = truth.join(loc, ["case_id", "node"], "left")
    return j.groupBy(F.col("type").alias("truth"), F.coalesce(F.col("l_type").cast("string"), F.lit("(missed)")).alias("pred")).agg(F.count("*").alias("n"))


_HITS = """h AS (SELECT f.case_id, f.fid, f.confidence, f.magnitude, f.type, max(CASE WHEN f.type = g.type AND
  greatest(least(f.x + f.w, g.x + g.w) - greatest(f.x, g.x), 0) * greatest(least(f.y + f.h, g.y + g.h) - greatest(f.y, g.y), 0) * 3 >= f.w * f.h + g.w * g.h THEN 1 ELSE 0 END) AS hit
  FROM findings f LEFT JOIN boxes_gt g ON f.case_id = g.case_id GROUP BY ALL)"""


def _hits(spark, d):
    f = view(spark, d, "findings")
    near = (F.col("l_type") == F.col("r_type")) & (G.overlap("l_", "r_") * 3 >= G.area("l_") + G.area("r_"))
    hit = spatial.spatial_join(f, view(spark, d, "boxes_gt"), condition=near).select("case_id", F.col("l_fid").alias("fid")).distinct().withColumn("hit", F.lit(True))
    return f.join(hit, ["case_id", "fid"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("a05_recall_by_bin", f"WITH {_HITS} SELECT magnitude // 10 AS bin, count(*) AS n, round(sum(hit)::DOUBLE / count(*), 9) AS rate FROM h GROUP BY 1")
def a05(spark, d):
    h = _hits(spark, d)
    return h.groupBy(F.floor(F.col("magnitude") / 10).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 9).alias("rate"))


@query("a07_average_precision", f"WITH {_HITS}, k AS (SELECT hit, row_number() OVER (ORDER BY confidence DESC, case_id, fid) AS k, sum(hit) OVER (ORDER BY confidence DESC, case_id, fid) AS c FROM h) SELECT round(sum(CASE WHEN hit = 1 THEN c::DOUBLE / k END) / (SELECT count(*) FROM boxes_gt), 9) AS ap FROM k")
def a07(spark, d):
    ap = quality.average_precision(_hits(spark, d), view(spark, d, "boxes_gt").count())
    return ap.select(F.round("ap", 9).alias("ap"))


_GOOD = """spec(metric, higher, norm, weight, stage) AS (VALUES ('node_recall', true, 1.0, 1.5, 'perceive'), ('text_cer', false, 1.0, 1.0, 'perceive'), ('mean_de', false, 20.0, 1.5, 'render'), ('ssim', true, 1.0, 0.5, 'render')),
  good AS (SELECT case_id, family, m.metric, value, weight::DOUBLE AS weight, stage, higher, CASE WHEN value IS NULL THEN NULL WHEN higher THEN least(1.0, greatest(0.0, value / norm)) ELSE 1 - least(1.0, greatest(0.0, value / norm)) END AS goodness FROM metrics m JOIN spec ON m.metric = spec.metric)"""


@query("f15_goodness", f"WITH {_GOOD} SELECT case_id, metric, round(goodness, 9) AS goodness FROM good")
def f15(spark, d):
    return quality.with_goodness(view(spark, d, "metrics")).select("case_id", "metric", F.round("goodness", 9).alias("goodness"))


def _all_metrics_sql() -> str:
    values = ", ".join(f"({k}, '{m}', {str(higher).lower()}, {norm or 1.0})" for k, (m, higher, norm, *_) in enumerate(quality.SPEC))
    return f"""WITH s(k, metric, higher, norm) AS (VALUES {values}), v AS (SELECT o_orderkey AS case_id, metric, higher, norm, CASE WHEN (o_orderkey + k) % 13 = 0 THEN NULL ELSE ((o_orderkey * 17 + k * 31 + o_custkey) % 131 - 10) / 100.0 * norm END AS value FROM orders, s)
  SELECT case_id, metric, round(CASE WHEN value IS NULL THEN -1 WHEN higher THEN least(1, greatest(0, value / norm)) ELSE 1 - least(1, greatest(0, value / norm)) END, 9) AS goodness FROM v"""


@query("f15_all_metrics", _all_metrics_sql())
def f15_all(spark, d):
    s = quality.spec(read(spark, d, "orders")).select("metric", F.coalesce("norm", F.lit(1.0)).alias("n"))
    place = F.array_position(F.array(*[F.lit(m) for m, *_ in quality.SPEC]), F.col("metric")) - 1
    key = F.col("o_orderkey")
    value = F.when((key + place) % 13 != 0, ((key * 17 + place * 31 + F.col("o_custkey")) % 131 - 10) / 100.0 * F.col("n"))
    m = read(spark, d, "orders").join(F.broadcast(s)).select(key.alias("case_id"), "metric", value.alias("value"))
    return quality.with_goodness(m).select("case_id", "metric", F.round(F.coalesce("goodness", F.lit(-1.0)), 9).alias("goodness"))


@query("a11_composites", f"WITH {_GOOD} SELECT case_id, round(sum(weight * goodness) / sum(CASE WHEN goodness IS NOT NULL THEN weight END), 9) AS composite FROM good GROUP BY case_id HAVING count(goodness) > 0")
def a11(spark, d):
    return quality.composites(view(spark, d, "metrics")).select("case_id", F.round("composite", 9).alias("composite"))


@query("a12_roll_up", f"WITH {_GOOD} SELECT metric, round(avg(value), 9) AS mean, round(median(value), 9) AS p50, CASE WHEN first(higher) THEN min(value) ELSE max(value) END AS worst, CASE WHEN first(higher) THEN max(value) ELSE min(value) END AS best, count(value) AS n, round(avg(goodness), 9) AS goodness FROM good GROUP BY metric")
def a12(spark, d):
    r = quality.roll_up(view(spark, d, "metrics"))
    return r.select("metric", F.round("mean", 9).alias("mean"), F.round("p50", 9).alias("p50"), "worst", "best", "n", F.round("goodness", 9).alias("goodness"))


@query("a13_worst", f"WITH {_GOOD} SELECT case_id, metric, value, round(weight * (1 - goodness), 9) AS deficit, stage FROM good WHERE goodness IS NOT NULL ORDER BY weight * (1 - goodness) DESC, case_id, metric LIMIT 20")
def a13(spark, d):
    return quality.worst(view(spark, d, "metrics"), 20).withColumn("deficit", F.round("deficit", 9))


@query("a15_gate", f"WITH {_GOOD}, a AS (SELECT metric, avg(goodness) AS g FROM good WHERE family < 5 AND metric <> 'ssim' GROUP BY metric), b AS (SELECT metric, avg(goodness) + 0.005 AS g FROM good GROUP BY metric) SELECT metric, round(was, 9) AS was, round(now, 9) AS now, reason FROM (SELECT coalesce(a.metric, b.metric) AS metric, b.g AS was, a.g AS now, CASE WHEN a.g IS NULL AND b.g IS NOT NULL THEN 'missing' WHEN a.g < b.g - 0.002 THEN 'worse' END AS reason FROM a FULL JOIN b ON a.metric = b.metric) WHERE reason IS NOT NULL")
def a15(spark, d):
    m = view(spark, d, "metrics")
    now = quality.roll_up(m.where("family < 5 AND metric <> 'ssim'"))
    was = quality.roll_up(m).withColumn("goodness", F.col("goodness") + 0.005)
    return quality.gate(now, was, 0.002).select("metric", F.round("was", 9).alias("was"), F.round("now", 9).alias("now"), "reason")


_CRITERIA = [("recall", "node_recall", ">=", 0.4), ("cer", "text_cer", "<=", 0.7)]
_MARGINS = """criteria(criterion, metric, op, threshold) AS (VALUES ('recall', 'node_recall', '>=', 0.4), ('cer', 'text_cer', '<=', 0.7)),
  margins AS (SELECT case_id, family, criterion, coalesce(CASE WHEN op = '>=' THEN value - threshold ELSE threshold - value END / threshold, -1.0) AS margin FROM metrics m JOIN criteria c ON m.metric = c.metric)"""


@query("a19_criteria", f"WITH {_MARGINS} SELECT case_id, family, criterion, round(margin, 9) AS margin, margin >= 0 AS passed FROM margins")
def a19(spark, d):
    criteria = spark.createDataFrame(_CRITERIA, "criterion string, metric string, op string, threshold double")
    return quality.judge_criteria(view(spark, d, "metrics"), criteria).withColumn("margin", F.round("margin", 9))


@query("a20_scenario_summary", f"WITH {_MARGINS} SELECT family, criterion, count(*) AS n, round(avg(CASE WHEN margin >= 0 THEN 1.0 ELSE 0.0 END), 9) AS rate, round(avg(least(1.0, greatest(-1.0, margin))), 9) AS objective, round(min(margin), 9) AS worst FROM margins GROUP BY family, criterion")
def a20(spark, d):
    m = a19(spark, d)
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("margin")))
    return m.groupBy("family", "criterion").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 9).alias("rate"), F.round(F.avg(clipped), 9).alias("objective"), F.min("margin").alias("worst"))


@query("a20_worst_cases", f"WITH {_MARGINS}, c AS (SELECT family, case_id, bool_and(margin >= 0) AS passed, min(margin) AS margin_min, round(avg(least(1.0, greatest(-1.0, margin))), 9) AS margin_mean FROM margins GROUP BY 1, 2) SELECT family, case_id, passed, round(margin_min, 9) AS margin_min, margin_mean, row_number() OVER (PARTITION BY family ORDER BY margin_min, margin_mean, case_id)::INTEGER AS rank FROM c QUALIFY rank <= 6")
def a20_worst(spark, d):
    return quality.worst_cases(a19(spark, d)).withColumn("margin_min", F.round("margin_min", 9))


@query("a22_change_by_metric", f"WITH {_GOOD}, g AS (SELECT family, metric, count(goodness) FILTER (case_id % 2 = 0) AS n_before, count(goodness) FILTER (case_id % 2 = 1) AS n_after, avg(goodness) FILTER (case_id % 2 = 0) AS b, avg(goodness) FILTER (case_id % 2 = 1) AS a FROM good GROUP BY 1, 2) SELECT family, metric, n_before, n_after, round(b, 9) AS before, round(a, 9) AS after, round(a - b, 8) AS delta FROM g")
def a22_change(spark, d):
    g = quality.with_goodness(view(spark, d, "metrics"))
    out = quality.generalisation(g.where("case_id % 2 = 0"), g.where("case_id % 2 = 1"), ["family", "metric"])
    return out.withColumns({"before": F.round("before", 9), "after": F.round("after", 9), "delta": F.round("delta", 8)})


@query("a22_generalisation", f"WITH {_GOOD} SELECT family, round(avg(CASE WHEN case_id % 2 = 0 THEN goodness END), 9) AS before, round(avg(CASE WHEN case_id % 2 = 1 THEN goodness END), 9) AS after FROM good GROUP BY family")
def a22(spark, d):
    g = quality.with_goodness(view(spark, d, "metrics"))
    side = lambda k: F.round(F.avg(F.when(F.col("case_id") % 2 == k, F.col("goodness"))), 9)
    return g.groupBy("family").agg(side(0).alias("before"), side(1).alias("after"))


# ---------------------------------------------------------------------------------------------- learning
_MOVES = "m AS (SELECT *, CASE WHEN accepted THEN gain / batch ELSE 0.0 END AS g, CASE WHEN area < 400 THEN 'xs' WHEN area < 4000 THEN 's' WHEN area < 40000 THEN 'm' ELSE 'l' END AS size FROM moves)"


@query("l01_move_summary", f"WITH {_MOVES}, k AS (SELECT kind, count(*) AS tried, sum(accepted::INT)::BIGINT AS accepted, sum(g) AS gain FROM m GROUP BY kind) SELECT kind, tried, accepted, round(gain, 6) AS gain, round(accepted::DOUBLE / tried, 9) AS accept_rate, round(gain / tried, 9) AS gain_per_try, round(gain / sum(gain) OVER (), 9) AS gain_share FROM k")
def l01(spark, d):
    s = learning.move_summary(view(spark, d, "moves"))
    return s.select("kind", "tried", "accepted", F.round("gain", 6).alias("gain"), *[F.round(c, 9).alias(c) for c in ("accept_rate", "gain_per_try", "gain_share")])


@query("l02_move_priors", f"""WITH {_MOVES}, w AS (SELECT sum(g) / sum(promised) AS rate, sum(g) / count(*) AS per_try FROM m),
  k AS (SELECT kind, (sum(g) + sum(promised) / count(*) * 20 * any_value(rate)) / (sum(promised) + sum(promised) / count(*) * 20) AS kind_rate FROM m, w GROUP BY kind),
  b AS (SELECT kind, node_type, size, count(*) AS tried, sum(g) AS gain, sum(promised) AS promised FROM m GROUP BY kind, node_type, size)
  SELECT b.kind, node_type, size, tried, round(gain, 6) AS gain, round(promised, 6) AS promised, round((gain + promised / tried * 20 * kind_rate) / (promised + promised / tried * 20) / rate, 9) AS prior, tried >= 30 AND gain / tried < per_try * 0.05 AS deprioritised FROM b JOIN k ON b.kind = k.kind CROSS JOIN w""")
def l02(spark, d):
    p = learning.move_priors(view(spark, d, "moves"))
    return p.select("kind", "node_type", "size", "tried", F.round("gain", 6).alias("gain"), F.round("promised", 6).alias("promised"), F.round("prior", 9).alias("prior"), "deprioritised")


_RECORDS = "records AS (SELECT user_id % 6 AS type, event_type AS operator, event_id % 3 = 0 AS fixed FROM events)"


def _records(spark, d):
    return read(spark, d, "events").select((F.col("user_id") % 6).alias("type"), F.col("event_type").alias("operator"), (F.col("event_id") % 3 == 0).alias("fixed"))


@query("l04_policy", f"WITH {_RECORDS}, t AS (SELECT type, operator, count(*) AS n, sum(fixed::INT)::BIGINT AS k FROM records GROUP BY 1, 2), o AS (SELECT operator, sum(fixed::INT)::DOUBLE / count(*) AS rate FROM records GROUP BY 1), p AS (SELECT type, t.operator, n, k, (k + 4 * rate) / (n + 4) AS p FROM t JOIN o ON t.operator = o.operator) SELECT type, operator, n, k, round(p, 9) AS p_fix, row_number() OVER (PARTITION BY type ORDER BY p DESC, operator)::INTEGER AS rank FROM p")
def l04(spark, d):
    return learning.policy_estimates(_records(spark, d)).withColumn("p_fix", F.round("p_fix", 9))


@query("l05_finder_confusion", "WITH c AS (SELECT l_partkey % 5 AS pred, l_suppkey % 5 AS truth, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT a.i AS pred, b.i AS truth FROM range(5) a(i), range(5) b(i)), f AS (SELECT g.pred, g.truth, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.pred = c.pred AND g.truth = c.truth) SELECT pred, truth, n, round((n + 1.0) / (sum(n) OVER (PARTITION BY pred) + 5), 9) AS p FROM f")
def l05(spark, d):
    r = read(spark, d, "lineitem").select((F.col("l_partkey") % 5).alias("pred"), (F.col("l_suppkey") % 5).alias("truth"))
    return learning.confusion(r, 5).withColumn("p", F.round("p", 9))


_RULES = """v AS (SELECT signature, answer, count(DISTINCT screen) AS support FROM corrections GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY support DESC, answer DESC) AS r FROM v),
  g AS (SELECT c.signature, count(DISTINCT screen) AS against FROM corrections c JOIN w ON c.signature = w.signature AND w.r = 1 AND c.answer <> w.answer GROUP BY 1)"""


@query("l16_derive_rules", f"WITH {_RULES} SELECT w.signature, answer, support, coalesce(against, 0) AS against, round(support::DOUBLE / (support + coalesce(against, 0)), 9) AS confidence, support >= 2 AND support::DOUBLE / (support + coalesce(against, 0)) >= 0.6 AS active FROM w LEFT JOIN g ON w.signature = g.signature WHERE r = 1")
def l16(spark, d):
    return learning.derive_rules(view(spark, d, "corrections")).withColumn("confidence", F.round("confidence", 9))


@query("j17_rule_diff", """WITH a AS (SELECT signature, answer, row_number() OVER (PARTITION BY signature ORDER BY count(DISTINCT screen) DESC, answer DESC) AS r FROM corrections WHERE item % 2 = 0 GROUP BY 1, 2), b AS (SELECT signature, answer, row_number() OVER (PARTITION BY signature ORDER BY count(DISTINCT screen) DESC, answer DESC) AS r FROM corrections GROUP BY 1, 2),
  j AS (SELECT coalesce(x.signature, y.signature) AS signature, x.answer AS old_answer, y.answer AS new_answer FROM (SELECT * FROM a WHERE r = 1) x FULL JOIN (SELECT * FROM b WHERE r = 1) y ON x.signature = y.signature)
  SELECT *, CASE WHEN old_answer IS NULL THEN 'added' WHEN new_answer IS NULL THEN 'removed' ELSE 'changed' END AS change FROM j WHERE old_answer IS DISTINCT FROM new_answer""")
def j17(spark, d):
    c = view(spark, d, "corrections")
    return learning.rule_diff(learning.derive_rules(c.where("item % 2 = 0")), learning.derive_rules(c))


@query("l29_state", "WITH u AS (SELECT DISTINCT reverts AS id FROM ledger WHERE accepted AND reverts IS NOT NULL), l AS (SELECT * FROM ledger WHERE accepted AND reverts IS NULL AND id NOT IN (SELECT id FROM u)), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, id DESC) AS n FROM l) SELECT k, new_value AS value FROM r WHERE n = 1")
def l29(spark, d):
    return learning.state(view(spark, d, "ledger"))


@query("l26_value_changes", "WITH p AS (SELECT id, k, lag(new_value) OVER (PARTITION BY k ORDER BY ts, id) AS old_value, new_value FROM ledger WHERE accepted) SELECT id, k, old_value::DOUBLE AS old_value, new_value FROM p WHERE old_value IS NULL OR old_value <> new_value")
def l26(spark, d):
    return learning.value_changes(view(spark, d, "ledger")).withColumn("old_value", F.col("old_value").cast("double"))


# -------------------------------------------------------------------------------------- statistics
@query("n00_components", "WITH RECURSIVE e AS (SELECT c_custkey AS a, 1000000 + c_custkey // 7 AS b FROM customer UNION ALL SELECT 1000000 + c_custkey // 7, c_custkey FROM customer), reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a AS v, least(a, min(b)) AS component FROM reach GROUP BY a")
def n00(spark, d):
    e = read(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.lit(1000000) + F.floor(F.col("c_custkey") / 7)).alias("b"))
    return stats.components(e)


def _tiles(spark, d):
    return read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 4).alias("stratum"), F.col("l_extendedprice").alias("value"))


@query("n01_histogram", "SELECT l_suppkey % 4 AS stratum, least(16, greatest(1, floor((l_extendedprice - 0.0) / 6250.0) + 1))::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def n01(spark, d):
    return stats.histogram(_tiles(spark, d), 0.0, 100000.0, 16)


@query("n02_survival", "WITH h AS (SELECT l_suppkey % 4 AS stratum, least(16, greatest(1, floor((l_extendedprice - 0.0) / 6250.0) + 1))::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT stratum, bin, round(sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC)::DOUBLE / sum(n) OVER (PARTITION BY stratum), 9) AS p FROM h")
def n02(spark, d):
    return stats.survival(n01(spark, d)).withColumn("p", F.round("p", 9))


@query("n07_robust_scale", """WITH t AS (SELECT event_id AS id, event_type AS stratum, value FROM events), s AS (SELECT stratum, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM t GROUP BY 1)
  SELECT id, t.stratum, round((value - m) / iqr, 6) AS z FROM t JOIN s ON t.stratum = s.stratum""")
def n07(spark, d):
    t = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stratum"), "value")
    return stats.robust_scale(t).withColumn("z", F.round("z", 6))


@query("n08_conformal", "WITH r AS (SELECT value AS score FROM events WHERE event_id % 2 = 0), s AS (SELECT event_id AS id, value AS score FROM events WHERE event_id % 2 = 1) SELECT id, score, round((1.0 + (SELECT count(*) FROM r WHERE r.score >= s.score)) / (1 + (SELECT count(*) FROM r)), 9) AS p FROM s")
def n08(spark, d):
    e = read(spark, d, "events")
    r = stats.conformal(e.where("event_id % 2 = 1").select(F.col("event_id").alias("id"), F.col("value").alias("score")), e.where("event_id % 2 = 0").select(F.col("value").alias("score")))
    return r.withColumn("p", F.round("p", 9))


# ---------------------------------------------------------------------------------- pixels and diffs
@query("p11_dominant_color", "WITH q AS (SELECT case_id, r1 // 32 AS r, g1 // 32 AS g, b1 // 32 AS b, count(*) AS n FROM pixels GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, r, g, b) AS i, sum(n) OVER (PARTITION BY case_id) AS s FROM q) SELECT case_id, r, g, b, round(n::DOUBLE / s, 9) AS share FROM k WHERE i = 1")
def p11(spark, d):
    q = view(spark, d, "pixels").groupBy("case_id", *[F.floor(F.col(f"{c}1") / 32).alias(c) for c in "rgb"]).agg(F.count("*").alias("n"))
    best = q.groupBy("case_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "r", "g", "b")).alias("t"), F.sum("n").alias("s"))
    return best.select("case_id", "t.r", "t.g", "t.b", F.round(-F.col("t.m") / F.col("s"), 9).alias("share"))


@query("d09_token_consistency", """WITH u AS (SELECT r_node % 4 AS token, l_type AS v, case_id FROM (SELECT case_id, node AS r_node, type AS l_type FROM boxes_gt)), c AS (SELECT case_id, token, v, count(*) AS n FROM u GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY case_id, token ORDER BY n DESC, v) AS r FROM c) SELECT case_id, token, v, n FROM m WHERE r > 1""")
def d09(spark, d):
    c = view(spark, d, "boxes_gt").groupBy("case_id", (F.col("node") % 4).alias("token"), F.col("type").alias("v")).agg(F.count("*").alias("n"))
    order = F.row_number().over(W.partitionBy("case_id", "token").orderBy(F.col("n").desc(), "v"))
    return c.withColumn("r", order).where("r > 1").drop("r")


@query("g03_split", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN substr(md5(o_orderkey::VARCHAR), 1, 1) < '4' THEN 'holdout' ELSE 'train' END AS split FROM orders) GROUP BY split")
def g03(spark, d):
    side = F.when(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1) < "4", "holdout").otherwise("train")
    return read(spark, d, "orders").groupBy(side.alias("split")).agg(F.count("*").alias("n"))


FLAGSHIP = a03
