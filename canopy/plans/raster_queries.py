"""Queries of structural similarity, edges and box features from rasters alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import pixels, raster
from canopy.plans.pixel_queries import _DE
from canopy.plans.views import view
from canopy.registry import query

_GRAY = "gr AS (SELECT case_id, x, y, (ar * 4899 + ag * 9617 + ab * 1868 + 8192) // 16384 AS a, (br * 4899 + bg * 9617 + bb * 1868 + 8192) // 16384 AS b FROM raster)"
_SSIM = f"""{_GRAY}, ws AS (SELECT c.case_id, c.x, c.y, sum(p.a) / 49.0 AS ua, sum(p.b) / 49.0 AS ub, sum(p.a * p.a) / 49.0 AS uaa, sum(p.b * p.b) / 49.0 AS ubb, sum(p.a * p.b) / 49.0 AS uab FROM gr c JOIN gr p ON p.case_id = c.case_id AND p.x BETWEEN c.x - 3 AND c.x + 3 AND p.y BETWEEN c.y - 3 AND c.y + 3 GROUP BY ALL HAVING count(*) = 49),
  sm AS (SELECT case_id, x, y, (2 * ua * ub + 6.5025) * (2 * (uab - ua * ub) * 49 / 48.0 + 58.5225) / ((ua * ua + ub * ub + 6.5025) * ((uaa - ua * ua + ubb - ub * ub) * 49 / 48.0 + 58.5225)) AS ssim FROM ws)"""


@query("p02_ssim", f"WITH {_SSIM} SELECT f.case_id, count(sm.ssim) AS windows, round(coalesce(avg(sm.ssim), 1.0), 6) AS ssim FROM (SELECT DISTINCT case_id FROM raster) f LEFT JOIN sm USING (case_id) GROUP BY 1")
def p02_ssim(spark, d):
    return raster.ssim(view(spark, d, "raster")).withColumn("ssim", F.round("ssim", 6))


@query("p08_tile_ssim", f"WITH {_SSIM}, t AS (SELECT *, unnest([x // 4 - 1, x // 4]) AS i FROM sm), u AS (SELECT *, unnest([y // 4 - 1, y // 4]) AS j FROM t) SELECT case_id, i::BIGINT AS i, j::BIGINT AS j, count(*) AS n, round(avg(ssim), 6) AS ssim, round(min(ssim), 6) AS worst FROM u WHERE i >= 0 AND j >= 0 GROUP BY 1, 2, 3")
def p08_tile_ssim(spark, d):
    return raster.tile_ssim(view(spark, d, "raster")).withColumns({c: F.round(c, 6) for c in ("ssim", "worst")})


def _edge_sql(side: str, low: int, high: int) -> str:
    """Edge pixels of one side of ``gr``: Sobel, thin ridges, and what hangs together with a strong one."""
    s = side
    return f"""h{s} AS (SELECT case_id, x, y, coalesce(max({s}) OVER nx, {s}) - coalesce(max({s}) OVER px, {s}) AS d, coalesce(max({s}) OVER px, {s}) + 2 * {s} + coalesce(max({s}) OVER nx, {s}) AS s FROM gr WINDOW px AS (PARTITION BY case_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), nx AS (PARTITION BY case_id, y ORDER BY x RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)),
  g{s} AS (SELECT case_id, x, y, coalesce(max(d) OVER u, d) + 2 * d + coalesce(max(d) OVER w, d) AS gx, coalesce(max(s) OVER w, s) - coalesce(max(s) OVER u, s) AS gy FROM h{s} WINDOW u AS (PARTITION BY case_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), w AS (PARTITION BY case_id, x ORDER BY y RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)),
  m{s} AS (SELECT *, abs(gx) + abs(gy) AS m FROM g{s}),
  n{s} AS (SELECT p.*, {", ".join(f"coalesce({n}.m, 0) AS {n}" for n in ("l", "r", "u", "w", "lu", "ru", "lw", "rw"))} FROM m{s} p {" ".join(f"LEFT JOIN m{s} {n} ON {n}.case_id = p.case_id AND {n}.x = p.x + {dx} AND {n}.y = p.y + {dy}" for n, dx, dy in (("l", -1, 0), ("r", 1, 0), ("u", 0, -1), ("w", 0, 1), ("lu", -1, -1), ("ru", 1, -1), ("lw", -1, 1), ("rw", 1, 1)))}),
  k{s} AS (SELECT case_id, x, y, m FROM n{s} WHERE m > {low} AND CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN m > l AND m >= r WHEN abs(gy) * 32768 > abs(gx) * 13573 + abs(gx) * 65536 THEN m > u AND m >= w WHEN (gx < 0) <> (gy < 0) THEN m > ru AND m > lw ELSE m > lu AND m > rw END),
  e{s} AS (SELECT case_id, x, y FROM k{s} WHERE m > {high} UNION SELECT k.case_id, k.x, k.y FROM e{s} e JOIN k{s} k ON k.case_id = e.case_id AND abs(k.x - e.x) <= 1 AND abs(k.y - e.y) <= 1)"""


_BOTH = f"{_GRAY}, {_edge_sql('a', 40, 120)}, {_edge_sql('b', 40, 120)}"


@query("p10_edges", f"WITH RECURSIVE {_BOTH} SELECT case_id, x, y, 'target' AS side FROM ea UNION ALL SELECT case_id, x, y, 'render' FROM eb")
def p10_edges(spark, d):
    return raster.side_edges(view(spark, d, "raster"), {"target": raster.gray("a"), "render": raster.gray("b")})


@query("p10_raster_agreement", f"""WITH RECURSIVE {_BOTH}, dt AS (SELECT t.case_id, t.x, t.y, 't' AS side, sqrt(min((t.x - r.x) * (t.x - r.x) + (t.y - r.y) * (t.y - r.y))) AS d FROM ea t LEFT JOIN eb r ON t.case_id = r.case_id GROUP BY 1, 2, 3),
  dr AS (SELECT r.case_id, r.x, r.y, 'r' AS side, sqrt(min((t.x - r.x) * (t.x - r.x) + (t.y - r.y) * (t.y - r.y))) AS d FROM eb r LEFT JOIN ea t ON t.case_id = r.case_id GROUP BY 1, 2, 3), s AS (SELECT * FROM dt UNION ALL SELECT * FROM dr),
  v AS (SELECT case_id, (avg(d) FILTER (side = 't') + avg(d) FILTER (side = 'r')) / 2 AS chamfer, avg(coalesce(d <= 1, false)::INT) FILTER (side = 't') AS within1, avg(coalesce(d <= 1, false)::INT) FILTER (side = 't') AS rec, avg(coalesce(d <= 1, false)::INT) FILTER (side = 'r') AS prec FROM s GROUP BY 1)
  SELECT case_id, round(chamfer, 6) AS chamfer, round(coalesce(within1, 1), 6) AS within1, round(CASE WHEN rec + prec > 0 THEN 2 * rec * prec / (rec + prec) ELSE 0 END, 6) AS f1 FROM v""")
def p10_raster(spark, d):
    found = raster.side_edges(view(spark, d, "raster"), {"target": raster.gray("a"), "render": raster.gray("b")})
    side = lambda name: found.where(F.col("side") == name).drop("side")
    e = pixels.edge_agreement(side("target"), side("render"), tol=1.0, tile=8)
    return e.select("case_id", *[F.round(c, 6).alias(c) for c in ("chamfer", "within1", "f1")])


_GAP = lambda t, c: "sqrt(" + " + ".join(f"pow({t.format(n)} - ({c.format(n)}), 2)" for n in ("l", "a", "bb")) + ")"


@query("p17_region_features", f"""WITH RECURSIVE {_DE}, {_BOTH}, size AS (SELECT case_id, max(x) + 1 AS pw, max(y) + 1 AS ph FROM px GROUP BY 1),
  co AS (SELECT px.case_id, px.x, px.y, bool_or(r.type = 0) AS text, bool_or(r.type = 1) AS icon FROM px JOIN regions r ON r.case_id = px.case_id AND px.x >= r.x AND px.x < r.x + r.w AND px.y >= r.y AND px.y < r.y + r.h WHERE r.type < 2 GROUP BY 1, 2, 3),
  p AS (SELECT px.*, ea.x IS NOT NULL AS et, eb.x IS NOT NULL AS ec, coalesce(text, false) AS text, coalesce(icon, false) AS icon FROM px LEFT JOIN ea USING (case_id, x, y) LEFT JOIN eb USING (case_id, x, y) LEFT JOIN co USING (case_id, x, y)),
  b AS (SELECT r.case_id, node, greatest(x, 0) AS x0, greatest(y, 0) AS y0, least(x + w, pw) AS x1, least(y + h, ph) AS y1, pw, ph FROM regions r JOIN size USING (case_id) WHERE least(x + w, pw) - greatest(x, 0) >= 2 AND least(y + h, ph) - greatest(y, 0) >= 2),
  i AS (SELECT p.*, node, x0, y0, x1, y1, pw, ph, (x = x0 OR x = x1 - 1)::INT + (y = y0 OR y = y1 - 1)::INT AS k FROM p JOIN b ON p.case_id = b.case_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1),
  md AS (SELECT case_id, node, {", ".join(f"median({s}{n}) AS m{s}{n}" for s in "ab" for n in ("l", "a", "bb"))} FROM (SELECT * FROM i WHERE k > 0 UNION ALL SELECT * FROM i WHERE k > 1) GROUP BY 1, 2),
  ft AS (SELECT case_id, node, {", ".join(f"CASE WHEN var_pop(b{n}) > 1e-18 THEN covar_pop(a{n}, b{n}) / var_pop(b{n}) ELSE 0 END AS s{n}, avg(a{n}) AS aa{n}, avg(b{n}) AS ab{n}" for n in ("l", "a", "bb"))} FROM i GROUP BY 1, 2),
  g AS (SELECT i.case_id, i.node, x0, y0, x1, y1, pw, ph, count(*) AS n, sum(de) AS total, avg(de) AS de_mean, quantile_cont(de, 0.9) AS de_p90, avg(al - bl) AS dl, avg(sqrt(aa * aa + abb * abb) - sqrt(ba * ba + bbb * bbb)) AS d_chroma, stddev_pop(al) AS tex_t, stddev_pop(bl) AS tex_c, avg(et::INT) AS edge_t, avg(ec::INT) AS edge_c,
    avg(({_GAP('a{}', 'ma{}')} > 10)::INT) AS it, avg(({_GAP('b{}', 'mb{}')} > 10)::INT) AS ic, avg(text::INT) AS text_frac, avg(icon::INT) AS icon_frac, sum({_GAP('a{}', 's{0} * (b{0} - ab{0}) + aa{0}')}) AS unfit FROM i JOIN md USING (case_id, node) JOIN ft USING (case_id, node) GROUP BY ALL),
  mv AS (SELECT i.case_id, i.node, dx, dy, sum({_GAP('i.a{}', 'q.b{}')}) AS e, count(*) AS k FROM i, (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy), px q WHERE q.case_id = i.case_id AND q.x = i.x + dx AND q.y = i.y + dy AND x0 + dx >= 0 AND y0 + dy >= 0 AND x1 + dx <= pw AND y1 + dy <= ph GROUP BY 1, 2, 3, 4),
  be AS (SELECT case_id, node, min(e) AS best FROM mv JOIN g USING (case_id, node) WHERE mv.k = g.n GROUP BY 1, 2)
  SELECT case_id, node, round(log10((x1 - x0) * (y1 - y0)), 5) AS log_area, round(ln((x1 - x0) * 1.0 / (y1 - y0)), 5) + 0 AS log_aspect, round((x1 - x0) * (y1 - y0) * 1.0 / (pw * ph), 5) AS page_frac, round(de_mean, 5) AS de_mean, round(de_p90, 5) AS de_p90, round(dl / greatest(de_mean, 1e-3), 5) + 0 AS dl_share, round(d_chroma, 5) + 0 AS d_chroma,
    round(tex_t, 5) AS tex_t, round(tex_c, 5) AS tex_c, round(edge_t, 5) AS edge_t, round(edge_c, 5) AS edge_c, round((it - ic) / (it + ic + 1e-6), 5) + 0 AS ink_balance, round(text_frac, 5) AS text_frac, round(icon_frac, 5) AS icon_frac, round(greatest(0, 1 - best / (total + 1e-6)), 5) AS shift_gain, round(greatest(0, 1 - unfit / (total + 1e-6)), 5) AS colour_gain FROM g LEFT JOIN be USING (case_id, node)""")
def p17_regions(spark, d):
    regions = view(spark, d, "regions")
    contents = regions.where("type < 2").withColumn("kind", F.when(F.col("type") == 0, "text").otherwise("icon"))
    f = raster.region_features(view(spark, d, "raster"), regions, contents)
    return f.select("case_id", "node", *[(F.round(c, 5) + 0.0).alias(c) for c in raster.FEATURES])
