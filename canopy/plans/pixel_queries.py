"""Registered queries of pixel and tile tables, over ``lineitem`` and ``part`` read as rasters, boxes and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import color as C
from canopy.operators import pixels
from canopy.plans.views import view
from canopy.registry import _lab, query


def de2000_sql(source: str, keep: str, one: str = "a", two: str = "b") -> str:
    """A subquery that adds ``de`` to ``keep``: CIEDE2000 of the Lab columns <one>l, <one>a, <one>bb and <two>..."""
    a, b = one, two
    return f"""(SELECT {keep}, sqrt(pow((l2 - l1) / (1 + 0.015 * pow(ml - 50, 2) / sqrt(20 + pow(ml - 50, 2))), 2) + pow((c2 - c1) / (1 + 0.045 * mc), 2) + pow(dhh / (1 + 0.015 * mc * t), 2)
      + -2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25.0, 7))) * sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * ((c2 - c1) / (1 + 0.045 * mc)) * (dhh / (1 + 0.015 * mc * t))) AS de
     FROM (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63)) AS t, 2 * sqrt(c1 * c2) * sin(radians(dh) / 2) AS dhh, (l1 + l2) / 2 AS ml, (c1 + c2) / 2 AS mc
     FROM (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
       CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh
     FROM (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2, CASE WHEN p1 = 0 AND b1 = 0 THEN 0 ELSE fmod(degrees(atan2(b1, p1)) + 360, 360) END AS h1, CASE WHEN p2 = 0 AND b2 = 0 THEN 0 ELSE fmod(degrees(atan2(b2, p2)) + 360, 360) END AS h2
     FROM (SELECT *, a1 * (1 + 0.5 * (1 - sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0, 7))))) AS p1, a2 * (1 + 0.5 * (1 - sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0, 7))))) AS p2
     FROM (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cm FROM (SELECT *, {a}l AS l1, {a}a AS a1, {a}bb AS b1, {b}l AS l2, {b}a AS a2, {b}bb AS b2 FROM {source}) s0) s1) s2) s3) s4) s5)"""


_DE = f"lab AS (SELECT *, {_lab('a')}, {_lab('b')} FROM raster), px AS (SELECT *, sqrt((al - bl) * (al - bl) + (aa - ba) * (aa - ba) + (abb - bbb) * (abb - bbb)) AS de FROM lab)"


def raster(spark, d):
    return view(spark, d, "raster")


def delta(spark, d):
    r = raster(spark, d)
    side = lambda p: r.select("case_id", "x", "y", *[F.col(p + c).alias(c) for c in "rgb"])
    return pixels.delta_map(side("a"), side("b"))


@query("f04_ciede2000", f"""WITH c AS (SELECT a.id, a.r AS ar, a.g AS ag, a.b AS ab, b.r AS br, b.g AS bg, b.b AS bb FROM colors a JOIN colors b ON b.id = a.id + 1), k AS (SELECT *, {_lab('a')}, {_lab('b')} FROM c)
  SELECT id, round(de, 6) AS de FROM {de2000_sql("k", "id")}""")
def f04(spark, d):
    c = view(spark, d, "colors").select("id", *[F.col(x).alias("a" + x) for x in "rgb"])
    j = c.join(view(spark, d, "colors").select((F.col("id") - 1).alias("id"), *[F.col(x).alias("b" + x) for x in "rgb"]), "id")
    return j.select("id", F.round(C.delta2000(pixels._lab("a"), pixels._lab("b")), 6).alias("de"))


@query("p01_delta_map", f"WITH {_DE} SELECT case_id, x, y, round(de, 6) AS de FROM px")
def p01(spark, d):
    return delta(spark, d).select("case_id", "x", "y", F.round("de", 6).alias("de"))


@query("p02_pixel_metrics", f"""WITH {_DE}, m AS (SELECT case_id, count(*) AS n, avg(((ar - br) * (ar - br) + (ag - bg) * (ag - bg) + (ab - bb) * (ab - bb)) / 3.0) AS mse, avg(de) AS mean_de, max(de) AS max_de, avg(CASE WHEN de > 6 THEN 1.0 ELSE 0.0 END) AS bad, avg(CASE WHEN de > 2.3 THEN 1.0 ELSE 0.0 END) AS jnd FROM px GROUP BY case_id)
  SELECT case_id, n, round(mse, 6) AS mse, round(CASE WHEN mse <= 1e-12 THEN 100.0 ELSE least(100.0, 10 * log10(65025.0 / mse)) END, 6) AS psnr, round(mean_de, 6) AS mean_de, round(max_de, 6) AS max_de, round(bad, 6) AS frac_bad, round(jnd, 6) AS jnd_frac FROM m""")
def p02(spark, d):
    m = pixels.metrics(delta(spark, d))
    return m.select("case_id", "n", *[F.round(c, 6).alias(c) for c in ("mse", "psnr", "mean_de", "max_de", "frac_bad", "jnd_frac")])


@query("p03_residual_regions", f"""WITH RECURSIVE {_DE}, bad AS (SELECT case_id, x, y, de, x + 100 * y AS id FROM px WHERE de > 6), e AS (SELECT a.case_id, a.id AS a, b.id AS b FROM bad a JOIN bad b ON a.case_id = b.case_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 5),
  reach(case_id, a, b) AS (SELECT case_id, a, b FROM e UNION SELECT r.case_id, r.a, e.b FROM reach r JOIN e ON r.case_id = e.case_id AND r.b = e.a), c AS (SELECT case_id, a AS id, min(b) AS c FROM reach GROUP BY 1, 2),
  g AS (SELECT bad.case_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n, sum(de) AS mass FROM bad JOIN c ON bad.case_id = c.case_id AND bad.id = c.id GROUP BY bad.case_id, c HAVING count(*) >= 4)
  SELECT case_id, x, y, w, h, n, round(mass, 5) AS mass FROM g""")
def p03(spark, d):
    return pixels.residual_regions(delta(spark, d), least=4).select("case_id", "x", "y", "w", "h", "n", F.round("mass", 5).alias("mass"))


@query("p04_node_errors", f"""WITH {_DE}, own AS (SELECT r.case_id, r.node, sum(de) AS s, count(de) AS n FROM regions r LEFT JOIN px ON px.case_id = r.case_id AND px.x >= r.x AND px.x < r.x + r.w AND px.y >= r.y AND px.y < r.y + r.h GROUP BY 1, 2),
  kid AS (SELECT p.case_id, p.node, sum(de) AS s, count(de) AS n FROM regions p JOIN regions k ON k.case_id = p.case_id AND k.parent = p.node JOIN px ON px.case_id = p.case_id AND px.x >= p.x AND px.x < p.x + p.w AND px.y >= p.y AND px.y < p.y + p.h AND px.x >= k.x AND px.x < k.x + k.w AND px.y >= k.y AND px.y < k.y + k.h GROUP BY 1, 2)
  SELECT o.case_id, o.node, round(CASE WHEN o.n = 0 THEN 0 WHEN o.n - coalesce(k.n, 0) <= 0 THEN o.s / o.n ELSE greatest(0, o.s - coalesce(k.s, 0)) / (o.n - coalesce(k.n, 0)) END, 6) AS error FROM own o LEFT JOIN kid k ON o.case_id = k.case_id AND o.node = k.node""")
def p04(spark, d):
    return pixels.node_errors(delta(spark, d), view(spark, d, "regions")).withColumn("error", F.round("error", 6))


@query("p06_text_split", f"""WITH {_DE}, j AS (SELECT px.case_id, de > 2.3 AS bad, EXISTS (SELECT 1 FROM regions r WHERE r.case_id = px.case_id AND r.type = 2 AND px.x >= r.x - 2 AND px.x < r.x + r.w + 2 AND px.y >= r.y - 2 AND px.y < r.y + r.h + 2) AS inside FROM px)
  SELECT case_id, round(avg(CASE WHEN inside THEN bad::INT END), 6) AS jnd_text, round(avg(CASE WHEN NOT inside THEN bad::INT END), 6) AS jnd_nontext FROM j GROUP BY case_id""")
def p06(spark, d):
    s = pixels.text_split(delta(spark, d), view(spark, d, "regions").where("type = 2"))
    return s.select("case_id", F.round("jnd_text", 6).alias("jnd_text"), F.round("jnd_nontext", 6).alias("jnd_nontext"))


@query("p07_flat_regions", f"""WITH RECURSIVE lab AS (SELECT *, {_lab('a')}, {_lab('b')} FROM raster), px AS (SELECT case_id, x, y, x + 100 * y AS id, ar // 12 AS r, ag // 12 AS g, ab // 12 AS b, de FROM {de2000_sql("lab", "case_id, x, y, ar, ag, ab")}),
  e AS (SELECT a.case_id, a.id AS a, b.id AS b FROM px a JOIN px b ON a.case_id = b.case_id AND a.r = b.r AND a.g = b.g AND a.b = b.b AND abs(a.x - b.x) + abs(a.y - b.y) <= 1),
  reach(case_id, a, b) AS (SELECT case_id, a, b FROM e UNION SELECT q.case_id, q.a, e.b FROM reach q JOIN e ON q.case_id = e.case_id AND q.b = e.a), c AS (SELECT case_id, a AS id, min(b) AS c FROM reach GROUP BY 1, 2)
  SELECT px.case_id, min(x) AS x, min(y) AS y, max(x) AS x2, max(y) AS y2, count(*) AS n, round(avg(de), 5) AS de FROM px JOIN c ON px.case_id = c.case_id AND px.id = c.id GROUP BY px.case_id, c HAVING count(*) >= 16""")
def p07(spark, d):
    return pixels.flat_regions(raster(spark, d), least=16).withColumn("de", F.round("de", 5))


@query("p08_tile_statistics", f"""WITH {_DE}, t AS (SELECT *, unnest([x // 4 - 1, x // 4]) AS i FROM px), u AS (SELECT *, unnest([y // 4 - 1, y // 4]) AS j FROM t)
  SELECT case_id, i::BIGINT AS i, j::BIGINT AS j, count(*) AS n, round(avg(de), 6) AS mean_de, round(avg(CASE WHEN de > 2.3 THEN 1.0 ELSE 0.0 END), 6) AS jnd_frac FROM u WHERE i >= 0 AND j >= 0 GROUP BY 1, 2, 3""")
def p08(spark, d):
    t = pixels.tile_statistics(delta(spark, d))
    return t.select("case_id", "i", "j", "n", F.round("mean_de", 6).alias("mean_de"), F.round("jnd_frac", 6).alias("jnd_frac"))


_NOISE = f"{_DE}, noise AS (SELECT case_id, CASE WHEN count(*) >= 50 THEN avg(CASE WHEN de > 0.3 THEN 1.0 ELSE 0.0 END) ELSE 0 END AS sub_share, CASE WHEN count(*) >= 50 THEN avg(CASE WHEN de > 2.3 THEN 1.0 ELSE 0.0 END) ELSE 0 END AS jnd_share FROM px WHERE x % 6 = 0 GROUP BY case_id)"


@query("p09_page_noise", f"WITH {_NOISE} SELECT case_id, round(sub_share, 6) AS sub_share, round(jnd_share, 6) AS jnd_share FROM noise")
def p09(spark, d):
    n = pixels.page_noise(delta(spark, d), F.col("x") % 6 == 0, least=50)
    return n.select("case_id", F.round("sub_share", 6).alias("sub_share"), F.round("jnd_share", 6).alias("jnd_share"))


@query("n06_page_bin", f"WITH {_NOISE} SELECT case_id, CASE WHEN jnd_share >= 0.3 THEN 3 WHEN NOT (case_id % 3 <> 0) THEN 2 WHEN case_id % 4 = 0 THEN 1 WHEN sub_share >= 0.4 THEN 3 ELSE 0 END AS page_bin FROM noise")
def n06(spark, d):
    n = pixels.page_noise(delta(spark, d), F.col("x") % 6 == 0, least=50)
    return pixels.page_bin(n.withColumn("registered", F.col("case_id") % 3 != 0).withColumn("fitted", F.col("case_id") % 4 == 0))


_EDGES = "t AS (SELECT case_id, x, y FROM raster WHERE x % 6 = 0), r AS (SELECT case_id, x, y FROM raster WHERE (x + case_id % 4) % 8 = 0)"


@query("p10_edge_agreement", f"""WITH {_EDGES}, dt AS (SELECT t.case_id, t.x, t.y, 't' AS side, sqrt(min((t.x - r.x) * (t.x - r.x) + (t.y - r.y) * (t.y - r.y))) AS d FROM t JOIN r ON t.case_id = r.case_id GROUP BY 1, 2, 3),
  dr AS (SELECT r.case_id, r.x, r.y, 'r' AS side, sqrt(min((t.x - r.x) * (t.x - r.x) + (t.y - r.y) * (t.y - r.y))) AS d FROM t JOIN r ON t.case_id = r.case_id GROUP BY 1, 2, 3), s AS (SELECT * FROM dt UNION ALL SELECT * FROM dr),
  w AS (SELECT case_id, (avg(d) FILTER (side = 't') + avg(d) FILTER (side = 'r')) / 2 AS chamfer, avg((d <= 1)::INT) FILTER (side = 't') AS within1, avg((d <= 1.5)::INT) FILTER (side = 't') AS rec, avg((d <= 1.5)::INT) FILTER (side = 'r') AS prec FROM s GROUP BY 1),
  q AS (SELECT case_id, x // 8 AS i, y // 8 AS j, avg(d) FILTER (side = 't') AS a, avg(d) FILTER (side = 'r') AS b, max(d) FILTER (side = 't') AS ma, max(d) FILTER (side = 'r') AS mb FROM s GROUP BY ALL), v AS (SELECT case_id, max((coalesce(a, mb) + coalesce(b, ma)) / 2) AS worst FROM q GROUP BY 1)
  SELECT w.case_id, round(chamfer, 6) AS chamfer, round(within1, 6) AS within1, round(CASE WHEN rec + prec > 0 THEN 2 * rec * prec / (rec + prec) ELSE 0 END, 6) AS f1, round(worst, 6) AS worst_tile FROM w JOIN v ON w.case_id = v.case_id""")
def p10(spark, d):
    at = raster(spark, d).select("case_id", "x", "y")
    e = pixels.edge_agreement(at.where("x % 6 = 0"), at.where("(x + case_id % 4) % 8 = 0"), tile=8)
    return e.select("case_id", *[F.round(c, 6).alias(c) for c in ("chamfer", "within1", "f1", "worst_tile")])


@query("p12_frame_conformity", """WITH p AS (SELECT r.*, x >= rw OR y >= rh AS missing FROM raster r JOIN frames f ON r.case_id = f.case_id), k AS (SELECT case_id, CASE WHEN avg(ar * 0.299 + ag * 0.587 + ab * 0.114) > 127.5 THEN 0 ELSE 255 END AS fill FROM p WHERE missing GROUP BY 1),
  m AS (SELECT p.case_id, count(*) FILTER (missing) AS missing, avg(CASE WHEN missing THEN fill ELSE br END) AS red FROM p LEFT JOIN k ON p.case_id = k.case_id GROUP BY 1)
  SELECT f.case_id, tw = rw AND th = rh AS size_match, round(least(tw, rw) * least(th, rh) * 1.0 / (tw * th + rw * rh - least(tw, rw) * least(th, rh)), 6) AS frame_iou, missing, round(red, 6) AS red FROM frames f JOIN m ON f.case_id = m.case_id""")
def p12(spark, d):
    f = view(spark, d, "frames")
    m = pixels.conformed(raster(spark, d), f).groupBy("case_id").agg(F.sum(F.col("missing").cast("long")).alias("missing"), F.round(F.avg("br"), 6).alias("red"))
    return pixels.frame_conformity(f).withColumn("frame_iou", F.round("frame_iou", 6)).join(m, "case_id")


@query("p13_covered_area", """WITH c AS (SELECT DISTINCT f.case_id, x.i AS x, y.i AS y FROM frames f JOIN regions r ON f.case_id = r.case_id AND r.type <> 1 JOIN range(24) x(i) ON x.i >= r.x AND x.i < r.x + r.w AND x.i < tw JOIN range(24) y(i) ON y.i >= r.y AND y.i < r.y + r.h AND y.i < th), n AS (SELECT case_id, count(*) AS n FROM c GROUP BY 1)
  SELECT f.case_id, coalesce(n, 0) AS area, round(coalesce(n, 0)::DOUBLE / (tw * th), 6) AS share FROM frames f LEFT JOIN n ON f.case_id = n.case_id""")
def p13(spark, d):
    return pixels.covered_area(view(spark, d, "regions").where("type <> 1"), view(spark, d, "frames")).withColumn("share", F.round("share", 6))


@query("p14_change_check", f"""WITH {_DE}, ch AS (SELECT case_id, x, y FROM px WHERE de > 2.3), f AS (SELECT * FROM regions WHERE type = 0), hit AS (SELECT f.node, ch.* FROM ch JOIN f ON ch.case_id = f.case_id AND ch.x >= f.x - 1 AND ch.x <= f.x + f.w AND ch.y >= f.y - 1 AND ch.y <= f.y + f.h)
  SELECT f.case_id, f.node, count(hit.x) AS px, coalesce(min(hit.x), -1) AS x, coalesce(min(hit.y), -1) AS y, coalesce(max(hit.x), -1) AS x2, coalesce(max(hit.y), -1) AS y2 FROM f LEFT JOIN hit ON f.case_id = hit.case_id AND f.node = hit.node GROUP BY 1, 2
  UNION ALL SELECT case_id, -1, count(*), -1, -1, -1, -1 FROM ch WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.case_id = ch.case_id AND hit.x = ch.x AND hit.y = ch.y) GROUP BY case_id""")
def p14(spark, d):
    ink, rest = pixels.change_check(delta(spark, d), view(spark, d, "regions").where("type = 0"))
    return ink.unionByName(rest.select("case_id", F.lit(-1).alias("node"), F.col("unexplained").alias("px")), allowMissingColumns=True).fillna(-1)


@query("p15_flat_palette", """WITH f AS (SELECT a.case_id, a.ar, a.ag, a.ab FROM raster a WHERE 4 = (SELECT count(*) FROM raster b WHERE b.case_id = a.case_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.ar = b.ar AND a.ag = b.ag AND a.ab = b.ab)),
  n AS (SELECT case_id, ar, ag, ab, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 8) SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, ar, ag, ab)::INTEGER AS rank FROM n QUALIFY rank <= 24""")
def p15(spark, d):
    return pixels.flat_palette(raster(spark, d))


@query("p16_colour_offset", f"""WITH lab AS (SELECT *, {_lab('a')}, {_lab('b')} FROM raster), o AS (SELECT case_id, bl - al AS l, ba - aa AS a, bbb - abb AS b FROM lab), m AS (SELECT case_id, quantile_disc(l, 0.5) AS ml, quantile_disc(a, 0.5) AS ma, quantile_disc(b, 0.5) AS mb FROM o GROUP BY 1)
  SELECT m.case_id, round(any_value(ml), 6) AS ml, round(any_value(ma), 6) AS ma, round(any_value(mb), 6) AS mb, round(sqrt(any_value(ml * ml + ma * ma + mb * mb)), 6) AS size, round(avg(CASE WHEN sqrt((l - ml) * (l - ml) + (a - ma) * (a - ma) + (b - mb) * (b - mb)) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM o JOIN m ON o.case_id = m.case_id GROUP BY m.case_id""")
def p16(spark, d):
    return pixels.colour_offset(raster(spark, d)).select("case_id", *[F.round(c, 6).alias(c) for c in ("ml", "ma", "mb", "size", "agreement")])


@query("p16_offset_p_values", """WITH s AS (SELECT c_custkey AS case_id, abs(c_acctbal) AS size FROM customer), q AS (SELECT p_retailprice AS size FROM part), u AS (SELECT quantile_cont(size, 0.9) AS u, count(*) AS n FROM q), x AS (SELECT avg(size - u) AS excess FROM q, u WHERE size > u)
  SELECT case_id, round(CASE WHEN size > u THEN 0.1 * exp(-(size - u) / excess) ELSE (1.0 + (SELECT count(*) FROM q WHERE q.size >= s.size)) / (n + 1) END, 9) AS p FROM s, u, x""")
def p16p(spark, d):
    s = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("case_id"), F.abs("c_acctbal").alias("size"))
    return pixels.offset_p_values(s, spark.read.parquet(f"{d}/part.parquet").select(F.col("p_retailprice").alias("size"))).withColumn("p", F.round("p", 9))


_FEATURES = ("log_area", "de_mean", "de_p90", "d_light", "d_chroma", "tex_t", "tex_c", "ink_balance")


@query("p17_box_features", f"""WITH {_DE}, j AS (SELECT r.case_id, r.node, de, al, bl, sqrt(aa * aa + abb * abb) AS ca, sqrt(ba * ba + bbb * bbb) AS cb FROM px JOIN regions r ON px.case_id = r.case_id AND px.x >= r.x AND px.x < r.x + r.w AND px.y >= r.y AND px.y < r.y + r.h)
  SELECT case_id, node, round(log10(count(*)), 5) AS log_area, round(avg(de), 5) AS de_mean, round(quantile_cont(de, 0.9), 5) AS de_p90, round(avg(bl) - avg(al), 5) + 0 AS d_light, round(avg(cb) - avg(ca), 5) + 0 AS d_chroma, round(stddev_pop(al), 5) AS tex_t, round(stddev_pop(bl), 5) AS tex_c, round(avg(sign(bl - al)), 5) AS ink_balance FROM j GROUP BY 1, 2""")
def p17(spark, d):
    return pixels.box_features(delta(spark, d), view(spark, d, "regions")).select("case_id", "node", *[(F.round(c, 5) + 0.0).alias(c) for c in _FEATURES])


@query("p18_evidence", f"""WITH {_DE}, g AS (SELECT r.case_id, r.node, count(*) FILTER (de > 15) AS px, avg(CASE WHEN de > 2.3 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM px JOIN regions r ON px.case_id = r.case_id AND px.x >= r.x - 1 AND px.x <= r.x + r.w AND px.y >= r.y - 1 AND px.y <= r.y + r.h GROUP BY 1, 2)
  SELECT r.case_id, r.node, coalesce(px, 0) AS px, coalesce(px, 0) >= 2 AS open, CASE WHEN share > 0.3 THEN 'jnd' END AS flagged FROM regions r LEFT JOIN g ON r.case_id = g.case_id AND r.node = g.node""")
def p18(spark, d):
    return pixels.evidence(delta(spark, d), view(spark, d, "regions"), gate_de=15.0, gate_px=2, jnd_share=0.3, region_de=1e9)
