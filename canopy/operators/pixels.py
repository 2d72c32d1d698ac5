"""Pixel and tile tables: differences, regions, error by node, loss, edges, coverage.

A pixel table holds (case_id, x, y) once, with the target's colour (ar, ag, ab) and the candidate's (br, bg, bb);
``delta_map`` makes it from one table a side and adds ``de``, the colour difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import color as C
from canopy.operators.core import checkpoint
from canopy.operators.core import components
from canopy.operators.core import dealt, written

#: Colour differences from which a pixel counts: just noticeable, plainly wrong.
JND, BAD = 2.3, 6.0


def _lab(p: str) -> tuple[Column, Column, Column]:
    return C.lab(*[F.col(p + c) for c in "rgb"])


def delta_map(target: DataFrame, candidate: DataFrame, method: str = "cie76") -> DataFrame:
    """Target and candidate pixels (case_id, x, y, r, g, b) joined, with their difference ``de``."""
    side = lambda df, p: df.select("case_id", "x", "y", *[F.col(c).alias(p + c) for c in "rgb"])
    delta = {"cie76": C.delta76, "ciede2000": C.delta2000}[method]
    return side(target, "a").join(side(candidate, "b"), ["case_id", "x", "y"]).withColumn("de", delta(_lab("a"), _lab("b")))


def with_delta(pixels: DataFrame, method: str = "cie76") -> DataFrame:
    """A table that has both sides already, with ``de``."""
    return pixels.withColumn("de", {"cie76": C.delta76, "ciede2000": C.delta2000}[method](_lab("a"), _lab("b")))


def metrics(pixels: DataFrame, bad: float = BAD, jnd: float = JND, cap: float = 100.0) -> DataFrame:
    """MSE, PSNR (capped), mean and largest difference, shares of bad and noticeable pixels by case."""
    square = sum((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "rgb") / 3.0
    share = lambda limit: F.avg((F.col("de") > limit).cast("double"))
    m = pixels.groupBy("case_id").agg(F.count("*").alias("n"), F.avg(square).alias("mse"), F.avg("de").alias("mean_de"), F.max("de").alias("max_de"), share(bad).alias("frac_bad"), share(jnd).alias("jnd_frac"))
    psnr = F.when(F.col("mse") <= 1e-12, cap).otherwise(F.least(F.lit(cap), F.log10(F.lit(65025.0) / F.col("mse")) * 10))
    return m.withColumn("psnr", psnr)


def residual_regions(pixels: DataFrame, bad: float = BAD, dilate: int = 2, least: int = 16, top: int = 64) -> DataFrame:
    """Regions of bad pixels that meet once each is grown by ``dilate`` steps, by falling sum of differences.

    Runs of bad pixels in a row are joined with those of the rows near it, so a region's pixels are not paired.
    """
    reach = 2 * dilate + 1
    row = W.partitionBy("case_id", "y").orderBy("x")
    b = pixels.where(F.col("de") > bad).withColumn("fresh", F.when(F.col("x") - F.lag("x").over(row) == 1, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(row))
    runs = b.groupBy("case_id", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"), F.sum("de").alias("mass"))
    runs = checkpoint(runs.withColumn("id", F.xxhash64("case_id", "y", "run")))
    upper = runs.select("case_id", F.col("id").alias("b"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("y").alias("u"), F.explode(F.sequence(F.col("y"), F.col("y") + reach)).alias("y"))
    gap = F.greatest(F.col("u0") - F.col("x1"), F.col("x0") - F.col("u1"), F.lit(0))
    edges = runs.join(upper, ["case_id", "y"]).where((F.col("id") != F.col("b")) & (gap + (F.col("y") - F.col("u")) <= reach)).select(F.col("id").alias("a"), "b")
    part = components(edges).select(F.col("v").alias("id"), "component")
    g = runs.join(part, "id", "left").groupBy("case_id", F.coalesce("component", "id").alias("c"))
    r = g.agg(F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("x2"), F.max("y").alias("y2"), F.sum("n").alias("n"), F.sum("mass").alias("mass")).where(F.col("n") >= least)
    r = r.select("case_id", "x", "y", (F.col("x2") - F.col("x") + 1).alias("w"), (F.col("y2") - F.col("y") + 1).alias("h"), "n", "mass")
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.col("mass").desc(), "y", "x"))
    return r.withColumn("rank", rank).where(F.col("rank") <= top)


def box_sums(pixels: DataFrame, boxes: DataFrame, value: Column, key: str = "node") -> DataFrame:
    """(case_id, key, s, n): sum of ``value`` and number of pixels in each box, from two points of each row it crosses.

    The running sum up to an edge is that of the last pixel before it, so rows need not be complete.
    """
    row = W.partitionBy("case_id", "y").orderBy("at")
    kept = written(pixels.select("case_id", "y", F.col("x").alias("at"), value.alias("value")))
    run = dealt(kept, kept.count(), "case_id", "y").select("case_id", "y", "at", F.sum("value").over(row).alias("s"), F.row_number().over(row).alias("n"))
    run = run.withColumn("until", F.coalesce(F.lead("at").over(W.partitionBy("case_id", "y").orderBy("at")) - 1, F.lit(2**31 - 1)))
    rows = _corners(boxes, key)
    hit = rows.join(run, ["case_id", "y"]).where("edge >= at AND edge <= until")
    return hit.groupBy("case_id", key).agg(F.sum(F.col("s") * F.col("sign")).alias("s"), F.sum(F.col("n") * F.col("sign")).alias("n"))


def _corners(boxes: DataFrame, key: str) -> DataFrame:
    """The two edges of each row of each box."""
    b = boxes.where("w > 0 AND h > 0").withColumn("y", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)))
    edges = F.array(F.struct((F.col("x") - 1).alias("edge"), F.lit(-1).alias("sign")), F.struct((F.col("x") + F.col("w") - 1).alias("edge"), F.lit(1).alias("sign")))
    return b.select("case_id", key, "y", F.explode(edges).alias("e")).select("case_id", key, "y", "e.edge", "e.sign")


def node_errors(pixels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean difference in each node's box less its children's parts of it; of the whole box if nothing is left."""
    kids = nodes.where("parent IS NOT NULL").select("case_id", F.col("node").alias("kid"), F.col("parent").alias("node"), *[F.col(c).alias(f"k{c}") for c in "xywh"])
    j = kids.join(nodes.select("case_id", "node", "x", "y", "w", "h"), ["case_id", "node"])
    x, y = F.greatest("x", "kx"), F.greatest("y", "ky")
    cut = j.select("case_id", "kid", "node", x.alias("x"), y.alias("y"), (F.least(F.col("x") + F.col("w"), F.col("kx") + F.col("kw")) - x).alias("w"), (F.least(F.col("y") + F.col("h"), F.col("ky") + F.col("kh")) - y).alias("h"))
    # boxes and their children's parts meet the pixels together
    boxes = nodes.select("case_id", "node", F.lit(None).cast(cut.schema["kid"].dataType).alias("kid"), *"xywh").unionByName(cut).withColumn("box", F.struct("node", "kid"))
    of = lambda kid, c: F.sum(F.when(F.col("box.kid").isNotNull() == F.lit(kid), F.col(c)))
    sums = box_sums(pixels, boxes, F.col("de"), "box").groupBy("case_id", "box.node").agg(of(False, "s").alias("total"), of(False, "n").alias("area"), of(True, "s").alias("s"), of(True, "n").alias("k"))
    e = nodes.select("case_id", "node").join(sums, ["case_id", "node"], "left")
    left, total = F.coalesce("area", F.lit(0)) - F.coalesce("k", F.lit(0)), F.coalesce("total", F.lit(0.0))
    error = F.when(F.coalesce("area", F.lit(0)) <= 0, 0.0).when(left <= 0, total / F.col("area")).otherwise(F.greatest(F.lit(0.0), total - F.coalesce("s", F.lit(0.0))) / left)
    return e.select("case_id", "node", error.alias("error"))


def loss(m: DataFrame, texts: DataFrame, frames: DataFrame, de_norm: float = 50.0, w_text: float = 0.5) -> DataFrame:
    """Weighted sum of pixel, bad share, text and size terms by case."""
    size = frame_conformity(frames).select("case_id", (1 - F.col("frame_iou")).alias("size_term"))
    j = m.join(size, "case_id", "left").join(texts.select("case_id", "text_term"), "case_id", "left")
    total = F.least(F.lit(1.0), F.col("mean_de") / de_norm) + F.col("frac_bad") + F.coalesce("text_term", F.lit(0.0)) * w_text + F.coalesce("size_term", F.lit(0.0))
    return j.select("case_id", total.alias("loss"))


def text_split(pixels: DataFrame, texts: DataFrame, jnd: float = JND, pad: int = 2) -> DataFrame:
    """Share of noticeable pixels inside and outside the padded text boxes of each case."""
    b = texts.select("case_id", F.explode(F.sequence(F.col("y") - pad, F.col("y") + F.col("h") + pad - 1)).alias("y"), (F.col("x") - pad).alias("lo"), (F.col("x") + F.col("w") + pad - 1).alias("hi")).distinct()
    # overlapping boxes of a row become disjoint stretches, so that a pixel meets one at most
    order = W.partitionBy("case_id", "y").orderBy("lo", "hi")
    fresh = F.when(F.col("lo") > F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)) + 1, 1).otherwise(0)
    s = b.withColumn("k", fresh).withColumn("k", F.sum("k").over(order)).groupBy("case_id", "y", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    inside = pixels.join(s, ["case_id", "y"]).where("x BETWEEN lo AND hi").select("case_id", "x", "y").withColumn("text", F.lit(True))
    p = pixels.join(inside, ["case_id", "x", "y"], "left").withColumn("bad", (F.col("de") > jnd).cast("double"))
    return p.groupBy("case_id").agg(F.avg(F.when(F.col("text"), F.col("bad"))).alias("jnd_text"), F.avg(F.when(F.col("text").isNull(), F.col("bad"))).alias("jnd_nontext"))


def flat_regions(pixels: DataFrame, quant: int = 12, least: int = 64) -> DataFrame:
    """Connected regions of one quantised target colour and their mean CIEDE2000 difference."""
    q = with_delta(pixels, "ciede2000").select("case_id", "x", "y", "de", *[F.floor(F.col(f"a{c}") / quant).alias(c) for c in "rgb"])
    row = W.partitionBy("case_id", "y", "r", "g", "b").orderBy("x")
    q = q.withColumn("fresh", F.when(F.col("x") - F.lag("x").over(row) == 1, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(row))
    runs = q.groupBy("case_id", "y", "r", "g", "b", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"), F.sum("de").alias("de"))
    runs = checkpoint(runs.withColumn("id", F.xxhash64("case_id", "y", "r", "g", "b", "run")))
    below = runs.select("case_id", (F.col("y") + 1).alias("y"), "r", "g", "b", F.col("id").alias("up"), F.col("x0").alias("u0"), F.col("x1").alias("u1"))
    edges = runs.join(below, ["case_id", "y", "r", "g", "b"]).where("u0 <= x1 AND x0 <= u1").select(F.col("id").alias("a"), F.col("up").alias("b"))
    part = components(edges).select(F.col("v").alias("id"), "component")
    g = runs.join(part, "id", "left").groupBy("case_id", F.coalesce("component", "id").alias("c"))
    r = g.agg(F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("x2"), F.max("y").alias("y2"), F.sum("n").alias("n"), (F.sum("de") / F.sum("n")).alias("de"))
    return r.where(F.col("n") >= least).select("case_id", "x", "y", "x2", "y2", "n", "de")


def tile_statistics(pixels: DataFrame, size: int = 8, jnd: float = JND) -> DataFrame:
    """Mean difference and noticeable share of half-overlapping square tiles."""
    half = size // 2
    own = lambda c: F.array(F.floor(F.col(c) / half) - 1, F.floor(F.col(c) / half))
    p = pixels.select("case_id", "de", F.explode(own("x")).alias("i"), own("y").alias("rows")).select("case_id", "de", "i", F.explode("rows").alias("j"))
    t = p.where("i >= 0 AND j >= 0").groupBy("case_id", "i", "j")
    return t.agg(F.count("*").alias("n"), F.avg("de").alias("mean_de"), F.avg((F.col("de") > jnd).cast("double")).alias("jnd_frac"))


def page_noise(pixels: DataFrame, edge: Column, sub: float = 0.3, jnd: float = JND, least: int = 100) -> DataFrame:
    """Shares of edge pixels that differ at all and noticeably; 0 on pages of few edge pixels."""
    e = pixels.withColumn("edge", edge)
    share = lambda limit: F.avg(F.when(F.col("edge"), (F.col("de") > limit).cast("double")))
    g = e.groupBy("case_id").agg(F.sum(F.col("edge").cast("long")).alias("n"), share(sub).alias("s"), share(jnd).alias("j"))
    enough = lambda c: F.when(F.col("n") >= least, F.col(c)).otherwise(0.0)
    return g.select("case_id", enough("s").alias("sub_share"), enough("j").alias("jnd_share"))


def page_bin(noise: DataFrame, cut: float = 0.3, sub_cut: float = 0.4) -> DataFrame:
    """Stratum of a page (N06): 3 unexplained, 2 not registered, 1 registered after a fitted blur or compression, 0 exact.

    ``noise``: (case_id, sub_share, jnd_share, registered, fitted).
    """
    bin_ = F.when(F.col("jnd_share") >= cut, 3).when(~F.col("registered"), 2).when(F.col("fitted"), 1).when(F.col("sub_share") >= sub_cut, 3).otherwise(0)
    return noise.select("case_id", bin_.alias("page_bin"))


def nearest_pixels(points: DataFrame, others: DataFrame, cell: int = 8) -> DataFrame:
    """Distance from each of ``points`` (case_id, x, y) to the nearest of ``others``; null where a case has none (P10).

    Both sides are dealt to square cells and meet in 3 x 3 of them. What has found nothing as near as a cell's
    side, which another cell could beat, goes again with cells twice as wide.
    """
    reachable = others.select("case_id").distinct()
    open_ = checkpoint(points.join(reachable, "case_id", "left_semi"))
    done = points.join(reachable, "case_id", "left_anti").select("case_id", "x", "y", F.lit(None).cast("double").alias("d"))
    while not open_.isEmpty():
        at = lambda c, size=cell: F.floor(F.col(c) / size)
        spread = open_.withColumn("i", F.explode(F.sequence(at("x") - 1, at("x") + 1))).withColumn("j", F.explode(F.sequence(at("y") - 1, at("y") + 1)))
        o = others.select("case_id", at("x").alias("i"), at("y").alias("j"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
        near = checkpoint(spread.join(o, ["case_id", "i", "j"], "left").groupBy("case_id", "x", "y").agg(F.min(d2).alias("d2")))
        settled = F.coalesce(F.col("d2") <= cell * cell, F.lit(False))
        done = done.unionByName(near.where(settled).select("case_id", "x", "y", F.sqrt("d2").alias("d")))
        open_, cell = near.where(~settled).select("case_id", "x", "y"), cell * 2
    return done


def edge_agreement(target: DataFrame, render: DataFrame, tol: float = 1.5, tile: int = 64) -> DataFrame:
    """Chamfer distance, share of target edges within a pixel, F1 at a tolerance and the worst tile by case (P10).

    Both inputs list edge pixels (case_id, x, y). Without edges on both sides 0, 1, 1 and 0; with edges on one side
    only, distances are null and F1 is 0.
    """
    sides = nearest_pixels(target, render).withColumn("side", F.lit("t")).unionByName(nearest_pixels(render, target).withColumn("side", F.lit("r")))
    is_t, is_r = F.col("side") == "t", F.col("side") == "r"
    mean = lambda s: F.avg(F.when(s, F.col("d")))
    within = lambda s, limit: F.avg(F.when(s, F.coalesce(F.col("d") <= limit, F.lit(False)).cast("double")))
    s = checkpoint(sides)
    whole = s.groupBy("case_id").agg(((mean(is_t) + mean(is_r)) / 2).alias("chamfer"), within(is_t, 1.0).alias("within1"), within(is_t, tol).alias("rec"), within(is_r, tol).alias("prec"))
    t = s.groupBy("case_id", F.floor(F.col("x") / tile).alias("i"), F.floor(F.col("y") / tile).alias("j"))
    t = t.agg(mean(is_t).alias("a"), mean(is_r).alias("b"), F.max(F.when(is_t, F.col("d"))).alias("ma"), F.max(F.when(is_r, F.col("d"))).alias("mb"))
    t = t.withColumn("v", (F.coalesce("a", "mb") + F.coalesce("b", "ma")) / 2).groupBy("case_id").agg(F.max("v").alias("worst_tile"))
    f1 = F.when(F.col("rec") + F.col("prec") > 0, F.col("rec") * F.col("prec") * 2 / (F.col("rec") + F.col("prec"))).otherwise(0.0)
    return whole.join(t, "case_id").select("case_id", "chamfer", F.coalesce("within1", F.lit(1.0)).alias("within1"), f1.alias("f1"), "worst_tile")


def frame_conformity(frames: DataFrame) -> DataFrame:
    """Whether sizes match, and the IoU of the frames (tw, th) and (rw, rh) put into one corner."""
    inter = F.least("tw", "rw") * F.least("th", "rh")
    union = F.col("tw") * F.col("th") + F.col("rw") * F.col("rh") - inter
    return frames.select("case_id", ((F.col("tw") == F.col("rw")) & (F.col("th") == F.col("rh"))).alias("size_match"), F.when(inter > 0, inter / union).otherwise(0.0).alias("frame_iou"))


def conformed(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Target pixels with the candidate's; where its frame (rw, rh) has none, black on light and white on dark."""
    p = pixels.join(frames.select("case_id", "rw", "rh"), "case_id").withColumn("missing", (F.col("x") >= F.col("rw")) | (F.col("y") >= F.col("rh")))
    light = F.col("ar") * 0.299 + F.col("ag") * 0.587 + F.col("ab") * 0.114
    fill = p.where("missing").groupBy("case_id").agg(F.when(F.avg(light) > 127.5, 0).otherwise(255).alias("fill"))
    p = p.join(fill, "case_id", "left")
    return p.select("case_id", "x", "y", "ar", "ag", "ab", *[F.when(F.col("missing"), F.col("fill")).otherwise(F.col(f"b{c}")).alias(f"b{c}") for c in "rgb"], "missing")


def covered_area(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """Area of the union of each case's boxes within its frame, as a share of it (P13), by merged stretches of rows."""
    b = boxes.join(frames.select("case_id", "tw", "th"), "case_id")
    b = b.select("case_id", F.greatest(F.lit(0), "x").alias("lo"), F.least("tw", F.col("x") + F.col("w")).alias("hi"), F.greatest(F.lit(0), "y").alias("top"), F.least("th", F.col("y") + F.col("h")).alias("end")).where("hi > lo AND end > top")
    rows = b.select("case_id", "lo", "hi", F.explode(F.sequence(F.col("top"), F.col("end") - 1)).alias("y"))
    order = W.partitionBy("case_id", "y").orderBy("lo", "hi")
    seen = F.coalesce(F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("lo"))
    area = rows.withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest(seen, F.col("lo")))).groupBy("case_id").agg(F.sum("new").alias("area"))
    return frames.join(area, "case_id", "left").select("case_id", F.coalesce("area", F.lit(0)).alias("area"), (F.coalesce("area", F.lit(0)) / (F.col("tw") * F.col("th"))).alias("share"))


def _in_boxes(pixels: DataFrame, boxes: DataFrame, pad: int, key: list[str]) -> DataFrame:
    """Pixels joined with the padded boxes they lie in, by row."""
    b = boxes.select("case_id", *key, F.explode(F.sequence(F.col("y") - pad, F.col("y") + F.col("h") + pad - 1)).alias("y"), (F.col("x") - pad).alias("_lo"), (F.col("x") + F.col("w") + pad - 1).alias("_hi"))
    return pixels.join(b, ["case_id", "y"]).where("x BETWEEN _lo AND _hi").drop("_lo", "_hi")


def change_check(pixels: DataFrame, findings: DataFrame, limit: float = JND, pad: int = 1) -> tuple[DataFrame, DataFrame]:
    """Changed pixels and their box for each finding, and the changed pixels of each case that none explains."""
    changed = pixels.where(F.col("de") > limit).select("case_id", "x", "y")
    hit = _in_boxes(changed, findings, pad, ["node"])
    ink = hit.groupBy("case_id", "node").agg(F.count("*").alias("px"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    ink = findings.select("case_id", "node").join(ink, ["case_id", "node"], "left").withColumn("px", F.coalesce("px", F.lit(0)))
    rest = changed.join(hit.select("case_id", "x", "y").distinct(), ["case_id", "x", "y"], "left_anti").groupBy("case_id").agg(F.count("*").alias("unexplained"))
    return ink, rest


def flat_palette(pixels: DataFrame, least: int = 8, top: int = 24) -> DataFrame:
    """Most frequent target colours of pixels that equal their four neighbours."""
    colour = F.struct("ar", "ag", "ab")
    row, column = W.partitionBy("case_id", "y").orderBy("x"), W.partitionBy("case_id", "x").orderBy("y")
    same = F.lit(True)
    for order, at in ((row, "x"), (column, "y")):
        for f, step in ((F.lag, 1), (F.lead, -1)):
            same = same & F.coalesce((f(colour).over(order) == colour) & (F.col(at) - f(at).over(order) == step), F.lit(False))
    n = pixels.withColumn("flat", same).where("flat").groupBy("case_id", "ar", "ag", "ab").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.col("n").desc(), "ar", "ag", "ab"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)


def colour_offset(pixels: DataFrame, agree: float = 2.0) -> DataFrame:
    """Median Lab offset of each case, its size and the share of pixels within ``agree`` of it."""
    a, b = _lab("a"), _lab("b")
    p = checkpoint(pixels.select("case_id", *[(y - x).alias(n) for x, y, n in zip(a, b, "lab", strict=True)]))
    m = p.groupBy("case_id").agg(*[F.percentile_approx(n, 0.5, 100000).alias(f"m{n}") for n in "lab"])
    off = sum((F.col(n) - F.col(f"m{n}")) * (F.col(n) - F.col(f"m{n}")) for n in "lab")
    share = p.join(m, "case_id").groupBy("case_id").agg(F.avg((F.sqrt(off) <= agree).cast("double")).alias("agreement"))
    size = F.sqrt(sum(F.col(f"m{n}") * F.col(f"m{n}") for n in "lab"))
    return m.join(share, "case_id").select("case_id", *[f"m{n}" for n in "lab"], size.alias("size"), "agreement")


def offset_p_values(offsets: DataFrame, null: DataFrame, tail: float = 0.1) -> DataFrame:
    """p-value of each offset's size against null sizes: rank, and beyond the null's top tenth an exponential tail."""
    u = null.agg(F.percentile("size", 1 - tail).alias("u"), F.count("*").alias("n"))
    over = null.crossJoin(F.broadcast(u)).where("size > u").agg(F.avg(F.col("size") - F.col("u")).alias("excess"))
    count = offsets.select(F.col("case_id"), F.col("size").alias("s"))
    bins = null.groupBy("size").agg(F.count("*").alias("k"))
    both = count.select("case_id", F.col("s").alias("size"), F.lit(0).cast("long").alias("k")).unionByName(bins.select(F.lit(None).alias("case_id"), "size", "k"))
    above = W.partitionBy(F.lit(0)).orderBy(F.col("size").desc()).rangeBetween(W.unboundedPreceding, 0)  # one row a case
    ranked = both.withColumn("as_large", F.sum("k").over(above)).where("case_id IS NOT NULL").crossJoin(F.broadcast(u)).crossJoin(F.broadcast(over))
    p = F.when((F.col("size") > F.col("u")) & (F.col("excess") > 0), F.exp(-(F.col("size") - F.col("u")) / F.col("excess")) * tail).otherwise((F.col("as_large") + 1) / (F.col("n") + 1))
    return ranked.select("case_id", p.alias("p"))


def box_features(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """By box (P17): log area, mean and 90 % point of the difference, lightness and chroma of both sides, texture, ink balance."""
    (la, aa, ba), (lb, ab, bb) = _lab("a"), _lab("b")
    p = _in_boxes(pixels.select("case_id", "x", "y", "de", la.alias("la"), lb.alias("lb"), F.sqrt(aa * aa + ba * ba).alias("ca"), F.sqrt(ab * ab + bb * bb).alias("cb")), boxes, 0, ["node"])
    g = p.groupBy("case_id", "node")
    return g.agg(F.log10(F.count("*")).alias("log_area"), F.avg("de").alias("de_mean"), F.percentile("de", 0.9).alias("de_p90"), (F.avg("lb") - F.avg("la")).alias("d_light"), (F.avg("cb") - F.avg("ca")).alias("d_chroma"), F.stddev_pop("la").alias("tex_t"), F.stddev_pop("lb").alias("tex_c"), F.avg(F.signum(F.col("lb") - F.col("la"))).alias("ink_balance"))


def evidence(pixels: DataFrame, findings: DataFrame, gate_de: float = 20.0, gate_px: int = 16, jnd: float = JND, jnd_share: float = 0.02, region_de: float = 5.0, pad: int = 1) -> DataFrame:
    """Whether a finding's padded box holds enough changed pixels, and whether a validator's rules would flag it."""
    p = _in_boxes(pixels, findings, pad, ["node"])
    means = [F.avg(f"{s}{c}").alias(f"{s}{c}") for s in "ab" for c in "rgb"]
    g = p.groupBy("case_id", "node").agg(F.sum((F.col("de") > gate_de).cast("long")).alias("px"), F.avg((F.col("de") > jnd).cast("double")).alias("share"), *means)
    g = findings.select("case_id", "node").join(g, ["case_id", "node"], "left")
    verdict = F.when(F.col("share") > jnd_share, "jnd").when(C.delta76(_lab("a"), _lab("b")) > region_de, "colour")
    return g.select("case_id", "node", F.coalesce("px", F.lit(0)).alias("px"), (F.coalesce("px", F.lit(0)) >= gate_px).alias("open"), verdict.alias("flagged"))
