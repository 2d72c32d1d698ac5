"""Null models of tile statistics, novelty of items, clusters of candidates, typing models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import geometry as G
from canopy.operators import spatial, stats
from canopy.operators.core import components

#: Logarithmic bins: ``BINS`` of them from 10^LOW to 10^HIGH; 0 is bin 0.
BINS, LOW, HIGH = 540, -7.0, 2.0


def log_bin(value):
    """0 for values up to 1e-7, else 1 to ``BINS`` by the logarithm."""
    at = F.floor((F.log10(value) - LOW) / ((HIGH - LOW) / BINS)) + 1
    return F.when(value <= 10.0**LOW, 0).otherwise(F.least(F.lit(BINS), F.greatest(F.lit(1), at))).cast("int")


def null_model(tiles: DataFrame, top: int = 400, xi_min: float = 0.1, beta_ci: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Histogram and tail of each stratum of tiles (page_bin, content_bin, value), its pooled strata included.

    Histogram: (page_bin, content_bin, bin, n), a null bin standing for all. Tail: (page_bin, content_bin, n, positive, u,
    beta, xi, k), a generalised Pareto distribution of the ``top`` largest positive values by moments.
    """
    sets = [["page_bin", "content_bin"], ["page_bin"], ["content_bin"], []]
    t = tiles.withColumn("bin", log_bin(F.col("value")))
    h = t.groupingSets([[*s, "bin"] for s in sets], "page_bin", "content_bin", "bin").agg(F.count("*").alias("n"))
    # the largest values of a pooled stratum are among the largest of its strata
    own = W.partitionBy("page_bin", "content_bin").orderBy(F.col("value").desc(), "id")
    large = spatial.checkpoint(tiles.where(F.col("value") > 10.0**LOW).withColumn("r", F.row_number().over(own)).where(F.col("r") <= top).drop("r"))
    each = None
    for s in sets:
        p = large.select("id", "value", *[F.col(c) if c in s else F.lit(None).cast(tiles.schema[c].dataType).alias(c) for c in ("page_bin", "content_bin")])
        each = p if each is None else each.unionByName(p)
    order = W.partitionBy("page_bin", "content_bin").orderBy(F.col("value").desc(), "id")
    best = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    g = best.groupBy("page_bin", "content_bin").agg(F.count("*").alias("k"), F.min("value").alias("u"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    mean, var = F.col("m") - F.col("u"), F.when(F.col("v") > 0, F.col("v")).otherwise(1e-12)
    g = g.withColumn("xi", F.least(F.lit(0.5), F.greatest(F.lit(xi_min), (1 - mean * mean / var) * 0.5)))
    g = g.withColumn("beta", F.greatest(mean * (1 - F.col("xi")), F.lit(1e-12)) * (F.lit(beta_ci) / F.sqrt("k") + 1))
    n = h.groupBy("page_bin", "content_bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bin") > 0, F.col("n")).otherwise(0)).alias("positive"))
    same = F.col("a.page_bin").eqNullSafe(F.col("b.page_bin")) & F.col("a.content_bin").eqNullSafe(F.col("b.content_bin"))
    tail = n.alias("a").join(g.alias("b"), same, "left").select("a.page_bin", "a.content_bin", "a.n", "a.positive", "b.u", "b.beta", "b.xi", "b.k")
    return h, tail


def p_values(tiles: DataFrame, histogram: DataFrame, tail: DataFrame, least: int = 3000) -> DataFrame:
    """(id, p) of tiles under the null model (N02): the share of positive values times the chance of as large a one.

    A stratum of fewer than ``least`` tiles gives way to that of its page bin, then of its content bin, then all. The body
    is counted, beyond u the tail's formula holds. The model's tables have a row for each stratum and bin.
    """
    up = W.partitionBy("page_bin", "content_bin").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    body = histogram.where("bin > 0").withColumn("above", F.sum("n").over(up)).select("page_bin", "content_bin", "bin", "above")
    # where a bin is empty, what is above it counts: spread over all bins
    grid = tail.select("page_bin", "content_bin").withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(BINS))))
    eq = lambda a, b, *c: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in c]
    on = lambda conds: conds[0] & conds[1] & conds[2]
    full = grid.alias("g").join(body.alias("b"), on(eq("g", "b", "page_bin", "content_bin", "bin")), "left").select("g.page_bin", "g.content_bin", "g.bin", "b.above")
    next_ = W.partitionBy("page_bin", "content_bin").orderBy("bin").rowsBetween(0, W.unboundedFollowing)
    full = full.withColumn("above", F.coalesce(F.first("above", ignorenulls=True).over(next_), F.lit(0)))
    # the stratum each pair of bins falls back to
    pairs = tiles.select("page_bin", "content_bin").distinct()
    choices = F.array(*[F.struct(F.lit(i).alias("o"), p.alias("p"), c.alias("c")) for i, (p, c) in enumerate(((F.col("page_bin"), F.col("content_bin")), (F.col("page_bin"), F.lit(None).cast("long")), (F.lit(None).cast("long"), F.col("content_bin")), (F.lit(None).cast("long"), F.lit(None).cast("long"))))])
    cand = pairs.withColumn("s", F.explode(choices)).alias("a").join(F.broadcast(tail).alias("t"), F.col("a.s.p").eqNullSafe(F.col("t.page_bin").cast("long")) & F.col("a.s.c").eqNullSafe(F.col("t.content_bin").cast("long")))
    cand = cand.where((F.col("n") >= least) | (F.col("a.s.o") == 3))
    own = cand.groupBy("a.page_bin", "a.content_bin").agg(F.min_by(F.struct("s", "n", "positive", "u", "beta", "xi", "k"), "a.s.o").alias("m"))
    j = tiles.withColumn("bin", log_bin(F.col("value"))).join(F.broadcast(own), ["page_bin", "content_bin"])
    f = full.select(F.col("page_bin").cast("long").alias("fp"), F.col("content_bin").cast("long").alias("fc"), F.col("bin").alias("fb"), "above")
    j = j.join(F.broadcast(f), F.col("m.s.p").eqNullSafe(F.col("fp")) & F.col("m.s.c").eqNullSafe(F.col("fc")) & (F.col("bin") == F.col("fb")), "left")
    share = (F.col("m.positive") + 1) / (F.col("m.n") + 1)
    z = F.greatest(F.lit(0.0), F.col("value") - F.col("m.u")) / F.col("m.beta")
    beyond = F.col("m.k") / (F.col("m.positive") + 1) * F.pow(F.col("m.xi") * z + 1, F.lit(-1.0) / F.col("m.xi"))
    cond = F.when((F.col("m.k") >= 10) & (F.col("value") > F.col("m.u")), beyond).otherwise(F.greatest(F.coalesce("above", F.lit(0)), F.lit(1)) / (F.col("m.positive") + 1))
    p = F.when(F.col("bin") == 0, 1.0).otherwise(F.greatest(F.lit(1e-300), share * F.least(F.lit(1.0), cond)))
    return j.select("id", p.alias("p"))


def page_normalised(tiles: DataFrame, q: float = 0.9, floor: float = 0.05, least: int = 20) -> DataFrame:
    """(id, value) divided by its page's ``q`` quantile in its content bin, of few tiles by the whole page's."""
    both = tiles.groupBy("page", "content_bin").agg(F.percentile("value", q).alias("own"), F.count("*").alias("n"))
    whole = tiles.groupBy("page").agg(F.percentile("value", q).alias("all"))
    j = tiles.join(both, ["page", "content_bin"]).join(whole, "page")
    return j.select("id", (F.col("value") / F.greatest(F.lit(floor), F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("all")))).alias("value"))


def null_tiles(tiles: DataFrame, truth: DataFrame, pad: int = 4) -> DataFrame:
    """Tiles (case_id, tile, x, y, w, h) that touch no true finding, padded."""
    wide = truth.select("case_id", F.col("fid"), (F.col("x") - pad).alias("x"), (F.col("y") - pad).alias("y"), (F.col("w") + 2 * pad).alias("w"), (F.col("h") + 2 * pad).alias("h"))
    hit = spatial.spatial_join(tiles, wide).select("case_id", F.col("l_tile").alias("tile")).distinct()
    return tiles.join(hit, ["case_id", "tile"], "left_anti")


def meaningful_regions(tiles: DataFrame, eps: float = 1.0) -> DataFrame:
    """Groups of overlapping tiles whose expected false alarms are under ``eps`` (N15): box, least alarm, what fired.

    Tiles: (case_id, tile, nfa, fired, x, y, w, h).
    """
    t = spatial.checkpoint(tiles.where(F.col("nfa") < eps).withColumn("v", F.xxhash64("case_id", "tile")))
    e = spatial.spatial_join(t, t, condition=F.col("l_v") < F.col("r_v")).select(F.col("l_v").alias("a"), F.col("r_v").alias("b"))
    g = t.join(components(e), "v", "left").groupBy("case_id", F.coalesce("component", "v").alias("c"))
    r = g.agg(F.count("*").alias("tiles"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"), F.min("nfa").alias("nfa"), F.min_by("fired", F.struct("nfa", "tile")).alias("fired"))
    return r.select("case_id", "tiles", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "nfa", "fired")


def item_table(regions: DataFrame, findings: DataFrame, top: int = 400, least: float = 24.0) -> DataFrame:
    """(case_id, id, source, type, x, y, w, h): each page's largest residual regions and its findings that are no noise."""
    area = F.col("w") * F.col("h")
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(area.desc(), "id"))
    r = regions.withColumn("r", rank).where((F.col("r") <= top) & (area >= least)).select("case_id", "id", F.lit("residual").alias("source"), F.lit(None).cast("string").alias("type"), "x", "y", "w", "h")
    f = findings.where(~F.col("type").startswith("noise") & (area >= least)).select("case_id", "id", F.lit("finding").alias("source"), "type", "x", "y", "w", "h")
    return r.unionByName(f)


def known_labels(items: DataFrame, truth: DataFrame, loc_iou: float = 0.3) -> DataFrame:
    """(case_id, id, label): type of the true finding an item overlaps best, else ``noise``."""
    j = spatial.spatial_join(items, truth, condition=G.iou("l_", "r_") >= loc_iou)
    best = j.groupBy("case_id", F.col("l_id").alias("id")).agg(F.max_by("r_type", F.struct(F.round(G.iou("l_", "r_"), 12), -F.col("r_fid"))).alias("label"))
    return items.select("case_id", "id").join(best, ["case_id", "id"], "left").withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("noise")))


def leave_one_out_distances(known: DataFrame, k: int = 5) -> DataFrame:
    """(id, d): distance of each known item (id, x array) to its kth nearest other one."""
    n = stats.k_nearest(known.withColumn("label", F.lit(0)), known.withColumn("label", F.lit(0)), k)
    return n.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt("d2").alias("d"))


def novelty(items: DataFrame, known: DataFrame, reference: DataFrame, k: int = 5, alpha: float = 0.02, purity: float = 0.6) -> DataFrame:
    """(id, d, p, label, purity, candidate) of items against known ones.

    p: share of the reference distances as large as the item's to its kth neighbour. Candidates have a p under ``alpha``,
    or one under twice that in a neighbourhood of mixed labels.
    """
    n = spatial.checkpoint(stats.k_nearest(items, known, k))
    kth = n.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt("d2").alias("score"))
    p = stats.conformal(kth, reference.select(F.col("d").alias("score")))
    pure = stats.purity(n).withColumnRenamed("query_id", "id")
    j = p.join(pure, "id")
    c = (F.col("p") < alpha) | ((F.col("purity") < purity) & (F.col("p") < 2 * alpha))
    return j.select("id", F.col("score").alias("d"), "p", "label", "purity", c.alias("candidate"))


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, cluster) of points (id, x, y) by density (N09); noise has no cluster, a border point that of its nearest core.

    Points meet in cells of side ``eps``; a cluster's name is its smallest core id. Points of one place have the same neighbours
    and the same cluster, so places meet, each once, with the number and the smallest id of their points.
    """
    cell = lambda c: F.floor(F.col(c) / eps)
    places = spatial.checkpoint(points.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumns({"i": cell("x"), "j": cell("y")}))
    own = places.select(F.col("id").alias("a"), "x", "y", "i", "j")
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    other = places.withColumn("i", around("i")).withColumn("j", around("j")).select("i", "j", F.col("id").alias("b"), "n", F.col("x").alias("bx"), F.col("y").alias("by"))
    d2 = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
    near = spatial.checkpoint(own.join(other, ["i", "j"]).withColumn("d2", d2).where(F.col("d2") <= eps * eps).select("a", "b", "n", "d2"))
    core = spatial.checkpoint(near.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("a"))
    links = near.join(core, "a", "left_semi").join(core.select(F.col("a").alias("b")), "b", "left_semi")
    part = components(links.select("a", "b"))
    member = part.select(F.col("v").alias("place"), F.col("component").alias("cluster"))
    border = near.join(core, "a", "left_anti").join(part.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("place")).agg(F.min_by("component", F.struct("d2", "b")).alias("cluster"))
    named = places.select("x", "y", F.col("id").alias("place")).join(member.unionByName(border), "place").select("x", "y", "cluster")
    return points.join(named, ["x", "y"], "left").select("id", "cluster")


def cluster_report(members: DataFrame, features: list[str]) -> DataFrame:
    """By cluster (N10): size, pages, promotable (two pages or more), commonest nearest type, mean and range of each feature, first item of each page."""
    g = members.groupBy("cluster")
    per = [f(F.col(c)).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]
    a = g.agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), *per)
    types = members.groupBy("cluster", "nearest").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.min_by("nearest", F.struct(-F.col("k"), F.col("nearest"))).alias("nearest"))
    firsts = members.groupBy("cluster", "page").agg(F.min("id").alias("id")).groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 4).alias("exemplars"))
    return a.withColumn("promotable", F.col("pages") >= 2).join(types, "cluster").join(firsts, "cluster")
