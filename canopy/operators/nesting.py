"""Trees out of flat boxes, and rewrites of trees: nesting, layout, rows, paragraphs, paint order, instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import color as C
from canopy.functions import geometry as G
from canopy.operators import spatial
from canopy.operators.core import components


def contained(boxes: DataFrame, share: float = 0.9, text_share: float = 0.6, text_type: int = 2, leaf_types: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(case_id, node, parent): the smallest larger box that holds a share of each box, null for outermost ones.

    Texts need less of their area inside; boxes of leaf types hold nothing. Of equal areas the smaller node is the holder.
    """
    need = F.when(F.col("l_type") == text_type, text_share).otherwise(share)
    size = lambda p: F.struct(G.area(p), -F.col(p + "node"))
    ok = ~F.col("r_type").isin(*leaf_types) & (size("r_") > size("l_")) & (G.overlap("l_", "r_") >= G.area("l_") * need)
    p = spatial.spatial_join(boxes, boxes, condition=ok).groupBy("case_id", F.col("l_node").alias("node")).agg(F.min_by("r_node", F.struct(G.area("r_"), -F.col("r_node"))).alias("parent"))
    return boxes.select("case_id", "node").join(p, ["case_id", "node"], "left")


def frame_layout(nodes: DataFrame, tol: float = 1.5, overlap: float = 1.0) -> DataFrame:
    """Layout of each frame's children (T10): (case_id, parent, n, direction, gap, drift, pad_main, pad_cross, align).

    A column's (row's) children follow each other downwards (rightwards) without overlap, in places that a constant gap
    predicts within ``tol``; else direction is none. Alignment across: start, end, center or none. The padding is the least
    distance from the frame's edges before the first child and beside all.
    """
    frame = nodes.select("case_id", F.col("node").alias("parent"), *[F.col(c).alias(f"f{c}") for c in "xywh"])
    kids = nodes.where("parent IS NOT NULL").join(frame, ["case_id", "parent"])

    def axis(name: str, p: str, s: str, q: str, t: str) -> DataFrame:
        order = W.partitionBy("case_id", "parent").orderBy(p, q, "node")
        k = kids.withColumn("gap", F.lead(p).over(order) - F.col(p) - F.col(s)).withColumn("at", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum(s).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        g = k.groupBy("case_id", "parent").agg(F.count("*").alias("n"), F.median("gap").alias("gap"), F.min("gap").alias("least"), F.min(p).alias("first"), (F.min(p) - F.first(f"f{p}")).alias("pad_main"), F.min(F.col(q) - F.col(f"f{q}")).alias("pad_cross"), (F.max(q) - F.min(q)).alias("starts"), (F.max(F.col(q) + F.col(t)) - F.min(F.col(q) + F.col(t))).alias("ends"), (F.max(F.col(q) + F.col(t) / 2) - F.min(F.col(q) + F.col(t) / 2)).alias("mids"))
        off = F.abs(F.col(p) - F.col("first") - F.col("before") - F.col("at") * F.col("gap"))
        d = k.drop("gap").join(g.select("case_id", "parent", "gap", "first"), ["case_id", "parent"]).groupBy("case_id", "parent").agg(F.max(off).alias("drift"))
        g = g.join(d, ["case_id", "parent"])
        align = F.when(F.col("starts") <= tol, "start").when(F.col("ends") <= tol, "end").when(F.col("mids") <= tol, "center").otherwise("none")
        good = (F.col("n") > 1) & (F.col("least") >= -overlap) & (F.col("drift") <= tol)
        return g.select("case_id", "parent", "n", F.lit(name).alias("direction"), "gap", "drift", "pad_main", "pad_cross", align.alias("align"), good.alias("good"))

    both = axis("column", "y", "h", "x", "w").unionByName(axis("row", "x", "w", "y", "h"))
    best = both.groupBy("case_id", "parent").agg(F.max("n").alias("n"), F.min_by(F.struct("direction", "gap", "drift", "pad_main", "pad_cross", "align"), F.when(F.col("good"), F.struct("drift", "direction"))).alias("t"))
    return best.select("case_id", "parent", "n", F.coalesce("t.direction", F.lit("none")).alias("direction"), "t.gap", "t.drift", "t.pad_main", "t.pad_cross", "t.align")


def column_cut(boxes: DataFrame, least: float = 16.0) -> DataFrame:
    """(case_id, node, side, cut): the widest stripe of white space of at least ``least`` that parts each case in two.

    One level: call it again on each side for more. Cases without a stripe are left out; of equal stripes the left one.
    """
    order = W.partitionBy("case_id").orderBy("x", "node")
    right = F.max(F.col("x") + F.col("w")).over(order.rowsBetween(W.unboundedPreceding, -1))
    s = boxes.withColumn("right", right).where(F.col("x") - F.col("right") >= least)
    cut = s.groupBy("case_id").agg(F.max_by(F.col("right"), F.struct(F.col("x") - F.col("right"), -F.col("x"))).alias("cut"))
    return boxes.join(cut, "case_id").select("case_id", "node", F.when(F.col("x") < F.col("cut"), 0).otherwise(1).alias("side"), "cut")


def icon_labels(icons: DataFrame, texts: DataFrame, reach: int = 16, chars: int = 24) -> DataFrame:
    """One-to-one pairs (case_id, icon, label) of an icon and the nearest short text below it."""
    short = texts.where(F.length("text") <= chars)
    below = icons.withColumns({**{f"o{c}": F.col(c) for c in "xywh"}, "y": F.col("y") + F.col("h"), "h": F.lit(reach + 1)})
    j = spatial.spatial_join(below, short)
    gap = F.col("r_y") - F.col("l_oy") - F.col("l_oh")
    off = F.abs(F.col("l_ox") + F.col("l_ow") / 2 - F.col("r_x") - F.col("r_w") / 2)
    j = j.where((gap >= 0) & (gap <= reach)).withColumn("score", -(gap + off))
    return spatial.match_one_to_one(j, ["case_id", "l_node"], ["case_id", "r_node"], "score").select("case_id", F.col("l_node").alias("icon"), F.col("r_node").alias("label"))


def glyph_clusters(pieces: DataFrame, gap: int = 4, largest: int = 28) -> DataFrame:
    """(case_id, cluster, n, x, y, w, h, merged): pieces within ``gap`` of each other; groups larger than a glyph stay apart."""
    p = spatial.checkpoint(pieces.withColumn("v", F.xxhash64("case_id", "node")))
    wide = p.select("case_id", "v", (F.col("x") * 2 - gap).alias("x"), (F.col("y") * 2 - gap).alias("y"), (F.col("w") * 2 + 2 * gap).alias("w"), (F.col("h") * 2 + 2 * gap).alias("h"))
    e = spatial.spatial_join(wide, wide, condition=F.col("l_v") < F.col("r_v")).select(F.col("l_v").alias("a"), F.col("r_v").alias("b"))
    g = p.join(components(e), "v", "left").groupBy("case_id", F.coalesce("component", "v").alias("c"))
    g = g.agg(F.min("node").alias("cluster"), F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    w, h = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return g.select("case_id", "cluster", "n", "x", "y", w.alias("w"), h.alias("h"), ((w <= largest) & (h <= largest)).alias("merged"))


def paragraphs(lines: DataFrame, slack: float = 0.6, tol: float = 2.0) -> DataFrame:
    """Stacked lines of one style and left edge as paragraphs (T15): (case_id, size, paragraph, n, text, line_height, y, h).

    A line goes on with the one above if the distance between is at most ``slack`` of its height.
    """
    key = ["case_id", "size", "weight", "left"]
    order = W.partitionBy(*key).orderBy("y", "node")
    t = lines.withColumn("left", F.round(F.col("x") / tol)).withColumn("above", F.lag(F.col("y") + F.col("h")).over(order)).withColumn("step", F.col("y") - F.lag("y").over(order))
    t = t.withColumn("fresh", F.when(F.col("y") - F.col("above") <= F.col("h") * slack, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    g = t.groupBy(*key, "run").agg(F.min("node").alias("paragraph"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("y", "node", "text"))).alias("l"), F.median(F.when(F.col("fresh") == 0, F.col("step"))).alias("line_height"), F.min("y").alias("y"), F.max(F.col("y") + F.col("h")).alias("y2"))
    return g.select("case_id", "size", "weight", "paragraph", "n", F.array_join("l.text", "\n").alias("text"), "line_height", "y", (F.col("y2") - F.col("y")).alias("h"))


def list_runs(items: DataFrame, blockers: DataFrame, gap: float = 3.0, tol: float = 2.0, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` items of one left edge and width that follow closely with nothing between.

    Dividers, thin blockers between two items, may fill a gap; any other blocker ends the run. (case_id, list, n, y, h).
    """
    key = ["case_id", "left", "wide"]
    i = items.withColumns({"left": F.round(F.col("x") / tol), "wide": F.round(F.col("w") / tol)})
    order = W.partitionBy(*key).orderBy("y", "node")
    i = i.withColumn("above", F.lag(F.col("y") + F.col("h")).over(order))
    between = i.where("above IS NOT NULL AND y > above").select("case_id", "node", "x", F.col("above").alias("y"), "w", (F.col("y") - F.col("above")).alias("h"))
    hit = spatial.spatial_join(between, blockers).groupBy("case_id", F.col("l_node").alias("node")).agg(F.sum(F.when(F.col("r_h") <= 2, F.col("r_h")).otherwise(0)).alias("dividers"), F.sum((F.col("r_h") > 2).cast("long")).alias("blocks"))
    i = i.join(hit, ["case_id", "node"], "left").fillna(0, ["dividers", "blocks"])
    goes_on = (F.col("y") - F.col("above") >= 0) & (F.col("y") - F.col("above") <= F.col("dividers") + gap) & (F.col("blocks") == 0)
    i = i.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    return i.groupBy(*key, "run").agg(F.min("node").alias("list"), F.count("*").alias("n"), F.min("y").alias("y"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h")).where(F.col("n") >= least).select("case_id", "list", "n", "y", "h")


def occlusion(nodes: DataFrame, up: DataFrame, tol: float = 0.5) -> DataFrame:
    """(case_id, node, occluded, veil): covered by a later opaque box outside its subtree, and the strongest translucent cover.

    Later is a larger ``layer``, then node. ``up``: (case_id, node, ancestor).
    """
    later = F.struct("r_layer", "r_node") > F.struct("l_layer", "l_node")
    c = spatial.spatial_join(nodes, nodes, condition=later & G.contains("r_", "l_", tol)).select("case_id", F.col("l_node").alias("node"), F.col("r_node").alias("cover"), F.col("r_opacity").alias("alpha"))
    own = up.select("case_id", F.col("ancestor").alias("node"), F.col("node").alias("cover"))
    c = c.join(own, ["case_id", "node", "cover"], "left_anti").groupBy("case_id", "node").agg(F.bool_or(F.col("alpha") >= 100).alias("occluded"), F.max(F.when(F.col("alpha") < 100, F.col("alpha"))).alias("veil"))
    return nodes.select("case_id", "node").join(c, ["case_id", "node"], "left").withColumn("occluded", F.coalesce("occluded", F.lit(False)))


def paint_order(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """(case_id, node, rank): children of one parent by the lowest layer of their subtree, then the node."""
    layers = nodes.select("case_id", "node", "layer").unionByName(up.select("case_id", "node", "ancestor").join(nodes.select("case_id", "node", "layer"), ["case_id", "node"]).select("case_id", F.col("ancestor").alias("node"), "layer"))
    low = layers.groupBy("case_id", "node").agg(F.min("layer").alias("low"))
    j = nodes.select("case_id", "node", "parent").join(low, ["case_id", "node"])
    return j.select("case_id", "node", F.row_number().over(W.partitionBy("case_id", "parent").orderBy("low", "node")).alias("rank"))


def adopted(records: DataFrame, up: DataFrame, width: int, height: int, tol: float = 0.5) -> DataFrame:
    """(case_id, node, parent): boxes on the page that paint, each under its nearest such ancestor that holds it.

    Records without area are dead hosts and are skipped; ``up``: (case_id, node, ancestor, distance).
    """
    live = records.where((F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") < width) & (F.col("y") < height) & (F.col("x") + F.col("w") > 0) & (F.col("y") + F.col("h") > 0))
    side = lambda p, k: live.select("case_id", F.col("node").alias(k), *[F.col(c).alias(p + c) for c in "xywh"])
    j = up.join(side("l_", "node"), ["case_id", "node"]).join(side("r_", "ancestor"), ["case_id", "ancestor"]).where(G.contains("r_", "l_", tol))
    p = j.groupBy("case_id", "node").agg(F.min_by("ancestor", "distance").alias("parent"))
    return live.select("case_id", "node").join(p, ["case_id", "node"], "left")


def collapsed(nodes: DataFrame, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the insides of component instances taken out, and these with the instance they belong to.

    An instance is a node with a component that has no ancestor with one. ``expanded`` puts them back.
    """
    with_component = nodes.where("component IS NOT NULL").select("case_id", "node")
    above = up.join(with_component.withColumnRenamed("node", "ancestor"), ["case_id", "ancestor"], "left_semi")
    top = above.groupBy("case_id", "node").agg(F.max_by("ancestor", "distance").alias("instance"))
    inner = nodes.join(top, ["case_id", "node"])
    return nodes.join(top.select("case_id", "node"), ["case_id", "node"], "left_anti"), inner


def expanded(outer: DataFrame, inner: DataFrame) -> DataFrame:
    return outer.unionByName(inner.drop("instance"))


def content_atoms(nodes: DataFrame, up: DataFrame, wrapper: str = "type = 0") -> DataFrame:
    """(case_id, node, atoms): what each node holds once wrappers between are looked through, in reading order.

    An atom's holder is its nearest ancestor that is no wrapper; wrappers themselves are no atoms.
    """
    holders = nodes.where(f"NOT ({wrapper})").select("case_id", F.col("node").alias("ancestor"))
    near = up.join(holders, ["case_id", "ancestor"], "left_semi").groupBy("case_id", "node").agg(F.min_by("ancestor", "distance").alias("holder"))
    a = nodes.where(f"NOT ({wrapper})").join(near, ["case_id", "node"])
    return a.groupBy("case_id", F.col("holder").alias("node")).agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col("node").alias("atom"), "type"))).alias("atoms"))


def discounted(nodes: DataFrame, flags: DataFrame) -> DataFrame:
    """Truth without occluded nodes; colours under a veil, or of translucent nodes, are unknown (T24). ``flags``: ``occlusion``."""
    j = nodes.join(flags, ["case_id", "node"], "left").where("NOT coalesce(occluded, false)")
    unseen = F.col("veil").isNotNull() | (F.col("opacity") < 99)
    return j.withColumns({c: F.when(~unseen, F.col(c)) for c in "rgb"}).drop("occluded", "veil")


def renumbered(nodes: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered from 0 in each case, and findings whose lists of node ids follow; ids that are gone are dropped."""
    ids = nodes.select("case_id", "node", (F.row_number().over(W.partitionBy("case_id").orderBy("node")) - 1).alias("new"))
    up = ids.select("case_id", F.col("node").alias("parent"), F.col("new").alias("new_parent"))
    n = nodes.join(ids, ["case_id", "node"]).join(up, ["case_id", "parent"], "left").withColumns({"node": F.col("new"), "parent": F.col("new_parent")}).drop("new", "new_parent")
    e = findings.select("case_id", "fid", F.posexplode_outer("nodes").alias("at", "node")).join(ids, ["case_id", "node"], "left")
    f = e.groupBy("case_id", "fid").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("at", "new")))), lambda s: s["new"]).alias("nodes"))
    return n.select(*nodes.columns), f


def host_components(hosts: DataFrame, lookup: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """(id, component, variant map): from tag and attributes (T28). Lookup: (tag, component); attributes fill the variant's
    properties, absent ones take their default, boolean attributes are true where present."""
    j = hosts.join(F.broadcast(lookup), "tag")
    pairs = [x for k, v in defaults.items() for x in (F.lit(k), F.coalesce(F.when(F.col("attributes")[k] == "", "true").otherwise(F.col("attributes")[k]), F.lit(v)))]
    return j.select("id", "component", F.create_map(*pairs).alias("variant"))


def lifted_paint(nodes: DataFrame, cover: float = 0.95) -> DataFrame:
    """(case_id, node, r, g, b, source): a node without paint takes that of its first child that covers it."""
    kids = nodes.where("parent IS NOT NULL AND painted").select("case_id", F.col("parent").alias("node"), F.col("node").alias("kid"), *[F.col(c).alias(f"r_{c}") for c in ("x", "y", "w", "h", "r", "g", "b")])
    bare = nodes.where("NOT painted").select("case_id", "node", *[F.col(c).alias(f"l_{c}") for c in "xywh"])
    j = bare.join(kids, ["case_id", "node"]).where(G.overlap("l_", "r_") >= G.area("l_") * cover)
    first = j.groupBy("case_id", "node").agg(F.min_by(F.struct("kid", "r_r", "r_g", "r_b"), "kid").alias("t"))
    n = nodes.join(first, ["case_id", "node"], "left")
    return n.select("case_id", "node", *[F.when(F.col("painted"), F.col(c)).otherwise(F.col(f"t.r_{c}")).alias(c) for c in "rgb"], F.col("t.kid").alias("source"))


def palette(nodes: DataFrame, limit: float = 3.0) -> DataFrame:
    """(case_id, r, g, b, first): colours in order of first use, those near a kept one left out."""
    c = nodes.groupBy("case_id", "r", "g", "b").agg(F.min("node").alias("first"))
    c = spatial.checkpoint(c.withColumns({f"v{n}": v for n, v in zip("lab", C.lab(*[F.col(x) for x in "rgb"]), strict=True)}))
    a, b = spatial.prefixed(c, "l_"), spatial.prefixed(c, "r_")
    lab = lambda p: tuple(F.col(f"{p}v{n}") for n in "lab")
    # colours meet within slices of lightness as wide as the limit
    slice_ = lambda p: F.floor(F.col(f"{p}vl") / limit)
    j = a.withColumn("s", slice_("l_")).join(b.withColumn("s", F.explode(F.sequence(slice_("r_") - 1, slice_("r_") + 1))), ["case_id", "s"])
    order = lambda p: F.struct(*[F.col(p + x) for x in ("first", "r", "g", "b")])
    pairs = j.where((order("l_") < order("r_")) & (C.delta76(lab("l_"), lab("r_")) <= limit))
    return spatial.without_beaten(c, pairs, ["r", "g", "b"], ["first"]).select("case_id", "r", "g", "b", "first")


def refitted(nodes: DataFrame, up: DataFrame, width: int, height: int) -> DataFrame:
    """Inferred frames stretched over their subtrees, then all boxes cut to the page (T31). Nodes have ``inferred``."""
    edges = nodes.select("case_id", "node", "x", "y", (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    below = up.select("case_id", "node", "ancestor").join(edges, ["case_id", "node"]).groupBy("case_id", F.col("ancestor").alias("node")).agg(F.min("x").alias("bx"), F.min("y").alias("by"), F.max("x2").alias("bx2"), F.max("y2").alias("by2"))
    j = nodes.join(below, ["case_id", "node"], "left")
    grow = lambda f, own, kid: F.when(F.col("inferred") & F.col(kid).isNotNull(), f(own, F.col(kid))).otherwise(own)
    x, y = grow(F.least, F.col("x"), "bx"), grow(F.least, F.col("y"), "by")
    x2, y2 = grow(F.greatest, F.col("x") + F.col("w"), "bx2"), grow(F.greatest, F.col("y") + F.col("h"), "by2")
    x, y, x2, y2 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y), F.least(F.lit(width), x2), F.least(F.lit(height), y2)
    return j.select("case_id", "node", x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h")).where("w > 0 AND h > 0")


def unit_kinds(boxes: DataFrame, glyph: int = 28, speck: int = 8, control_w: int = 64, control_h: int = 56, chars: int = 2) -> DataFrame:
    """(case_id, node, kind): text, glyph, speck, control or painted, by type, size and text."""
    small = (F.col("w") <= glyph) & (F.col("h") <= glyph)
    is_text = F.col("type") == 2
    like_glyph = is_text & small & (F.length("text") <= chars)
    kind = F.when(like_glyph, "glyph").when(is_text, "text").when((F.col("w") < speck) & (F.col("h") < speck), "speck").when(small, "glyph").when((F.col("w") <= control_w) & (F.col("h") <= control_h), "control").otherwise("painted")
    return boxes.select("case_id", "node", kind.alias("kind"))
