"""Typed differences between two node tables, an expected and an actual one.

Nodes: (case_id, node, parent, x, y, w, h, type, r, g, b, stroke, radius, opacity, shadow, text, size, weight, glyph,
component, variant, gap); opacity in hundredths, type 2 is text, 3 an icon, all others are shapes. In pairs ``l_*``
is the actual node and ``r_*`` the expected one. Findings: (case_id, node, actual, type, magnitude, x, y, w, h).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import color as C
from canopy.functions import geometry as G
from canopy.functions import text as X
from canopy.operators import spatial
from canopy.operators.core import components, runs, written

#: Tolerances of the checks.
POS_TOL, SIZE_TOL, TEXT_SLACK, COLOR_TOL, RADIUS_TOL, SHADOW_TOL = 1.0, 1.5, 2.0, 6.0, 2.0, 2.0
#: Types of findings that ``moves`` takes.
MOVED = ("geometry.shift", "text.position")
FINDING = ["case_id", "node", "actual", "type", "magnitude", "x", "y", "w", "h"]


def kind(p: str = "") -> Column:
    return F.when(F.col(p + "type") == 2, "text").when(F.col(p + "type") == 3, "icon").otherwise("shape")


def lab(p: str = "") -> tuple[Column, Column, Column]:
    return C.lab(*[F.col(p + c) for c in "rgb"])


def _grey(p: str) -> tuple[Column, Column, Column]:
    s = F.col(p + "stroke")
    return C.lab(s, s, s)


def _union_box(*sides: str) -> list[Column]:
    """x, y, w, h of the box around the boxes with these prefixes."""
    edge = lambda f, c, e: f(*[F.col(p + c) + (F.col(p + e) if e else 0) for p in sides])
    x, y = edge(F.least, "x", ""), edge(F.least, "y", "")
    return [x.alias("x"), y.alias("y"), (edge(F.greatest, "x", "w") - x).alias("w"), (edge(F.greatest, "y", "h") - y).alias("h")]


#: Levels of a tree that are walked before it is taken for a cycle.
DEEPEST = 64


def closure(nodes: DataFrame) -> DataFrame:
    """(case_id, node, ancestor, distance) of every node.

    A case's nodes are dealt once and walked level by level where they lie; a task holds one case's numbers.
    """
    kinds = dict(nodes.dtypes)
    n = nodes.where("node IS NOT NULL AND parent IS NOT NULL").select("case_id", "node", F.col("parent").cast(kinds["node"]).alias("parent"))
    n = n.withColumns({"_none": F.col("case_id").isNull().cast("int"), "_case": F.coalesce("case_id", F.lit(0).cast(kinds["case_id"]))})
    own = f"case_id {kinds['case_id']}, node {kinds['node']}, ancestor {kinds['node']}, distance int"
    return written(n.repartition("_none", "_case").sortWithinPartitions("_none", "_case").mapInArrow(_walk_up, own))


def _walk_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of cases (case_id, node, parent, _none, _case) with each of its ancestors; rows of one node each go up."""
    for table, marks in runs(batches, ["_none", "_case"]):
        size = np.diff(marks)
        case = np.repeat(np.arange(len(size)), size)
        names, code = np.unique(np.concatenate([table["node"].to_numpy(), table["parent"].to_numpy()]), return_inverse=True)
        node, parent = case * len(names) + code[: len(case)], case * len(names) + code[len(case) :]
        order = np.argsort(node, kind="stable")
        up = node[order]
        row, above, distance = np.arange(len(node)), parent, 1
        while len(row):
            if distance == DEEPEST:
                raise RuntimeError(f"tree deeper than {DEEPEST}")
            found = table.select(["case_id", "node"]).take(pa.array(row)).append_column("ancestor", pa.array(names[above % len(names)], table.schema.field("node").type))
            yield from found.append_column("distance", pa.array(np.full(len(row), distance, np.int32))).combine_chunks().to_batches()
            low = np.searchsorted(up, above)
            many = np.searchsorted(up, above, side="right") - low
            at = order[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            row, above, distance = np.repeat(row, many), parent[at], distance + 1


def pair_items(expected: DataFrame, actual: DataFrame, max_distance: float = 40.0, least: float = 0.35) -> DataFrame:
    """One-to-one pairs by overlap, nearness, size and text likeness (J05): as many as possible, of those the best by
    total score; those that score less than ``least`` are left out then."""
    pad = {"x": F.col("x") - max_distance, "y": F.col("y") - max_distance, "w": F.col("w") + 2 * max_distance, "h": F.col("h") + 2 * max_distance}
    own = {f"o{c}": F.col(c) for c in "xywh"}
    wide = actual.withColumns(own).withColumns(pad)
    back = {f"l_{c}": F.col(f"l_o{c}") for c in "xywh"}
    j = spatial.spatial_join(wide, expected).withColumns(back).drop(*[f"l_o{c}" for c in "xywh"])
    mid = lambda p, c, e: F.col(p + c) + F.col(p + e) / 2
    dx, dy = mid("l_", "x", "w") - mid("r_", "x", "w"), mid("l_", "y", "h") - mid("r_", "y", "h")
    ratio = lambda c: F.least(f"l_{c}", f"r_{c}") / F.greatest(F.col(f"l_{c}"), F.col(f"r_{c}"), F.lit(1e-6))
    ke, ka = kind("r_"), kind("l_")
    j = j.withColumns({"iou": G.iou("l_", "r_"), "d": F.sqrt(dx * dx + dy * dy), "alike": ratio("w") * ratio("h"), "same_text": 1 - X.cer(F.col("l_text"), F.col("r_text"))})
    gate = (ke == ka) | ((ke != "text") & (ka != "text"))
    near = ((F.col("iou") >= 0.05) | (F.col("d") <= max_distance)) & ((F.col("alike") >= 0.2) | (F.col("iou") >= 0.3))
    words = (ke != "text") | (F.col("same_text") >= 0.3) | (F.col("iou") >= 0.5)
    score = F.col("iou") + F.exp(-F.col("d") / 8) * 0.5 + F.col("alike") * 0.3 + F.when(F.col("l_type") == F.col("r_type"), 0.2).otherwise(0.0) - F.when(ke != ka, 0.3).otherwise(0.0) + F.when(ke == "text", F.col("same_text") * 0.6).otherwise(0.0)
    j = j.where(gate & near & words).withColumn("score", score).drop("alike", "same_text", "d")
    return spatial.assign(j, ["case_id", "l_node"], ["case_id", "r_node"], "score", most=True).where(F.col("score") >= least)


def match_elements(target: DataFrame, candidate: DataFrame, max_shift: float = 40.0, min_ratio: float = 0.5, max_cost: float = 1.8, weights: tuple[float, float, float, float] = (1.0, 0.6, 0.8, 0.3)) -> DataFrame:
    """One-to-one pairs by overlap, edge displacement, colour, text and glyph (J04): as many as possible, of those the
    cheapest; those above ``max_cost`` are left out then."""
    w_shift, w_color, w_text, w_icon = weights
    own = {f"o{c}": F.col(c) for c in "xywh"}
    wide = candidate.withColumns(own).withColumns({"x": F.col("x") - max_shift - 1, "y": F.col("y") - max_shift - 1, "w": F.col("w") + 2 * max_shift + 2, "h": F.col("h") + 2 * max_shift + 2})
    j = spatial.spatial_join(wide, target).withColumns({f"l_{c}": F.col(f"l_o{c}") for c in "xywh"}).drop(*[f"l_o{c}" for c in "xywh"])
    gap = lambda c, e="": F.abs(F.col(f"l_{c}") + (F.col(f"l_{e}") if e else 0) - F.col(f"r_{c}") - (F.col(f"r_{e}") if e else 0))
    shift = F.greatest(gap("x"), gap("y"), gap("x", "w"), gap("y", "h"))
    small = lambda c: F.least(f"l_{c}", f"r_{c}") < F.greatest(f"l_{c}", f"r_{c}") * min_ratio
    cost = 1 - G.iou("l_", "r_") + shift * w_shift / max_shift + F.least(F.lit(1.0), C.delta76(lab("l_"), lab("r_")) / 50) * w_color
    cost = cost + F.when(kind("r_") == "text", F.least(F.lit(1.0), X.cer(F.col("l_text"), F.col("r_text"))) * w_text).otherwise(0.0)
    cost = cost + F.when((kind("r_") == "icon") & ~F.col("l_glyph").eqNullSafe(F.col("r_glyph")), w_icon).otherwise(0.0)
    j = j.where((shift <= max_shift) & spatial.same(kind("l_"), kind("r_")) & ~(small("w") & small("h"))).withColumn("cost", cost)
    return spatial.assign(j.withColumn("likeness", -F.col("cost")), ["case_id", "l_node"], ["case_id", "r_node"], "likeness", most=True).drop("likeness").where(F.col("cost") <= max_cost)


def with_colours(pairs: DataFrame) -> DataFrame:
    """Lab of fills (_fl*, _fr*) and strokes (_sl*, _sr*) of both sides, and their differences, computed once."""
    sides = {"_fl": lab("l_"), "_fr": lab("r_"), "_sl": _grey("l_"), "_sr": _grey("r_")}
    p = pairs.withColumns({k + n: v for k, t in sides.items() for n, v in zip("lab", t, strict=True)})
    of = lambda k: tuple(F.col(k + n) for n in "lab")
    return p.withColumns({"_fill": C.delta76(of("_fl"), of("_fr")), "_stroke": C.delta76(of("_sl"), of("_sr"))})


def pair_findings(pairs: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Up to eleven typed differences of each pair, as rows (D01); only those of ``types``, if given."""
    col = lambda c: (F.col(f"l_{c}"), F.col(f"r_{c}"))
    diff = lambda c: F.abs(F.col(f"l_{c}") - F.col(f"r_{c}"))
    text, shape = (kind("l_") == "text") & (kind("r_") == "text"), (kind("l_") == "shape") & (kind("r_") == "shape")
    found = lambda when, name, magnitude: (name, F.when(when, F.struct(F.lit(name).alias("type"), magnitude.cast("double").alias("magnitude"))))
    content = text & (X.normalize(F.col("l_text")) != X.normalize(F.col("r_text")))
    style = text & ~content & ((diff("size") > 1) | (diff("weight") >= 100))
    dl, dt = F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")
    dr, db = dl + F.col("l_w") - F.col("r_w"), dt + F.col("l_h") - F.col("r_h")
    slack = F.when(kind("r_") == "text", TEXT_SLACK).otherwise(0.0)
    edge = F.greatest(F.abs(dl), F.abs(dt), F.abs(dr), F.abs(db))
    moved = ~content & ~style & (edge > slack + POS_TOL)
    same_size = (diff("w") <= slack + SIZE_TOL) & (diff("h") <= slack + SIZE_TOL)
    way = F.sqrt((dl + dr) * (dl + dr) / 4 + (dt + db) * (dt + db) / 4)
    pairs = with_colours(pairs) if types is None or any(t.startswith("color.") for t in types) else pairs
    fill, stroke = F.col("_fill"), F.col("_stroke")
    reach = F.greatest(*col("shadow"))
    one_shadow = ((F.col("l_shadow") > 0) != (F.col("r_shadow") > 0)) & (reach > SHADOW_TOL)
    who = lambda p: F.struct(F.col(p + "component"), F.when(F.col(p + "component").isNotNull(), F.col(p + "variant")))
    checks = [
        found(content, "text.content", X.cer(F.col("l_text"), F.col("r_text"))),
        found(style, "text.style", diff("size") + diff("weight") / 100),
        found(moved & same_size & (kind("r_") == "text"), "text.position", way),
        found(moved & same_size & (kind("r_") != "text"), "geometry.shift", way),
        found(moved & ~same_size, "geometry.size", edge),
        found(fill > COLOR_TOL, "color.fill", fill),
        found(shape & (stroke > COLOR_TOL), "color.stroke", stroke),
        found(shape & (F.least("r_w", "r_h") >= 8) & (diff("radius") > RADIUS_TOL), "geometry.radius", diff("radius")),
        found(diff("opacity") > 5, "effect.opacity", diff("opacity") / 100),
        found(shape & (one_shadow | (diff("shadow") > SHADOW_TOL + 2)), "effect.shadow", diff("shadow")),
        found((kind("l_") == "icon") & (kind("r_") == "icon") & ~F.col("l_glyph").eqNullSafe(F.col("r_glyph")), "icon.glyph", F.lit(None)),
        found(diff("gap") > 2 * POS_TOL + 1, "layout.spacing", diff("gap")),
        found(~who("l_").eqNullSafe(who("r_")), "component.identity", F.lit(None)),
    ]
    box = F.struct(*_union_box("l_", "r_"))
    f = pairs.select("case_id", F.col("r_node").alias("node"), F.col("l_node").alias("actual"), F.explode(F.array_compact(F.array(*[c for n, c in checks if types is None or n in types]))).alias("f"), box.alias("box"))
    return f.select("case_id", "node", "actual", "f.type", "f.magnitude", "box.x", "box.y", "box.w", "box.h")


def splits(pairs: DataFrame, rest: DataFrame, name: str = "structure.split", cover: float = 0.6) -> DataFrame:
    """Pairs of which the unmatched ``rest`` of the actual side is the other part (D02). For merges swap the sides.

    Of several pairs the one whose parts cover the expected node best.
    """
    j = spatial.spatial_join(rest, pairs.select("case_id", *[F.col(f"r_{c}").alias(c) for c in "xywh"], F.col("r_node").alias("node"), F.col("r_type").alias("type"), F.col("r_text").alias("text"), F.struct(*[F.col(f"l_{c}").alias(c) for c in ("x", "y", "w", "h", "node", "type", "text")]).alias("own")))
    j = j.withColumns({f"o_{c}": F.col(f"r_own.{c}") for c in ("x", "y", "w", "h", "node", "type", "text")})
    x, y, w, h = _union_box("l_", "o_")
    j = j.withColumns({"u_x": x, "u_y": y, "u_w": w, "u_h": h}).withColumn("cover", G.iou("u_", "r_"))
    joined = F.when(F.col("o_x") <= F.col("l_x"), F.concat_ws(" ", "o_text", "l_text")).otherwise(F.concat_ws(" ", "l_text", "o_text"))
    same = spatial.same(kind("l_"), kind("r_")) & (kind("o_") == kind("r_"))
    ok = same & (G.overlap("l_", "r_") >= F.greatest(G.area("l_"), F.lit(1e-6)) * 0.6) & (G.iou("o_", "r_") <= 0.92) & (F.col("cover") >= cover) & ((kind("r_") != "text") | (X.cer(joined, F.col("r_text")) <= 0.2))
    away = lambda c, e: F.greatest(F.col(f"o_{c}") - F.col(f"l_{c}") - F.col(f"l_{e}"), F.col(f"l_{c}") - F.col(f"o_{c}") - F.col(f"o_{e}"), F.lit(0))
    best = F.row_number().over(W.partitionBy("case_id", "l_node").orderBy(F.col("cover").desc(), "r_node"))
    j = j.where(ok).withColumn("_k", best).where("_k = 1")
    gap = F.sqrt(away("x", "w") * away("x", "w") + away("y", "h") * away("y", "h"))
    return j.select("case_id", F.col("r_node").alias("node"), F.col("o_node").alias("actual"), F.col("l_node").alias("part"), F.lit(name).alias("type"), gap.alias("magnitude"), *_union_box("l_", "r_", "o_"))


def swapped(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides changed over."""
    return pairs.select(*[F.col(c).alias({"l_": "r_", "r_": "l_"}.get(c[:2], c[:2]) + c[2:]) for c in pairs.columns])


def fades(pairs: DataFrame, nodes: DataFrame, contrast: float = 20.0, residual: float = 0.15) -> DataFrame:
    """(case_id, node, parent, alpha) of pairs whose colour is the expected one blended with the colour behind.

    Behind a node is its parent, or white.
    """
    behind = nodes.select("case_id", F.col("node").alias("r_parent"), *[F.col(c).alias(f"k{c}") for c in "rgb"])
    j = pairs.join(behind, ["case_id", "r_parent"], "left")
    back = [F.coalesce(f"k{c}", F.lit(255)) for c in "rgb"]
    span = [F.col(f"r_{c}") - k for c, k in zip("rgb", back, strict=True)]
    norm = sum(s * s for s in span)
    alpha = sum((F.col(f"l_{c}") - k) * s for c, k, s in zip("rgb", back, span, strict=True)) / F.nullif(norm, F.lit(0))
    left = F.sqrt(sum(F.pow(F.col(f"l_{c}") - k - alpha * s, F.lit(2.0)) for c, k, s in zip("rgb", back, span, strict=True))) / F.nullif(F.sqrt(norm), F.lit(0.0))
    fit = (C.delta76(lab("l_"), lab("r_")) > COLOR_TOL) & (norm >= contrast * contrast) & (alpha >= 0.05) & (alpha <= 0.95) & (left <= residual)
    return j.where(fit).select("case_id", F.col("r_node").alias("node"), F.col("l_node").alias("actual"), F.col("r_parent").alias("parent"), alpha.alias("alpha"), *_union_box("l_", "r_"))


def opacity_groups(faded: DataFrame, up: DataFrame) -> DataFrame:
    """One opacity finding for each faded subtree, or for siblings that faded alike (D03). ``up``: ``closure``."""
    f = faded.select("case_id", "node", "parent", "alpha", "actual", "x", "y", "w", "h")
    above = f.join(up, ["case_id", "node"]).join(f.select("case_id", F.col("node").alias("ancestor"), F.col("alpha").alias("a2")), ["case_id", "ancestor"]).where(F.abs(F.col("a2") - F.col("alpha")) <= 0.2)
    root = above.groupBy("case_id", "node").agg(F.min_by("ancestor", "distance").alias("root"))
    f = spatial.checkpoint(f.join(root, ["case_id", "node"], "left"))
    kids = f.where("root IS NOT NULL")
    heads = kids.select("case_id", F.col("root").alias("node")).distinct().join(f.drop("root"), ["case_id", "node"]).withColumn("root", F.col("node"))
    alone = f.where("root IS NULL").withColumn("band", F.round(F.col("alpha") * 5))
    merge = lambda df, *by: df.groupBy("case_id", *by).agg(F.min("node").alias("node"), F.min_by("actual", "node").alias("actual"), (1 - F.avg("alpha")).alias("magnitude"), F.count("*").alias("nodes"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    both = merge(kids.unionByName(heads), "root").drop("root").unionByName(merge(alone, "parent", "band").drop("parent", "band"))
    return both.select("case_id", "node", "actual", F.lit("effect.opacity").alias("type"), "magnitude", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "nodes")


def global_tint(pairs: DataFrame, least: int = 4, share: float = 0.6, spread: float = 0.4) -> DataFrame:
    """Cases most of whose colours, surfaces among them, are offset alike, with the mean difference."""
    rows = [F.struct(*[(F.col(f"{k}l{n}") - F.col(f"{k}r{n}")).alias(n) for n in "lab"], F.col(de).alias("de"), (kind("r_") == "shape").alias("shape")) for k, de in (("_f", "_fill"), ("_s", "_stroke"))]
    # dealt by case as they are, before the colours are computed, once
    p = pairs.select("case_id", "r_type", *[s + c for s in ("l_", "r_") for c in ("r", "g", "b", "stroke")]).repartition("case_id")
    c = with_colours(p).select("case_id", F.explode(F.array(*rows)).alias("c")).select("case_id", "c.*").withColumn("changed", F.col("de") > COLOR_TOL / 2)
    case = W.partitionBy("case_id")
    mean = lambda n: F.avg(F.when(F.col("changed"), F.col(n))).over(case)
    count = lambda k: F.sum(k.cast("long")).over(case)
    m = c.withColumns({"n": F.count("*").over(case), "k": count(F.col("changed")), "s": count(F.col("shape")), "sk": count(F.col("shape") & F.col("changed")), "magnitude": mean("de")} | {f"m{n}": mean(n) for n in "lab"})
    m = m.where(F.col("changed") & (F.col("n") >= least) & (F.col("k") >= F.col("n") * share) & (F.col("sk") > 0) & (F.col("sk") >= F.col("s") * 0.5))
    size = F.sqrt(sum(F.col(f"m{n}") * F.col(f"m{n}") for n in "lab"))
    off = F.sqrt(sum(F.pow(F.col(n) - F.col(f"m{n}"), F.lit(2.0)) for n in "lab"))
    g = m.groupBy("case_id").agg(F.avg(off).alias("off"), *[F.first(v).alias(v) for v in ("magnitude", "n", "k", "ml", "ma", "mb")])
    ok = (F.col("off") / F.greatest(size, F.lit(1e-6)) <= spread) & (size > COLOR_TOL / 2)
    return g.where(ok).select("case_id", "magnitude", F.col("n").alias("pairs"), F.col("k").alias("changed"))


def moves(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Shift and text position findings with their offsets, the expected place and parent."""
    mid = lambda c, e: (F.col(f"l_{c}") + F.col(f"l_{e}") / 2) - (F.col(f"r_{c}") + F.col(f"r_{e}") / 2)
    at = pairs.select("case_id", F.col("r_node").alias("node"), F.col("r_parent").alias("parent"), mid("x", "w").alias("dx"), mid("y", "h").alias("dy"), F.col("r_x").alias("ex"), F.col("r_y").alias("ey"))
    return findings.where(F.col("type").isin(*MOVED)).join(at, ["case_id", "node"])


def fold_moves(m: DataFrame, up: DataFrame, tol: float = POS_TOL + 1) -> DataFrame:
    """Moves without those of nodes that moved along with a moved ancestor."""
    a = m.select("case_id", F.col("node").alias("ancestor"), F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    along = m.join(up, ["case_id", "node"]).join(a, ["case_id", "ancestor"]).where((F.abs(F.col("dx") - F.col("ax")) <= tol) & (F.abs(F.col("dy") - F.col("ay")) <= tol))
    return m.join(along.select("case_id", "node").distinct(), ["case_id", "node"], "left_anti")


def merge_neighbours(m: DataFrame, gap: int = 8) -> DataFrame:
    """Moves of siblings with one type and offset that lie within ``gap`` of each other, as one."""
    keyed = spatial.checkpoint(m.withColumns({"ox": F.round("dx"), "oy": F.round("dy"), "id": F.xxhash64("case_id", "node")}))
    wide = keyed.select("case_id", "id", "parent", "type", "ox", "oy", (F.col("x") * 2 - gap).alias("x"), (F.col("y") * 2 - gap).alias("y"), (F.col("w") * 2 + 2 * gap).alias("w"), (F.col("h") * 2 + 2 * gap).alias("h"))
    like = spatial.same(F.col("l_parent"), F.col("r_parent")) | (F.col("l_parent").isNull() & F.col("r_parent").isNull())
    for c in ("type", "ox", "oy"):
        like = like & spatial.same(F.col(f"l_{c}"), F.col(f"r_{c}"))
    like = like & (F.col("l_id") < F.col("r_id"))
    part = components(spatial.spatial_join(wide, wide, condition=like).select(F.col("l_id").alias("a"), F.col("r_id").alias("b")))
    g = keyed.join(part.withColumnRenamed("v", "id"), "id", "left").groupBy("case_id", F.coalesce("component", "id").alias("c"))
    g = g.agg(F.max_by(F.struct("node", "actual", "type", "magnitude", "dx", "dy"), F.struct(F.col("w") * F.col("h"), -F.col("node"))).alias("t"), F.count("*").alias("nodes"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    return g.select("case_id", "t.node", "t.actual", "t.type", "t.magnitude", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "nodes")


def spacing_drift(m: DataFrame, tol: float = POS_TOL + 1) -> DataFrame:
    """Siblings that moved along one axis by growing multiples of one step (D06): (case_id, parent, axis, step, n)."""
    axis = lambda a, o, e, n: m.where((F.abs(F.col(o)) <= tol) & (F.abs(F.col(a)) > tol - 1)).select("case_id", "parent", "node", F.lit(n).alias("axis"), F.abs(F.col(a)).alias("way"), F.col(e).alias("at"))
    s = axis("dx", "dy", "ex", "x").unionByName(axis("dy", "dx", "ey", "y"))
    order = W.partitionBy("case_id", "parent", "axis").orderBy("at", "node")
    s = s.withColumn("back", F.coalesce(F.col("way") < F.lag("way").over(order) - tol, F.lit(False))).withColumn("step", F.min(F.round("way")).over(W.partitionBy("case_id", "parent", "axis")))
    times = F.round("way") / F.col("step")
    g = s.withColumn("off", F.abs(times - F.round(times))).groupBy("case_id", "parent", "axis").agg(F.count("*").alias("n"), F.first("step").alias("step"), F.countDistinct(F.round("way")).alias("offsets"), F.max("off").alias("off"), F.bool_or("back").alias("back"))
    return g.where("n >= 2 AND offsets >= 2 AND step > 0 AND off <= 0.25 AND NOT back").select("case_id", "parent", "axis", "step", "n")


def subtree_roots(unmatched: DataFrame, up: DataFrame) -> DataFrame:
    """Unmatched nodes no ancestor of which is unmatched too."""
    other = unmatched.select("case_id", F.col("node").alias("ancestor"))
    inner = up.join(other, ["case_id", "ancestor"], "left_semi").select("case_id", "node").distinct()
    return unmatched.join(inner, ["case_id", "node"], "left_anti")


def tree_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """All differences of two node tables, groups of raw ones replaced by what explains them.

    Splits and merges replace their pair's findings, opacity groups fill changes, a tint all colour findings of its
    case and opacity groups, spacing its moves; then one finding for each moved, missing or extra subtree.
    """
    pairs = written(pair_items(expected, actual))
    # what is read of the nodes from here on, so that they are not put together again for each part
    looks = ["case_id", "node", "parent", *"xywh", "type", "text"]
    expected, actual = written(expected.select(*looks, *"rgb")), written(actual.select(*looks))
    up_e, up_a = closure(expected), closure(actual)
    # of nodes without a partner only what is read below is looked for
    rest = lambda df, side: df.select("case_id", "node", *"xywh", "type", "text").join(pairs.select("case_id", F.col(f"{side}node").alias("node")), ["case_id", "node"], "left_anti")
    free_e, free_a = written(rest(expected, "r_")), written(rest(actual, "l_"))
    split = written(splits(pairs, free_a))
    merge = splits(swapped(pairs), free_e, "structure.merge")
    merge = written(merge.select("case_id", F.col("actual").alias("node"), F.col("node").alias("actual"), "part", "type", "magnitude", "x", "y", "w", "h"))
    f = pair_findings(pairs).join(split.unionByName(merge).select("case_id", "node").distinct(), ["case_id", "node"], "left_anti")
    fading = written(fades(pairs, expected))
    tint = written(global_tint(pairs))
    opacity = opacity_groups(fading, up_e).join(tint.select("case_id"), "case_id", "left_anti")
    is_fill, is_colour = F.col("type") == "color.fill", F.col("type").startswith("color.")
    faded = f.where(is_fill).join(fading.select("case_id", "node"), ["case_id", "node"], "left_semi").select("case_id", "node", "type")
    f = f.join(faded, ["case_id", "node", "type"], "left_anti")
    f = written(f.where(~is_colour).unionByName(f.where(is_colour).join(tint.select("case_id"), "case_id", "left_anti")))
    m = written(fold_moves(moves(pairs, f), up_e))
    drift = written(spacing_drift(m))
    tol = POS_TOL + 1
    along = F.when(F.col("axis") == "x", (F.abs(F.col("dy")) <= tol) & (F.abs(F.col("dx")) > tol - 1)).otherwise((F.abs(F.col("dx")) <= tol) & (F.abs(F.col("dy")) > tol - 1))
    explained = m.alias("m").join(drift.select("case_id", F.col("parent").alias("p"), "axis"), "case_id").where(F.col("parent").eqNullSafe(F.col("p")) & along).select("case_id", "node").distinct()
    moved = merge_neighbours(m.join(explained, ["case_id", "node"], "left_anti"))
    spacing = drift.select("case_id", F.col("parent").alias("node"), F.lit(None).cast("int").alias("actual"), F.lit("layout.spacing").alias("type"), F.col("step").alias("magnitude"), *[F.lit(None).cast("double").alias(c) for c in "xywh"])
    page = tint.select("case_id", *[F.lit(None).cast("int").alias(c) for c in ("node", "actual")], F.lit("color.tint_global").alias("type"), "magnitude", *[F.lit(None).cast("double").alias(c) for c in "xywh"])
    used = lambda s: s.select("case_id", F.col("part").alias("node")).distinct()
    lost = subtree_roots(free_e.join(used(merge), ["case_id", "node"], "left_anti"), up_e)
    more = subtree_roots(free_a.join(used(split), ["case_id", "node"], "left_anti"), up_a)
    gone = lost.select("case_id", "node", F.lit(None).cast("int").alias("actual"), F.when(kind() == "icon", "icon.missing").otherwise("structure.missing").alias("type"), (F.col("w") * F.col("h")).alias("magnitude"), "x", "y", "w", "h")
    extra = more.select("case_id", F.lit(None).cast("int").alias("node"), F.col("node").alias("actual"), F.lit("structure.extra").alias("type"), (F.col("w") * F.col("h")).alias("magnitude"), "x", "y", "w", "h")
    other = f.where(~F.col("type").isin("geometry.shift", "text.position"))
    parts = [other, moved, spacing, opacity, page, split, merge, gone, extra]
    out = parts[0].select(FINDING)
    for p in parts[1:]:
        out = out.unionByName(p.select(FINDING))
    return out


# ------------------------------------------------------------------------------ expected tables and relations
def translate(nodes: DataFrame, dx: int, dy: int) -> DataFrame:
    """Nodes moved by an offset."""
    return nodes.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def swap_channels(nodes: DataFrame) -> DataFrame:
    """Red and blue changed over."""
    return nodes.withColumns({"r": F.col("b"), "b": F.col("r")})


def mirror(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes reflected in the page's middle."""
    return nodes.withColumn("x", F.lit(width) - F.col("x") - F.col("w"))


def crop(nodes: DataFrame, x: int, y: int, w: int, h: int, keep: float = 0.5) -> DataFrame:
    """Nodes at least ``keep`` of which lies in the window, cut to it and moved to its corner."""
    left, top = F.greatest(F.lit(x), F.col("x")), F.greatest(F.lit(y), F.col("y"))
    wide = F.greatest(F.lit(0), F.least(F.lit(x + w), F.col("x") + F.col("w")) - left)
    high = F.greatest(F.lit(0), F.least(F.lit(y + h), F.col("y") + F.col("h")) - top)
    cut = nodes.withColumns({"_l": left, "_t": top, "_w": wide, "_h": high}).where(F.col("_w") * F.col("_h") >= F.col("w") * F.col("h") * keep)
    return cut.withColumns({"x": F.col("_l") - x, "y": F.col("_t") - y, "w": F.col("_w"), "h": F.col("_h")}).drop("_l", "_t", "_w", "_h")


def without_row(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes without those of one row (case_id, top, bottom) of each case; what is below moves up."""
    j = nodes.join(rows.select("case_id", "top", "bottom"), "case_id", "left")
    inside = (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    lower = F.coalesce(F.col("y") >= F.col("bottom"), F.lit(False))
    return j.where(~F.coalesce(inside, F.lit(False))).withColumn("y", F.when(lower, F.col("y") - (F.col("bottom") - F.col("top"))).otherwise(F.col("y"))).drop("top", "bottom")


def relation_summary(findings: dict[str, DataFrame]) -> DataFrame:
    """Number of findings by relation and type."""
    each = [f.groupBy(F.lit(n).alias("relation"), "type").agg(F.count("*").alias("n")) for n, f in findings.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def parts_found(expected: DataFrame, actual: DataFrame, iou_num: int = 1, iou_den: int = 2) -> DataFrame:
    """By case: expected parts, how many are distinct nodes of their type in the actual table, and whether all are."""
    hit = spatial.match_nodes(actual, expected, iou_num, iou_den).select("case_id", F.col("r_node").alias("node"), F.lit(1).alias("hit"))
    g = expected.join(hit, ["case_id", "node"], "left").groupBy("case_id").agg(F.count("*").alias("parts"), F.count("hit").alias("found"))
    return g.withColumn("complete", F.col("parts") == F.col("found"))


def boundaries(hits: DataFrame) -> DataFrame:
    """Where the stable tail of hits of each (component, axis) begins, hits before it, and whether there are none."""
    tail = W.partitionBy("component", "axis").orderBy(F.col("value").desc()).rowsBetween(W.unboundedPreceding, 0)
    t = hits.withColumn("stable", F.bool_and("hit").over(tail))
    g = t.groupBy("component", "axis").agg(F.min(F.when(F.col("stable"), F.col("value"))).alias("start"), F.sum((F.col("hit") & ~F.col("stable")).cast("long")).alias("islands"))
    return g.withColumn("monotone", F.col("islands") == 0)


def round_trip(before: DataFrame, after: DataFrame, tol: float = 0.5) -> DataFrame:
    """By case: nodes on both sides, lost and new ids, largest and mean drift of the edges, changed texts."""
    side = lambda df, p: df.select("case_id", "node", *[F.col(c).alias(p + c) for c in ("x", "y", "w", "h", "text")], F.lit(True).alias(p + "in"))
    j = side(before, "a_").join(side(after, "b_"), ["case_id", "node"], "full_outer")
    drift = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "xywh"])
    both = F.col("a_in").isNotNull() & F.col("b_in").isNotNull()
    count = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    g = j.groupBy("case_id").agg(F.count("a_in").alias("before"), F.count("b_in").alias("after"), count(F.col("b_in").isNull()).alias("lost"), count(F.col("a_in").isNull()).alias("new"), F.max(drift).alias("max_drift"), F.avg(drift).alias("mean_drift"), count(both & ~F.col("a_text").eqNullSafe(F.col("b_text"))).alias("texts"))
    return g.withColumn("lossy", (F.col("lost") > 0) | (F.col("new") > 0) | (F.col("texts") > 0) | (F.coalesce("max_drift", F.lit(0)) > tol))


def cause_groups(regions: DataFrame, gap: int = 24, tol: float = 1.0) -> DataFrame:
    """Regions that one cause explains, as components: same node and type, or the same offset close together.

    Regions: (case_id, id, node, type, dx, dy, mass, x, y, w, h). A group takes the type of its largest mass.
    """
    r = regions.withColumn("v", F.xxhash64("case_id", "id"))
    twin = r.where("node IS NOT NULL").groupBy("case_id", "node", "type").agg(F.min("v").alias("a"), F.collect_set("v").alias("all")).select("a", F.explode("all").alias("b"))
    wide = r.select("case_id", "v", "type", "dx", "dy", (F.col("x") * 2 - gap).alias("x"), (F.col("y") * 2 - gap).alias("y"), (F.col("w") * 2 + 2 * gap).alias("w"), (F.col("h") * 2 + 2 * gap).alias("h"))
    like = (F.col("l_v") < F.col("r_v")) & (F.abs(F.col("l_dx") - F.col("r_dx")) <= tol) & (F.abs(F.col("l_dy") - F.col("r_dy")) <= tol)
    moved = spatial.spatial_join(wide, wide, condition=like).select(F.col("l_v").alias("a"), F.col("r_v").alias("b"))
    part = components(twin.where("a <> b").unionByName(moved))
    g = r.join(part, "v", "left").groupBy("case_id", F.coalesce("component", "v").alias("c"))
    return g.agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max_by("type", F.struct("mass", -F.col("id"))).alias("type"), F.sum("mass").alias("mass")).drop("c")


def blind_spots(violations: DataFrame) -> DataFrame:
    """By relation and type of (relation, type, flagged): violations, those no rule flags, and their share."""
    g = violations.groupBy("relation", "type").agg(F.count("*").alias("n"), F.sum((~F.col("flagged")).cast("long")).alias("unseen"))
    return g.withColumn("share", F.col("unseen") / F.col("n"))
