"""Matching of nodes to a catalog's component signatures, learned rules, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import color as C
from canopy.functions import geometry as G
from canopy.operators import spatial
from canopy.operators.core import against, small_enough

#: Weights of a signature's parts, and the score below which a critical part halves the whole (fixed values).
WEIGHTS = {"height": 2.0, "radius": 1.5, "fill": 2.0, "stroke": 1.5, "text": 0.75}
ZERO_PENALTY = 0.5
#: Weight of a needed component among a node's content.
CHILD_WEIGHT = 1.5


def colour_class(l: Column, a: Column, b: Column, neutral: float = 12.0, light: float = 75.0, dark: float = 35.0) -> Column:
    """none, neutral-light, neutral-mid, neutral-dark, or accent-* by chroma and lightness."""
    shade = F.when(l >= light, "light").when(l <= dark, "dark").otherwise("mid")
    hue = F.when(F.sqrt(a * a + b * b) < neutral, "neutral-").otherwise("accent-")
    return F.when(l.isNull(), "none").otherwise(F.concat(hue, shade))


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation."""
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / top).otherwise(0.0)


def count_score(n: Column, low: Column, high: Column) -> Column:
    """1 in [low, high], falling by a half for each step outside."""
    off = F.greatest(low - n, n - high, F.lit(0))
    return F.greatest(F.lit(0.0), 1 - off * 0.5)


def radius_score(radius: Column, w: Column, h: Column, rule: Column, tol: float = 2.0, pill: float = 0.42) -> Column:
    """Score of a corner radius against ``any``, ``pill``, ``none`` or a number as text."""
    short = F.greatest(F.lit(1.0), F.least(w, h))
    is_pill = radius >= short * pill
    number = rule.try_cast("double")
    soft = G.soft_range(radius, number - tol, number + tol, F.lit(2 * tol))
    none = F.when(radius <= tol, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (radius - tol) / (2 * tol)))
    exact = F.when(is_pill & (number < short / 2 - tol), 0.0).otherwise(soft)
    return F.when(rule == "any", 1.0).when(rule == "pill", F.when(is_pill, 1.0).otherwise(F.greatest(F.lit(0.0), radius / (short / 2)))).when(rule == "none", none).otherwise(exact)


def color_score(distance: Column, limit: float = 6.0) -> Column:
    """1 up to ``limit``, 0 from twice that on."""
    return F.when(distance <= limit, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (distance - limit) / limit))


def stroke_score(present: Column, distance: Column, width: Column, low: Column, high: Column, rule: Column, tol: float = 1.0) -> Column:
    """Score of a stroke against ``any``, ``none`` or a colour distance and a width range."""
    both = color_score(distance) * 0.7 + G.soft_range(width, low, high, F.lit(tol)) * 0.3
    return F.when(rule == "any", 1.0).when(rule == "none", F.when(present, 0.0).otherwise(1.0)).when(~present, 0.0).otherwise(both)


def type_distance(size: Column, weight: Column, line: Column, role_size: Column, role_weight: Column, role_line: Column) -> Column:
    """Distance of a text style from a type role in units of tolerance."""
    lines = F.when(line.isNotNull() & role_line.isNotNull(), F.abs(line - role_line) / 4.0).otherwise(0.0)
    return F.abs(size - role_size) / 1.5 + F.abs(weight - role_weight) / 150.0 + lines


def nearest_role(texts: DataFrame, roles: DataFrame, limit: float = 1.5) -> DataFrame:
    """(id, role, distance): nearest type role within ``limit``, ties to the smaller priority."""
    styles = texts.select("size", "weight", "line").distinct()
    pairs = against(styles, roles.select("role", "priority", F.col("size").alias("rs"), F.col("weight").alias("rw"), F.col("line").alias("rl")))
    d = F.round(type_distance(*[F.col(c) for c in ("size", "weight", "line", "rs", "rw", "rl")]), 9)
    best = pairs.withColumn("d", d).groupBy("size", "weight", "line").agg(F.min(F.struct("d", "priority", "role")).alias("m"))
    on = F.col("t.size").eqNullSafe(F.col("b.size")) & F.col("t.weight").eqNullSafe(F.col("b.weight")) & F.col("t.line").eqNullSafe(F.col("b.line"))
    return texts.alias("t").join(best.alias("b"), on).select("t.id", F.when(F.col("m.d") <= limit, F.col("m.role")).alias("role"), F.col("m.d").alias("distance"))


def nearest_level(values: DataFrame, levels: DataFrame, tol: float = 3.0) -> DataFrame:
    """(id, level): nearest elevation within ``tol``, ties to the lower one."""
    pairs = against(values.select("id", "value"), levels.select("level", "reach")).withColumn("d", F.abs(F.col("value") - F.col("reach")))
    best = pairs.groupBy("id").agg(F.min(F.struct("d", "reach", "level")).alias("m"))
    return best.select("id", F.when(F.col("m.d") <= tol, F.col("m.level")).alias("level"))


def token_map(parts: dict[str, DataFrame]) -> DataFrame:
    """(id, tokens): a map from property to token from tables (id, token), where there is one."""
    all_ = None
    for name, df in parts.items():
        p = df.where("token IS NOT NULL").select("id", F.lit(name).alias("k"), F.col("token").cast("string").alias("v"))
        all_ = p if all_ is None else all_.unionByName(p)
    return all_.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tokens"))


def match_catalog(nodes: DataFrame, signatures: DataFrame, top: int = 3) -> DataFrame:
    """(id, component, variant, score, rank): best variant of each component, the ``top`` components of each node.

    Nodes: (id, type, w, h, radius, r, g, b, stroke, texts). Signatures: (component, variant, type, low, high, rule,
    sr, sg, sb, stroked, least, most), of a node's type only. With ``needs`` in the signatures (a component or null) and ``parts``
    in the nodes (the components among a node's content) a signature that needs a component counts it as one more part. The
    score is the weighted mean of the parts; one that is 0 in height or fill multiplies it by a half.
    """
    lab = lambda p, names, of: {f"{p}{k}": v for k, v in zip(names, C.lab(*[F.col(c) for c in of]), strict=True)}
    # nodes are dealt before they meet their signatures, so that pairs are not shuffled
    n, s = nodes.withColumns(lab("n", "lab", "rgb")).repartition("id"), signatures.withColumns(lab("s", "uvw", ("sr", "sg", "sb")))
    j = n.join(small_enough(s, 20_000), "type")
    j = j.withColumn("de", C.delta76(tuple(F.col(f"n{k}") for k in "lab"), tuple(F.col(f"s{k}") for k in "uvw")))
    parts = {
        "height": G.soft_range(F.col("h").cast("double"), F.col("low"), F.col("high"), F.lit(6.0)),
        "radius": radius_score(F.col("radius"), F.col("w"), F.col("h"), F.col("rule")),
        "fill": color_score(F.col("de")),
        "stroke": F.when((F.col("stroke") > 0) == F.col("stroked"), 1.0).otherwise(0.0),
        "text": count_score(F.col("texts"), F.col("least"), F.col("most")),
    }
    j = j.withColumns({f"p_{k}": v for k, v in parts.items()})
    total, weight = sum(F.col(f"p_{k}") * w for k, w in WEIGHTS.items()), F.lit(sum(WEIGHTS.values()))
    if "needs" in signatures.columns:
        total = total + F.when(F.array_contains("parts", F.col("needs")), CHILD_WEIGHT).otherwise(0.0)
        weight = weight + F.when(F.col("needs").isNotNull(), CHILD_WEIGHT).otherwise(0.0)
    mean = total / weight
    j = j.withColumn("score", F.round(mean * F.when((F.col("p_height") == 0) | (F.col("p_fill") == 0), ZERO_PENALTY).otherwise(1.0), 9))
    best = j.groupBy("id", "component").agg(F.min_by(F.struct("variant", "score"), F.struct(-F.col("score"), F.col("variant"))).alias("t"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("t.score").desc(), "component"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("id", "component", "t.variant", "t.score", "rank")


def fill_slots(atoms: DataFrame, slots: DataFrame) -> DataFrame:
    """(id, slot, atom): each slot takes the next unused atom of its kind, one for ``multiple`` all that are left.

    Atoms: (id, component, position, kind, atom); slots: (component, position, slot, kind, multiple).
    """
    a = atoms.withColumn("n", F.row_number().over(W.partitionBy("id", "kind").orderBy("position")))
    s = slots.withColumn("n", F.row_number().over(W.partitionBy("component", "kind").orderBy("position"))).select("component", "slot", "kind", "multiple", F.col("n").alias("at"))
    # an open slot ends its kind's list
    first_open = s.where("multiple").groupBy("component", "kind").agg(F.min("at").alias("open"))
    s = s.join(first_open, ["component", "kind"], "left").where("open IS NULL OR at <= open").drop("open")
    return a.join(small_enough(s, 20_000), ["component", "kind"]).where("n = at OR (multiple AND n >= at)").select("id", "slot", "atom")


def rule_lookup(nodes: DataFrame, rules: DataFrame, height_tol: float = 6.0, aspect_tol: float = 0.35) -> DataFrame:
    """(id, rule, answer, confidence): the best active rule with the node's signature and about its size.

    Rules: (rule, signature, answer, height, aspect, confidence, support, local, active). Ties by support, then local
    rules, then the id. Nodes of one signature and size have the same rule, and of rules alike in signature, height and
    aspect only the first can be the best; so distinct sizes meet distinct rules, in steps of height wider than ``height_tol``.
    """
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (~F.col("local")).alias("l"), "rule")
    shape = ["signature", "h", "ratio"]
    n = nodes.select("id", "signature", "h", (F.col("w") / F.greatest(F.col("h"), F.lit(1))).alias("ratio"))
    kept = rules.where("active").groupBy("signature", "height", "aspect").agg(F.min(F.struct(order.alias("o"), "answer", "confidence")).alias("t"))
    step = lambda c: F.floor(F.col(c) / (height_tol + 1))
    kept = kept.withColumn("_step", F.explode(F.sequence(step("height") - 1, step("height") + 1)))
    j = n.select(*shape).distinct().withColumn("_step", step("h")).join(kept, ["signature", "_step"])
    near = j.where((F.abs(F.col("h") - F.col("height")) <= height_tol) & (F.abs(F.col("ratio") - F.col("aspect")) <= aspect_tol))
    best = near.groupBy(*shape).agg(F.min("t").alias("t"))
    return n.join(best, shape).select("id", F.col("t.o.rule").alias("rule"), "t.answer", "t.confidence")


def rule_effect(candidates: DataFrame, rules: DataFrame, boost: float = 0.25, override: float = 0.75, cap: float = 0.9, veto_score: float = 0.85, veto_margin: float = 0.4) -> DataFrame:
    """(id, component, confidence, effect) of the best candidate after its rule.

    Agreement boosts (up to ``cap``); a confident rule overrides, unless the candidate's score and margin veto it; an
    answer of ``none`` rejects the candidate; else it stays.
    """
    j = candidates.join(rules.select("id", "answer", F.col("confidence").alias("rule_confidence")), "id", "left")
    veto = (F.col("score") >= veto_score) & (F.col("margin") >= veto_margin)
    effect = F.when(F.col("answer").isNull(), "none").when(F.col("answer") == F.col("component"), "boost").when(veto, "veto").when(F.col("answer") == "none", "reject").when(F.col("rule_confidence") >= override, "override").otherwise("kept")
    j = j.withColumn("effect", effect)
    confidence = F.when(effect == "boost", F.greatest(F.col("confidence"), F.least(F.lit(cap), F.col("confidence") + F.lit(boost)))).when(effect == "override", F.least(F.lit(cap), F.col("rule_confidence"))).when(effect == "reject", 0.0).otherwise(F.col("confidence"))
    component = F.when(effect == "override", F.col("answer")).when(effect == "reject", F.lit(None)).otherwise(F.col("component"))
    return j.select("id", component.alias("component"), confidence.alias("confidence"), "effect")


def derived_signature(nodes: DataFrame, pad: float = 2.0) -> DataFrame:
    """Signature of each component from its exemplars (J34): size ranges, radii, whether any is stroked, text counts."""
    g = nodes.groupBy("component")
    low, high = (lambda c: F.min(c) - pad), (lambda c: F.max(c) + pad)
    return g.agg(F.count("*").alias("n"), low("h").alias("low"), high("h").alias("high"), F.min("radius").alias("radius_low"), F.max("radius").alias("radius_high"), F.bool_or(F.col("stroke") > 0).alias("stroked"), F.min("texts").alias("least"), F.max("texts").alias("most"))


def export_diff(before: DataFrame, after: DataFrame, geom_tol: float = 2.0, color_de: float = 3.0) -> DataFrame:
    """Corrections between an exported tree and what came back (J27), places relative to the parent.

    (case_id, node, kind, value): added, deleted, hidden, text, icon, component, move, resize, recolour.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        up = df.select("case_id", F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
        r = df.join(up, ["case_id", "parent"], "left").withColumns({"x": F.col("x") - F.coalesce("px", F.lit(0)), "y": F.col("y") - F.coalesce("py", F.lit(0))})
        return r.select("case_id", "node", *[F.col(c).alias(p + c) for c in ("x", "y", "w", "h", "r", "g", "b", "text", "glyph", "component", "opacity")], F.lit(True).alias(p + "in"))

    j = side(before, "a_").join(side(after, "b_"), ["case_id", "node"], "full_outer")
    both = F.col("a_in").isNotNull() & F.col("b_in").isNotNull()
    j = j.withColumn("de", C.delta76(C.lab(*[F.col(f"a_{c}") for c in "rgb"]), C.lab(*[F.col(f"b_{c}") for c in "rgb"])))
    off = lambda a, b: F.greatest(F.abs(F.col(f"a_{a}") - F.col(f"b_{a}")), F.abs(F.col(f"a_{b}") - F.col(f"b_{b}")))
    other = lambda c: both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    row = lambda when, kind, value: F.when(when, F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")))
    hidden = both & (F.col("a_opacity") > 0) & (F.col("b_opacity") == 0)
    rows = [
        row(F.col("a_in").isNull(), "added", F.lit(None)), row(F.col("b_in").isNull(), "deleted", F.lit(None)), row(hidden, "hidden", F.lit(None)),
        row(other("text"), "text", F.col("b_text")), row(other("glyph"), "icon", F.col("b_glyph")), row(other("component"), "component", F.col("b_component")),
        row(both & (off("x", "y") > geom_tol), "move", F.concat_ws(",", "b_x", "b_y")), row(both & (off("w", "h") > geom_tol), "resize", F.concat_ws(",", "b_w", "b_h")), row(both & (F.col("de") > color_de), "recolour", F.concat_ws(",", "b_r", "b_g", "b_b")),
    ]
    return j.select("case_id", "node", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("case_id", "node", "c.kind", "c.value")


def apply_corrections(nodes: DataFrame, corrections: DataFrame, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrected nodes, and skipped corrections with a reason.

    Corrections: (case_id, node, kind, value). A deletion takes the subtree along (``up``: (case_id, node, ancestor));
    text, component and icon set that field; move sets the place.
    """
    kinds = ("deleted", "text", "component", "icon", "move")
    c = corrections.join(nodes.select("case_id", "node", F.lit(True).alias("known")), ["case_id", "node"], "left")
    reason = F.when(F.col("known").isNull(), "no such node").when(~F.col("kind").isin(*kinds), "unknown kind").when(F.col("value").isNull() & (F.col("kind") != "deleted"), "no value")
    c = c.withColumn("reason", reason)
    good = c.where("reason IS NULL")
    gone = good.where("kind = 'deleted'").select("case_id", "node")
    below = up.join(gone.withColumnRenamed("node", "ancestor"), ["case_id", "ancestor"], "left_semi").select("case_id", "node")
    value = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"new_{k}")
    new = good.where("kind <> 'deleted'").groupBy("case_id", "node").agg(*[value(k) for k in kinds[1:]])
    j = nodes.join(gone.unionByName(below).distinct(), ["case_id", "node"], "left_anti").join(new, ["case_id", "node"], "left")
    at = F.split("new_move", ",")
    place = lambda i, c: F.when(F.col("new_move").isNotNull(), at[i].try_cast("double").cast(nodes.schema[c].dataType)).otherwise(F.col(c))
    j = j.withColumns({"text": F.coalesce("new_text", "text"), "component": F.coalesce("new_component", "component"), "glyph": F.coalesce("new_icon", "glyph"), "x": place(0, "x"), "y": place(1, "y")})
    return j.select(*nodes.columns), c.where("reason IS NOT NULL").select("case_id", "node", "kind", "reason")


def best_reading(lines: DataFrame, texts: DataFrame, distance: Column) -> DataFrame:
    """(case_id, text_term): mean over a case's target lines of the least error rate of any of its texts.

    A pair whose lengths alone differ too much to beat an exact reading is not compared; without texts it is 1.
    """
    j = lines.join(texts.select("case_id", F.col("text").alias("read")), "case_id", "left")
    best = j.withColumn("e", F.coalesce(distance, F.lit(1.0))).groupBy("case_id", "line_id").agg(F.min("e").alias("e"))
    return best.groupBy("case_id").agg(F.avg("e").alias("text_term"))


def nearest_lines(targets: DataFrame, lines: DataFrame, reach: float, bonus: float = 10.0) -> DataFrame:
    """One-to-one pairs of target and read lines by distance of their centres, equal texts preferred."""
    wide = lines.withColumns({**{f"o{c}": F.col(c) for c in "xywh"}, "x": F.col("x") - reach, "y": F.col("y") - reach, "w": F.col("w") + 2 * reach, "h": F.col("h") + 2 * reach})
    j = spatial.spatial_join(wide, targets)
    dx = F.col("l_ox") + F.col("l_ow") / 2 - F.col("r_x") - F.col("r_w") / 2
    dy = F.col("l_oy") + F.col("l_oh") / 2 - F.col("r_y") - F.col("r_h") / 2
    d = F.sqrt(dx * dx + dy * dy)
    j = j.withColumn("d", d).where(F.col("d") <= reach).withColumn("score", F.when(F.col("l_text") == F.col("r_text"), F.lit(bonus)).otherwise(0.0) - F.col("d")).select("case_id", "l_node", "r_node", "d", "score")
    return spatial.match_one_to_one(j, ["case_id", "l_node"], ["case_id", "r_node"], "score").select("case_id", F.col("r_node").alias("target"), F.col("l_node").alias("line"), "d")


def prior_knowledge(worst: DataFrame, knowledge: DataFrame, top: int = 3) -> DataFrame:
    """Each worst entry with at most ``top`` knowledge entries of its metric and stage, best first."""
    rank = F.row_number().over(W.partitionBy("case_id", "metric").orderBy(F.col("strength").desc(), "entry"))
    return worst.join(knowledge, ["metric", "stage"]).withColumn("rank", rank).where(F.col("rank") <= top)


def keyword_references(clusters: DataFrame, entries: DataFrame, top: int = 4) -> DataFrame:
    """(cluster, entry, hits): entries of most words equal to a cluster's keywords, ties to the smaller entry."""
    words = entries.select("entry", F.explode(F.split(F.lower("text"), r"\W+")).alias("word")).where("word <> ''").groupBy("entry", "word").agg(F.count("*").alias("k"))
    keys = clusters.select("cluster", F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("word"))
    hits = keys.join(words, "word").groupBy("cluster", "entry").agg(F.sum("k").alias("hits"))
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.col("hits").desc(), "entry"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top)
