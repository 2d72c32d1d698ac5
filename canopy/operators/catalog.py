"""Tokens, layered parameters, aliases, nesting and tile statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.operators import tree


def layered(layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Value of each key from the last layer that has it, and that layer's name."""
    named = [df.select("key", F.col("value"), F.lit(i).alias("order"), F.lit(n).alias("layer")) for i, (n, df) in enumerate(layers)]
    every = named[0]
    for n in named[1:]:
        every = every.unionByName(n)
    return every.where("value IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("value", "layer"), "order").alias("t")).select("key", "t.value", "t.layer")


def aliases(glyphs: DataFrame) -> DataFrame:
    """Names that share a codepoint, each with the first of them: a group of n names gives n rows, not n * n."""
    names = glyphs.select("name", "code").distinct()
    first = names.groupBy("code").agg(F.min("name").alias("first"), F.count("*").alias("n")).where("n > 1")
    return names.join(first, "code").select("code", "name", "first")


def retheme(tokens: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """A catalog with tokens replaced by name, or by the last segment of a dotted name, and new ones added."""
    short = lambda c: F.element_at(F.split(c, r"\."), -1)
    new = changes.select(F.col("token").alias("given"), short(F.col("token")).alias("short"), *[F.col(c).alias(f"new_{c}") for c in columns])
    # a full name beats a last segment
    old = tokens.withColumn("short", short(F.col("token")))
    full = old.join(new.drop("short"), old["token"] == new["given"], "left")
    rest = full.where("given IS NULL").select(*tokens.columns, "short").join(new, "short", "left")
    merged = full.where("given IS NOT NULL").drop("short").unionByName(rest.drop("short"))
    kept = merged.select("token", *[F.when(F.col("given").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.when(F.col("given").isNotNull(), "replaced").otherwise("kept").alias("source"))
    used = merged.where("given IS NOT NULL").select("given").distinct()
    added = new.join(used, "given", "left_anti").select(F.col("given").alias("token"), *[F.col(f"new_{c}").alias(c) for c in columns], F.lit("added").alias("source"))
    return kept.unionByName(added)


def height_clusters(items: DataFrame, tolerance: float) -> DataFrame:
    """Heights of each signature in clusters whose consecutive members differ by at most ``tolerance``."""
    n = items.groupBy("signature", "h").agg(F.count("*").alias("n"))  # the window sees distinct heights only
    order = W.partitionBy("signature").orderBy("h")
    fresh = F.when(F.col("h") - F.lag("h").over(order) <= tolerance, 0).otherwise(1)
    return n.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(order)).groupBy("signature", "cluster").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("n").alias("n"))


def typescale(texts: DataFrame) -> DataFrame:
    """Count, median line height and most frequent family (ties to the smaller) by size and weight."""
    g = texts.groupBy("size", "weight").agg(F.count("*").alias("n"), F.median("line_height").alias("line_height"))
    f = texts.groupBy("size", "weight", "family").agg(F.count("*").alias("k")).groupBy("size", "weight").agg(F.min(F.struct((-F.col("k")).alias("k"), "family"))["family"].alias("family"))
    return g.join(f, ["size", "weight"])


def shape_tokens(boxes: DataFrame) -> DataFrame:
    """Count of each radius and whether it makes a pill somewhere."""
    return boxes.groupBy("radius").agg(F.count("*").alias("n"), F.bool_or(F.col("radius") * 2 >= F.least("w", "h")).alias("pill"))


def tile_alarms(tiles: DataFrame, p: dict[str, Column]) -> DataFrame:
    """Expected false alarms of each tile, tests of its page times the least p, and the statistic that fired."""
    least = F.array_min(F.array(*[F.struct(c.alias("p"), F.lit(n).alias("fired")) for n, c in p.items()]))
    tests = tiles.groupBy("case_id").agg((F.count("*") * len(p)).alias("tests"))
    return tiles.withColumn("least", least).join(tests, "case_id").select("case_id", "tile", (F.col("tests") * F.col("least.p")).alias("nfa"), "least.fired")


def alarm_curve(scores: DataFrame, steps: list[int]) -> DataFrame:
    """Tiles at or below each threshold, in one pass."""
    sums = scores.agg(*[F.count(F.when(F.col("score") <= s, 1)).alias(f"s{s}") for s in steps])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(s).alias("eps"), F.col(f"s{s}").alias("n")) for s in steps])).alias("r")).select("r.eps", "r.n")


def fold_weak(findings: DataFrame, share: float) -> DataFrame:
    """Findings under a share of their page's median magnitude become one abstention a page."""
    bar = findings.groupBy("case_id").agg(F.median("magnitude").alias("m"))
    j = findings.join(bar, "case_id").withColumn("weak", F.col("magnitude") < F.col("m") * share)
    weak = j.where("weak").groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit(None).cast("long").alias("fid"), "n", F.lit("abstain").alias("kind"))
    return j.where("NOT weak").select("case_id", "fid", F.lit(1).cast("long").alias("n"), F.lit("finding").alias("kind")).unionByName(weak)


def fit_descendants(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Union of the boxes (id, x, y, x2, y2) at and under each node of a tree."""
    up = tree.ancestors(nodes).select("id", "ancestor").unionByName(nodes.select("id", F.col("id").alias("ancestor")))
    own = boxes.groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return own.join(up, "id").groupBy(F.col("ancestor").alias("id")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def visibility(nodes: DataFrame, floor: float = 0.02) -> DataFrame:
    """Opacity of each node times those of its ancestors, and whether it can be seen."""
    up = tree.ancestors(nodes.select("id", "parent")).join(nodes.select(F.col("id").alias("ancestor"), F.col("opacity").alias("o")), "ancestor")
    path = up.groupBy("id").agg(F.aggregate(F.array_sort(F.collect_list("o")), F.lit(1.0), lambda a, v: a * v).alias("above"))  # as long as the tree is deep
    j = nodes.join(path, "id", "left").withColumn("shown", F.col("opacity") * F.coalesce("above", F.lit(1.0)))
    return j.select("id", "shown", (F.col("shown") > floor).alias("visible"))


def strict_sequences(boxes: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Groups of at least ``least`` boxes that follow each other downwards without overlap."""
    order = W.partitionBy(*by).orderBy("y", "node")
    clear = F.coalesce(F.lead("y").over(order) >= F.col("y") + F.col("h"), F.lit(True))
    return boxes.withColumn("clear", clear).groupBy(*by).agg(F.count("*").alias("n"), F.bool_and("clear").alias("clear")).where((F.col("n") >= least) & F.col("clear")).drop("clear")


def clamp(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes cut to the page; those wholly outside go."""
    x, y = F.greatest(F.lit(0), F.col("x")), F.greatest(F.lit(0), F.col("y"))
    w, h = F.least(F.lit(width), F.col("x") + F.col("w")) - x, F.least(F.lit(height), F.col("y") + F.col("h")) - y
    return boxes.withColumns({"x": x, "y": y, "w": w, "h": h}).where("w > 0 AND h > 0")
