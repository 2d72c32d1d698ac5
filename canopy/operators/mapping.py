"""Mapping of whole trees to a catalog, level by level from the leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.operators import matcher, tokens
from canopy.operators.core import written

#: Kinds that are never components themselves.
CONTENT = ["text", "icon", "image"]


def depths(nodes: DataFrame, most: int = 64) -> DataFrame:
    """``nodes`` with ``depth``, 0 for roots, by one join a level."""
    level = written(nodes.where("parent IS NULL").select("case_id", "node", F.lit(0).alias("depth")))
    out = level
    for d in range(1, most + 1):
        level = written(nodes.join(level.select("case_id", F.col("node").alias("parent")), ["case_id", "parent"]).select("case_id", "node", F.lit(d).alias("depth")))
        if level.isEmpty():
            return nodes.join(out, ["case_id", "node"])
        out = out.unionByName(level)
    raise RuntimeError(f"tree deeper than {most}")


def map_documents(
    nodes: DataFrame, signatures: DataFrame, slots: DataFrame, rules: DataFrame, page: float = 0.98, assign: float = 0.6, candidate: float = 0.35, top: int = 3, cap: float = 0.9,
) -> DataFrame:
    """(case_id, node, component, variant, confidence, effect, props, candidates), one row a node.

    Nodes: case_id, node, parent, kind, type, x, y, w, h, radius, r, g, b (null: no fill), stroke (a number, 0 for none), shadow
    (likewise), text, signature. Signatures, slots and rules as ``match_catalog``, ``fill_slots`` and ``rule_lookup`` read them.

    From the deepest level up, each level's nodes get their content atoms: visible children, but for a bare wrapper (an
    unpainted frame with children and no component) its own atoms, so that what a level is assigned decides what its
    parents contain. Roots, content and boxes as large as their root are not matched. A node whose best candidate scores
    ``assign`` or which a rule overrides gets the component, its confidence and its slots' content; one that scores
    ``candidate`` keeps its candidates for review; the others have neither.
    """
    roots = nodes.where("parent IS NULL").select("case_id", F.col("w").alias("pw"), F.col("h").alias("ph"))
    hosts = nodes.where("parent IS NOT NULL").select("case_id", F.col("parent").alias("node")).distinct().withColumn("host", F.lit(True))
    n = depths(nodes).join(hosts, ["case_id", "node"], "left").join(roots, "case_id")
    painted = F.col("r").isNotNull() | (F.col("stroke") > 0) | (F.col("shadow") > 0)
    large = (F.col("w") >= F.col("pw") * page) & (F.col("h") >= F.col("ph") * page)
    n = written(n.withColumns({"matched": F.col("parent").isNotNull() & ~F.col("kind").isin(*CONTENT) & ~large, "atomic": (F.col("kind") != "frame") | painted | F.col("host").isNull()}).drop("pw", "ph", "host"))
    deepest = n.agg(F.max("depth")).first()[0]
    atoms: DataFrame | None = None  # (case_id, host, atom, kind, component, x, y, text) of the level below
    done: DataFrame | None = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        level = n.where(F.col("depth") == d)
        atoms = atoms if atoms is not None else _no_atoms(nodes)
        content = atoms.groupBy("case_id", F.col("host").alias("node")).agg(F.count_if(F.col("kind") == "text").alias("texts"), F.array_sort(F.collect_set("component")).alias("parts"))
        features = level.where("matched").join(content, ["case_id", "node"], "left").select(
            F.struct("case_id", "node").alias("id"), "type", "w", "h", "radius", *"rgb", "stroke", "signature", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("parts", F.array().cast("array<string>")).alias("parts"))
        found = written(matcher.match_catalog(features, signatures, top))
        answers = matcher.rule_lookup(features, rules)
        best = tokens.calibrated(found.select("id", F.struct("component", "variant").alias("component"), "score")).select("id", "component.component", "component.variant", "score", "margin", "confidence")
        effect = matcher.rule_effect(best, answers, cap=cap).select("id", F.col("component").alias("answer"), F.col("confidence").alias("sure"), "effect")
        j = best.join(effect, "id")
        forced = F.col("effect") == "override"
        keep = (F.col("effect") != "reject") & ((F.col("score") >= assign) | forced)
        summary = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "component", "variant", "score"))), lambda c: F.struct(c["component"].alias("component"), c["variant"].alias("variant"), c["score"].alias("score"))).alias("candidates"))
        j = j.join(summary, "id").select(
            "id", F.when(keep, F.col("answer")).alias("component"), F.when(keep & (F.col("answer") == F.col("component")), F.col("variant")).alias("variant"), F.when(keep, F.col("sure")).alias("confidence"), "effect",
            F.when(~keep & (F.col("effect") != "reject") & (F.col("score") >= candidate), F.col("candidates")).alias("candidates"))
        placed = W.partitionBy("id").orderBy("x", "y", "atom")
        own = atoms.select(F.struct("case_id", F.col("host").alias("node")).alias("id"), "kind", "atom", "text", F.coalesce(F.col("component"), F.col("text"), F.col("atom").cast("string")).alias("value"), "x", "y").withColumn("position", F.row_number().over(placed))
        filled = own.join(j.where("component IS NOT NULL").select("id", "component"), "id").select("id", "component", "position", "kind", F.struct("position", "value").alias("atom"))
        props = matcher.fill_slots(filled, slots).groupBy("id", "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list("atom")), lambda a: a["value"]), "|").alias("value"))
        props = props.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "value")))).alias("props"))
        solved = j.join(props, "id", "left").select("id.case_id", "id.node", "component", "variant", "confidence", "effect", "props", "candidates")
        solved = written(level.select("case_id", "node", "parent", "kind", "atomic", "x", "y", "text").join(solved, ["case_id", "node"], "left"))
        done = solved if done is None else done.unionByName(solved)
        whole = F.col("atomic") | F.col("component").isNotNull()
        mine = solved.where(F.col("parent").isNotNull() & whole).select("case_id", F.col("parent").alias("host"), F.col("node").alias("atom"), F.when(F.col("component").isNotNull(), "instance").otherwise(F.col("kind")).alias("kind"), "component", "x", "y", "text")
        wrapped = atoms.join(solved.where(F.col("parent").isNotNull() & ~whole).select("case_id", F.col("node").alias("host"), "parent"), ["case_id", "host"]).select("case_id", F.col("parent").alias("host"), "atom", "kind", "component", "x", "y", "text")
        atoms = written(mine.unionByName(wrapped))
    columns = ["case_id", "node", "component", "variant", "confidence", "effect", "props", "candidates"]
    if done is None:
        empty = "component string, variant string, confidence double, effect string, props map<string,string>, candidates array<struct<component:string,variant:string,score:double>>"
        return nodes.select("case_id", "node").join(nodes.sparkSession.createDataFrame([], "case_id long, node long, " + empty), ["case_id", "node"])
    return done.select(*columns)


def _no_atoms(nodes: DataFrame) -> DataFrame:
    none = nodes.where(F.lit(False))
    return none.select("case_id", F.col("parent").alias("host"), F.col("node").alias("atom"), "kind", F.lit(None).cast("string").alias("component"), "x", "y", "text")
