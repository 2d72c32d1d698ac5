"""Readers of design files: nodes, style and variable tokens, component sets with their variants.

A file is a JSON document that is walked one level of children at a time as VARIANT; everything else is read off that walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import text as X
from canopy.operators.core import written
from canopy.sources.readers import _get

#: Style types and what they become (fixed values).
CATEGORIES = {"FILL": "color", "TEXT": "typescale", "EFFECT": "elevation", "STROKE": "color"}
#: States that a set's default variant may have, and how far an alias of variables is followed.
RESTING, ALIASES = ["enabled", "default", "rest"], 16


#: Levels of children that are walked where a file was parsed, before what lies deeper is walked from a table.
STEPS = 6


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, computed once a row: every expression that reads a projection computes it anew, and a
    file would be parsed for each field that is read of it."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def read_design_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc): a file a line, doc_id its field ``name``; what is no JSON is left out."""
    doc = spark.read.text(path).select(F.explode(F.array(F.expr("try_parse_json(value)"))).alias("doc")).where("doc IS NOT NULL")
    return doc.select(_get("doc", "name", "string").alias("doc_id"), "doc")


def walk(files: DataFrame, most: int = 256) -> DataFrame:
    """(doc_id, parent_id, path, shown, origin, node): every node, also hidden ones and those inside glyphs.

    ``shown``: it and all its ancestors are visible and the ancestors are frames; ``origin``: the top node's box.
    """
    box = F.struct(*[F.coalesce(_get("node", f"absoluteBoundingBox.{c}", "double"), F.lit(0.0)).alias(c) for c in "xy"])
    level = _once(files, "node", _get("doc", "document", "variant")).where("node IS NOT NULL")
    level = level.select("doc_id", F.lit(None).cast("string").alias("parent_id"), F.array(F.lit(0)).alias("path"), F.lit(True).alias("open"), box.alias("origin"), "node")
    out, done = None, 0
    while done < most - 1:
        first, steps = done, min(STEPS, most - 1 - done)
        for done in range(first + 1, first + steps + 1):
            level = _with_children(level, done)
        level = level.withColumn("shown", F.col("open") & F.coalesce(_get("node", "visible", "boolean"), F.lit(True)))
        # VARIANT columns cannot be told apart by a union's constraints, so what is walked at once is a table of its own
        level = written(level, "zstd")
        out = level if out is None else out.unionByName(level.where(F.size("path") > first + 1))
        level = level.where(F.size("path") == done + 1).drop("shown")
        if level.isEmpty():
            return out.select("doc_id", "parent_id", "path", "shown", "origin", "node")
    raise ValueError(f"file deeper than {most}")


def _with_children(level: DataFrame, depth: int) -> DataFrame:
    """``level`` and the children of its nodes whose path has ``depth`` parts."""
    here = F.size("path") == depth
    level = _once(level, "s", F.when(here, F.expr("try_variant_get(node, '$', 'struct<id:string,name:string,type:string,visible:boolean,children:array<variant>>')")))
    named = F.map_values(F.expr("try_variant_get(node, '$.children', 'map<string,variant>')"))
    kids = F.when(here, F.coalesce("s.children", named))
    both = level.select("*", F.posexplode(F.when(kids.isNull(), F.array("node")).otherwise(F.concat(F.array("node"), kids))).alias("_pos", "_node"))
    of = lambda new, old: F.when(F.col("_pos") > 0, new).otherwise(F.col(old)).alias(old)
    inside = F.col("open") & F.coalesce("s.visible", F.lit(True)) & (_kind(F.col("s.type"), F.col("s.name")) == "frame")
    return both.select("doc_id", of(F.col("s.id"), "parent_id"), of(F.concat("path", F.array(F.col("_pos") - 1)), "path"), of(inside, "open"), "origin", F.col("_node").alias("node"))


def _kind(kind: Column, name: Column) -> Column:
    t, name = F.coalesce(kind, F.lit("FRAME")), F.lower(F.coalesce(name, F.lit("")))
    glyph = t.isin("VECTOR", "BOOLEAN_OPERATION", "STAR", "REGULAR_POLYGON") | (t.isin("INSTANCE", "FRAME", "GROUP") & (name.contains("icon") | name.startswith("ic_") | name.startswith("ic/")))
    return F.when(t == "TEXT", "text").when(t == "ELLIPSE", "ellipse").when(t == "LINE", "line").when(t == "RECTANGLE", "rect").when(glyph, "icon").otherwise("frame")


#: Lists of paints and of effects as they are read of a node, and the fields of a text's style.
_PAINTS = "array<struct<type:string,visible:boolean,opacity:double,color:struct<r:double,g:double,b:double,a:double>>>"
_EFFECTS = "array<struct<type:string,visible:boolean,radius:double,spread:double,offset:struct<x:double,y:double>>>"
_LOOK = f"fills:{_PAINTS},strokes:{_PAINTS},effects:{_EFFECTS},style:struct<fontFamily:string,fontSize:double,fontWeight:double,lineHeightPx:double,letterSpacing:double>"


def _paint(paints: str) -> Column:
    """Hex of the first visible solid paint of a list; null without one."""
    solid = F.get(F.filter(paints, lambda p: (p["type"] == "SOLID") & F.coalesce(p["visible"], F.lit(True)) & p["color"].isNotNull()), F.lit(0))
    part = lambda c: F.round(F.coalesce(solid["color"][c], F.lit(0.0)) * 255).cast("int")
    return F.when(solid.isNotNull(), F.format_string("#%02x%02x%02x", part("r"), part("g"), part("b")))


def _shadow() -> Column:
    e = F.get(F.filter("s.effects", lambda p: p["type"].isin("DROP_SHADOW", "INNER_SHADOW") & F.coalesce(p["visible"], F.lit(True))), F.lit(0))
    number = lambda c: F.coalesce(c, F.lit(0.0))
    return F.when(e.isNotNull(), F.struct(number(e["offset"]["x"]).alias("dx"), number(e["offset"]["y"]).alias("dy"), number(e["radius"]).alias("blur"), number(e["spread"]).alias("spread"), (e["type"] == "INNER_SHADOW").alias("inner")))


def _style() -> Column:
    number = lambda c, d: F.coalesce(f"s.style.{c}", F.lit(d))
    return F.struct(F.coalesce("s.style.fontFamily", F.lit("Roboto")).alias("family"), number("fontSize", 14.0).alias("size"), number("fontWeight", 400.0).cast("int").alias("weight"), F.col("s.style.lineHeightPx").alias("line_height"), number("letterSpacing", 0.0).alias("tracking"))


def design_nodes(walked: DataFrame) -> DataFrame:
    """One row for each node that is shown, in pre-order.

    Places are relative to the top node's origin. A glyph without a fill takes that of its first child that has one; its name
    without a leading ``icon`` is its glyph. Strokes count only with a width; children of what is no frame are not nodes.
    """
    s = F.expr(f"try_variant_get(node, '$', 'struct<id:string,name:string,type:string,absoluteBoundingBox:struct<x:double,y:double,width:double,height:double>,opacity:double,rectangleCornerRadii:array<double>,cornerRadius:double,strokeWeight:double,characters:string,layoutMode:string,itemSpacing:double,{_LOOK}>')")
    number = lambda c: F.coalesce(f"s.{c}", F.lit(0.0))
    mode = {"HORIZONTAL": "row", "VERTICAL": "column"}
    paints = F.struct(_kind(F.col("s.type"), F.col("s.name")).alias("kind"), _paint("s.fills").alias("fill"), _paint("s.strokes").alias("stroke"), number("strokeWeight").alias("width"), F.coalesce(*[F.when(F.col("s.layoutMode") == a, F.lit(b)) for a, b in mode.items()]).alias("layout"))
    inner = _once(walked.select("doc_id", "path", "node"), "fills", F.expr(f"try_variant_get(node, '$.fills', '{_PAINTS}')")).where(F.size("fills") > 0)
    inner = inner.groupBy("doc_id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.min_by(_paint("fills"), "path").alias("inner_fill"))
    corner = F.coalesce(F.get("s.rectangleCornerRadii", F.lit(0)), "s.cornerRadius", F.lit(0.0))
    kind, stroked = F.col("p.kind"), F.col("p.width") > 0
    # a node carries its children, so only what is read of it goes through the join
    n = _once(_once(walked.where("shown"), "s", s), "p", paints).select(
        "doc_id", F.col("s.id").alias("node_id"), "parent_id", (F.size("path") - 1).alias("depth"), "path", kind.alias("type"), F.col("s.name").alias("name"),
        (number("absoluteBoundingBox.x") - F.col("origin.x")).alias("x"), (number("absoluteBoundingBox.y") - F.col("origin.y")).alias("y"), number("absoluteBoundingBox.width").alias("w"), number("absoluteBoundingBox.height").alias("h"), F.coalesce("s.opacity", F.lit(1.0)).alias("opacity"), corner.alias("radius"),
        F.when(kind != "text", F.col("p.fill")).alias("fill"), F.when(stroked, F.col("p.stroke")).alias("stroke"), F.when(stroked & F.col("p.stroke").isNotNull(), F.col("p.width")).alias("stroke_width"),
        _shadow().alias("shadow"), F.when(kind == "text", F.coalesce("s.characters", F.lit(""))).alias("text"), F.when(kind == "text", _style()).alias("style"), F.when(kind == "text", F.coalesce("p.fill", F.lit("#000000"))).alias("ink"),
        F.when(kind == "frame", F.col("p.layout")).alias("layout"), F.when((kind == "frame") & F.col("p.layout").isNotNull(), number("itemSpacing")).alias("gap"),
        F.when(kind == "icon", F.coalesce(F.nullif(X.kebab(F.regexp_replace("s.name", r"(?i)^(icons?[/_-]?)", "")), F.lit("")), F.lit("icon"))).alias("glyph"))
    n = n.join(inner, ["doc_id", "path"], "left").withColumn("fill", F.when(F.col("type") == "icon", F.coalesce("fill", "inner_fill")).otherwise(F.col("fill"))).drop("inner_fill")
    return n.withColumn("preorder", F.row_number().over(W.partitionBy("doc_id").orderBy("path")) - 1)


def style_tokens(files: DataFrame, walked: DataFrame) -> DataFrame:
    """(doc_id, style_id, name, category, value) of styles that some node uses.

    The value is that of the first node in pre-order that names the style for any property; styles of other types, unused ones,
    and those whose first user has no such value are left out.
    """
    spark = files.sparkSession
    styles = spark.sql("SELECT doc_id, s.key AS style_id, s.value AS said FROM {files}, LATERAL variant_explode(try_variant_get(doc, '$.styles', 'variant')) AS s", files=files)
    styles = _once(styles, "s", F.struct(_get("said", "name", "string").alias("name"), F.upper(_get("said", "styleType", "string")).alias("style_type"))).select("doc_id", "style_id", "s.*")
    used = spark.sql("SELECT doc_id, path, CAST(s.value AS string) AS style_id, node FROM {walked}, LATERAL variant_explode(try_variant_get(node, '$.styles', 'variant')) AS s", walked=walked)
    used = _once(used, "s", F.expr(f"try_variant_get(node, '$', 'struct<{_LOOK}>')"))
    used = used.select("doc_id", "style_id", "path", _paint("s.fills").alias("fill"), _paint("s.strokes").alias("stroke"), F.to_json(_shadow()).alias("shadow"), F.to_json(_style()).alias("text"))
    first = used.groupBy("doc_id", "style_id").agg(F.min_by(F.struct("fill", "stroke", "shadow", "text"), "path").alias("v"))
    value = F.coalesce(*[F.when(F.col("style_type") == t, F.col(f"v.{c}")) for t, c in (("FILL", "fill"), ("TEXT", "text"), ("EFFECT", "shadow"), ("STROKE", "stroke"))])
    name = F.concat(F.lit("style."), F.replace(F.replace(X.kebab(F.coalesce("name", "style_id")), F.lit("-/-"), F.lit(".")), F.lit("/"), F.lit(".")))
    category = F.coalesce(*[F.when(F.col("style_type") == t, F.lit(c)) for t, c in CATEGORIES.items()])
    return styles.join(first, ["doc_id", "style_id"]).select("doc_id", "style_id", name.alias("name"), category.alias("category"), value.alias("value")).where("category IS NOT NULL AND value IS NOT NULL")


def variable_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, variable_id, name, category, value): variables in their collection's default mode.

    An alias stands for its target's value in that target's default mode, followed up to ``ALIASES`` times; what does not
    end by then, as in a cycle, has no value and is left out. Numbers are spacing, shape or dimension by their name.
    """
    # all but aliases is read off a file where it was parsed
    own = files.where("doc_id IS NOT NULL").select("doc_id", F.expr("try_variant_get(doc, '$.variableCollections', 'map<string,struct<defaultModeId:string>>')").alias("modes"), F.explode(F.expr("try_variant_get(doc, '$.variables', 'map<string,variant>')")).alias("id", "v"))
    own = _once(own, "s", F.expr("try_variant_get(v, '$', 'struct<name:string,resolvedType:string,variableCollectionId:string,valuesByMode:map<string,variant>>')"))
    preset = F.element_at("modes", F.col("s.variableCollectionId"))["defaultModeId"]
    # a list of values has no modes
    values = F.coalesce(F.map_entries("s.valuesByMode"), F.transform(F.expr("try_variant_get(v, '$.valuesByMode', 'array<variant>')"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))))
    own = _once(_once(own, "preset", preset), "m", F.get(F.filter(values, lambda e: F.col("preset").isNull() | (e["key"] == F.col("preset"))), F.lit(0))).where("m IS NOT NULL")
    own = _once(own.select("doc_id", "id", F.col("s.name").alias("name"), F.coalesce("s.resolvedType", F.lit("STRING")).alias("kind"), F.col("m.value").alias("value")), "p", F.expr("try_variant_get(value, '$', 'struct<id:string,r:double,g:double,b:double>')"))
    own = written(own.select("doc_id", "id", "name", "kind", F.col("p.id").alias("alias"), F.expr("to_json(value)").alias("raw"), *[F.col(f"p.{c}").alias(c) for c in "rgb"], F.expr("try_cast(value AS double)").alias("number"), F.expr("try_cast(value AS string)").alias("said")))
    # the target's value, for what is an alias so far
    said = ["alias", "raw", *"rgb", "number", "said"]
    target, done, at = own.select("doc_id", F.col("id").alias("to"), *said), own.where("alias IS NULL"), own
    for _ in range(ALIASES):
        at = at.where("alias IS NOT NULL").select("doc_id", "id", "name", "kind", F.col("alias").alias("to"))
        at = written(at.join(target, ["doc_id", "to"]).select("doc_id", "id", "name", "kind", *said))
        done = done.unionByName(at.where("alias IS NULL"))
        if at.where("alias IS NOT NULL").isEmpty():
            break
    j = done
    name = F.concat(F.lit("var."), F.replace(X.kebab(F.coalesce("name", "id")), F.lit("/"), F.lit(".")))
    part = lambda p: F.round(F.coalesce(F.col(p), F.lit(0.0)) * 255).cast("int")
    is_colour, is_number = (F.col("kind") == "COLOR") & F.col("raw").startswith("{"), (F.col("kind") == "FLOAT") & F.col("number").isNotNull()
    has = lambda *words: F.greatest(*[F.col("token").contains(w) for w in (*words, words[0])])
    size = F.when(has("spac", "gap", "pad"), "spacing").when(has("radius", "corner"), "shape").otherwise("dimension")
    value = F.when(is_colour, F.format_string("#%02x%02x%02x", part("r"), part("g"), part("b"))).when(is_number, F.col("number").cast("string")).otherwise(F.coalesce("said", "raw"))
    return j.withColumn("token", name).select("doc_id", F.col("id").alias("variable_id"), F.col("token").alias("name"), F.when(is_colour, "color").when(is_number, size).otherwise("other").alias("category"), value.alias("value")).where("value IS NOT NULL")


def component_sets(walked: DataFrame) -> DataFrame:
    """(doc_id, set_id, name, variant_id, variant, props, preset, low, high): the variants of each component set.

    ``props`` are the variant's name read as ``Key=Value, ...`` in kebab case; ``preset`` marks the set's default, the first variant
    without a state or with a resting one, else the first; low and high are the set's heights, two pixels wider.
    """
    kind = _get("node", "type", "string")
    # of a repeated key the last value counts
    last = lambda entries: F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"])))
    sets = walked.where(kind == "COMPONENT_SET").select("doc_id", _get("node", "id", "string").alias("set_id"), _get("node", "name", "string").alias("name"))
    v = walked.where(kind == "COMPONENT").select("doc_id", F.col("parent_id").alias("set_id"), "path", _get("node", "id", "string").alias("variant_id"), _get("node", "name", "string").alias("variant"), F.coalesce(_get("node", "absoluteBoundingBox.height", "double"), F.lit(0.0)).alias("h"))
    v = _once(v, "variant", F.col("variant"))
    pairs = F.filter(F.split("variant", ","), lambda p: p.contains("="))
    word = lambda c: X.kebab(F.trim(c))
    entries = F.transform(pairs, lambda p: F.struct(word(F.substring_index(p, "=", 1)).alias("k"), word(F.substr(p, F.instr(p, F.lit("=")) + 1)).alias("v")))
    v = _once(_once(v, "entries", entries), "props", last(F.col("entries"))).drop("entries")
    v = v.withColumn("state", F.element_at("props", F.lit("state")))
    every, order = W.partitionBy("doc_id", "set_id"), F.struct(F.when(F.col("state").isNull() | F.col("state").isin(*RESTING), 0).otherwise(1).alias("late"), F.col("path"))
    v = v.withColumns({"preset": order == F.min(order).over(every), "low": F.min("h").over(every) - 2, "high": F.max("h").over(every) + 2})
    return sets.join(v, ["doc_id", "set_id"]).select("doc_id", "set_id", "name", "variant_id", "variant", "props", "preset", "low", "high")
