"""Readers of screen trees, catalogs, token files, ledgers, bundles, manifests and histories.

Files are read by Spark's readers, so paths may be any it can open. Nested JSON of unknown shape is a VARIANT that is
walked one level at a time; each level is cut from its lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import text as X
from canopy.operators.core import checkpoint


def _get(v: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def read_trees(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each JSON document with a screen tree: (doc_id, width, height, dpr, design_system, meta, doc).

    A document is a file, doc_id its name up to the first point; with ``lines`` it is a line, doc_id its field ``id``.
    What is no JSON is left out.
    """
    doc = F.expr("try_parse_json(value)").alias("doc")
    if lines:
        return with_head(spark.read.text(path).select(doc).where("doc IS NOT NULL").select(_get("doc", "id", "string").alias("doc_id"), "doc"))
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1).alias("doc_id"), doc)
    return with_head(t.where("doc IS NOT NULL"))


def with_head(docs: DataFrame) -> DataFrame:
    """The flat columns of documents (doc_id, doc)."""
    return docs.select("doc_id", _get("doc", "width", "int").alias("width"), _get("doc", "height", "int").alias("height"), F.coalesce(_get("doc", "dpr", "double"), F.lit(1.0)).alias("dpr"), _get("doc", "design_system", "string").alias("design_system"), _get("doc", "meta", "variant").alias("meta"), "doc")


def flatten_trees(docs: DataFrame, max_depth: int = 256) -> DataFrame:
    """One row for each node in pre-order (T01), numbered from 0 in each document.

    Columns: doc_id, node_id, parent_id, depth, preorder, path (positions among siblings from the root), type, x, y, w,
    h (absolute), text, visible, opacity, component.
    """
    spark = docs.sparkSession
    level = docs.select("doc_id", F.lit(None).cast("string").alias("parent_id"), F.array(F.lit(0)).alias("path"), _get("doc", "root", "variant").alias("node")).where("node IS NOT NULL")
    out = None
    for _ in range(max_depth):
        level = checkpoint(level)
        if level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
        level = spark.sql("SELECT doc_id, try_variant_get(node, '$.id', 'string') AS parent_id, concat(path, array(c.pos)) AS path, c.value AS node FROM {level}, LATERAL variant_explode(try_variant_get(node, '$.children', 'variant')) AS c", level=level)
    else:
        raise ValueError(f"tree deeper than {max_depth}")
    if out is None:
        out = level
    box = [_get("node", f"box.{c}", "double").alias(c) for c in "xywh"]
    n = out.select("doc_id", _get("node", "id", "string").alias("node_id"), "parent_id", (F.size("path") - 1).alias("depth"), "path", _get("node", "type", "string").alias("type"), *box, _get("node", "text", "string").alias("text"), F.coalesce(_get("node", "visible", "boolean"), F.lit(True)).alias("visible"), F.coalesce(_get("node", "opacity", "double"), F.lit(1.0)).alias("opacity"), _get("node", "component.name", "string").alias("component"))
    return n.withColumn("preorder", F.row_number().over(W.partitionBy("doc_id").orderBy("path")) - 1)


def flatten_json(records: DataFrame, key: list[str], column: str, max_depth: int = 32) -> DataFrame:
    """(key, name, value): the leaves of a VARIANT of nested objects under dotted names (S22); lists are leaves."""
    spark = records.sparkSession
    names = ", ".join(f"`{k}`" for k in key)
    level = records.select(*key, F.lit("").alias("name"), F.col(column).alias("v"))
    out = None
    for _ in range(max_depth):
        level = checkpoint(spark.sql(f"SELECT {names}, concat(CASE WHEN name = '' THEN '' ELSE concat(name, '.') END, c.key) AS name, c.value AS v, startswith(schema_of_variant(c.value), 'OBJECT') AS inner FROM {{level}}, LATERAL variant_explode(v) AS c WHERE startswith(schema_of_variant(v), 'OBJECT')", level=level))
        leaves = level.where("NOT inner OR inner IS NULL").drop("inner")
        out = leaves if out is None else out.unionByName(leaves)
        level = level.where("inner").drop("inner")
        if level.isEmpty():
            return out.select(*key, "name", F.expr("CAST(v AS STRING)").alias("value"))
    raise ValueError(f"objects nested deeper than {max_depth}")


def read_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens, variants and slots of design-system files, one a file or, without ``multi_line``, one a line.

    A variant's signature is its component's with every field set that the variant sets itself.
    """
    rule = "struct<height: array<double>, radius: double, fill: array<string>, text: boolean>"
    schema = f"name string, tokens array<struct<name: string, category: string, value: string>>, components array<struct<name: string, signature: {rule}, variants: array<struct<name: string, signature: {rule}>>, slots: array<struct<name: string, kind: string, multiple: boolean>>>>"
    c = spark.read.schema(schema).json(path, multiLine=multi_line)
    tokens = c.select(F.col("name").alias("catalog"), F.inline("tokens"))
    parts = c.select(F.col("name").alias("catalog"), F.explode("components").alias("c"))
    merged = [F.coalesce(f"v.signature.{f}", f"c.signature.{f}").alias(f) for f in ("height", "radius", "fill", "text")]
    variants = parts.select("catalog", "c", F.explode_outer("c.variants").alias("v")).select("catalog", F.col("c.name").alias("component"), F.col("v.name").alias("variant"), *merged)
    slots = parts.select("catalog", F.col("c.name").alias("component"), F.posexplode("c.slots").alias("position", "s")).select("catalog", "component", "position", "s.*")
    return tokens, variants, slots


#: Category of each type of a token document (fixed values).
CATEGORIES = {"color": "color", "dimension": "dimension", "number": "dimension", "fontSize": "dimension", "lineHeight": "dimension", "letterSpacing": "dimension", "typography": "typography", "shadow": "shadow"}


def design_tokens(documents: DataFrame, max_depth: int = 16) -> DataFrame:
    """(doc_id, name, type, category, value) of token documents (doc_id, doc) with groups, inherited types and aliases.

    ``{a.b}`` stands for the value of token a.b, through up to ``max_depth`` steps; a type that is given nowhere is
    inferred from the value. Colours and lengths that cannot be read are left out.
    """
    spark = documents.sparkSession
    level = documents.select("doc_id", F.lit("").alias("name"), F.lit(None).cast("string").alias("type"), F.col("doc").alias("v"))
    found = None
    while True:
        level = level.withColumn("type", F.coalesce(F.expr("try_variant_get(v, '$[\"$type\"]', 'string')"), "type"))
        level = checkpoint(level.withColumn("value", F.expr("try_variant_get(v, '$[\"$value\"]', 'variant')")))
        tokens = level.where("value IS NOT NULL").select("doc_id", "name", "type", F.expr("CAST(value AS STRING)").alias("value"))
        found = tokens if found is None else found.unionByName(tokens)
        groups = level.where("value IS NULL")
        level = spark.sql("SELECT doc_id, concat(CASE WHEN name = '' THEN '' ELSE concat(name, '.') END, c.key) AS name, type, c.value AS v FROM {groups}, LATERAL variant_explode(v) AS c WHERE NOT startswith(c.key, '$') AND startswith(schema_of_variant(c.value), 'OBJECT')", groups=groups)
        if level.isEmpty():
            break
    known = checkpoint(found)
    now = known
    alias = F.regexp_replace(F.regexp_extract(F.trim("value"), r"^\{([^}]+)\}$", 1), "/", ".")
    for _ in range(max_depth):
        asked = now.withColumn("to", alias)
        if asked.where("to <> ''").isEmpty():
            break
        target = known.select("doc_id", F.col("name").alias("to"), F.col("value").alias("other"))
        now = checkpoint(asked.join(target, ["doc_id", "to"], "left").withColumn("value", F.coalesce("other", "value")).drop("to", "other"))
    kind = F.coalesce("type", F.when(F.col("value").rlike("^(#|rgb)"), "color").when(X.parse_px(F.col("value")).isNotNull(), "dimension"))
    t = now.withColumn("type", kind).withColumn("category", F.coalesce(F.create_map(*[F.lit(x) for p in CATEGORIES.items() for x in p])[F.col("type")], F.lit("other")))
    size = F.when(F.col("category") == "dimension", X.parse_px(F.col("value")).cast("string")).otherwise(F.col("value"))
    return t.withColumn("value", size).where("value IS NOT NULL AND (category <> 'color' OR value RLIKE '^(#[0-9a-fA-F]{3,8}|rgba?.*)$')").select("doc_id", "name", "type", "category", "value")


def theme_tokens(documents: DataFrame, scheme: str = "light") -> DataFrame:
    """(doc_id, name, value) of theme exports (doc_id, text): roles of one scheme and all palette tones."""
    maps = "map<string, map<string, string>>"
    t = documents.select("doc_id", F.from_json("text", f"schemes {maps}, palettes {maps}").alias("t"))
    roles = t.select("doc_id", F.explode(F.coalesce(F.col("t.schemes")[scheme], F.element_at(F.map_values("t.schemes"), 1))).alias("k", "value")).select("doc_id", F.concat(F.lit("sys.color."), X.kebab(F.col("k"))).alias("name"), "value")
    tones = t.select("doc_id", F.explode("t.palettes").alias("p", "m")).select("doc_id", "p", F.explode("m").alias("k", "value")).select("doc_id", F.concat(F.lit("ref.palette."), X.kebab(F.col("p")), F.col("k")).alias("name"), "value")
    return roles.unionByName(tones).where("value RLIKE '^#[0-9a-fA-F]{3,8}$'")


def read_codepoints(spark: SparkSession, path: str) -> DataFrame:
    """(name, code) of lines "name hex" (S11); other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) RLIKE '^\\\\S+\\\\s+[0-9a-fA-F]+$'").select(parts[0].alias("name"), F.conv(parts[1], 16, 10).cast("long").alias("code"))


def read_ledger(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of JSON-lines ledgers, oldest first (S13): (id, ts, kind, accepted, reverts, entry).

    Lines that are no JSON object with an id are skipped; of several entries with one id the first in the order of
    the paths, and of the lines in a file, counts.
    """
    all_ = None
    for i, p in enumerate(paths):
        t = spark.read.text(p).select("value", F.lit(i).alias("source"), "_metadata.file_name", "_metadata.file_block_start")
        all_ = t if all_ is None else all_.unionByName(t)
    e = all_.withColumn("line", F.monotonically_increasing_id()).withColumn("entry", F.expr("try_parse_json(value)"))
    e = e.withColumn("id", _get("entry", "id", "string")).where("id IS NOT NULL AND id <> ''")
    first = F.struct("source", "file_name", "file_block_start", "line")
    e = e.groupBy("id").agg(F.min_by("entry", first).alias("entry"))
    return e.select("id", _get("entry", "ts", "string").alias("ts"), _get("entry", "kind", "string").alias("kind"), _get("entry", "accepted", "boolean").alias("accepted"), _get("entry", "reverts", "string").alias("reverts"), "entry").orderBy("ts", "id")


BUNDLE = "id string, created string, consent struct<screenshot: boolean, text: boolean>, items array<struct<id: string, kind: string, node: string, value: string>>, _corrupt_record string"


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, created, share_screenshot, share_text, item, kind, node, value) of feedback bundles (S14); unreadable ones are skipped."""
    b = spark.read.schema(BUNDLE).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    b = checkpoint(b).where("_corrupt_record IS NULL AND id IS NOT NULL")
    i = b.select(F.col("id").alias("bundle"), "created", F.coalesce("consent.screenshot", F.lit(False)).alias("share_screenshot"), F.coalesce("consent.text", F.lit(False)).alias("share_text"), F.explode_outer("items").alias("i"))
    return i.select("bundle", "created", "share_screenshot", "share_text", F.col("i.id").alias("item"), "i.kind", "i.node", "i.value")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, name) of all files below a folder of corpora, without reading them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.split("path", "/").alias("p"))
    return f.select(F.element_at("p", -2).alias("corpus"), F.element_at("p", -1).alias("name"))


def scan_corpus(manifest: DataFrame, files: DataFrame, limit: int | None = None, needs: tuple[str, ...] = (".png", ".gt.json")) -> DataFrame:
    """(corpus, id, reason): reason is null for what can run, and says why for everything else.

    ``manifest``: (corpus, id, position); ``files``: (corpus, name). A corpus without a manifest is its truth files.
    """
    truth = files.where(F.col("name").endswith(needs[-1])).select("corpus", F.expr(f"substr(name, 1, length(name) - {len(needs[-1])})").alias("id"))
    bare = truth.join(manifest.select("corpus").distinct(), "corpus", "left_anti").select("corpus", "id", F.lit(0).cast("long").alias("position"))
    listed = manifest.select("corpus", "id", F.col("position").cast("long").alias("position")).unionByName(bare)
    have = files.select("corpus", "name", F.lit(True).alias("have"))
    want = listed.select("*", F.explode(F.array(*[F.lit(n) for n in needs])).alias("ext")).withColumn("name", F.concat("id", "ext")).join(have, ["corpus", "name"], "left")
    lost = want.groupBy("corpus", "id", "position").agg(F.array_sort(F.collect_list(F.when(F.col("have").isNull(), F.col("name")))).alias("lost"))
    lost = lost.withColumn("reason", F.when(F.size("lost") > 0, F.concat(F.lit("missing "), F.array_join("lost", ", "))))
    if limit is not None:
        order = W.partitionBy("corpus", F.col("reason").isNull()).orderBy("position", "id")
        over = F.col("reason").isNull() & (F.row_number().over(order) > limit)
        lost = lost.withColumn("reason", F.when(over, F.lit(f"over limit={limit}")).otherwise(F.col("reason")))
    unlisted = truth.join(listed, ["corpus", "id"], "left_anti").select("corpus", "id", F.lit("not listed in the manifest").alias("reason"))
    return lost.select("corpus", "id", "reason").unionByName(unlisted)


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(corpus, position, id, w, h, nodes, components, types) of corpus manifests."""
    schema = "corpus string, cases array<struct<id: string, w: int, h: int, nodes: int, components: map<string, int>, types: map<string, int>>>"
    return spark.read.schema(schema).json(path, multiLine=multi_line).select("corpus", F.posexplode("cases").alias("position", "c")).select("corpus", "position", "c.*")


def kept_screens(screens: DataFrame, files: DataFrame) -> DataFrame:
    """Successful captures (ok) whose file is there."""
    return screens.where("ok").join(files.select(F.col("name").alias("file")), "file", "left_semi")


def backfilled_moves(moves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Move records with node type and area of their run's last file that has the node, else the box's area.

    ``moves``: (run, kind, node, node_type, area, w, h, ...); ``nodes``: (run, file, node, type, area). Stops are dropped.
    """
    last = nodes.groupBy("run", "node").agg(F.max_by(F.struct("type", "area"), "file").alias("t"))
    j = moves.where("kind <> 'stop'").join(last, ["run", "node"], "left")
    return j.withColumn("node_type", F.coalesce("node_type", "t.type")).withColumn("area", F.coalesce("area", "t.area", F.col("w") * F.col("h"))).drop("t")


def run_summary(metrics: DataFrame, validation: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each run of any table: its metrics, validation errors and node counts."""
    v = validation.groupBy("run").agg(F.count("*").alias("checks"), F.sum(F.col("error").isNotNull().cast("long")).alias("errors"))
    n = nodes.groupBy("run").agg(F.count("*").alias("nodes"), F.sum(F.col("component").isNotNull().cast("long")).alias("components"))
    return metrics.join(v, "run", "full_outer").join(n, "run", "full_outer")
