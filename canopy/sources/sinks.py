"""Sinks, exports and imports: benchmarks, reports, baselines, build plans, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import text as X


def save_benchmark(cases: DataFrame, findings: DataFrame, folder: str) -> None:
    """Cases and findings as Parquet, cases by split and family."""
    cases.write.mode("overwrite").partitionBy("split", "family").parquet(f"{folder}/cases")
    findings.write.mode("overwrite").parquet(f"{folder}/findings")


def load_benchmark(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/cases"), spark.read.parquet(f"{folder}/findings")


def write_report(rows: DataFrame, run_id: str, folder: str) -> None:
    """Rows of one run, under its id; a run that is written again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{folder}/run_id={run_id}")


def write_baseline(goodness: DataFrame, cases: DataFrame, folder: str) -> None:
    """The accepted run's goodness by metric and composite by case."""
    goodness.coalesce(1).write.mode("overwrite").parquet(f"{folder}/goodness")
    cases.write.mode("overwrite").parquet(f"{folder}/cases")


def read_baseline(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/goodness"), spark.read.parquet(f"{folder}/cases")


#: Style name of each font weight (fixed values).
STYLES = {100: "Thin", 200: "ExtraLight", 300: "Light", 400: "Regular", 500: "Medium", 600: "SemiBold", 700: "Bold", 800: "ExtraBold", 900: "Black"}


def build_plan(nodes: DataFrame) -> DataFrame:
    """One row for each plan node: place relative to its parent, paint in parts of one, style name, token bindings."""
    up = nodes.select("case_id", F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    style = F.create_map(*[F.lit(v) for pair in STYLES.items() for v in pair])
    j = nodes.join(up, ["case_id", "parent"], "left")
    paint = [(F.col(c) / F.lit(255.0)).alias(c) for c in "rgb"]
    bound = F.when(F.col("token").isNotNull(), F.create_map(F.lit("fill"), F.col("token")))
    return j.select("case_id", "node", "parent", (F.col("x") - F.coalesce("px", F.lit(0))).alias("x"), (F.col("y") - F.coalesce("py", F.lit(0))).alias("y"), "w", "h", *paint, F.coalesce(style[F.col("weight").cast("int")], F.lit("Regular")).alias("style"), (F.col("opacity") / F.lit(100.0)).alias("opacity"), bound.alias("bindings"))


def plan_nodes(plan: DataFrame, up: DataFrame) -> DataFrame:
    """Plan nodes with absolute places again and paint in 0 to 255 (S23). ``up``: (case_id, node, ancestor) of the plan."""
    at = plan.select("case_id", F.col("node").alias("ancestor"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    off = up.join(at, ["case_id", "ancestor"]).groupBy("case_id", "node").agg(F.sum("ax").alias("ox"), F.sum("ay").alias("oy"))
    j = plan.join(off, ["case_id", "node"], "left")
    return j.select("case_id", "node", "parent", (F.col("x") + F.coalesce("ox", F.lit(0))).alias("x"), (F.col("y") + F.coalesce("oy", F.lit(0))).alias("y"), "w", "h", *[F.round(F.col(c) * 255).cast("long").alias(c) for c in "rgb"])


def consented_export(items: DataFrame) -> DataFrame:
    """Feedback for sharing: text redacted without consent, screenshots only with both consents, else with the reason.

    ``items``: (bundle, item, value, share_text, share_screenshot, store_screenshot).
    """
    shot = F.col("share_screenshot") & F.col("store_screenshot")
    reason = F.when(~F.col("store_screenshot"), "not stored").when(~F.col("share_screenshot"), "not shared")
    return items.select("bundle", "item", F.when(F.col("share_text"), F.col("value")).otherwise(X.redact(F.col("value"))).alias("value"), shot.alias("screenshot"), F.when(~shot, reason).alias("excluded"))


def import_bundles(incoming: DataFrame, known: DataFrame, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Accepted new observations and rejected rows with a reason.

    An observation counts once by (bundle, item), in what is there already and in what comes in.
    """
    reason = F.when(F.col("bundle").isNull() | F.col("item").isNull(), "no id").when(~F.col("kind").isin(*kinds) | F.col("kind").isNull(), "unknown kind").when(F.col("value").isNull(), "no value")
    checked = incoming.withColumn("reason", reason)
    good = checked.where("reason IS NULL").drop("reason")
    once = good.withColumn("_k", F.row_number().over(W.partitionBy("bundle", "item").orderBy("kind", "value"))).where("_k = 1").drop("_k")
    return once.join(known.select("bundle", "item"), ["bundle", "item"], "left_anti"), checked.where("reason IS NOT NULL")


def ingest_corrections(corrections: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Corrections with their node's type and box, put into the known items: a newer one replaces its (bundle, item)."""
    context = nodes.select("case_id", F.col("node"), F.col("type").alias("node_type"), "x", "y", "w", "h")
    c = corrections.join(context, ["case_id", "node"], "left")
    return known.join(c.select("bundle", "item"), ["bundle", "item"], "left_anti").unionByName(c, allowMissingColumns=True)


def user_corpus(bundles: DataFrame, targets: DataFrame, trees: DataFrame, known: DataFrame) -> DataFrame:
    """Cases of bundles with a target and a corrected tree (S25); ``status``: new, kept, or removed for vanished ones."""
    usable = bundles.join(targets.select("bundle"), "bundle", "left_semi").join(trees.select("bundle"), "bundle", "left_semi").select("bundle", F.lit(True).alias("now"))
    j = usable.join(known.select("bundle", F.lit(True).alias("was")), "bundle", "full_outer")
    return j.select("bundle", F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "new").otherwise("kept").alias("status"))
