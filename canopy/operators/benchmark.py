"""Scoring of predictions against truth: structure by case, detection by level, headline, gates, decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions import color as C
from canopy.functions import geometry as G
from canopy.functions import text as X
from canopy.operators import quality, spatial
from canopy.operators.quality import f1, ratio


def _lines(texts: DataFrame) -> DataFrame:
    """Each text and each of its lines, with the band of the box it fills."""
    t = texts.select("case_id", "node", "x", "y", "w", "h", F.col("text").alias("part"), F.split("text", "\n", -1).alias("a"))
    lines = t.where(F.size("a") > 1).select("case_id", "node", "x", "w", "y", "h", F.size("a").alias("n"), F.posexplode("a").alias("k", "part"))
    lines = lines.withColumn("top", F.col("y") + F.col("h") * F.col("k") / F.col("n")).select("case_id", "node", "x", F.col("top").alias("y"), "w", (F.col("h") / F.col("n")).alias("h"), "part")
    whole = t.select("case_id", "node", "x", F.col("y").cast("double").alias("y"), "w", F.col("h").cast("double").alias("h"), "part")
    return whole.unionByName(lines).where(X.normalize(F.col("part")) != "")


def recovered_texts(pred: DataFrame, truth: DataFrame, limit: float = 0.2) -> DataFrame:
    """(case_id, node) of true texts that some overlapping predicted text, or line of one, reads within ``limit``."""
    near = X.cer(F.col("l_part"), F.col("r_part")) <= limit
    return spatial.spatial_join(_lines(pred), _lines(truth), condition=near).select("case_id", F.col("r_node").alias("node")).distinct()


def structural_metrics(pred: DataFrame, truth: DataFrame, text_type: int = 2) -> DataFrame:
    """Metrics of each case (A01, A02); undefined ones are null.

    precision, recall, mean_iou, color_de, text_cer, text_recall, radius_mae, type_acc, component_acc (name and variant),
    component_name_acc, token_acc. Matching is by IoU over all types, with the greatest total.
    """
    own = ["case_id", "node", "x", "y", "w", "h", "type", "r", "g", "b", "text", "radius", "component", "variant", "token"]
    pairs = spatial.spatial_join(pred.select(*own), truth.select(*own), condition=G.overlap("l_", "r_") * 2 >= G.union_area("l_", "r_")).withColumn("iou", G.iou("l_", "r_"))
    m = spatial.assign(pairs, ["case_id", "l_node"], ["case_id", "r_node"], "iou")
    lab = lambda p: C.lab(*[F.col(p + c) for c in "rgb"])
    both_text = (F.col("l_type") == text_type) & (F.col("r_type") == text_type)
    yes = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("double"))
    alike = lambda c: F.col(f"l_{c}") == F.col(f"r_{c}")
    one = m.groupBy("case_id").agg(
        F.count("*").alias("k"), F.avg("iou").alias("mean_iou"), F.avg(C.delta76(lab("l_"), lab("r_"))).alias("color_de"),
        F.avg(F.when(both_text, X.cer(F.col("l_text"), F.col("r_text")))).alias("text_cer"),
        F.avg(F.when(F.col("r_type") != text_type, F.abs(F.col("l_radius") - F.col("r_radius")))).alias("radius_mae"),
        F.avg((F.col("l_type") == F.col("r_type")).cast("double")).alias("type_acc"),
        yes(alike("component") & alike("variant")).alias("components"), yes(alike("component")).alias("names"), yes(alike("token")).alias("tokens"),
    )
    read = recovered_texts(pred.where(F.col("type") == text_type), truth.where(F.col("type") == text_type)).groupBy("case_id").agg(F.count("*").alias("read"))
    # true nodes are counted by case, and do not meet their matches again
    g = truth.groupBy("case_id").agg(F.count("*").alias("n_gt"), F.count(F.when(F.col("type") == text_type, 1)).alias("n_text"), F.count("component").alias("n_component"), F.count("token").alias("n_token"))
    p = pred.groupBy("case_id").agg(F.count("*").alias("n_pred"))
    j = g.join(p, "case_id", "left").join(one, "case_id", "left").join(read, "case_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    share = lambda c, n: F.when(F.col(n) > 0, F.coalesce(c, F.lit(0)).cast("double") / F.col(n))
    j = j.withColumns({"text_recall": share("read", "n_text"), "component_acc": share("components", "n_component"), "component_name_acc": share("names", "n_component"), "token_acc": share("tokens", "n_token")})
    names = ("mean_iou", "color_de", "text_cer", "text_recall", "radius_mae", "type_acc", "component_acc", "component_name_acc", "token_acc")
    return j.select("case_id", (F.col("k") / F.col("n_pred")).alias("precision"), (F.col("k") / F.col("n_gt")).alias("recall"), *names)


def match_findings(pred: DataFrame, truth: DataFrame, page_area: float, parent: Column | None = None, loc_iou: float = 0.3, centre_share: float = 0.25, tie: Column | None = None) -> DataFrame:
    """One-to-one pairs (l: predicted, r: true) of findings that are localised.

    Localised: IoU of ``loc_iou``, or the centre in a true box of at most a quarter of the page. Equal types, and equal
    parents (``parent`` of a column ``type``; the part before the point without it), are preferred. As many pairs as
    possible are taken, and of those the best by score.
    """
    up = lambda p: F.split_part(F.col(p + "type").cast("string"), F.lit("."), F.lit(1))
    inside = (G.area("r_") <= page_area * centre_share) & G.contains_centre("r_", "l_")
    j = spatial.spatial_join(pred, truth, condition=(G.iou("l_", "r_") >= loc_iou) | inside)
    bonus = lambda same: F.when(same, 0.5).otherwise(0.0)
    same_parent = up("l_") == up("r_") if parent is None else F.col("l_parent") == F.col("r_parent")
    j = j.withColumn("score", 1 + G.iou("l_", "r_") + bonus(same_parent) + bonus(F.col("l_type") == F.col("r_type")))
    if tie is not None:
        j = j.withColumn("tie", tie)
    return spatial.assign(j, ["case_id", "l_fid"], ["case_id", "r_fid"], "score", most=True, tie=None if tie is None else "tie")


def detection_levels(pairs: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(level, name, tp, n_pred, n_gt, precision, recall, f1): all, by leaf and parent, and macro means over present types.

    Tables hold ``type`` and ``parent``; pairs hold them for both sides (l, r). At level all every pair counts.
    """
    one = lambda df, tp, p, g, *c: df.select(*c, F.lit(tp).alias("tp"), F.lit(p).alias("p"), F.lit(g).alias("g"))

    def level(name: str, key: str | None) -> DataFrame:
        hit = pairs if key is None else pairs.where(F.col(f"l_{key}") == F.col(f"r_{key}"))
        label = (lambda c: F.lit("all").alias("name")) if key is None else (lambda c: F.col(c).cast("string").alias("name"))
        u = one(hit, 1, 0, 0, label(f"r_{key}")).union(one(pred, 0, 1, 0, label(key))).union(one(truth, 0, 0, 1, label(key)))
        return u.groupBy("name").agg(F.sum("tp").alias("tp"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gt")).select(F.lit(name).alias("level"), "*")

    t = level("all", None).union(level("leaf", "type")).union(level("parent", "parent"))
    tp, p, g = F.col("tp"), F.col("n_pred"), F.col("n_gt")
    t = t.withColumns({"precision": ratio(tp, p), "recall": ratio(tp, g), "f1": f1(tp, p, g)})
    present = t.where("level <> 'all' AND n_gt > 0").groupBy(F.concat(F.lit("macro "), "level").alias("level"))
    macro = present.agg(F.lit("mean").alias("name"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gt").alias("n_gt"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return t.unionByName(macro)


def confusion_matrix(pairs: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(truth, pred, n) with (missed) and (spurious) (A04); keys: case_id and fid."""
    hit = pairs.groupBy(F.col("r_type").cast("string").alias("truth"), F.col("l_type").cast("string").alias("pred")).agg(F.count("*").alias("n"))
    missed = truth.join(pairs.select("case_id", F.col("r_fid").alias("fid")), ["case_id", "fid"], "left_anti").groupBy(F.col("type").cast("string").alias("truth"), F.lit("(missed)").alias("pred")).agg(F.count("*").alias("n"))
    extra = pred.join(pairs.select("case_id", F.col("l_fid").alias("fid")), ["case_id", "fid"], "left_anti").groupBy(F.lit("(spurious)").alias("truth"), F.col("type").cast("string").alias("pred")).agg(F.count("*").alias("n"))
    return hit.unionByName(missed).unionByName(extra)


def recall_by(pairs: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """(by, found, n, recall) of true findings by bin or family."""
    hit = pairs.select("case_id", F.col("r_fid").alias("fid"), F.lit(1).alias("hit"))
    g = truth.join(hit, ["case_id", "fid"], "left").groupBy(by).agg(F.count("hit").alias("found"), F.count("*").alias("n"))
    return g.withColumn("recall", F.col("found") / F.col("n"))


def headline(levels: DataFrame, noise: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """One score from detection F1, macro leaf F1, and silence on noise cases as far as it comes with recall (A10).

    ``noise``: (case_id, false) for noise cases, number of findings each.
    """
    row = levels.agg(F.max(F.when(F.col("level") == "all", F.col("f1"))).alias("det"), F.max(F.when(F.col("level") == "all", F.col("recall"))).alias("recall"), F.max(F.when(F.col("level") == "macro leaf", F.col("f1"))).alias("macro"))
    quiet = noise.agg((1 - F.coalesce(F.avg((F.col("false") > 0).cast("double")), F.lit(0.0))).alias("quiet"))
    a, b, c = weights
    return row.crossJoin(F.broadcast(quiet)).select((F.col("det") * a + F.col("macro") * b + F.col("quiet") * F.col("recall") * c).alias("headline"), "det", "macro", "quiet")


def gate_failures(current: DataFrame, baseline: DataFrame, eps: float = 0.003, metric_eps: float = 0.01, case_eps: float = 0.05) -> DataFrame:
    """(scope, name, was, now, reason) of what is worse than the baseline, or cannot be compared.

    Both: (case_id, metric, goodness, composite), composite being the case's. Scopes: cases (new or lost ones),
    composite, metric, case.
    """
    case = lambda df, n: df.groupBy("case_id").agg(F.first("composite").alias(n))
    cases = case(current, "now").join(case(baseline, "was"), "case_id", "full_outer").withColumn("name", F.col("case_id").cast("string"))
    sets = cases.where("(now IS NULL) <> (was IS NULL)").select(F.lit("cases").alias("scope"), "name", "was", "now", F.when(F.col("now").isNull(), "lost").otherwise("new").alias("reason"))
    worse = lambda tol: F.col("now") < F.col("was") - tol
    each = cases.where(worse(case_eps)).select(F.lit("case").alias("scope"), "name", "was", "now", F.lit("worse").alias("reason"))
    whole = cases.agg(F.avg("was").alias("was"), F.avg("now").alias("now")).where(worse(eps)).select(F.lit("composite").alias("scope"), F.lit("all").alias("name"), "was", "now", F.lit("worse").alias("reason"))
    mean = lambda df, n: df.groupBy("metric").agg(F.avg("goodness").alias(n))
    m = mean(current, "now").join(mean(baseline, "was"), "metric", "full_outer")
    reason = F.when(F.col("now").isNull() & F.col("was").isNotNull(), "missing").when(worse(metric_eps), "worse")
    metric = m.select(F.lit("metric").alias("scope"), F.col("metric").alias("name"), "was", "now", reason.alias("reason")).where("reason IS NOT NULL")
    return sets.unionByName(each).unionByName(whole).unionByName(metric)


def bench_report(cases: DataFrame, dropped: DataFrame) -> DataFrame:
    """(section, name, value): counts, composite, time by stage, errors and dropped cases of a run.

    Cases: (case_id, composite, error, seconds map<string, double>); dropped: (id, reason).
    """
    row = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    c = cases.agg(F.count("*").alias("n"), F.count("error").alias("e"), F.avg("composite").alias("m"))
    head = c.select(F.explode(F.array(row("run", "cases", F.col("n")), row("run", "errors", F.col("e")), row("run", "composite", F.col("m")))).alias("r")).select("r.*")
    time = cases.select(F.explode("seconds").alias("name", "s")).groupBy("name").agg(F.sum("s").alias("value")).select(F.lit("seconds").alias("section"), "name", "value")
    bad = cases.where("error IS NOT NULL").groupBy(F.lit("error").alias("section"), F.col("error").alias("name")).agg(F.count("*").cast("double").alias("value"))
    lost = dropped.groupBy(F.lit("dropped").alias("section"), F.col("reason").alias("name")).agg(F.count("*").cast("double").alias("value"))
    return head.unionByName(time).unionByName(bad).unionByName(lost)


def failure_drafts(worst: DataFrame) -> DataFrame:
    """One draft text for each worst entry."""
    return worst.select("case_id", "metric", F.format_string("%s: %s = %.4f (suspected stage: %s)", F.col("case_id").cast("string"), "metric", F.col("value").cast("double"), "stage").alias("draft"))


def bounded_priors(changes: DataFrame, registry: DataFrame, forbidden: tuple[str, ...], step: float = 0.25, most: int = 5) -> DataFrame:
    """(change, key, reason) of parameter changes that are not allowed.

    Changes: (change, key, old, new); registry: (key, low, high). A step is a share of the range.
    """
    j = changes.join(registry, "key", "left")
    banned = F.lit(False)
    for p in forbidden:
        banned = banned | F.col("key").startswith(p)
    reasons = F.array_compact(F.array(
        F.when(banned, "forbidden"), F.when(F.col("low").isNull(), "unregistered"), F.when((F.col("new") < F.col("low")) | (F.col("new") > F.col("high")), "out of range"),
        F.when(F.abs(F.col("new") - F.col("old")) > (F.col("high") - F.col("low")) * step, "step too large"),
    ))
    each = j.select("change", "key", F.explode(reasons).alias("reason"))
    many = changes.groupBy("change").agg(F.count("*").alias("n")).where(F.col("n") > most).select("change", F.lit("*").alias("key"), F.lit("too many keys").alias("reason"))
    return each.unionByName(many)


def invariance(before: DataFrame, after: DataFrame, page_area: float, loc_iou: float = 0.3) -> DataFrame:
    """(relation, lost, new): findings of equal type without a partner before and after a change that should keep them."""
    pairs = spatial.checkpoint(match_findings(after, before, page_area, loc_iou=loc_iou).where("l_type = r_type"))
    left = lambda df, side, n: df.join(pairs.select("case_id", F.col(f"{side}fid").alias("fid")), ["case_id", "fid"], "left_anti").groupBy("relation").agg(F.count("*").alias(n))
    g = left(before, "r_", "lost").join(left(after, "l_", "new"), "relation", "full_outer")
    return before.select("relation").union(after.select("relation")).distinct().join(g, "relation", "left").fillna(0, ["lost", "new"])


def apply_decisions(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, status, answer): applied, skipped (no answer), unknown (answer to nothing that was asked)."""
    j = decisions.select("id", F.lit(True).alias("asked"), "options").join(answers.select("id", "answer"), "id", "full_outer")
    status = F.when(F.col("asked").isNull(), "unknown").when(F.col("answer").isNull(), "skipped").when(F.array_contains("options", F.col("answer")), "applied").otherwise("unknown")
    return j.select("id", status.alias("status"), F.when(status == "applied", F.col("answer")).alias("answer"))


def plan_errors(plan: DataFrame, layouts: tuple[str, ...] = ("none", "row", "column")) -> DataFrame:
    """(case_id, node, error) of plan nodes (A29): sizes, colours in 0 to 1, opacity, layout names, ids that occur twice."""
    n = F.count("*").over(W.partitionBy("case_id", "node"))
    out = lambda c: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1)
    rules = {"negative size": (F.col("w") < 0) | (F.col("h") < 0), "colour out of range": out("r") | out("g") | out("b"), "opacity out of range": out("opacity"), "unknown layout": ~F.coalesce(F.col("layout").isin(*layouts), F.lit(False)), "id occurs twice": F.col("_n") > 1}
    errors = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return plan.withColumn("_n", n).select("case_id", "node", F.explode(errors).alias("error"))


def surfaces_found(expected: DataFrame, nodes: DataFrame, iou: float = 0.8, fill_de: float = 1.0) -> DataFrame:
    """(case_id, n, found, filled): expected surfaces with a node of that overlap, and of that fill."""
    j = spatial.spatial_join(nodes, expected).withColumn("o", G.iou("l_", "r_")).where(F.col("o") >= iou)
    de = C.delta76(C.lab(*[F.col(f"l_{c}") for c in "rgb"]), C.lab(*[F.col(f"r_{c}") for c in "rgb"]))
    best = j.withColumn("de", de).groupBy("case_id", F.col("r_node").alias("node")).agg(F.min("de").alias("de"))
    g = expected.join(best, ["case_id", "node"], "left").groupBy("case_id")
    return g.agg(F.count("*").alias("n"), F.count("de").alias("found"), F.sum(F.coalesce((F.col("de") <= fill_de).cast("long"), F.lit(0))).alias("filled"))


def promoted(baseline: DataFrame, summary: DataFrame, by: str = "family") -> tuple[DataFrame, DataFrame]:
    """The baseline with each family of the summary put in or replaced, and the ledger's rows for what changed."""
    j = baseline.select(by, F.col("rate").alias("was")).join(summary.select(by, F.col("rate").alias("now")), by, "full_outer")
    new = j.select(by, F.coalesce("now", "was").alias("rate"))
    entry = j.where("now IS NOT NULL AND NOT (now <=> was)").select(X.content_id("baseline", F.col(by), F.col("now")).alias("id"), F.col(by).cast("string").alias("key"), F.col("was").alias("old"), F.col("now").alias("new"))
    return new, entry


def scoped_measures(pred: DataFrame, truth: DataFrame, roi: DataFrame, share: float = 0.5) -> DataFrame:
    """(case_id, scope, n_gt, matched, recall) of the whole frame and of the nodes in the region of interest."""
    box = ["case_id", "node", "x", "y", "w", "h"]
    ink = [c for c in ("ix", "iy", "iw", "ih") if c in truth.columns]
    m = spatial.match_nodes(pred.select(*box, "type"), truth.select(*box, "type", *ink))
    hit = m.select("case_id", F.col("r_node").alias("node"), *[F.col(f"r_{c}").alias(c) for c in "xywh"])
    inside = lambda df: spatial.spatial_join(df, roi, condition=G.overlap("l_", "r_") >= G.area("l_") * share).select("case_id", F.col("l_node").alias("node")).distinct()
    # counted by case where they are; nodes do not meet their matches again
    count = lambda df, scope, n: df.groupBy("case_id").agg(F.count("*").alias(n)).withColumn("scope", F.lit(scope))
    parts = [count(truth, "full", "n_gt"), count(inside(truth.select(*box)), "roi", "n_gt"), count(hit, "full", "matched"), count(inside(hit), "roi", "matched")]
    g = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("case_id", "scope").agg(F.sum("n_gt").alias("n_gt"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"))
    return g.withColumn("recall", F.col("matched") / F.col("n_gt"))


def editable_composites(metrics: DataFrame, factors: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Composite of each case times its editability and frame factor (A11). ``factors``: (case_id, raster_frac, frame_iou)."""
    c = quality.composites(metrics).join(factors, "case_id", "left")
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    raster = 1 - unit(F.coalesce("raster_frac", F.lit(0.0)) * penalty)
    return c.select("case_id", (F.col("composite") * raster * unit(F.coalesce("frame_iou", F.lit(1.0)))).alias("composite"))
