"""Queries of change verdicts, sweeps and rebaselining."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import verdict
from canopy.plans.views import view
from canopy.registry import query

_COUNTS = """fd AS (SELECT f.detector, f.case_id, f.confidence, (f.type = g.type)::INT AS hit FROM findings f JOIN boxes_gt g ON g.case_id = f.case_id AND g.node * 3 + f.detector = f.fid), cs AS (SELECT case_id, count(*) AS n_gt FROM boxes_gt GROUP BY 1),
  grid AS (SELECT d AS detector, c * 100 AS cut FROM (SELECT unnest(range(3)) AS d), (SELECT unnest(range(10)) AS c)),
  pc AS (SELECT grid.detector, grid.cut, cs.case_id, n_gt, count(*) FILTER (hit = 1 AND confidence >= cut) AS hits, count(*) FILTER (confidence >= cut) AS n_pred FROM grid CROSS JOIN cs LEFT JOIN fd ON fd.detector = grid.detector AND fd.case_id = cs.case_id GROUP BY 1, 2, 3, 4),
  ct AS (SELECT detector, cut, case_id, CASE WHEN case_id % 10 < 7 THEN 'calibration' ELSE 'fresh' END AS split, case_id % 5 AS family, CASE WHEN case_id % 11 = 0 THEN 0 ELSE hits END AS tp, n_pred, CASE WHEN case_id % 11 = 0 THEN 0 ELSE n_gt END AS n_gt, (case_id % 11 = 0)::INT AS noise_cases, (case_id % 11 = 0 AND n_pred > 0)::INT AS false_cases FROM pc)"""


def _counts(spark, d):
    truth = view(spark, d, "boxes_gt")
    cases = truth.groupBy("case_id").agg(F.count("*").alias("n_gt"))
    found = view(spark, d, "findings").join(truth.select("case_id", F.col("node"), F.col("type").alias("truth")), "case_id").where("node * 3 + detector = fid")
    cuts = F.explode(F.sequence(F.lit(0), F.lit(900), F.lit(100)))
    per = found.withColumn("cut", cuts).groupBy("detector", "case_id", "cut").agg(F.count_if((F.col("type") == F.col("truth")) & (F.col("confidence") >= F.col("cut"))).alias("tp"), F.count_if(F.col("confidence") >= F.col("cut")).alias("n_pred"))
    every = cases.withColumn("detector", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("cut", cuts)
    c, noise = every.join(per, ["detector", "case_id", "cut"], "left").fillna(0, ["tp", "n_pred"]), F.col("case_id") % 11 == 0
    return c.select("detector", "cut", "case_id", F.when(F.col("case_id") % 10 < 7, "calibration").otherwise("fresh").alias("split"), (F.col("case_id") % 5).alias("family"), F.when(noise, 0).otherwise(F.col("tp")).alias("tp"), "n_pred", F.when(noise, 0).otherwise(F.col("n_gt")).alias("n_gt"), noise.cast("int").alias("noise_cases"), (noise & (F.col("n_pred") > 0)).cast("int").alias("false_cases"))


_F1 = "round(CASE WHEN sum(n_pred) + sum(n_gt) > 0 THEN 2.0 * sum(tp) / (sum(n_pred) + sum(n_gt)) ELSE 0 END, 9)"


@query("a26_change_verdicts", f"""WITH {_COUNTS}, s AS (SELECT detector AS change, split, cut, {_F1} AS f1, sum(false_cases) / greatest(sum(noise_cases), 1) AS rate FROM ct GROUP BY 1, 2, 3), ch AS (SELECT change, change + 1 AS params, 500 AS old_cut FROM (SELECT DISTINCT detector AS change FROM ct)),
  nw AS (SELECT change, cut AS new_cut FROM s WHERE split = 'calibration' QUALIFY row_number() OVER (PARTITION BY change ORDER BY f1 DESC, cut) = 1),
  lv AS (SELECT c.detector AS change, f.family, c.cut, {_F1} AS f1 FROM ct c JOIN (SELECT DISTINCT family FROM ct) f ON c.family <> f.family WHERE split = 'calibration' GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY c.detector, f.family ORDER BY f1 DESC, c.cut) = 1),
  fa AS (SELECT detector AS change, family, cut, {_F1} AS f1 FROM ct WHERE split = 'calibration' GROUP BY 1, 2, 3), w AS (SELECT lv.change, lv.family, round(a.f1 - b.f1, 9) AS delta FROM lv JOIN fa a ON a.change = lv.change AND a.family = lv.family AND a.cut = lv.cut JOIN fa b ON b.change = lv.change AND b.family = lv.family AND b.cut = 500),
  ww AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY change ORDER BY delta, family) = 1), vi AS (SELECT detector AS change, count(*) FILTER (type = 0) AS before, count(*) FILTER (type = 1) AS after FROM findings GROUP BY 1),
  j AS (SELECT ch.change, old_cut, new_cut, params, round(n.f1 - o.f1, 9) AS gain, round(params * 0.003, 9) AS required, round(n.rate - o.rate, 9) AS noise_change, least(0.0, delta) AS worst, ww.family AS worst_family, round(fn.f1 - fo.f1, 9) AS fresh_change, after - before AS more, greatest(1, ceil(before * 0.05)) AS allowed
    FROM ch JOIN nw USING (change) JOIN s o ON o.change = ch.change AND o.split = 'calibration' AND o.cut = old_cut JOIN s n ON n.change = ch.change AND n.split = 'calibration' AND n.cut = new_cut JOIN s fo ON fo.change = ch.change AND fo.split = 'fresh' AND fo.cut = old_cut JOIN s fn ON fn.change = ch.change AND fn.split = 'fresh' AND fn.cut = new_cut JOIN ww ON ww.change = ch.change JOIN vi ON vi.change = ch.change)
  SELECT change, old_cut, new_cut, params, gain, required, noise_change, worst, worst_family, fresh_change, concat_ws(',', CASE WHEN gain < required THEN 'gain' END, CASE WHEN noise_change > 1e-12 THEN 'noise' END, CASE WHEN worst < -0.01 THEN 'family' END, CASE WHEN fresh_change < -0.005 THEN 'fresh' END, CASE WHEN more > allowed THEN 'violations' END) AS reasons FROM j""")
def a26(spark, d):
    counts = _counts(spark, d).withColumnRenamed("detector", "change")
    changes = counts.select("change").distinct().select("change", (F.col("change") + 1).alias("params"), F.lit(500).alias("cut"))
    violations = view(spark, d, "findings").groupBy(F.col("detector").alias("change")).agg(F.count_if(F.col("type") == 0).alias("before"), F.count_if(F.col("type") == 1).alias("after"))
    v = verdict.change_verdicts(counts, changes, violations)
    return v.withColumn("reasons", F.array_join("reasons", ",")).drop("accepted", "more_violations", "allowed")


@query("l13_seed_stability", f"""WITH {_COUNTS}, p AS (SELECT detector AS name, case_id % 4 AS seed, {_F1} AS f1 FROM ct WHERE cut = 300 GROUP BY 1, 2) SELECT name, count(*) AS seeds, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS sd, round(min(f1), 6) AS low, round(max(f1), 6) AS high FROM p GROUP BY 1""")
def l13_seeds(spark, d):
    s = verdict.seed_stability(_counts(spark, d).where("cut = 300").withColumns({"name": F.col("detector"), "seed": F.col("case_id") % 4}))
    return s.select("name", "seeds", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "low", "high")])


@query("g05_sweep", """WITH s AS (SELECT k AS candidate, CASE WHEN case_id % 4 = 0 THEN 'holdout' ELSE 'train' END AS split, value * (1 + ((case_id * k + k * k) % 7) / 100.0) AS score FROM metrics, (SELECT unnest(range(12)) AS k) WHERE metric = 'node_recall'),
  m AS (SELECT candidate, round(avg(score) FILTER (split = 'train'), 9) AS train, round(avg(score) FILTER (split = 'holdout'), 9) AS holdout FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY train DESC, CASE WHEN candidate = 0 THEN 0 ELSE 1 END, candidate) AS rank FROM m)
  SELECT candidate, train, holdout, rank::INTEGER AS rank, rank = 1 AND candidate <> 0 AND holdout > (SELECT holdout FROM m WHERE candidate = 0) AS kept FROM r""")
def g05(spark, d):
    m = view(spark, d, "metrics").where("metric = 'node_recall'").withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(11))))
    k = F.col("candidate")
    score = F.col("value") * (1 + ((F.col("case_id") * k + k * k) % 7) / 100.0)
    return verdict.sweep(m.select("candidate", F.when(F.col("case_id") % 4 == 0, "holdout").otherwise("train").alias("split"), score.alias("score")), 0)


@query("a34_accept_by_family", """WITH n AS (SELECT family, avg(value) AS composite FROM metrics WHERE metric = 'ssim' GROUP BY 1), w AS (SELECT family + 1 AS family, avg(value) AS composite FROM metrics WHERE metric = 'ssim' GROUP BY 1)
  SELECT coalesce(n.family, w.family) AS family, round(w.composite, 9) AS was, round(n.composite, 9) AS now, n.composite IS NOT NULL AND (w.composite IS NULL OR n.composite >= w.composite - 0.003) AS passed, round(CASE WHEN n.composite IS NOT NULL AND (w.composite IS NULL OR n.composite >= w.composite - 0.003) THEN n.composite ELSE w.composite END, 9) AS kept FROM n FULL JOIN w ON n.family = w.family""")
def a34(spark, d):
    m = view(spark, d, "metrics").where("metric = 'ssim'").groupBy("family").agg(F.avg("value").alias("composite"))
    a = verdict.accept_by_family(m, m.withColumn("family", F.col("family") + 1))
    return a.select("family", "passed", *[F.round(c, 9).alias(c) for c in ("was", "now", "kept")])
