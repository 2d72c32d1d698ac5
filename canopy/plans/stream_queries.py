"""Registered queries of the streams, over ``events`` read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.plans.source_queries import folder
from canopy.registry import query, read
from canopy.streaming import live


def _events(spark, d):
    return live.stream(spark, f"{d}/events.parquet")


def _plain(*names):
    """Times without a zone again, as the table has them."""
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


@query("r01_first_entries", "SELECT DISTINCT user_id, event_type FROM events WHERE value IS NOT NULL")
def r01(spark, d):
    e = _events(spark, d).where("value IS NOT NULL").select("user_id", "event_type", "ts")
    return live.drain(live.first_entries(e, ["user_id", "event_type"], "60 days").select("user_id", "event_type"))


def _ledger_lines(spark, d):
    """Every event as a line, each third of them twice, some of them broken."""
    at, k = folder(spark, "ledger"), F.col("event_id")
    good = F.to_json(F.struct(F.concat(F.lit("e"), k.cast("string")).alias("id"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), (k % 5 != 0).alias("accepted")))
    line = F.when(k % 17 == 0, F.lit("{oops")).when(k % 19 == 0, F.concat(F.lit('{"kind":"'), F.col("event_type"), F.lit('"}'))).when(k % 23 == 0, F.regexp_replace(good, '"kind":"[^"]*"', '"kind":"other"')).when(k % 29 == 0, F.lit("[1]")).otherwise(good)
    times = F.explode(F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    read(spark, d, "events").select(line.alias("value"), times.alias("n")).select("value").write.text(at)
    kinds = [r[0] for r in read(spark, d, "events").select("event_type").distinct().collect()]  # a vocabulary
    return live.ledger_lines(spark, at, kinds)


_BROKEN = "CASE WHEN event_id % 17 = 0 THEN 'not an object' WHEN event_id % 19 = 0 THEN 'no id' WHEN event_id % 23 = 0 THEN 'unknown kind' WHEN event_id % 29 = 0 THEN 'not an object' END"


@query("r01_ledger_lines", f"SELECT 'e' || event_id AS id, event_type AS kind, event_id % 5 <> 0 AS accepted FROM events WHERE {_BROKEN} IS NULL")
def r01_lines(spark, d):
    entries, _ = _ledger_lines(spark, d)
    return live.drain(live.first_entries(entries, ["id"], "60 days").select("id", "kind", "accepted"))


@query("r01_rejected_lines", f"SELECT {_BROKEN} AS reason, sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS n FROM events WHERE {_BROKEN} IS NOT NULL GROUP BY 1")
def r01_rejected(spark, d):
    _, rejected = _ledger_lines(spark, d)
    return live.drain(rejected).groupBy("reason").agg(F.count("*").alias("n"))


@query("r02_latency_windows", """WITH w AS (SELECT event_type AS kind, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events)
  SELECT kind, start, start + INTERVAL 1 HOUR AS "end", count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM w
  WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY kind, start""")
def r02(spark, d):
    s = _events(spark, d).select(F.col("event_type").alias("kind"), "ts", "value")
    return live.drain(live.latency_windows(s, "1 hour", "30 minutes", "2 hours")).select("kind", *_plain("start", "end"), "n", F.round("mean", 6).alias("mean"), "max")


@query("r03_run_sessions", """WITH b AS (SELECT user_id AS run, ts, event_id, event_id % 3 = 0 AS accepted, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY ts, event_id) AS k FROM b)
  SELECT run, min(ts) AS first, max(ts) AS last, count(*) AS n, round(avg(accepted::INT), 9) AS accept_rate FROM s GROUP BY run, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def r03(spark, d):
    m = _events(spark, d).select(F.col("user_id").alias("run"), "ts", (F.col("event_id") % 3 == 0).alias("accepted"))
    return live.drain(live.run_sessions(m, "6 hours", "1 hour")).select("run", *_plain("first", "last"), "n", F.round("accept_rate", 9).alias("accept_rate"))


@query("r04_live_rules", """WITH l AS (SELECT user_id % 40 AS signature, user_id AS screen, event_type AS answer, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
  v AS (SELECT signature, answer, count(*) AS support, sum(count(*)) OVER (PARTITION BY signature) AS total, row_number() OVER (PARTITION BY signature ORDER BY count(*) DESC, answer DESC) AS r FROM l WHERE n = 1 GROUP BY signature, answer)
  SELECT signature, answer, support, round(support::DOUBLE / total, 9) AS confidence, support >= 2 AND support::DOUBLE / total >= 0.6 AS active FROM v WHERE r = 1""")
def r04(spark, d):
    o = _events(spark, d).select((F.col("user_id") % 40).alias("signature"), F.col("user_id").alias("screen"), F.col("event_id").alias("item"), F.col("event_type").alias("answer"), "ts")
    return live.live_rules(live.drain(live.support_changes(o))).withColumn("confidence", F.round("confidence", 9))
