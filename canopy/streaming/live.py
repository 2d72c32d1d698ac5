"""Streams of ledger entries, job samples, move records and corrections.

Each operator maps a streaming DataFrame to a streaming DataFrame in append mode; ``drain`` runs one to the end
of what is there and reads what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from canopy.operators.core import shared_folder


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` as a stream, with the schema they have now; ``ts`` becomes a timestamp, as watermarks need.

    As a pattern the path may also be a single file, which the streaming reader refuses as a plain path.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def ledger_lines(spark: SparkSession, path: str, kinds: list[str], files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries ``(id, kind, ts, accepted, body)`` and rejected lines ``(value, reason)`` of an append-only folder of JSON lines.

    A line is rejected that is no JSON object, or has no id, no time or a kind that is not in ``kinds``; blank lines are skipped. ``body``
    is the line itself. ``files``: most files of a batch.
    """
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    lines = reader.text(path).where(F.trim("value") != "").withColumn("doc", F.expr("try_parse_json(value)"))
    get = lambda name, kind: F.expr(f"try_variant_get(doc, '$.{name}', '{kind}')")
    v = lines.select("value", F.expr("schema_of_variant(doc)").alias("shape"), get("id", "string").alias("id"), get("kind", "string").alias("kind"), get("ts", "string").try_cast("timestamp").alias("ts"), F.coalesce(get("accepted", "boolean"), F.lit(False)).alias("accepted"))
    reason = F.when(F.col("shape").isNull() | ~F.col("shape").startswith("OBJECT"), "not an object").when(F.col("id").isNull(), "no id").when(F.col("ts").isNull(), "no time").when(F.col("kind").isNull() | ~F.col("kind").isin(*kinds), "unknown kind")
    v = v.withColumn("reason", reason)
    return v.where("reason IS NULL").select("id", "kind", "ts", "accepted", F.col("value").alias("body")), v.where("reason IS NOT NULL").select("value", "reason")


def drain(df: DataFrame) -> DataFrame:
    """What ``df`` yields for all input present, from a Parquet sink in the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def first_entries(entries: DataFrame, key: list[str], delay: str) -> DataFrame:
    """One entry of each key among those that come within ``delay`` of each other."""
    return entries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def latency_windows(samples: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    """Count, mean, 95 % point and maximum of ``value`` by kind and window, once the watermark closes it."""
    g = samples.withWatermark("ts", delay).groupBy("kind", F.window("ts", width, slide).alias("w"))
    a = g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile_approx("value", 0.95, 1000).alias("p95"), F.max("value").alias("max"))
    return a.select("kind", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "p95", "max")


def run_sessions(moves: DataFrame, gap: str, delay: str) -> DataFrame:
    """Moves of a run that follow each other within ``gap``: count, accepted share, first and last time."""
    g = moves.withWatermark("ts", delay).groupBy("run", F.session_window("ts", gap).alias("w"))
    a = g.agg(F.count("*").alias("n"), F.avg(F.col("accepted").cast("double")).alias("accept_rate"), F.max("ts").alias("last"))
    return a.select("run", F.col("w.start").alias("first"), "last", "n", "accept_rate")


def support_changes(observations: DataFrame, keep: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Changes of the support of (signature, answer) as each screen's latest answer changes.

    The state is one answer for each (signature, screen), so no key's state grows. The sum of ``change`` is
    the support: see ``live_rules``.

    With ``keep`` (as "30 days") the state of a pair goes once the watermark, ``delay`` behind the latest time, has passed its latest
    answer by so long: its vote then stands for good, and a later answer of that screen is a vote of its own.
    """
    lasting = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)

    def latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        # rows of a pair come before its timeout in the batch that would fire it
        if lasting is not None and old is not None and old[0] // 1000 + lasting <= state.getCurrentWatermarkMs():
            old = None
        best = old
        for f in frames:
            top = f.sort_values(["at", "item"]).iloc[-1]
            row = (int(top["at"]), int(top["item"]), top["answer"])
            best = row if best is None or row[:2] > tuple(best[:2]) else best
        if lasting is not None and best is not None:
            state.update(tuple(best))
            state.setTimeoutTimestamp(max(best[0] // 1000 + lasting, state.getCurrentWatermarkMs() + 1))
        if best is not old:
            state.update(tuple(best))
            if old is None or old[2] != best[2]:
                gone = [] if old is None else [(key[0], old[2], -1)]
                yield pd.DataFrame([*gone, (key[0], best[2], 1)], columns=["signature", "answer", "change"])

    o = observations if keep is None else observations.withWatermark("ts", delay)
    o = o.where("answer IS NOT NULL").select("signature", "screen", "item", "answer", F.unix_micros("ts").alias("at"), *(["ts"] if keep else []))
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    return o.groupBy("signature", "screen").applyInPandasWithState(latest, "signature long, answer string, change long", "at long, item long, answer string", "append", timeout)


def live_rules(changes: DataFrame, min_support: int = 2, min_confidence: float = 0.6) -> DataFrame:
    """The best supported answer of each signature, and whether it is active, from logged changes."""
    votes = changes.groupBy("signature", "answer").agg(F.sum("change").alias("support")).where("support > 0")
    g = votes.groupBy("signature").agg(F.max(F.struct("support", "answer")).alias("top"), F.sum("support").alias("all"))
    conf = F.col("top.support") / F.col("all")
    return g.select("signature", "top.answer", "top.support", conf.alias("confidence"), ((F.col("top.support") >= min_support) & (conf >= min_confidence)).alias("active"))
