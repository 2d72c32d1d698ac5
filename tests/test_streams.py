"""Streams over several batches, repeats and late rows."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from canopy.operators import catalog, review
from canopy.streaming import live

DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


@pytest.fixture
def batches(spark):
    """A stream that brings each list of rows as a batch of its own."""

    def make(schema, *lists):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for rows in lists:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def test_support_follows_the_latest_answer(batches):
    s = batches("signature long, screen long, item long, answer string, ts timestamp", [(1, 10, 1, "a", at(0)), (1, 11, 2, "a", at(1)), (1, 12, 3, None, at(1))], [(1, 10, 4, "b", at(2)), (1, 11, 5, "b", at(0.5))])
    changes = live.drain(live.support_changes(s))
    votes = {(r.answer, r.s) for r in changes.groupBy("answer").agg(F.sum("change").alias("s")).collect()}
    assert votes == {("a", 1), ("b", 1)}  # the late answer of screen 11 changes nothing
    rule = live.live_rules(changes).collect()[0]
    assert (rule.answer, rule.support, rule.confidence, rule.active) == ("b", 1, 0.5, False)


def test_first_entries_drop_repeats_of_other_batches(batches):
    s = batches("id long, ts timestamp", [(1, at(0)), (2, at(0)), (1, at(0))], [(1, at(1)), (3, at(1))])
    assert sorted(r.id for r in live.drain(live.first_entries(s, ["id"], "5 hours").select("id")).collect()) == [1, 2, 3]


def test_votes_stand_once_their_state_is_gone(batches):
    rows = "signature long, screen long, item long, answer string, ts timestamp", [(1, 10, 1, "a", at(0)), (1, 11, 2, "a", at(1))], [(2, 99, 3, "z", at(100))], [(1, 10, 4, "b", at(101))]
    votes = lambda keep: {(r.signature, r.answer, r.s) for r in live.drain(live.support_changes(batches(*rows), keep)).groupBy("signature", "answer").agg(F.sum("change").alias("s")).where("s > 0").collect()}
    assert votes(None) == {(1, "a", 1), (1, "b", 1), (2, "z", 1)}
    assert votes("30 days") == votes(None)
    # after the second batch the first answers are three days old: their state goes, so the answer of the third is one more vote
    assert votes("1 day") == {(1, "a", 2), (1, "b", 1), (2, "z", 1)}


def test_ledger_lines_are_checked_and_repeats_dropped(spark, tmp_path):
    good = lambda k, h: f'{{"id":"e{k}","kind":"move","ts":"{at(h)}","accepted":true,"more":{{"x":1}}}}'
    files = [[good(1, 0), good(2, 1), "{broken", ""], [good(1, 0), '{"kind":"move"}', "[1, 2]", "  ", '"text"'], [good(3, 2).replace("move", "odd"), good(3, 2), '{"id":"e9","kind":"move","ts":"soon"}', good(2, 1)]]
    for k, lines in enumerate(files):
        (tmp_path / f"{k}.jsonl").write_text("\n".join(lines))
    entries, rejected = live.ledger_lines(spark, str(tmp_path), ["move"], 1)
    got = live.drain(live.first_entries(entries, ["id"], "5 hours")).collect()
    assert sorted((r.id, r.accepted) for r in got) == [("e1", True), ("e2", True), ("e3", True)] and '"more"' in got[0].body
    assert sorted(r.reason for r in live.drain(rejected).collect()) == ["no id", "no time", "not an object", "not an object", "not an object", "unknown kind"]


def test_windows_and_sessions_close_behind_the_watermark(batches):
    rows = [("k", at(0.1), 1.0), ("k", at(0.2), 3.0)], [("k", at(9), 5.0)]
    w = live.drain(live.latency_windows(batches("kind string, ts timestamp, value double", *rows), "1 hour", "1 hour", "1 hour")).collect()
    assert [(r.n, r.mean, r.max) for r in w] == [(2, 2.0, 3.0)]
    runs = [(1, at(0), True), (1, at(1), False)], [(1, at(20), True)]
    s = live.drain(live.run_sessions(batches("run long, ts timestamp, accepted boolean", *runs), "2 hours", "1 hour")).collect()
    assert [(r.n, r.accept_rate) for r in s] == [(2, 0.5)]


def test_layers_aliases_and_checks(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 6)], "key int, value int"), spark.createDataFrame([(2, 9), (1, None)], "key int, value int")
    assert sorted(map(tuple, catalog.layered([("low", a), ("high", b)]).collect())) == [(1, 5, "low"), (2, 9, "high")]
    g = spark.createDataFrame([("x", 1), ("y", 1), ("z", 2)], "name string, code int")
    assert sorted(map(tuple, catalog.aliases(g).collect())) == [(1, "x", "x"), (1, "y", "x")]
    e = review.record_errors(a, ["key"], {"big": F.col("value") > 5, "odd": F.col("key") % 2 == 1})
    assert sorted(map(tuple, e.collect())) == [(1, "odd"), (2, "big")]
    assert review.record_errors(a.limit(0), ["key"], {"big": F.col("value") > 5}).count() == 0
