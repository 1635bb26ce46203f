"""Ordered scans keep rows with null keys and null times, as SQL windows do."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import numbering
from tidewatch.operators import windows as W
from tidewatch.operators.numbering import running_sum, sequence_number

T0 = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, None]),
             None if rng.random() < 0.15 else T0 + timedelta(seconds=rng.randint(0, 900)),
             rng.choice([None, 1, 2, 3])) for i in range(300)]
    return spark.createDataFrame(rows, "id long, k string, k2 long, ts timestamp_ntz, v long").repartition(7).cache()


@pytest.fixture(autouse=True, params=[100_000, 20], ids=["keys whole", "keys cut"])
def rows_per_chunk(request, monkeypatch):
    """Every scan with all keys in one chunk, and with keys cut at quantiles of their times."""
    monkeypatch.setattr(numbering, "ROWS_PER_CHUNK", request.param)


def same(a, b):
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


@pytest.mark.parametrize("keys", [["k"], ["k", "k2"]])
def test_scans_equal_sql_windows(events, keys):
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    same(sequence_number(events, keys, ["ts", "id"]), events.withColumn("seq", F.row_number().over(w) - 1))
    same(W.previous_in_key(events, keys, ["ts", "id"], ["v", "ts"]),
         events.withColumns({"prev_v": F.lag("v").over(w), "prev_ts": F.lag("ts").over(w)}))
    same(W.next_in_key(events, keys, ["ts", "id"], ["v"]), events.withColumn("next_v", F.lead("v").over(w)))
    total = F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    same(running_sum(events, keys, ["ts", "id"], F.coalesce("v", F.lit(0)), "s"), events.withColumn("s", total))


def test_rates_equal_the_range_window(events):
    us = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    want = events.withColumn("_s", us).withColumn("rate", F.count(F.lit(1)).over(
        Window.partitionBy("k").orderBy("_s").rangeBetween(-60, 0))).drop("_s")
    same(W.rate_in_range(events, "k", "ts", 60), want)
    assert events.where("ts is null").count() > 10


def test_upserts_merge_null_keys(spark):
    from tidewatch.operators.state import accumulate_upsert
    schema = "ip string, port long, n long"
    old = spark.createDataFrame([(None, 1, 3), ("a", None, 1), (None, None, 5), ("b", 2, 7)], schema)
    new = spark.createDataFrame([(None, 1, 2), (None, None, 1), ("c", None, 4)], schema)
    got = accumulate_upsert(old, new, ["ip", "port"], add=["n"])
    assert Counter(map(tuple, got.collect())) == Counter([(None, 1, 5), ("a", None, 1), (None, None, 6), ("b", 2, 7), ("c", None, 4)])


def test_polls_without_load_figures(spark):
    from tidewatch.operators.state import poll_changes
    fn, state = poll_changes(), {}
    event = {"device_id": 1, "event_id": 1, "status": "online", "cpu_percent": None, "memory_percent": 90.0, "last_config_change": None}
    assert fn(event, state) == [] and fn({**event, "cpu_percent": 90.0, "memory_percent": None}, state) == []
    assert [a["reason"] for a in fn({**event, "cpu_percent": 90.0}, state)] == ["cpu_spike"]


def test_sessions_keep_null_keys(events):
    out = W.sessionize(events, ["k"], "ts", "20 seconds", ["ts", "id"])
    w = Window.partitionBy("k").orderBy("ts", "id")
    start = F.coalesce(F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 20 SECONDS"), F.lit(False))
    want = events.withColumn("_s", start.cast("long")).withColumn(
        "_session", F.when(F.col("ts").isNotNull(), F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")
    same(out, want)
    got = W.session(events, "ts", "20 seconds", ["k"], [F.count("*").alias("n")], order_cols=["ts", "id"])
    # Spark's own session window (rows without a time have no window)
    same(got.select("k", "n", "window_start"), events.groupBy(F.session_window("ts", "20 seconds").alias("w"), "k")
         .count().select("k", F.col("count").alias("n"), F.col("w.start").alias("window_start")))


def test_a_users_column_is_not_taken_for_a_chunk(events):
    clash = events.withColumn("_tb", F.lit(1)).withColumn("__cuts", F.lit("x"))
    same(sequence_number(clash, ["k"], ["ts", "id"]).drop("_tb", "__cuts"), sequence_number(events, ["k"], ["ts", "id"]))


@pytest.mark.parametrize("n", [3, 1500])
def test_top_per_group(spark, events, n):
    out = W.top_per_group(events, ["k"], [F.col("v").desc(), F.col("id")], n, "rank", ["id"])
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("id"))
    want = events.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint")).filter(F.col("rank") < n)
    same(out, want)


@pytest.mark.parametrize("keys,per_key", [(1, 6000), (3, 2000), (1500, 4)])
def test_table_of_chunks_stays_small(spark, monkeypatch, keys, per_key):
    """One row per chunk of a large key, whether keys are few and dense or many and sparse."""
    monkeypatch.setattr(numbering, "ROWS_PER_CHUNK", 200)
    rng = random.Random(keys)
    # bursts: half of a key's rows lie in a hundredth of its time
    rows = [(i, f"k{i % keys}", T0 + timedelta(seconds=rng.randint(0, 1000) if rng.random() < 0.5 else rng.randint(0, 100_000)))
            for i in range(keys * per_key)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz").repartition(5)
    c = numbering.Chunks(df, ["k"], ["ts", "id"])
    if per_key <= 200:
        assert c.whole
    else:
        table = c.table(c.df, F.count(F.lit(1)).alias("n")).collect()
        assert len(table) <= 0.01 * len(rows) and max(r.n for r in table) <= 2 * 200
    w = Window.partitionBy("k").orderBy("ts", "id")
    same(sequence_number(df, ["k"], ["ts", "id"]), df.withColumn("seq", F.row_number().over(w) - 1))
    same(W.previous_in_key(df, ["k"], ["ts", "id"], ["ts"]), df.withColumn("prev_ts", F.lag("ts").over(w)))
