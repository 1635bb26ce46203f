"""Stored sketches rolled up from hours to days stay within their bounds."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import sketches as SK
from tidewatch.streaming.runner import fresh_dir

T0 = datetime(2024, 5, 1)


def rows(n=30_000):
    rng = random.Random(8)
    return [(rng.choice(["a", "a", "b", None]), T0 + timedelta(seconds=rng.randint(0, 3 * 86_400 - 1)), f"s{rng.randint(0, 3000)}",
             None if rng.random() < 0.02 else rng.gauss(100, 20)) for _ in range(n)]


def test_hours_roll_up_to_days(spark):
    df = spark.createDataFrame(rows(), "k string, ts timestamp_ntz, who string, size double").repartition(5)
    path = fresh_dir(spark, "sketches")
    SK.window_sketches(df, "ts", "1 hour", ["k"], ["who"], ["size"]).write.parquet(path)
    stored = spark.read.parquet(path)
    for size in ("1 day", None):
        keys = ["k"] if size is None else ["window_start", "k"]
        raw = df if size is None else df.withColumn("window_start", F.window("ts", size).start)
        want = {tuple(r[k] for k in keys): r for r in raw.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("who").alias("d"), F.avg("size").alias("m"), F.stddev_pop("size").alias("s"),
            F.collect_list("size").alias("all")).collect()}
        got = SK.estimates(SK.roll_up(stored, size, ["k"])).collect()
        assert len(got) == len(want)
        for r in got:
            w = want[tuple(r[k] for k in keys)]
            assert r.n == w.n and abs(r.who_distinct - w.d) <= 0.08 * w.d
            assert abs(r.size_mean - w.m) < 1e-6 and abs(r.size_stddev - w.s) < 1e-4
            ranked = sorted(w["all"])
            for p, v in ((0.5, r.size_p50), (0.95, r.size_p95)):
                assert abs(sum(x <= v for x in ranked) / len(ranked) - p) < 0.04


def test_small_sets_are_exact(spark):
    df = spark.createDataFrame(rows(600), "k string, ts timestamp_ntz, who string, size double").where("who < 's12'")
    got = SK.estimates(SK.roll_up(SK.window_sketches(df, "ts", "1 hour", ["k"], ["who"]), "1 day", ["k"]))
    want = df.groupBy(F.window("ts", "1 day").start.alias("window_start"), "k").agg(F.countDistinct("who").alias("who_distinct"))
    key = lambda r: str(tuple(r))
    assert sorted(got.select("window_start", "k", "who_distinct").collect(), key=key) == sorted(want.collect(), key=key)
    assert SK.estimates(SK.window_sketches(df.limit(0), "ts", "1 hour", ["k"], ["who"], ["size"])).count() == 0


def test_values_that_are_all_null(spark):
    df = spark.createDataFrame([("a", T0, None, None)], "k string, ts timestamp_ntz, who string, size double")
    r = SK.estimates(SK.roll_up(SK.window_sketches(df, "ts", "1 hour", ["k"], ["who"], ["size"]), "1 day", ["k"])).first()
    assert (r.n, r.who_distinct, r.size_mean, r.size_p50) == (1, 0, None, None)
