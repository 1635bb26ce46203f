"""Stream = batch with shuffled micro-batches, for the operators that the other stream tests do not cover."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detect as D
from tidewatch.operators import effects as EF
from tidewatch.operators import joins as J
from tidewatch.operators import state as ST
from tidewatch.operators import windows as W
from tidewatch.sources import events as E
from tidewatch.streaming import effects as SE
from tidewatch.streaming import runner as R
from test_ordered_streams import shuffled_topic

T0 = datetime(2024, 5, 1)
END = T0 + timedelta(hours=9)                 # last events that move the watermark past all others
FLOWS = "src_ip string, event_time timestamp, event_id long, dst_ip string, dst_port long, bytes_received long, device_id long"
LOGS = "source_ip string, event_time timestamp, event_id long, destination_ip string, event_type string"


def flow_rows(n=500, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "b", None]), T0 + timedelta(seconds=rng.randint(0, 1800)), i, rng.choice("xy"),
             rng.randint(1, 12), rng.choice([0, 0, 5]), rng.randint(0, 5)) for i in range(n)]


def log_rows(n=500, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "b", None]), T0 + timedelta(seconds=rng.randint(0, 1800)), i, rng.choice("xy"),
             rng.choice(["auth_failure", "auth_failure", "firewall_deny", "auth_success"])) for i in range(n)]


# one of each kind: a filter is pushed below the watermark, which then sees only what passes
LAST_FLOW = [("end", END, 99999, "x", 1, received, 0) for received in (0, 5)]
LAST_LOG = [("end", END, 99999, "x", kind) for kind in ("auth_failure", "firewall_deny")]


def stream(spark, rows, schema, last):
    src = shuffled_topic(spark, rows, schema, disorder_s=60)
    for later in (0, 1):                      # the second one's micro-batch runs behind the first one's watermark
        rows = [(r[0], r[1] + timedelta(hours=later), *r[2:]) for r in last]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("event_time", "90 seconds")


def written(spark, df):
    out = R.fresh_dir(spark, "out")
    R.run_available_now(df, out, R.fresh_dir(spark, "ck"))
    return spark.read.parquet(out)


def same(got, want):
    rows = lambda df: sorted((tuple(r) for r in df.select(*sorted(want.columns)).collect() if "end" not in tuple(r)), key=str)
    a, b = rows(got), rows(want)
    assert a == b and a


def test_hop(spark):
    def hop(df):
        return W.hop(df, "event_time", "10 minutes", "5 minutes", ["src_ip"], [F.count("*").alias("n"), F.sum("dst_port").alias("s")],
                     having=F.col("n") > 3)
    same(written(spark, hop(stream(spark, flow_rows(), FLOWS, LAST_FLOW))), hop(spark.createDataFrame(flow_rows(), FLOWS)))


def test_interval_left(spark):
    def join(flows, logs):
        bad = logs.filter("event_type = 'firewall_deny'").select("source_ip", F.col("event_time").alias("seen"), F.col("event_id").alias("log_id"))
        return J.interval_join(flows.select("src_ip", "event_time", "event_id"), bad, [("src_ip", "source_ip")], "event_time", "seen",
                               -30, 30, how="left").select("event_id", "src_ip", "log_id")
    got = written(spark, join(stream(spark, flow_rows(), FLOWS, LAST_FLOW), stream(spark, log_rows(), LOGS, LAST_LOG)))
    want = join(spark.createDataFrame(flow_rows(), FLOWS), spark.createDataFrame(log_rows(), LOGS))
    assert want.where("log_id is null").count() > 20
    same(got, want)


def test_static_enrich(spark):
    inventory = spark.createDataFrame([(i, f"kind{i}") for i in range(4)], "device_id long, device_type string")
    enrich = lambda df: df.join(F.broadcast(inventory), "device_id", "left").select("event_id", "device_id", "device_type")
    got = written(spark, enrich(stream(spark, flow_rows(), FLOWS, LAST_FLOW)))
    same(got.where("event_id <> 99999"), enrich(spark.createDataFrame(flow_rows(), FLOWS)))


def test_brute_force(spark):
    rule = lambda df: D.brute_force(df, "2 minutes", 3)
    same(written(spark, rule(stream(spark, log_rows(), LOGS, LAST_LOG))), rule(spark.createDataFrame(log_rows(), LOGS)))


def test_threat_correlated_is_one_query(spark):
    options = {"window": "2 minutes", "window_s": 120, "min_ports": 4, "slack_s": 60, "critical_at": 6}
    got = written(spark, D.threat_correlated_stream(stream(spark, flow_rows(), FLOWS, LAST_FLOW), stream(spark, log_rows(), LOGS, LAST_LOG), **options))
    flows, logs = spark.createDataFrame(flow_rows(), FLOWS), spark.createDataFrame(log_rows(), LOGS)
    want = D.threat_correlated(D.port_scan(flows, "2 minutes", min_ports=4), logs, 120, 60, critical_at=6)
    same(got, want)
    same(D.threat_correlated_stream(flows, logs, **options), want)


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_value_by_key(spark, seed):
    """Key-value state: micro-batches in any order keep the last write in event order."""
    spec = EF.KnowledgeTable("kv", {"src_ip": "string"}, {"dst_port": ("bigint", "replace"), "event_time": ("timestamp", "greatest")})
    path = R.fresh_dir(spark, "kv")

    def changes(batch):
        at = [F.col("event_time"), F.col("event_id")]
        return batch.select("src_ip", EF.change("replace", F.col("dst_port"), at).alias("dst_port"), "event_time")
    rows = flow_rows(seed=seed)
    src = shuffled_topic(spark, rows, FLOWS, disorder_s=2000)
    R.run_foreach_batch(spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 1).parquet(src), SE.changes_sink(path, spec, changes),
                        R.fresh_dir(spark, "ck"))
    batch = spark.createDataFrame(rows, FLOWS)
    want = ST.kv_latest(batch, "src_ip", "dst_port", "event_time", "event_id")
    same(SE.table_now(spark, path, spec), want)


def test_ip_reputation(spark):
    spec = EF.KnowledgeTable("reputation", {"ip": "string"}, {
        "score": ("bigint", "add"), "event_count": ("bigint", "add"), "first_seen": ("timestamp", "least"), "last_seen": ("timestamp", "greatest")})
    path, rows = R.fresh_dir(spark, "rep"), flow_rows()
    at = F.col("event_time")

    def changes(batch):
        return batch.select(F.col("src_ip").alias("ip"), F.when(F.col("bytes_received") == 0, 1).otherwise(0).alias("score"),
                            F.lit(1).alias("event_count"), at.alias("first_seen"), at.alias("last_seen"))
    src = shuffled_topic(spark, rows, FLOWS, disorder_s=2000)
    R.run_foreach_batch(spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 1).parquet(src), SE.changes_sink(path, spec, changes),
                        R.fresh_dir(spark, "ck"))
    batch = spark.createDataFrame(rows, FLOWS)
    want = batch.groupBy(F.col("src_ip").alias("ip")).agg(
        F.sum(F.when(F.col("bytes_received") == 0, 1).otherwise(0)).alias("score"), F.count("*").alias("event_count"),
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    same(SE.table_now(spark, path, spec), want)


def test_start_offsets_of_a_stream(spark):
    """A stream that starts at given offsets reads the rows that the batch read of the same range gives."""
    from tidewatch.plans.q_sources import flow_messages
    src = R.fresh_dir(spark, "topic")
    flow_messages(spark, "/root/testdata/sf0.001").write.parquet(src)
    start = {"network.flows": {0: 100, 1: 250}}
    batch = E.read_events(spark, src, E.FLOW_SCHEMA, start=start)
    got = written(spark, E.read_events(spark, src, E.FLOW_SCHEMA, streaming=True, start=start).select("partition", "offset"))
    everything = E.read_events(spark, src, E.FLOW_SCHEMA).count()
    assert 0 < batch.count() < everything
    same(got, batch.select("partition", "offset"))
