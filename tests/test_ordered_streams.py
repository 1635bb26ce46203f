"""Row-ordered rules on a stream equal their batch forms, with rows shuffled across micro-batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import detect as D
from tidewatch.operators import sequences as SEQ
from tidewatch.operators import state as ST
from tidewatch.streaming import runner as R
from tidewatch.streaming.ordered import process_in_order

T0 = datetime(2024, 5, 1)


def shuffled_topic(spark, rows, schema, disorder_s):
    """Files of rows that are out of order by less than ``disorder_s`` seconds."""
    rng = random.Random(7)
    rows = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, disorder_s))
    src = R.fresh_dir(spark, "ordered")
    step = len(rows) // 6 + 1
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], schema).coalesce(1).write.mode("append").parquet(src)
    return src


def run(spark, src, schema, build):
    out, ck = R.fresh_dir(spark, "out"), R.fresh_dir(spark, "ck")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    R.run_available_now(build(stream), out, ck)
    return spark.read.parquet(out)


def test_polls(spark):
    schema = ("device_id long, event_time timestamp, event_id long, status string, cpu_percent double, "
              "memory_percent double, last_config_change string")
    rng, rows, t = random.Random(1), [], {}
    for i in range(300):
        d = i % 3
        t[d] = t.get(d, T0) + timedelta(seconds=rng.choice([30, 30, 30, 200]))
        rows.append((d, t[d], i, rng.choice(["online"] * 9 + ["offline"]), rng.choice([50.0, 90.0]),
                     rng.choice([70.0, 85.0]), rng.choice([None, "2024-01-01", "2024-02-01"])))
    end = max(t.values())
    rows.append((9, end + timedelta(seconds=1000), 999, "online", 1.0, 1.0, None))   # moves the watermark on
    src = shuffled_topic(spark, rows, schema, disorder_s=100)
    got = run(spark, src, schema, lambda s: process_in_order(
        s, ["device_id"], "event_time", ["event_time", "event_id"], ST.poll_changes(), ST.POLL_ALERT_SCHEMA,
        delay="120 seconds", silence_s=60, on_silence=ST.silent_poll))
    alerts = {(r.device_id, r.event_id, r.reason) for r in got.collect()}
    polls = spark.createDataFrame(rows, schema).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    want = {(r.device_id, r.event_id, r.reason) for r in D.device_offline(polls, 60).collect()}
    want |= {(r.device_id, r.event_id, "cpu_spike") for r in D.cpu_spike(polls).collect()}
    want |= {(r.device_id, r.event_id, "config_change") for r in D.config_change(polls).collect()}
    last = {max(i for d, _, i, *_ in rows if d == k) for k in (0, 1, 2)}
    # a stream also notices that the last poll of a device is followed by nothing
    assert alerts == want | {(d, i, "silent") for d, _, i, *_ in rows if i in last}
    batch = ST.process_events(polls, ["device_id"], ["event_time", "event_id"], ST.poll_changes(), ST.POLL_ALERT_SCHEMA)
    assert {(r.device_id, r.event_id, r.reason) for r in batch.collect()} == {x for x in alerts if x[2] != "silent"}


def test_failure_sequences(spark):
    schema = "source_ip string, event_time timestamp, event_id long, event_type string"
    rng = random.Random(2)
    rows = [(f"ip{rng.randint(0, 2)}", T0 + timedelta(seconds=10 * i), i,
             rng.choice(["auth_failure"] * 3 + ["auth_success", "vpn_connect"])) for i in range(300)]
    rows.append(("other", T0 + timedelta(hours=5), 999, "vpn_connect"))
    src = shuffled_topic(spark, rows, schema, disorder_s=50)
    got = run(spark, src, schema, lambda s: process_in_order(
        s, ["source_ip"], "event_time", ["event_time", "event_id"], ST.failures_then_success_rule(3, 300),
        ST.SEQUENCE_SCHEMA, delay="60 seconds"))
    logs = spark.createDataFrame(rows, schema).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    want = SEQ.failures_then_success(logs, ["source_ip"], ["event_time", "event_id"], "event_time",
                                     F.col("event_type") == "auth_failure", "auth_success", 3, "300 seconds")
    at = {r[1]: r[2] for r in rows}
    assert {(r.source_ip, at[r.run_start], r.failures, at[r.success_time]) for r in want.collect()} == {
        (r.source_ip, r.run_start_id, r.failures, r.success_id) for r in got.collect()} and got.count() > 3


def test_rates(spark):
    schema = "src_ip string, event_time timestamp, event_id long"
    rng = random.Random(3)
    rows = [(f"ip{rng.randint(0, 1)}", T0 + timedelta(seconds=rng.randint(0, 2000)), i) for i in range(400)]
    rows.append(("other", T0 + timedelta(hours=5), 999))
    src = shuffled_topic(spark, rows, schema, disorder_s=50)
    rule = ST.rate_with_reset(60, 7)
    got = run(spark, src, schema, lambda s: process_in_order(
        s, ["src_ip"], "event_time", ["event_time", "event_id"], rule,
        "alert_type string, severity string, src_ip string, count bigint, event_time timestamp, event_id bigint",
        delay="60 seconds"))
    batch = spark.createDataFrame(rows, schema).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    want = ST.process_events(batch, ["src_ip"], ["event_time", "event_id"], rule, ST.RATE_RESET_SCHEMA)
    key = lambda df: sorted((r.src_ip, r.event_id, r["count"]) for r in df.collect())
    assert key(got) == key(want) and key(got)


def _flows(spark):
    rng = random.Random(5)
    rows = [(f"10.0.{rng.randint(1, 3)}.{rng.randint(1, 4)}", T0 + timedelta(seconds=rng.randint(0, 3000)), i,
             f"10.0.2.{rng.randint(10, 16)}", rng.choice([22, 22, 80, 443]), rng.randint(0, 90_000),
             rng.choice(["outbound", "inbound"]), rng.randint(1, 50)) for i in range(900)]
    # rows that every rule reads move its watermark on (Spark filters before it takes the watermark)
    rows += [("10.0.3.9", T0 + timedelta(hours=5), 9999 + n, "10.0.2.99", 22, 1, way, 1)
             for n, way in enumerate(("outbound", "inbound"))]
    schema = ("src_ip string, event_time timestamp, event_id long, dst_ip string, dst_port long, bytes_sent long, "
              "direction string, packets long")
    return rows, schema


def test_windowed_detections(spark):
    rows, schema = _flows(spark)
    src = shuffled_topic(spark, rows, schema, disorder_s=50)
    batch = spark.createDataFrame(rows, schema).filter("event_id < 9999")
    for detect in (lambda df, **k: D.exfiltration(df, "5 minutes", 400_000),
                   lambda df, **k: D.lateral_movement(df, "5 minutes", min_targets=3, **k),
                   lambda df, **k: D.ddos(df, "5 minutes", min_sources=4, min_packets=100, **k)):
        got = run(spark, src, schema, lambda s: detect(s.withWatermark("event_time", "60 seconds"), streaming=True))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, detect(batch).collect())) and got.count() > 0


def test_two_chained_queries(spark):
    """A consumer's derived topic is the next consumer's input, each with its own checkpoint."""
    from pyspark.sql import types as T
    from tidewatch.operators import windows as W
    from tidewatch.sources import events as E
    from tidewatch.sources import sinks as S
    rows, schema = _flows(spark)
    src = shuffled_topic(spark, rows, schema, disorder_s=50)
    topic, out, ck1, ck2 = (R.fresh_dir(spark, k) for k in ("topic", "alerts", "ck1", "ck2"))
    body = T.StructType([T.StructField("src_ip", T.StringType()), T.StructField("flows", T.LongType())])
    for _ in range(2):        # the second round finds nothing new and adds nothing
        flows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
        counts = W.tumble(flows.withWatermark("event_time", "60 seconds"), "event_time", "10 minutes", ["src_ip"],
                          [F.count("*").alias("flows")]).select("src_ip", "flows")
        R.run_available_now(S.to_messages(counts, "src_ip", "flows.counts"), topic, ck1)
        derived = E.decode(E.read_topic_files(spark, topic, streaming=True), body, keep_envelope=("topic",), time_field=None)
        R.run_available_now(derived.filter("flows >= 18").select("src_ip", "flows"), out, ck2)
    batch = spark.createDataFrame(rows, schema).filter("event_id < 9999")
    want = batch.groupBy(F.window("event_time", "10 minutes"), "src_ip").agg(F.count("*").alias("flows")).filter("flows >= 18")
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted((r.src_ip, r.flows) for r in want.collect()) and got
