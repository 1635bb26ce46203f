"""Batch = stream: the same transforms over ``spark.read`` and over a file
stream with ``availableNow``, compared on closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import state as ST
from tidewatch.operators import windows as W
from tidewatch.plans.q_sources import flow_messages
from tidewatch.plans.q_windows import flow_summary
from tidewatch.sources import events as E
from tidewatch.streaming import processors as P
from tidewatch.streaming import runner as R

from conftest import SF_SMALL

CUTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


def _chunks(msgs):
    t = F.col("timestamp")
    a, b = (F.lit(c).cast("timestamp_ntz") for c in CUTS)
    return [msgs.filter(t.isNull() | (t < a)), msgs.filter((t >= a) & (t < b)), msgs.filter(t >= b)]


def _run_chunks(spark, build, output_mode="append"):
    src, out, ck = R.fresh_dir(spark, "t"), R.fresh_dir(spark, "s"), R.fresh_dir(spark, "c")
    for i, part in enumerate(_chunks(flow_messages(spark, SF_SMALL))):
        part.write.mode("append").parquet(src)
        R.run_available_now(build(src), out, ck, output_mode)
    return spark.read.parquet(out)


def test_tumble_stream_equals_batch(spark):
    got = _run_chunks(spark, lambda src: R.flow_summary_stream(R.flow_stream(spark, src), "1 day", "1 hour", 2))
    fl = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    wm = fl.agg(F.max("ts")).first()[0]
    from datetime import timedelta
    want = flow_summary(spark, SF_SMALL, "1 day", 2).filter(F.col("window_end") <= F.lit(wm - timedelta(hours=1)))
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() > 0


def test_session_stream_equals_batch(spark):
    def build(src):
        flows = R.flow_stream(spark, src)
        s = W.session(W.with_watermark(flows, "event_time", "1 hour"), "event_time", "6 hours", ["src_ip"],
                      [F.count("*").alias("events")])
        return s.select(F.col("window_start").cast("timestamp_ntz").alias("ws"), "src_ip", "events")
    got = _run_chunks(spark, build)
    batch = E.decode(flow_messages(spark, SF_SMALL), E.FLOW_SCHEMA)
    want = W.session(batch, "event_time", "6 hours", ["src_ip"], [F.count("*").alias("events")]) \
        .select(F.col("window_start").alias("ws"), "src_ip", "events", "window_end")
    got_rows = {tuple(r) for r in got.collect()}
    want_rows = {(r.ws, r.src_ip, r.events) for r in want.collect()}
    assert got_rows and got_rows <= want_rows
    # every session closed by the final watermark was emitted
    last = batch.agg(F.max("event_time")).first()[0]
    from datetime import timedelta
    closed = {(r.ws, r.src_ip, r.events) for r in want.collect() if r.window_end <= last - timedelta(hours=1)}
    assert closed <= got_rows


def test_event_function_stream_equals_batch(spark):
    def build(src):
        msgs = E.read_topic_files(spark, src, streaming=True)
        flows = E.decode(msgs, E.FLOW_SCHEMA).select("src_ip", "dst_ip", F.col("offset").alias("event_id"),
                                                    "event_time")
        return P.process_events_stream(flows, ["src_ip"], ["event_time", "event_id"], ST.first_contact(),
                                       ST.FIRST_CONTACT_SCHEMA)
    got = _run_chunks(spark, build)
    batch = E.decode(flow_messages(spark, SF_SMALL), E.FLOW_SCHEMA).select(
        "src_ip", "dst_ip", F.col("offset").alias("event_id"), "event_time")
    want = ST.process_events(batch, ["src_ip"], ["event_time", "event_id"], ST.first_contact(),
                             ST.FIRST_CONTACT_SCHEMA)
    assert sorted(got.select("src_ip", "dst_ip", "event_id").collect()) == \
        sorted(want.select("src_ip", "dst_ip", "event_id").collect())


def test_dedup_within_watermark_stream(spark):
    def build(src):
        msgs = E.read_topic_files(spark, src, streaming=True)
        flows = E.decode(msgs, E.FLOW_SCHEMA).select("topic", "partition", "offset", "event_time")
        flows = flows.withColumn("event_time", F.col("event_time").cast("timestamp"))
        return flows.withWatermark("event_time", "1 hour").dropDuplicatesWithinWatermark(
            ["topic", "partition", "offset"])
    src, out, ck = R.fresh_dir(spark, "t"), R.fresh_dir(spark, "s"), R.fresh_dir(spark, "c")
    msgs = flow_messages(spark, SF_SMALL)
    parts = _chunks(msgs)
    for part in parts:
        part.write.mode("append").parquet(src)
        part.write.mode("append").parquet(src)          # every message delivered twice
        R.run_available_now(build(src), out, ck)
    n_good = E.decode(msgs, E.FLOW_SCHEMA).count()
    assert spark.read.parquet(out).count() == n_good


def test_table_changes_are_idempotent(spark):
    """A replayed micro-batch replaces its own changes; the table is the fold of all."""
    from tidewatch.operators import effects as EF
    from tidewatch.streaming import effects as SE
    spec = EF.KnowledgeTable("scores", {"ip": "string"}, {"score": ("bigint", "add")})
    base = R.fresh_dir(spark, "changes")
    fn = SE.changes_sink(base, spec, lambda batch: batch.select("ip", F.lit(1).alias("score")))
    b0 = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "ip string")
    b1 = spark.createDataFrame([("a",), ("c",), (None,)], "ip string")
    fn(b0, 0)
    fn(b1, 1)
    fn(b1, 1)                                          # replayed batch
    want = [("a", 3), ("b", 1), ("c", 1), (None, 2)]
    assert sorted(map(tuple, SE.table_now(spark, base, spec).collect()), key=str) == sorted(want, key=str)
    small = R.fresh_dir(spark, "compact")
    SE.compact(spark, base, small, spec)
    assert spark.read.parquet(small).count() == 4
    assert sorted(map(tuple, SE.table_now(spark, small, spec).collect()), key=str) == sorted(want, key=str)


def test_interval_join_stream_equals_batch(spark):
    from tidewatch.operators import joins as J
    from tidewatch.plans import views as V
    sys_dir = R.fresh_dir(spark, "syslog")
    sl = V.v_syslog(spark, SF_SMALL).filter(F.col("event_type").isin("auth_failure", "firewall_deny")) \
        .select(F.col("event_id").alias("syslog_event_id"), "source_ip", F.col("event_time").alias("syslog_time"))
    sl.write.parquet(sys_dir)

    def build(src):
        flows = R.flow_stream(spark, src).select(F.col("offset").alias("event_id"), "src_ip", "event_time") \
            .withWatermark("event_time", "1 hour")
        s = spark.readStream.schema(sl.schema).parquet(sys_dir) \
            .withColumn("syslog_time", F.col("syslog_time").cast("timestamp")).withWatermark("syslog_time", "1 hour")
        j = J.interval_join(flows, s, [("src_ip", "source_ip")], "event_time", "syslog_time", -1800, 1800)
        return j.select("event_id", "syslog_event_id")
    got = _run_chunks(spark, build)
    flows_b = E.decode(flow_messages(spark, SF_SMALL), E.FLOW_SCHEMA).select(
        F.col("offset").alias("event_id"), "src_ip", "event_time")
    want = J.interval_join(flows_b, sl, [("src_ip", "source_ip")], "event_time", "syslog_time", -1800, 1800) \
        .select("event_id", "syslog_event_id")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 0


def test_observed_counters_and_dlq_sink(spark):
    from tidewatch.plans.q_state import route_flows  # noqa: F401  (same split rules)
    from tidewatch.operators import state as ST2
    src, ck = R.fresh_dir(spark, "t"), R.fresh_dir(spark, "c")
    good_p, bad_p = R.fresh_dir(spark, "good"), R.fresh_dir(spark, "dlq")
    msgs = flow_messages(spark, SF_SMALL)
    for part in _chunks(msgs):
        part.write.mode("append").parquet(src)
    stream = E.decode(E.read_topic_files(spark, src, streaming=True), E.FLOW_SCHEMA, with_errors=True)
    stream = R.observe_counters(stream, "flows", F.col("bytes_sent") >= 150_000)

    def split(df):
        return ST2.dlq_split(df, [(F.col("_parse_error"), "parse", F.lit("undecodable JSON"))])
    q = R.run_foreach_batch(stream, R.dlq_sink(good_p, bad_p, split), ck)
    total = msgs.count()
    assert spark.read.parquet(good_p).count() + spark.read.parquet(bad_p).count() == total
    obs = R.observed_totals(q, "flows")
    assert obs["events_in"] == total
    assert obs["alerts_out"] == E.decode(msgs, E.FLOW_SCHEMA).filter(F.col("bytes_sent") >= 150_000).count()


def test_chunk_udtf_equals_udf(spark):
    from tidewatch.functions.text import chunks, register_udtfs
    register_udtfs(spark)
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").createOrReplaceTempView("docs_udtf")
    sql_rows = spark.sql("SELECT d.doc_id, c.chunk_no, c.chunk FROM docs_udtf d, LATERAL chunk_text(d.text) c")
    udf_rows = spark.table("docs_udtf").select("doc_id", F.posexplode(chunks("text")).alias("chunk_no", "chunk"))
    assert sorted(sql_rows.collect()) == sorted(udf_rows.collect())


def test_rate_reset_processor_stream_equals_batch(spark):
    def build(src):
        flows = E.decode(E.read_topic_files(spark, src, streaming=True), E.FLOW_SCHEMA) \
            .select(F.col("offset").alias("event_id"), "src_ip", "event_time")
        return P.process_events_stream(flows, ["src_ip"], ["event_time", "event_id"],
                                       ST.rate_with_reset(6 * 3600, 2), ST.RATE_RESET_SCHEMA)
    got = _run_chunks(spark, build)
    batch = E.decode(flow_messages(spark, SF_SMALL), E.FLOW_SCHEMA).select(
        F.col("offset").alias("event_id"), "src_ip", "event_time")
    want = ST.process_events(batch, ["src_ip"], ["event_time", "event_id"], ST.rate_with_reset(6 * 3600, 2),
                             ST.RATE_RESET_SCHEMA)
    # micro-batches arrive in time order (the topic chunks), so per-key order matches batch
    key = ["src_ip", "event_id", "count"]
    assert sorted(got.select(*key).collect()) == sorted(want.select(*key).collect()) and got.count() > 0


def test_port_scan_stream_equals_batch(spark):
    from tidewatch.operators import detect as D

    def build(src):
        flows = R.flow_stream(spark, src).withWatermark("event_time", "1 hour")
        s = D.port_scan(flows, "1 day", min_ports=2, streaming=True)
        return s.select(F.col("window_start").cast("timestamp_ntz").alias("ws"), "src_ip", "distinct_ports", "flows")
    got = _run_chunks(spark, build)
    batch = E.decode(flow_messages(spark, SF_SMALL), E.FLOW_SCHEMA)
    last = batch.agg(F.max("event_time")).first()[0]
    from datetime import timedelta
    want = D.port_scan(batch, "1 day", min_ports=2).filter(F.col("window_end") <= F.lit(last - timedelta(hours=1))) \
        .select(F.col("window_start").alias("ws"), "src_ip", "distinct_ports", "flows")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 0


def test_read_events_batch_and_stream(spark):
    src = R.fresh_dir(spark, "t")
    flow_messages(spark, SF_SMALL).write.parquet(src)
    b = E.read_events(spark, src, E.FLOW_SCHEMA, start={"network.flows": {0: 100}})
    n_all = E.read_events(spark, src, E.FLOW_SCHEMA).count()
    assert 0 < b.count() < n_all
    s = E.read_events(spark, src, E.FLOW_SCHEMA, streaming=True)
    assert s.isStreaming


def test_knowledge_ingest_stream(spark):
    docs_dir, out, ck = R.fresh_dir(spark, "docs"), R.fresh_dir(spark, "kb"), R.fresh_dir(spark, "c")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        "doc_id", F.col("text").alias("content"), F.col("lang").alias("tenant"))
    docs.write.parquet(docs_dir)
    stream = spark.readStream.schema(docs.schema).parquet(docs_dir)
    R.run_foreach_batch(stream, R.knowledge_ingest_sink(out), ck)
    from tidewatch.functions.text import chunks
    want = docs.select(F.sum(F.size(chunks("content")))).first()[0]
    got = spark.read.parquet(out)
    assert got.count() == want and set(got.columns) >= {"doc_id", "chunk_no", "content", "embedding", "tenant"}
