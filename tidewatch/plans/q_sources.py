"""§2.1 sources and sinks over the fixture views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import scratch_path
from tidewatch.sources import events as E
from tidewatch.sources import sinks as S
from tidewatch.sources.tables import load
from tidewatch.plans import views as V
from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql
from tidewatch.plans.q_windows import flow_summary, _rate, RATE_SQL, SEQ_SQL

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSS"
DUCK_TS_FMT = "%Y-%m-%d %H:%M:%S.%g"


def flow_messages(spark, sf_dir):
    """v_flows as the producer's JSON on a ``network.flows`` topic, plus the
    document texts as undecodable lines on the same topic."""
    fl = V.v_flows(spark, sf_dir)
    body = F.struct(F.date_format("event_time", TS_FMT).alias("timestamp"), "src_ip", "dst_ip",
                    "dst_port", "bytes_sent", "bytes_received", "packets", "application",
                    F.concat(F.lit("dev-"), "device_id").alias("device_id"), "direction")
    good = fl.select(F.lit("network.flows").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"),
                     F.col("event_id").alias("offset"), F.col("event_time").alias("timestamp"),
                     F.col("src_ip").alias("key"), F.to_json(body).alias("value"))
    docs = load(spark, sf_dir, "documents")
    bad = docs.select(F.lit("network.flows").alias("topic"), F.lit(0).alias("partition"),
                      (F.col("doc_id") + 1_000_000_000).alias("offset"),
                      F.lit(None).cast("timestamp_ntz").alias("timestamp"),
                      F.lit(None).cast("string").alias("key"), F.col("text").alias("value"))
    return good.unionByName(bad)


FLOW_COLS = ["event_time", "src_ip", "dst_ip", "dst_port", "bytes_sent", "bytes_received", "packets",
             "application", "device_id", "direction"]


@register("src_json_events", sql(f"""
SELECT strptime(strftime(event_time, '{DUCK_TS_FMT}'), '{DUCK_TS_FMT}') AS event_time, src_ip, dst_ip,
       dst_port, bytes_sent, bytes_received, packets, application, 'dev-' || device_id AS device_id, direction
FROM v_flows""", "v_flows"))
def src_json_events(spark, sf_dir):
    return E.decode(flow_messages(spark, sf_dir), E.FLOW_SCHEMA).select(*FLOW_COLS)


START = {"network.click": {0: 100, 1: 100, 2: 100, 3: 100}, "network.view": {0: -1}}
END = {"network.error": {0: 50}, "network.purchase": {3: -2}}


@register("src_start_position", sql("""
SELECT topic, "partition", count(*) AS n, min("offset") AS first_offset, max("offset") AS last_offset
FROM v_messages
WHERE NOT (topic = 'network.click' AND "offset" < 100)
  AND NOT (topic = 'network.view' AND "partition" = 0)
  AND NOT (topic = 'network.error' AND "partition" = 0 AND "offset" >= 50)
  AND NOT (topic = 'network.purchase' AND "partition" = 3)
GROUP BY topic, "partition\"""", "v_messages"))
def src_start_position(spark, sf_dir):
    msgs = E.offset_range(V.v_messages(spark, sf_dir), START, END)
    return msgs.groupBy("topic", "partition").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"),
                                                  F.max("offset").alias("last_offset"))


@register("src_multi_topic", sql("""
SELECT 'network.flows' AS topic, event_id, event_time, src_ip, dst_ip, bytes_sent FROM v_flows
UNION ALL BY NAME
SELECT 'network.syslog' AS topic, event_id, event_time, source_ip, destination_ip, event_type, severity
FROM v_syslog""", "v_flows", "v_syslog"))
def src_multi_topic(spark, sf_dir):
    fl = V.v_flows(spark, sf_dir).select("event_id", "event_time", "src_ip", "dst_ip", "bytes_sent")
    sl = V.v_syslog(spark, sf_dir).select("event_id", "event_time", "source_ip", "destination_ip",
                                          "event_type", "severity")
    return E.union_topics({"network.flows": fl, "network.syslog": sl})


def _summary_text(spark, sf_dir):
    s = flow_summary(spark, sf_dir)
    return s.select(F.date_format("window_start", TS_FMT).alias("window_start"),
                    F.date_format("window_end", TS_FMT).alias("window_end"),
                    "src_ip", "total_bytes", "flow_count")


SUMMARY_SQL = """
SELECT time_bucket(INTERVAL 1 DAY, event_time) AS ws, src_ip,
       CAST(sum(bytes_sent) AS BIGINT) AS total_bytes, count(*) AS flow_count
FROM v_flows GROUP BY ALL HAVING count(*) > 12"""


@register("sink_derived", sql(f"""
SELECT 'traffic.summary' AS topic, src_ip AS key,
  to_json(struct_pack(window_start := strftime(ws, '{DUCK_TS_FMT}'),
                      window_end := strftime(ws + INTERVAL 1 DAY, '{DUCK_TS_FMT}'),
                      src_ip := src_ip, total_bytes := total_bytes, flow_count := flow_count))::VARCHAR AS value
FROM summary""", "v_flows", ctes=(("summary", SUMMARY_SQL),)))
def sink_derived(spark, sf_dir):
    return S.to_messages(_summary_text(spark, sf_dir), "src_ip", "traffic.summary")


@register("sink_table", sql("""
SELECT ws AS window_start, ws + INTERVAL 1 DAY AS window_end, src_ip, total_bytes, flow_count, 0 AS batch_id
FROM summary""", "v_flows", ctes=(("summary", SUMMARY_SQL),)))
def sink_table(spark, sf_dir):
    """Write the summary as micro-batch 0 twice (a replay) and read the table back:
    the idempotent sink keeps one copy."""
    path = scratch_path(spark, f"tables/flow_summary-{uuid.uuid4().hex}")
    summary = flow_summary(spark, sf_dir)
    for _ in range(2):
        S.write_batch_idempotent(summary, path, 0)
    schema = T.StructType([*summary.schema.fields, T.StructField("batch_id", T.IntegerType())])  # empty batch reads back
    return spark.read.schema(schema).parquet(path).select("window_start", "window_end", "src_ip", "total_bytes",
                                                          "flow_count", "batch_id")


def _alerts(spark, sf_dir):
    from tidewatch.plans.q_windows import win_match_sequence
    rate = _rate(spark, sf_dir).filter(F.col("rate") >= 8).select(
        F.lit("high_rate").alias("alert_type"), F.lit("high").alias("severity"),
        F.col("src_ip").alias("subject"), F.col("rate").alias("count"),
        F.col("event_time").alias("timestamp"), F.lit(None).cast("string").alias("cell_id"))
    seq = win_match_sequence(spark, sf_dir).select(
        F.lit("auth_failures_then_success").alias("alert_type"), F.lit("critical").alias("severity"),
        F.col("user_id").cast("string").alias("subject"), F.col("failures").alias("count"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit("auth-cell").alias("cell_id"))
    return rate.unionByName(seq)


@register("alert_envelope", sql("""
SELECT alert_type, severity, subject, count,
       coalesce("timestamp", TIMESTAMP '2024-02-01 00:00:00') AS "timestamp",
       coalesce(cell_id, 'perimeter-cell') AS cell_id, 'perimeter' AS cell_name
FROM (
  SELECT 'high_rate' AS alert_type, 'high' AS severity, src_ip AS subject, rate AS count,
         event_time AS "timestamp", CAST(NULL AS VARCHAR) AS cell_id FROM rate WHERE rate >= 8
  UNION ALL
  SELECT 'auth_failures_then_success', 'critical', CAST(user_id AS VARCHAR), failures,
         CAST(NULL AS TIMESTAMP), 'auth-cell' FROM seq)""",
    "v_flows", "v_syslog", ctes=(("rate", RATE_SQL), ("seq", SEQ_SQL))))
def alert_envelope(spark, sf_dir):
    return S.alert_envelope(_alerts(spark, sf_dir), "perimeter-cell", "perimeter",
                            now=F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


SUMMARY_SCHEMA = "window_start string, window_end string, src_ip string, total_bytes bigint, flow_count bigint"


@register("pipeline_compose", sql("""
SELECT src_ip, count(*) AS windows, max(total_bytes) AS max_window_bytes,
       CAST(sum(flow_count) AS BIGINT) AS flows
FROM summary GROUP BY src_ip""", "v_flows", ctes=(("summary", SUMMARY_SQL),)))
def pipeline_compose(spark, sf_dir):
    """Windowed aggregate -> derived topic (JSON) -> a second consumer scoring it."""
    topic = S.to_messages(_summary_text(spark, sf_dir), "src_ip", "traffic.summary")
    parsed = topic.select(F.from_json("value", SUMMARY_SCHEMA).alias("m")).select("m.*")
    return parsed.groupBy("src_ip").agg(F.count("*").alias("windows"),
                                        F.max("total_bytes").alias("max_window_bytes"),
                                        F.sum("flow_count").alias("flows"))
