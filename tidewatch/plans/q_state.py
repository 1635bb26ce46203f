"""§2.7 stateful processing, upserts, dead letters and counters over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import effects as EF
from tidewatch.operators import mergeable as M
from tidewatch.operators import state as ST
from tidewatch.operators import windows as W
from tidewatch.sources import events as E
from tidewatch.plans import views as V
from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql
from tidewatch.plans.q_sources import flow_messages
from tidewatch.plans.q_windows import RATE_SQL, _rate


@register("udf_process_event", sql("""
SELECT 'new_destination' AS alert_type, src_ip, dst_ip, event_id, event_time FROM (
  SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY event_time, event_id) AS rn FROM v_flows)
WHERE rn = 1""", "v_flows"))
def udf_process_event(spark, sf_dir):
    """A user ``process_event`` (first contact of a source with a destination) in event order per key; its
    mergeable form, so a hot source is not one task."""
    fl = V.v_flows(spark, sf_dir).select("event_id", "event_time", "src_ip", "dst_ip")
    return M.process_mergeable(fl, ["src_ip"], ["event_time", "event_id"], M.mergeable_first_contact(),
                               ST.FIRST_CONTACT_SCHEMA)


# One recursion step per event of a key, all keys at once: the kept times of the window, emptied by an alert.
RATE_RESET_SQL = sql("""
SELECT 'high_rate' AS alert_type, 'high' AS severity, src_ip, CAST(n AS BIGINT) AS count, event_time, event_id
FROM steps WHERE n > 5""", "v_flows", ctes=(("numbered", """
  SELECT src_ip, event_time, event_id, epoch_us(event_time) AS us,
         row_number() OVER (PARTITION BY src_ip ORDER BY event_time, event_id) AS i FROM v_flows"""),
    ("steps", """
  SELECT src_ip, i, event_time, event_id, 1 AS n, [us] AS times FROM numbered WHERE i = 1
  UNION ALL
  SELECT src_ip, i, event_time, event_id, len(kept) AS n, CASE WHEN len(kept) > 5 THEN CAST([] AS BIGINT[]) ELSE kept END
  FROM (SELECT e.src_ip, e.i, e.event_time, e.event_id,
               list_filter(list_append(s.times, e.us), lambda t: e.us - t < 6 * 3600 * 1000000::BIGINT) AS kept
        FROM steps s JOIN numbered e ON e.src_ip = s.src_ip AND e.i = s.i + 1)"""))).replace("WITH ", "WITH RECURSIVE ", 1)


@register("win_rate_reset", RATE_RESET_SQL)
def win_rate_reset(spark, sf_dir, window_s=6 * 3600, threshold=5):
    fl = V.v_flows(spark, sf_dir).select("event_id", "event_time", "src_ip")
    return M.process_mergeable(fl, ["src_ip"], ["event_time", "event_id"],
                               M.mergeable_rate_with_reset(window_s, threshold), ST.RATE_RESET_SCHEMA)


@register("udf_knowledge_writes", RATE_RESET_SQL.replace(
    "SELECT 'high_rate' AS alert_type, 'high' AS severity, src_ip, CAST(n AS BIGINT) AS count, event_time, event_id",
    "SELECT src_ip AS ip, CAST(count(*) AS DOUBLE) AS score, CAST(max_by(n, i) AS BIGINT) AS event_count")
    + " GROUP BY src_ip")
def udf_knowledge_writes(spark, sf_dir, window_s=6 * 3600, threshold=5):
    """The reference's example as an event function with a knowledge argument: at each alert of the rate rule
    the source's score goes up by one and its event count is replaced; the result is that table."""
    fl = V.v_flows(spark, sf_dir).select("event_id", "event_time", "src_ip")
    effects = EF.process_with_knowledge(fl, ["src_ip"], ["event_time", "event_id"], EF.scored_rate(window_s, threshold),
                                        ST.RATE_RESET_SCHEMA, [EF.IP_SCORES], independent_after_s=window_s)
    return EF.table_rows(effects.changes("ip_scores"), EF.IP_SCORES)


@register("state_kv_upsert", sql("""
SELECT key, value, updated_at FROM (
  SELECT 'device:' || device_id AS key, status || '/' || CAST(memory_percent AS BIGINT) AS value,
         event_time AS updated_at,
         row_number() OVER (PARTITION BY device_id ORDER BY event_time DESC, event_id DESC) AS rn
  FROM v_device_status) WHERE rn = 1""", "v_device_status"))
def state_kv_upsert(spark, sf_dir):
    ds = V.v_device_status(spark, sf_dir)
    writes = ds.select(F.concat(F.lit("device:"), F.col("device_id").cast("string")).alias("key"),
                       F.concat_ws("/", "status", F.col("memory_percent").cast("bigint").cast("string")).alias("value"),
                       F.col("event_time").alias("updated_at"), "event_id")
    return ST.kv_latest(writes, "key", "value", "updated_at", "event_id")


@register("upsert_accumulate", sql("""
SELECT src_ip AS ip, count(*) AS score,
       max_by(rate, CAST(epoch_us(event_time) AS HUGEINT) * 100000 + event_id) AS event_count
FROM rate WHERE rate >= 8 GROUP BY src_ip""", "v_flows", ctes=(("rate", RATE_SQL),)))
def upsert_accumulate(spark, sf_dir):
    """``score = score + 1`` per alert, ``event_count`` = latest count: a snapshot
    (alerts before Jan 16) merged with the next batch (the rest)."""
    alerts = _rate(spark, sf_dir).filter(F.col("rate") >= 8)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")

    def agg(df):
        return df.groupBy(F.col("src_ip").alias("ip")).agg(
            F.count("*").alias("score"),
            F.max_by("rate", F.struct("event_time", "event_id")).alias("event_count"))
    return ST.accumulate_upsert(agg(alerts.filter(F.col("event_time") < cut)),
                                agg(alerts.filter(F.col("event_time") >= cut)),
                                ["ip"], add=["score"], replace=["event_count"])


def _flow_checks():
    per_packet = F.try_divide(F.col("bytes_sent"), F.col("packets") - 1)
    return [(F.col("_parse_error"), "parse", F.lit("undecodable JSON")),
            (per_packet.isNull(), "ZeroDivisionError", F.lit("division by zero"))]


def route_flows(spark, sf_dir):
    decoded = E.decode(flow_messages(spark, sf_dir), E.FLOW_SCHEMA, with_errors=True)
    return ST.dlq_split(decoded, _flow_checks())


@register("dlq_route", sql("""
SELECT event_id AS "offset", CASE WHEN packets - 1 = 0 THEN 'dlq' ELSE 'ok' END AS status,
       CASE WHEN packets - 1 = 0 THEN 'ZeroDivisionError' END AS error_type
FROM v_flows
UNION ALL SELECT doc_id + 1000000000, 'dlq', 'parse' FROM documents""", "v_flows"))
def dlq_route(spark, sf_dir):
    """Every message once: ``ok`` or routed to the DLQ with its error type (one pass)."""
    decoded = E.decode(flow_messages(spark, sf_dir), E.FLOW_SCHEMA, with_errors=True)
    tagged = ST.dlq_tag(decoded, _flow_checks())
    return tagged.select("offset", F.when(F.col("error_type").isNull(), "ok").otherwise("dlq").alias("status"),
                         "error_type")


@register("dlq_tail", sql("""
SELECT consumer_id, "timestamp", error_type, error, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY consumer_id ORDER BY "timestamp" DESC, event_id DESC) AS rn
  FROM v_dlq) WHERE rn <= 5""", "v_dlq"))
def dlq_tail(spark, sf_dir, n=5):
    d = V.v_dlq(spark, sf_dir).select("consumer_id", "timestamp", "event_id", "error_type", "error")
    return W.ranked_tail(d, ["consumer_id"], ["timestamp", "event_id"], n).drop("event_id")


@register("dlq_summary", sql("""
SELECT consumer_id, count(*) AS errors, max_by(error, CAST(epoch_us("timestamp") AS HUGEINT) * 100000 + event_id) AS latest_error,
       max("timestamp") AS last_error_time
FROM v_dlq GROUP BY consumer_id""", "v_dlq"))
def dlq_summary(spark, sf_dir):
    d = V.v_dlq(spark, sf_dir)
    return d.groupBy("consumer_id").agg(F.count("*").alias("errors"),
                                        F.max_by("error", F.struct("timestamp", "event_id")).alias("latest_error"),
                                        F.max("timestamp").alias("last_error_time"))


def consumer_counters(events, alerts_flag, errors, key):
    """Events in, alerts out, last event time per consumer, plus its DLQ errors."""
    c = events.groupBy(key).agg(F.count("*").alias("events_in"),
                                F.count(F.when(alerts_flag, 1)).alias("alerts_out"),
                                F.max("event_time").alias("last_event_time"))
    e = errors.groupBy(key).agg(F.count("*").alias("errors"))
    return c.join(e, key, "left").select(key, "events_in", "alerts_out",
                                         F.coalesce("errors", F.lit(0).cast("bigint")).alias("errors"),
                                         "last_event_time")


@register("counters_observe", sql("""
SELECT f.application AS consumer, count(*) AS events_in,
       count(CASE WHEN bytes_sent >= 150000 THEN 1 END) AS alerts_out,
       coalesce(max(e.errors), 0) AS errors, max(event_time) AS last_event_time
FROM v_flows f LEFT JOIN (SELECT error_type, count(*) AS errors FROM v_dlq GROUP BY error_type) e
  ON e.error_type = f.application
GROUP BY f.application""", "v_flows", "v_dlq"))
def counters_observe(spark, sf_dir):
    fl = V.v_flows(spark, sf_dir).select(F.col("application").alias("consumer"), "bytes_sent", "event_time")
    errs = V.v_dlq(spark, sf_dir).select(F.col("error_type").alias("consumer"))
    return consumer_counters(fl, F.col("bytes_sent") >= 150_000, errs, "consumer")
