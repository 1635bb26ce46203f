"""§2.8 detections on the fixture views, with the day-scale thresholds of FIXTURES.md §3."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import detect as D
from tidewatch.plans import views as V
from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql
from tidewatch.plans.q_windows import RATE_SQL

DAY = "1 day"
TB = "time_bucket(INTERVAL 1 DAY, event_time)"


def port_scans(spark, sf_dir):
    return D.port_scan(V.v_flows(spark, sf_dir), DAY, min_ports=3, min_silent_share=0.5)


PORT_SCAN_SQL = f"""
SELECT {TB} AS window_start, {TB} + INTERVAL 1 DAY AS window_end, src_ip, dst_ip,
       count(DISTINCT dst_port) FILTER (bytes_received = 0) AS distinct_ports,
       count(*) FILTER (bytes_received = 0) AS flows
FROM v_flows GROUP BY ALL HAVING count(DISTINCT dst_port) FILTER (bytes_received = 0) >= 3
  AND count(*) FILTER (bytes_received = 0) >= 0.5 * count(*)"""

register("det_port_scan", sql(PORT_SCAN_SQL, "v_flows"))(port_scans)


@register("det_exfiltration", sql("""
SELECT window_start, window_end, src_ip, total_bytes, flows, max_flow_bytes FROM (
  SELECT *, count(total_bytes) OVER w AS n, avg(total_bytes) OVER w AS mean FROM daily_out
  WINDOW w AS (PARTITION BY src_ip ORDER BY window_start ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
WHERE total_bytes >= 300000 OR max_flow_bytes >= 250000 OR (n >= 3 AND total_bytes >= mean * 1.5)""", "v_flows",
    ctes=(("daily_out", f"""
  SELECT {TB} AS window_start, {TB} + INTERVAL 1 DAY AS window_end, src_ip,
         CAST(sum(bytes_sent) AS BIGINT) AS total_bytes, count(*) AS flows, max(bytes_sent) AS max_flow_bytes
  FROM v_flows WHERE direction = 'outbound' GROUP BY ALL"""),)))
def det_exfiltration(spark, sf_dir):
    return D.exfiltration(V.v_flows(spark, sf_dir), DAY, min_window_bytes=300_000, min_flow_bytes=250_000,
                          baseline_factor=1.5)


@register("det_lateral_movement", sql(f"""
SELECT {TB} AS window_start, {TB} + INTERVAL 1 DAY AS window_end, src_ip,
       count(DISTINCT dst_ip) AS targets, count(*) AS flows
FROM v_flows WHERE starts_with(src_ip, '10.0.3.') AND starts_with(dst_ip, '10.0.2.') AND dst_port = 22
GROUP BY ALL HAVING count(DISTINCT dst_ip) >= 2""", "v_flows"))
def det_lateral_movement(spark, sf_dir):
    return D.lateral_movement(V.v_flows(spark, sf_dir), DAY, min_targets=2)


@register("det_ddos", sql(f"""
SELECT {TB} AS window_start, {TB} + INTERVAL 1 DAY AS window_end, dst_ip,
       count(DISTINCT src_ip) AS sources, CAST(sum(packets) AS BIGINT) AS packets, count(*) AS flows
FROM v_flows WHERE direction = 'inbound' GROUP BY ALL HAVING count(DISTINCT src_ip) >= 6 AND sum(packets) >= 800""", "v_flows"))
def det_ddos(spark, sf_dir):
    return D.ddos(V.v_flows(spark, sf_dir), DAY, min_sources=6, min_packets=800)


@register("det_brute_force", sql(f"""
SELECT {TB} AS window_start, {TB} + INTERVAL 1 DAY AS window_end, source_ip, destination_ip,
       count(*) AS failures
FROM v_syslog WHERE event_type = 'auth_failure' GROUP BY ALL HAVING count(*) >= 3""", "v_syslog"))
def det_brute_force(spark, sf_dir):
    return D.brute_force(V.v_syslog(spark, sf_dir), DAY, min_failures=3)


@register("det_threat_correlated", sql(f"""
SELECT d.window_start, d.window_end, d.src_ip, d.dst_ip, d.distinct_ports, d.flows, count(s.event_id) AS correlated_events,
       CASE WHEN count(s.event_id) >= 5 THEN 'critical' ELSE 'high' END AS severity
FROM scans d JOIN v_syslog s ON s.source_ip = d.src_ip AND s.event_type IN ('auth_failure', 'firewall_deny')
  AND s.event_time BETWEEN d.window_start AND d.window_start + INTERVAL 86700 SECOND
GROUP BY ALL""", "v_flows", "v_syslog", ctes=(("scans", PORT_SCAN_SQL),)))
def det_threat_correlated(spark, sf_dir):
    return D.threat_correlated(port_scans(spark, sf_dir), V.v_syslog(spark, sf_dir), 86_400, 300)


@register("det_device_offline", sql("""
SELECT device_id, event_id, event_time, reason, gap_seconds FROM (
  SELECT device_id, event_id, event_time, 'offline' AS reason, gap_seconds FROM g WHERE status = 'offline'
  UNION ALL
  SELECT device_id, event_id, event_time, 'silent', gap_seconds FROM g WHERE gap_seconds > 14400)""",
    "v_device_status", ctes=(("g", """
  SELECT device_id, event_id, event_time, status,
    CAST(floor((epoch_us(lead(event_time) OVER (PARTITION BY device_id ORDER BY event_time, event_id))
                - epoch_us(event_time)) / 1000000) AS BIGINT) AS gap_seconds
  FROM v_device_status"""),)))
def det_device_offline(spark, sf_dir):
    return D.device_offline(V.v_device_status(spark, sf_dir), max_gap_s=14_400)


@register("det_cpu_spike", sql("""
SELECT device_id, event_id, event_time, cpu_percent, memory_percent FROM (
  SELECT *, lag(spike) OVER (PARTITION BY device_id ORDER BY event_time, event_id) AS prev_spike
  FROM (SELECT *, cpu_percent >= 20 AND memory_percent >= 80 AS spike FROM v_device_status))
WHERE spike AND NOT coalesce(prev_spike, false)""", "v_device_status"))
def det_cpu_spike(spark, sf_dir):
    return D.cpu_spike(V.v_device_status(spark, sf_dir), min_cpu=20.0, min_memory=80.0)


@register("det_config_change", sql("""
SELECT device_id, event_id, event_time, last_config_change, previous_change FROM (
  SELECT *, lag(last_config_change) OVER (PARTITION BY device_id ORDER BY event_time, event_id) AS previous_change
  FROM v_device_status)
WHERE last_config_change IS NOT NULL AND last_config_change IS DISTINCT FROM previous_change""",
    "v_device_status"))
def det_config_change(spark, sf_dir):
    return D.config_change(V.v_device_status(spark, sf_dir))


@register("det_high_rate", sql("""
SELECT 'high_rate' AS alert_type, 'high' AS severity, src_ip, rate AS count, event_time, event_id
FROM rate WHERE rate > 7""", "v_flows", ctes=(("rate", RATE_SQL),)))
def det_high_rate(spark, sf_dir):
    return D.high_rate(V.v_flows(spark, sf_dir), seconds=6 * 3600, threshold=7)


DAILY_SQL = f"""
SELECT src_ip, {TB} AS day, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes FROM v_flows GROUP BY ALL"""


@register("score_traffic_anomaly", sql("""
SELECT src_ip, day, total_bytes, round(mean, 4) AS baseline_mean, round((total_bytes - mean) / sd, 4) AS z
FROM (SELECT *, count(total_bytes) OVER w AS n, avg(total_bytes) OVER w AS mean, stddev_pop(total_bytes) OVER w AS sd
      FROM daily WINDOW w AS (PARTITION BY src_ip ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
WHERE n >= 3 AND sd > 0 AND abs(round((total_bytes - mean) / sd, 4)) >= 2""",
    "v_flows", ctes=(("daily", DAILY_SQL),)))
def score_traffic_anomaly(spark, sf_dir):
    fl = V.v_flows(spark, sf_dir)
    daily = fl.groupBy("src_ip", F.window("event_time", DAY).start.alias("day")) \
              .agg(F.sum("bytes_sent").alias("total_bytes"))
    return D.zscore_anomalies(daily, "src_ip", "day", "total_bytes", history=7, min_history=3, min_abs_z=2.0)


@register("score_device_health", sql("""
SELECT device_id, arg_max(health_score, event_time) AS health_score, max(event_time) AS event_time,
       round(avg(health_score), 2) AS mean_health
FROM (SELECT device_id, event_time, event_id,
        round(least(greatest(100.0 - cpu_percent * 0.4 - memory_percent * 0.3
                             - greatest(temperature_celsius - 40.0, 0.0) * 0.2
                             - len(list_filter(interfaces[1:4], lambda x: x.status = 'down')) * 10.0, 0.0),
                    100.0), 2) AS health_score
      FROM v_device_status)
GROUP BY device_id""", "v_device_status"))
def score_device_health(spark, sf_dir):
    return D.device_health(V.v_device_status(spark, sf_dir))


@register("score_ip_reputation", sql("""
SELECT src_ip AS ip, CAST(sum(CASE WHEN bytes_received = 0 THEN 1 ELSE 0 END) AS BIGINT) AS score, count(*) AS event_count,
       min(event_time) AS first_seen, max(event_time) AS last_seen
FROM v_flows GROUP BY src_ip""", "v_flows"))
def score_ip_reputation(spark, sf_dir):
    """Reputation kept as a snapshot and upserted per batch: the first half of
    the month is the snapshot, the second half the incoming batch."""
    from tidewatch.operators.state import accumulate_upsert
    fl = V.v_flows(spark, sf_dir)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")

    def batch(df):
        return df.groupBy(F.col("src_ip").alias("ip")).agg(
            F.sum(F.when(F.col("bytes_received") == 0, 1).otherwise(0)).alias("score"),
            F.count("*").alias("event_count"), F.min("event_time").alias("first_seen"),
            F.max("event_time").alias("last_seen"))
    snapshot = batch(fl.filter(F.col("event_time") < cut))
    incoming = batch(fl.filter(F.col("event_time") >= cut))
    return accumulate_upsert(snapshot, incoming, ["ip"], add=["score", "event_count"],
                             least=["first_seen"], greatest=["last_seen"])
