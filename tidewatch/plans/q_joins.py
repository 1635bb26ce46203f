"""§2.3 joins over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.exprs import json_path
from tidewatch.operators import joins as J
from tidewatch.plans import views as V
from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql

DENY_TYPES = ("auth_failure", "firewall_deny")


def _flows_out(spark, sf_dir):
    return V.v_flows(spark, sf_dir).filter(F.col("direction") == "outbound") \
        .select("event_id", "src_ip", "event_time")


def _denies(spark, sf_dir):
    return V.v_syslog(spark, sf_dir).filter(F.col("event_type").isin(*DENY_TYPES)) \
        .select(F.col("event_id").alias("syslog_event_id"), "source_ip", F.col("event_time").alias("syslog_time"))


INTERVAL_SQL = """
SELECT f.event_id, f.src_ip, f.event_time, s.event_id AS syslog_event_id, s.event_time AS syslog_time
FROM (SELECT * FROM v_flows WHERE direction = 'outbound') f
{how} JOIN (SELECT * FROM v_syslog WHERE event_type IN ('auth_failure', 'firewall_deny')) s
  ON s.source_ip = f.src_ip AND s.event_time BETWEEN f.event_time - INTERVAL 30 MINUTE
                                                 AND f.event_time + INTERVAL 30 MINUTE"""


@register("join_interval_topics", sql(INTERVAL_SQL.format(how="INNER"), "v_flows", "v_syslog"))
def join_interval_topics(spark, sf_dir):
    out = J.interval_join(_flows_out(spark, sf_dir), _denies(spark, sf_dir), [("src_ip", "source_ip")],
                          "event_time", "syslog_time", -1800, 1800)
    return out.select("event_id", "src_ip", "event_time", "syslog_event_id", "syslog_time")


@register("join_interval_left", sql(INTERVAL_SQL.format(how="LEFT"), "v_flows", "v_syslog"))
def join_interval_left(spark, sf_dir):
    out = J.interval_join(_flows_out(spark, sf_dir), _denies(spark, sf_dir), [("src_ip", "source_ip")],
                          "event_time", "syslog_time", -1800, 1800, how="left")
    return out.select("event_id", "src_ip", "event_time", "syslog_event_id", "syslog_time")


@register("join_static_enrich", sql("""
SELECT f.event_id, f.device_id, d.device_type, d.location, d.vlan_id
FROM v_flows f LEFT JOIN v_devices d ON f.device_id = d.device_id""", "v_flows", "v_devices"))
def join_static_enrich(spark, sf_dir):
    fl = V.v_flows(spark, sf_dir).select("event_id", "device_id")
    inv = V.v_devices(spark).select("device_id", "device_type", "location", "vlan_id")
    return fl.join(inv, "device_id", "left")


def ip_scores(spark, sf_dir):
    """Per-source threat score: flows that got no bytes back plus SSH flows."""
    fl = V.v_flows(spark, sf_dir)
    return fl.groupBy("src_ip").agg(
        (F.sum(F.when(F.col("bytes_received") == 0, 1).otherwise(0))
         + F.sum(F.when(F.col("dst_port") == 22, 1).otherwise(0))).alias("threat_score"),
        F.count("*").alias("flows"))


IP_SCORES_SQL = """
SELECT src_ip, sum(CASE WHEN bytes_received = 0 THEN 1 ELSE 0 END)
               + sum(CASE WHEN dst_port = 22 THEN 1 ELSE 0 END) AS threat_score, count(*) AS flows
FROM v_flows GROUP BY src_ip"""


@register("join_knowledge_scores", sql("""
SELECT k.id, json_extract_string(k.metadata, '$.ip') AS ip, CAST(s.threat_score AS BIGINT) AS threat_score
FROM v_knowledge k JOIN ip_scores s ON s.src_ip = json_extract_string(k.metadata, '$.ip')
WHERE s.threat_score > 20""", "v_knowledge", "v_flows", ctes=(("ip_scores", IP_SCORES_SQL),)))
def join_knowledge_scores(spark, sf_dir):
    kb = V.v_knowledge(spark, sf_dir, vectors=False).select("id", json_path("metadata", "$.ip").alias("ip"))
    sc = ip_scores(spark, sf_dir).filter(F.col("threat_score") > 20)
    return kb.join(sc, kb.ip == sc.src_ip).select("id", "ip", F.col("threat_score").cast("bigint"))


def _known_ips(spark, sf_dir):
    kb = V.v_knowledge(spark, sf_dir, vectors=False).filter(F.col("category") == "src3")
    return kb.select(json_path("metadata", "$.ip").alias("src_ip"))


KNOWN_SQL = "SELECT json_extract_string(metadata, '$.ip') AS ip FROM v_knowledge WHERE category = 'src3'"


@register("join_semi_known", sql("""
SELECT event_id, src_ip FROM v_flows WHERE src_ip IN (SELECT ip FROM known)""",
                                 "v_flows", "v_knowledge", ctes=(("known", KNOWN_SQL),)))
def join_semi_known(spark, sf_dir):
    return J.semi(V.v_flows(spark, sf_dir).select("event_id", "src_ip"), _known_ips(spark, sf_dir), "src_ip")


@register("join_anti_new", sql("""
SELECT event_id, src_ip FROM v_flows WHERE src_ip NOT IN (SELECT ip FROM known)""",
                               "v_flows", "v_knowledge", ctes=(("known", KNOWN_SQL),)))
def join_anti_new(spark, sf_dir):
    return J.anti(V.v_flows(spark, sf_dir).select("event_id", "src_ip"), _known_ips(spark, sf_dir), "src_ip")
