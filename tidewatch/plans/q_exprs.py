"""§2.2 projection, filter and scalar expressions over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.sources.tables import load
from tidewatch.plans import views as V
from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql


@register("expr_event_time", sql("""
SELECT event_id, "timestamp",
  coalesce(try_strptime("timestamp", '%Y-%m-%d %H:%M:%S.%g'),
           try_strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ')) AS parsed_time
FROM v_device_status""", "v_device_status"))
def expr_event_time(spark, sf_dir):
    ds = V.v_device_status(spark, sf_dir)
    return ds.select("event_id", "timestamp", X.event_time("timestamp").alias("parsed_time"))


@register("expr_json_path", sql("""
SELECT event_id, json_extract_string(event, '$.k') AS k FROM v_dlq""", "v_dlq"))
def expr_json_path(spark, sf_dir):
    return V.v_dlq(spark, sf_dir).select("event_id", X.json_path("event", "$.k").alias("k"))


@register("expr_default", sql("""
SELECT event_id, coalesce(last_config_change, 'never') AS last_config_change,
       coalesce(CAST(NULL AS VARCHAR), 'unknown') AS firmware
FROM v_device_status""", "v_device_status"))
def expr_default(spark, sf_dir):
    ds = V.v_device_status(spark, sf_dir)
    # ``firmware`` is absent from the polls: the default fills it.
    fw = X.json_path(F.to_json(F.struct("device_id", "status")), "$.firmware")
    return ds.select("event_id", X.with_default("last_config_change", "never").alias("last_config_change"),
                     X.with_default(fw, "unknown").alias("firmware"))


@register("expr_nested_interfaces", sql("""
SELECT device_id, count(DISTINCT event_id) AS polls,
  CAST(sum(CASE WHEN i.status = 'up' THEN 1 ELSE 0 END) AS BIGINT) AS iface_up,
  CAST(sum(CASE WHEN i.status = 'down' THEN 1 ELSE 0 END) AS BIGINT) AS iface_down,
  round(avg(i.utilization_percent), 4) AS avg_utilization,
  max(down_in_poll) AS max_down_in_poll
FROM (SELECT device_id, event_id, unnest(interfaces[1:4]) AS i,
             len(list_filter(interfaces[1:4], lambda x: x.status = 'down')) AS down_in_poll
      FROM v_device_status)
GROUP BY device_id""", "v_device_status"))
def expr_nested_interfaces(spark, sf_dir):
    ds = V.v_device_status(spark, sf_dir)
    first4 = F.slice("interfaces", 1, 4)
    per_poll = ds.select("device_id", "event_id",
                         F.size(F.filter(first4, lambda x: x["status"] == "down")).cast("bigint").alias("down_in_poll"),
                         F.explode(first4).alias("i"))
    return per_poll.groupBy("device_id").agg(
        F.count_distinct("event_id").alias("polls"),
        F.sum(F.when(F.col("i.status") == "up", 1).otherwise(0)).alias("iface_up"),
        F.sum(F.when(F.col("i.status") == "down", 1).otherwise(0)).alias("iface_down"),
        F.round(F.avg("i.utilization_percent"), 4).alias("avg_utilization"),
        F.max("down_in_poll").alias("max_down_in_poll"))


@register("classify_vlan", sql("""
SELECT ip, CASE WHEN starts_with(ip, '10.0.1.') THEN 100 WHEN starts_with(ip, '10.0.2.') THEN 200
                WHEN starts_with(ip, '10.0.3.') THEN 300 ELSE 0 END AS vlan_id,
           CASE WHEN starts_with(ip, '10.0.1.') THEN 'corporate' WHEN starts_with(ip, '10.0.2.') THEN 'servers'
                WHEN starts_with(ip, '10.0.3.') THEN 'iot_guest' ELSE 'external' END AS vlan_name
FROM (SELECT src_ip AS ip FROM v_flows UNION SELECT dst_ip FROM v_flows)""", "v_flows"))
def classify_vlan(spark, sf_dir):
    fl = V.v_flows(spark, sf_dir)
    ips = fl.select(F.col("src_ip").alias("ip")).union(fl.select("dst_ip")).distinct()
    return ips.select("ip", X.vlan_id("ip").alias("vlan_id"), X.vlan_name("ip").alias("vlan_name"))


@register("classify_direction", sql("""
SELECT event_id, CASE WHEN NOT starts_with(src_ip, '10.') THEN 'inbound'
                      WHEN starts_with(dst_ip, '10.') THEN 'internal' ELSE 'outbound' END AS direction
FROM v_flows""", "v_flows"))
def classify_direction(spark, sf_dir):
    fl = V.v_flows(spark, sf_dir)
    return fl.select("event_id", X.direction("src_ip", "dst_ip").alias("direction"))


@register("classify_topic", sql("""
SELECT topic, CASE WHEN starts_with(topic, 'network.') THEN 'source'
                   WHEN starts_with(topic, 'agent.decisions') THEN 'decisions'
                   WHEN starts_with(topic, 'dlq.') THEN 'dlq'
                   WHEN topic IN ('threats.detected', 'traffic.anomalies', 'device.health.scores') THEN 'derived'
                   ELSE 'other' END AS type
FROM (SELECT topic FROM v_messages
      UNION SELECT 'dlq.consumer-' || consumer_id FROM v_dlq
      UNION SELECT 'agent.decisions.cell-' || cell_id FROM v_decisions
      UNION SELECT output_topic FROM v_registry
      UNION SELECT CASE WHEN severity = 'error' THEN 'threats.detected' ELSE 'traffic.anomalies' END FROM v_syslog)""",
    "v_messages", "v_dlq", "v_decisions", "v_registry", "v_syslog"))
def classify_topic(spark, sf_dir):
    topics = (V.v_messages(spark, sf_dir, offsets=False).select("topic")
              .union(V.v_dlq(spark, sf_dir).select(F.concat(F.lit("dlq.consumer-"), F.col("consumer_id").cast("string"))))
              .union(V.v_decisions(spark, sf_dir).select(
                  F.concat(F.lit("agent.decisions.cell-"), F.col("cell_id").cast("string"))))
              .union(V.v_registry(spark, sf_dir).select("output_topic"))
              .union(V.v_syslog(spark, sf_dir).select(
                  F.when(F.col("severity") == "error", "threats.detected").otherwise("traffic.anomalies")))
              .distinct())
    return topics.select("topic", X.topic_type("topic").alias("type"))


@register("filter_predicates", sql("""
SELECT id, category, tenant FROM v_knowledge
WHERE category = 'src3' AND content LIKE '%ou%' AND tenant <> 'de'""", "v_knowledge"))
def filter_predicates(spark, sf_dir):
    kb = V.v_knowledge(spark, sf_dir, vectors=False)
    return kb.filter((F.col("category") == "src3") & F.col("content").like("%ou%") & (F.col("tenant") != "de")) \
             .select("id", "category", "tenant")


@register("pack_token_budget", """
SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS est_tokens, length(text) // 4 > 4000 AS truncated,
  CASE WHEN length(text) // 4 <= 4000 THEN text
       ELSE substr(text, 1, 15800) || chr(10) || chr(10) || '[Truncated: showing ~4000 of ~'
            || (length(text) // 4) || ' tokens. Narrow your query for complete results.]' END AS packed
FROM documents""")
def pack_token_budget(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    est = X.estimated_tokens("text")
    return d.select("doc_id", est.alias("est_tokens"), (est > X.TOKEN_BUDGET).alias("truncated"),
                    X.pack_to_budget("text").alias("packed"))


@register("root_cause", sql("""
SELECT CASE WHEN len(c) > 0 THEN regexp_replace(c[-1], '^(.*?)Caused by: (.*)$', '\\1\\2')
            ELSE substr(split_part(traceback, chr(10), 1), 1, 300) END AS root_cause,
       count(*) AS n
FROM (SELECT traceback, regexp_extract_all(traceback, '(?m)^[ \\t]*(Caused by:.*?)[ \\t\\r]*$', 1) AS c FROM v_dlq)
GROUP BY 1""", "v_dlq"))
def root_cause(spark, sf_dir):
    dlq = V.v_dlq(spark, sf_dir)
    return dlq.groupBy(X.root_cause("traceback").alias("root_cause")).agg(F.count("*").alias("n"))
