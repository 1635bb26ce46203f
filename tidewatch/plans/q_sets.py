"""§2.6 sort, limit, top-k, set operations and dedupe over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import windows as W
from tidewatch.operators.search import dedupe_recent
from tidewatch.plans import views as V
from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql


@register("topk_order_limit", sql("""
SELECT src_ip, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes FROM v_flows
GROUP BY src_ip ORDER BY total_bytes DESC, src_ip LIMIT 10""", "v_flows"))
def topk_order_limit(spark, sf_dir):
    # orderBy + limit plans as TakeOrderedAndProject: a per-task top-k, then a merge of k rows per task.
    fl = V.v_flows(spark, sf_dir)
    return fl.groupBy("src_ip").agg(F.sum("bytes_sent").alias("total_bytes")) \
             .orderBy(F.col("total_bytes").desc(), "src_ip").limit(10)


@register("tail_log", sql("""
SELECT topic, "partition", "offset", "timestamp", key, value, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY "timestamp" DESC, "partition" DESC, "offset" DESC) AS rn
  FROM v_messages) WHERE rn <= 5""", "v_messages"))
def tail_log(spark, sf_dir, n=5):
    """Most recent n messages of every topic (true most-recent-N over all partitions)."""
    msgs = V.v_messages(spark, sf_dir).select("topic", "partition", "offset", "timestamp", "key", "value")
    return W.ranked_tail(msgs, ["topic"], ["timestamp", "partition", "offset"], n)


@register("set_union_streams", sql("""
SELECT 'flows' AS family, event_id, event_time, src_ip AS ip FROM v_flows
UNION ALL SELECT 'syslog', event_id, event_time, source_ip FROM v_syslog WHERE severity <> 'info'""",
                                   "v_flows", "v_syslog"))
def set_union_streams(spark, sf_dir):
    fl = V.v_flows(spark, sf_dir).select(F.lit("flows").alias("family"), "event_id", "event_time",
                                         F.col("src_ip").alias("ip"))
    sl = V.v_syslog(spark, sf_dir).filter(F.col("severity") != "info").select(
        F.lit("syslog").alias("family"), "event_id", "event_time", F.col("source_ip").alias("ip"))
    return fl.unionByName(sl)


def topic_sets(registry):
    inputs = registry.select(F.explode("source_topics").alias("topic")).distinct()
    outputs = registry.select(F.col("output_topic").alias("topic")).distinct()
    return (inputs.subtract(outputs).select("topic", F.lit("external_source").alias("relation"))
            .unionByName(outputs.intersect(inputs).select("topic", F.lit("intermediate").alias("relation")))
            .unionByName(outputs.subtract(inputs).select("topic", F.lit("unconsumed_output").alias("relation"))))


@register("set_topic_algebra", sql("""
SELECT topic, 'external_source' AS relation FROM (SELECT unnest(source_topics) AS topic FROM v_registry
  EXCEPT SELECT output_topic FROM v_registry)
UNION ALL SELECT topic, 'intermediate' FROM (SELECT output_topic AS topic FROM v_registry
  INTERSECT SELECT unnest(source_topics) FROM v_registry)
UNION ALL SELECT topic, 'unconsumed_output' FROM (SELECT output_topic AS topic FROM v_registry
  EXCEPT SELECT unnest(source_topics) FROM v_registry)""", "v_registry"))
def set_topic_algebra(spark, sf_dir):
    return topic_sets(V.v_registry(spark, sf_dir))


@register("dedup_recent_prefix", sql("""
SELECT id, category, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY substr(content, 1, 100) ORDER BY created_at DESC, id) AS rn
  FROM v_knowledge) WHERE rn = 1""", "v_knowledge"))
def dedup_recent_prefix_q(spark, sf_dir):
    kb = V.v_knowledge(spark, sf_dir, vectors=False).select("id", "content", "category", "created_at",
                                             F.col("id").alias("rank"))
    return dedupe_recent(kb, qid=None, key_order=False).select("id", "category", "created_at")


@register("dedup_events", sql("""
SELECT DISTINCT topic, "partition", "offset", event_id FROM v_messages""", "v_messages"))
def dedup_events(spark, sf_dir):
    """A redelivered topic (network.error read twice) deduplicated on the envelope id."""
    msgs = V.v_messages(spark, sf_dir).select("topic", "partition", "offset", "event_id")
    redelivered = msgs.unionByName(msgs.filter(F.col("topic") == "network.error"))
    return redelivered.dropDuplicates(["topic", "partition", "offset"])
