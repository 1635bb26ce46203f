"""§2.10 pipeline audit, decision log and panels over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import audit as AU
from tidewatch.plans import views as V
from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql


LINEAGE_CTES = (
    ("ins", "SELECT cell_id, unnest(source_topics) AS topic, consumer_id FROM v_registry"),
    ("outs", """SELECT cell_id, output_topic AS topic, consumer_id, runtime FROM v_registry
                WHERE output_topic IS NOT NULL AND output_topic <> ''"""),
    ("in_t", "SELECT DISTINCT cell_id, topic FROM ins"),
    ("out_t", "SELECT DISTINCT cell_id, topic FROM outs"),
    ("writers", "SELECT cell_id, topic, count(*) AS n FROM outs GROUP BY ALL HAVING count(*) > 1"),
    ("findings", """
  SELECT cell_id, 'external_source' AS kind, topic, CAST(NULL AS BIGINT) AS consumer_id, CAST(NULL AS BIGINT) AS n
  FROM (SELECT * FROM in_t EXCEPT SELECT * FROM out_t)
  UNION ALL SELECT cell_id, 'intermediate', topic, NULL, NULL FROM (SELECT * FROM in_t INTERSECT SELECT * FROM out_t)
  UNION ALL SELECT o.cell_id, 'unwired_output', o.topic, o.consumer_id, NULL FROM outs o
    WHERE o.runtime = 'flink_sql' AND NOT EXISTS (SELECT 1 FROM in_t i WHERE i.cell_id = o.cell_id AND i.topic = o.topic)
  UNION ALL SELECT i.cell_id, 'orphan_input', i.topic, i.consumer_id, NULL FROM ins i
    WHERE i.topic NOT IN ('t0', 't1', 't2')
      AND NOT EXISTS (SELECT 1 FROM out_t o WHERE o.cell_id = i.cell_id AND o.topic = i.topic)
  UNION ALL SELECT o.cell_id, 'shared_output', o.topic, o.consumer_id, w.n FROM outs o JOIN writers w USING (cell_id, topic)"""),
    ("warn", """SELECT cell_id, count(*) AS w FROM findings WHERE kind IN ('unwired_output', 'orphan_input') GROUP BY cell_id
         UNION ALL SELECT cell_id, count(*) FROM writers GROUP BY cell_id"""),
)


@register("lineage_audit", sql("""
SELECT * FROM findings
UNION ALL
SELECT c.cell_id, CASE WHEN coalesce(sum(w.w), 0) = 0 THEN 'healthy' ELSE 'unhealthy' END, NULL, NULL,
       CAST(coalesce(sum(w.w), 0) AS BIGINT)
FROM (SELECT DISTINCT cell_id FROM v_registry) c LEFT JOIN warn w USING (cell_id) GROUP BY c.cell_id""", "v_registry",
    ctes=LINEAGE_CTES))
def lineage_audit(spark, sf_dir):
    return AU.lineage(V.v_registry(spark, sf_dir), V.KNOWN_SOURCES)


HEALTH_SQL = """
SELECT r.consumer_id, r.runtime,
  CASE WHEN r.runtime = 'flink_sql' AND j.state IS NULL THEN 'no_job'
       WHEN r.runtime = 'flink_sql' AND j.state IN ('FAILED', 'CANCELED') THEN 'failed'
       WHEN r.runtime = 'flink_sql' AND coalesce(j.records_in, 0) = 0 THEN 'no_records'
       WHEN r.runtime = 'flink_sql' THEN 'healthy'
       WHEN coalesce(d.errors, 0) > 0 THEN 'dlq_errors'
       WHEN coalesce(e.events_processed, 0) = 0 THEN 'no_events'
       ELSE 'healthy' END AS status,
  CAST(coalesce(j.records_in, 0) AS BIGINT) AS records_in,
  CAST(coalesce(e.events_processed, 0) AS BIGINT) AS events_processed,
  CAST(coalesce(d.errors, 0) AS BIGINT) AS errors
FROM v_registry r
LEFT JOIN (SELECT job, sum(read_records) AS records_in,
                  CASE WHEN job % 17 = 0 THEN 'FAILED' ELSE 'RUNNING' END AS state
           FROM v_metrics GROUP BY job) j ON j.job = r.consumer_id % 120
LEFT JOIN (SELECT consumer_id, count(*) AS errors FROM v_dlq GROUP BY consumer_id) d ON d.consumer_id = r.consumer_id % 10
LEFT JOIN (SELECT CAST(key AS BIGINT) AS k, count(*) AS events_processed FROM v_messages GROUP BY key) e
  ON e.k = r.consumer_id % 200"""


@register("pipeline_health", sql(HEALTH_SQL, "v_registry", "v_metrics", "v_dlq", "v_messages"))
def pipeline_health(spark, sf_dir):
    """Consumers of the registry joined with job metrics, DLQ and input counts.
    Fixture wiring: job id = consumer % 120, DLQ key = consumer % 10,
    input key = consumer % 200; a job whose id is a multiple of 17 has FAILED."""
    reg = V.v_registry(spark, sf_dir)
    consumers = reg.select("consumer_id", "runtime", (F.col("consumer_id") % 120).alias("job_id"),
                           (F.col("consumer_id") % 10).alias("dlq_key"), (F.col("consumer_id") % 200).alias("event_key"))
    jobs = V.v_metrics(spark, sf_dir).groupBy(F.col("job").alias("job_id")).agg(
        F.sum("read_records").alias("records_in")) \
        .select("*", F.when(F.col("job_id") % 17 == 0, "FAILED").otherwise("RUNNING").alias("state"))
    dlq = V.v_dlq(spark, sf_dir).groupBy(F.col("consumer_id").alias("dlq_key")).agg(F.count("*").alias("errors"))
    ev = V.v_messages(spark, sf_dir, offsets=False).groupBy(F.col("key").cast("bigint").alias("event_key")) \
        .agg(F.count("*").alias("events_processed"))
    return AU.consumer_health(consumers, jobs, dlq, ev)


@register("decision_log_query", sql("""
SELECT cell_id, conv_id, turn, type, message, rn FROM (
  SELECT cell_id, conv_id, turn, coalesce(entry_type, decision_type) AS type, substr(message, 1, 150) AS message,
         row_number() OVER (PARTITION BY cell_id ORDER BY conv_id DESC, turn DESC) AS rn
  FROM v_decisions WHERE entry_type = 'assistant' OR decision_type = 'assistant') WHERE rn <= 20""", "v_decisions"))
def decision_log_query(spark, sf_dir):
    return AU.decision_query(V.v_decisions(spark, sf_dir), "assistant", last=20)


@register("decision_log_rollup", sql("""
SELECT cell_id, entry_type, count(*) AS entries, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens
FROM v_decisions GROUP BY ALL""", "v_decisions"))
def decision_log_rollup(spark, sf_dir):
    return AU.decision_rollup(V.v_decisions(spark, sf_dir))


@register("registry_list", sql("""
SELECT cell_id, name, CASE WHEN length(directive) > 80 THEN substr(directive, 1, 80) || '...' ELSE directive END
         AS directive, status, created_at, consumers
FROM v_cells WHERE status <> 'terminated'""", "v_cells"))
def registry_list(spark, sf_dir):
    return AU.registry_list(V.v_cells(spark, sf_dir))


@register("panel_snapshot", sql("""
SELECT application AS label, count(*) AS series_1, CAST(sum(bytes_sent) AS BIGINT) AS series_2
FROM v_flows GROUP BY application""", "v_flows"))
def panel_snapshot(spark, sf_dir):
    per_app = V.v_flows(spark, sf_dir).groupBy("application").agg(
        F.count("*").alias("flows"), F.sum("bytes_sent").alias("bytes"))
    return AU.panel_snapshot(per_app, "application", ["flows", "bytes"])


@register("panel_append", sql("""
SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS ts, count(*) AS flows FROM v_flows
               GROUP BY 1 ORDER BY ts DESC LIMIT 100)""", "v_flows"))
def panel_append(spark, sf_dir):
    hourly = V.v_flows(spark, sf_dir).groupBy(F.window("event_time", "1 hour").start.alias("ts")) \
        .agg(F.count("*").alias("flows"))
    return AU.panel_append(hourly, "ts", 100)
