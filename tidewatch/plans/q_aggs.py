"""§2.4 aggregations over the fixture views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import aggregates as A
from tidewatch.operators import sketches as SK
from tidewatch.plans import views as V
from tidewatch.session import scratch_path
from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql


@register("agg_having", sql("""
SELECT src_ip, application, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes, count(*) AS flows
FROM v_flows GROUP BY src_ip, application HAVING count(*) > 50""", "v_flows"))
def agg_having(spark, sf_dir):
    return A.having(V.v_flows(spark, sf_dir), ["src_ip", "application"],
                    [F.sum("bytes_sent").alias("total_bytes"), F.count("*").alias("flows")],
                    F.col("flows") > 50)


@register("agg_category_counts", sql("""
SELECT category, count(*) AS entries FROM v_knowledge GROUP BY category""", "v_knowledge"))
def agg_category_counts(spark, sf_dir):
    return V.v_knowledge(spark, sf_dir, vectors=False).groupBy("category").agg(F.count("*").alias("entries"))


@register("agg_topic_stats", sql("""
SELECT topic, CASE WHEN starts_with(topic, 'network.') THEN 'source'
                   WHEN starts_with(topic, 'agent.decisions') THEN 'decisions'
                   WHEN starts_with(topic, 'dlq.') THEN 'dlq'
                   WHEN topic IN ('threats.detected', 'traffic.anomalies', 'device.health.scores') THEN 'derived'
                   ELSE 'other' END AS type,
       count(*) AS partitions, CAST(sum(high - low) AS BIGINT) AS messages
FROM (SELECT topic, "partition", max("offset") + 1 AS high, min("offset") AS low FROM v_messages GROUP BY ALL)
GROUP BY topic""", "v_messages"))
def agg_topic_stats(spark, sf_dir):
    return A.topic_stats(V.v_messages(spark, sf_dir))


@register("agg_status_rollup", sql("""
SELECT 'cells' AS metric, count(*) AS value FROM v_cells
UNION ALL SELECT 'active_cells', count(*) FROM v_cells WHERE status = 'active'
UNION ALL SELECT 'consumers', CAST(sum(consumers) AS BIGINT) FROM v_cells WHERE status <> 'terminated'
UNION ALL SELECT 'events_processed', count(*) FROM v_messages""", "v_cells", "v_messages"))
def agg_status_rollup(spark, sf_dir):
    cells = V.v_cells(spark, sf_dir)
    c = cells.agg(F.count("*").alias("cells"),
                  F.count(F.when(F.col("status") == "active", 1)).alias("active_cells"),
                  F.sum(F.when(F.col("status") != "terminated", F.col("consumers"))).alias("consumers"))
    long = c.select(F.explode(F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("value"))
          for n in ("cells", "active_cells", "consumers")])).alias("m")).select("m.*")
    events = V.v_messages(spark, sf_dir, offsets=False).agg(F.count("*").alias("value")) \
        .select(F.lit("events_processed").alias("metric"), "value")
    return long.unionByName(events)


@register("agg_operator_metrics", sql("""
SELECT job, count(*) AS vertices, CAST(sum(read_records) AS BIGINT) AS total_read_records,
       CAST(sum(write_records) AS BIGINT) AS total_write_records,
       CAST(sum(read_bytes) AS BIGINT) AS total_read_bytes, CAST(sum(write_bytes) AS BIGINT) AS total_write_bytes
FROM v_metrics GROUP BY job""", "v_metrics"))
def agg_operator_metrics(spark, sf_dir):
    m = V.v_metrics(spark, sf_dir)
    return m.groupBy("job").agg(F.count("*").alias("vertices"),
                                *[F.sum(c).alias("total_" + c) for c in
                                  ("read_records", "write_records", "read_bytes", "write_bytes")])


@register("agg_distinct_exact", sql("""
SELECT time_bucket(INTERVAL 1 DAY, event_time) AS window_start, src_ip,
       count(DISTINCT dst_port) AS distinct_ports, count(DISTINCT dst_ip) AS distinct_targets
FROM v_flows GROUP BY ALL""", "v_flows"))
def agg_distinct_exact(spark, sf_dir):
    fl = V.v_flows(spark, sf_dir)
    return fl.groupBy(F.window("event_time", "1 day").start.alias("window_start"), "src_ip").agg(
        A.distinct_count("dst_port").alias("distinct_ports"),
        A.distinct_count("dst_ip").alias("distinct_targets"))


APPROX_BOUND = 0.1     # share of the exact count that the sketch (5 % standard error) may be off here


@register("agg_distinct_approx", sql("""
SELECT dst_ip, count(DISTINCT src_ip) AS sources, count(DISTINCT event_id) AS flows, true AS within_bound
FROM v_flows GROUP BY dst_ip""", "v_flows"))
def agg_distinct_approx(spark, sf_dir):
    """The HyperLogLog++ sketch beside the exact counts, and whether it is within its bound."""
    fl = V.v_flows(spark, sf_dir)
    both = fl.groupBy("dst_ip").agg(
        A.distinct_count("src_ip").alias("sources"), A.distinct_count("event_id").alias("flows"),
        A.distinct_count("src_ip", approx=True).alias("_s"), A.distinct_count("event_id", approx=True).alias("_f"))
    near = lambda a, e: F.abs(F.col(a) - F.col(e)) <= APPROX_BOUND * F.col(e)
    return both.select("dst_ip", "sources", "flows", (near("_s", "sources") & near("_f", "flows")).alias("within_bound"))


@register("agg_sketch_rollup", sql("""
SELECT time_bucket(INTERVAL 1 DAY, event_time) AS window_start, dst_ip, count(*) AS n,
       count(DISTINCT src_ip) AS src_ip_distinct, round(avg(bytes_sent), 4) AS bytes_sent_mean
FROM v_flows GROUP BY ALL""", "v_flows"))
def agg_sketch_rollup(spark, sf_dir):
    """Hourly sketches, stored and rolled up to days: distinct sources and mean volume a destination.  The
    sketch is exact for sets as small as a day's sources are here."""
    path = scratch_path(spark, f"sketches/{uuid.uuid4().hex}")
    SK.window_sketches(V.v_flows(spark, sf_dir), "event_time", "1 hour", ["dst_ip"], ["src_ip"], ["bytes_sent"]).write.parquet(path)
    days = SK.estimates(SK.roll_up(spark.read.parquet(path), "1 day", ["dst_ip"]), percentiles=())
    return days.select("window_start", "dst_ip", "n", "src_ip_distinct", F.round("bytes_sent_mean", 4).alias("bytes_sent_mean"))


@register("agg_baseline", sql("""
SELECT src_ip, count(*) AS n, round(avg(bytes_sent), 4) AS mean, round(stddev_pop(bytes_sent), 4) AS stddev,
       list_sort(list(bytes_sent))[greatest(CAST(ceil(0.5 * count(*)) AS BIGINT), 1)] AS p50,
       list_sort(list(bytes_sent))[greatest(CAST(ceil(0.95 * count(*)) AS BIGINT), 1)] AS p95
FROM v_flows GROUP BY src_ip""", "v_flows"))
def agg_baseline(spark, sf_dir):
    return A.baseline(V.v_flows(spark, sf_dir), ["src_ip"], "bytes_sent")


@register("agg_json_objects", sql("""
SELECT src_ip, to_json(list(struct_pack(dst_port := dst_port, flows := flows) ORDER BY rn))::VARCHAR AS top_dst_ports
FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY flows DESC, dst_port) AS rn
      FROM (SELECT src_ip, dst_port, count(*) AS flows FROM v_flows GROUP BY ALL))
WHERE rn <= 3 GROUP BY src_ip""", "v_flows"))
def agg_json_objects(spark, sf_dir):
    return A.top_values_json(V.v_flows(spark, sf_dir), "src_ip", "dst_port", 3)
