"""Streaming keys: watermark lateness and checkpoint resume, run as real
Structured Streaming queries over the flow topic written as message files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql
from tidewatch.plans.q_sources import flow_messages
from tidewatch.streaming import runner as R

CUT = "2024-01-16 00:00:00"

CLOSED_SQL = """
SELECT ws AS window_start, ws + INTERVAL 1 DAY AS window_end, src_ip, total_bytes, flow_count
FROM summary WHERE ws + INTERVAL 1 DAY <= (SELECT max(event_time) FROM {src}) - INTERVAL 1 HOUR {extra}"""

SUMMARY_SQL = """
SELECT time_bucket(INTERVAL 1 DAY, event_time) AS ws, src_ip,
       CAST(sum(bytes_sent) AS BIGINT) AS total_bytes, count(*) AS flow_count
FROM {src} GROUP BY ALL HAVING count(*) > 12"""


def _two_runs(spark, sf_dir, first, second):
    """Write ``first`` messages, run the stream, append ``second``, resume from the checkpoint."""
    src, out, ck = R.fresh_dir(spark, "topics"), R.fresh_dir(spark, "sinks"), R.fresh_dir(spark, "checkpoints")
    first.write.parquet(src)
    queries = []
    for part in (None, second):
        if part is not None:
            part.write.mode("append").parquet(src)
        stream = R.flow_summary_stream(R.flow_stream(spark, src), size="1 day", delay="1 hour", min_flows=12)
        queries.append(R.run_available_now(stream, out, ck))
    return spark.read.parquet(out), queries


@register("resume_checkpoint", sql(CLOSED_SQL.format(src="v_flows", extra=""), "v_flows",
                                   ctes=(("summary", SUMMARY_SQL.format(src="v_flows")),)))
def resume_checkpoint(spark, sf_dir):
    """Half the topic, stop, the rest from the same checkpoint: equals one run
    (all windows closed by the 1-hour watermark)."""
    msgs = flow_messages(spark, sf_dir)
    cut = F.lit(CUT).cast("timestamp_ntz")
    early = msgs.filter(F.col("timestamp").isNull() | (F.col("timestamp") < cut))
    late = msgs.filter(F.col("timestamp") >= cut)
    result, _ = _two_runs(spark, sf_dir, early, late)
    return result


@register("win_watermark_late", sql(CLOSED_SQL.format(src="v_flows", extra=""), "v_flows",
                                    ctes=(("later", f"SELECT * FROM v_flows WHERE event_time >= TIMESTAMP '{CUT}'"),
                                          ("summary", SUMMARY_SQL.format(src="later")))))
def win_watermark_late(spark, sf_dir):
    """The second half of the month arrives first; the first half then comes
    later than the watermark and is dropped (``numRowsDroppedByWatermark``)."""
    msgs = flow_messages(spark, sf_dir)
    cut = F.lit(CUT).cast("timestamp_ntz")
    later = msgs.filter(F.col("timestamp") >= cut)
    earlier = msgs.filter(F.col("timestamp").isNull() | (F.col("timestamp") < cut))
    result, _ = _two_runs(spark, sf_dir, later, earlier)
    return result
