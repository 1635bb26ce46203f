"""Structured Streaming runners: the batch transforms over a stream.

Topics are folders of envelope parquet files in tests (the Kafka connector
is a thin option-driven branch of ``sources.events.read_kafka``).  Event
time is cast to TIMESTAMP for ``withWatermark`` (it rejects NTZ) and back
to NTZ on output; the session time zone is UTC, so wall clocks are equal.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import windows as W
from tidewatch.session import scratch_path
from tidewatch.sources import events as E


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared checkpoint directory."""
    return scratch_path(spark, f"{kind}/{uuid.uuid4().hex}")


def flow_stream(spark: SparkSession, topic_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    msgs = E.read_topic_files(spark, topic_path, streaming=True, max_files_per_trigger=max_files_per_trigger)
    flows = E.decode(msgs, E.FLOW_SCHEMA)
    return flows.withColumn("event_time", F.col("event_time").cast("timestamp"))


def flow_summary_stream(flows: DataFrame, size: str = "1 minute", delay: str = "5 seconds",
                        min_flows: int = 50) -> DataFrame:
    """The flagship job as a stream: watermark, tumbling window, HAVING; NTZ output."""
    agg = W.tumble(W.with_watermark(flows, "event_time", delay), "event_time", size, ["src_ip"],
                   [F.sum("bytes_sent").alias("total_bytes"), F.count("*").alias("flow_count")],
                   having=F.col("flow_count") > min_flows)
    return agg.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      "src_ip", "total_bytes", "flow_count")


def _finish(q: StreamingQuery, timeout_s: float | None) -> StreamingQuery:
    """Wait for the query's end (for ever, unless a limit is asked for) and keep every progress
    entry: Spark itself remembers only the last hundred, so they are gathered while it runs."""
    import time

    seen: dict = {}
    began = time.monotonic()
    while True:
        ended = q.awaitTermination(0.2)
        for p in q.recentProgress:
            seen[(p.runId, p.batchId, p.timestamp)] = p
        if ended:
            break
        if timeout_s is not None and time.monotonic() - began > timeout_s:
            q.stop()
            raise TimeoutError("streaming query did not finish")
    if q.exception():
        raise q.exception()
    q.all_progress = list(seen.values())
    return q


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, output_mode: str = "append",
                      fmt: str = "parquet", timeout_s: float | None = None) -> StreamingQuery:
    """Process everything available now, then stop; the checkpoint keeps offsets
    and state, so a later call resumes exactly where this one ended (file
    sinks are exactly-once)."""
    return _finish(df.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).start(sink_path), timeout_s)


def run_foreach_batch(df: DataFrame, fn, checkpoint: str, output_mode: str = "append",
                      timeout_s: float | None = None) -> StreamingQuery:
    return _finish(df.writeStream.foreachBatch(fn).outputMode(output_mode).option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).start(), timeout_s)


def progress_of(q: StreamingQuery) -> list:
    return getattr(q, "all_progress", None) or q.recentProgress


def dropped_by_watermark(q: StreamingQuery) -> int:
    """Late rows dropped by the stateful operators, summed over the run's progress."""
    return sum(op.numRowsDroppedByWatermark for p in progress_of(q) for op in p.stateOperators)


def observe_counters(df: DataFrame, name: str, alert_flag=None, time_col: str = "event_time") -> DataFrame:
    """Per-batch consumer counters as observed metrics (events in, alerts out,
    last event time); they surface in each progress' ``observedMetrics``."""
    flag = alert_flag if alert_flag is not None else F.lit(False)
    return df.observe(name, F.count(F.lit(1)).alias("events_in"),
                      F.count(F.when(flag, 1)).alias("alerts_out"),
                      F.max(time_col).alias("last_event_time"))


def observed_totals(q: StreamingQuery, name: str) -> dict:
    """Sum of a query's observed counters over all its progress."""
    events = alerts = 0
    last = None
    for p in progress_of(q):
        row = p.observedMetrics.get(name)
        if row is None:
            continue
        events += row["events_in"] or 0
        alerts += row["alerts_out"] or 0
        if row["last_event_time"] is not None and (last is None or row["last_event_time"] > last):
            last = row["last_event_time"]
    return {"events_in": events, "alerts_out": alerts, "last_event_time": last}


def dlq_sink(good_path: str, dlq_path: str, split):
    """``foreachBatch`` writing good rows and dead letters of one micro-batch
    (``split(df) -> (good, bad)``), each as its own ``batch_id`` partition so a
    replayed batch overwrites instead of duplicating."""
    from tidewatch.sources.sinks import write_batch_idempotent

    def _write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.persist()
        try:
            good, bad = split(batch_df)
            write_batch_idempotent(good, good_path, batch_id)
            write_batch_idempotent(bad, dlq_path, batch_id)
        finally:
            batch_df.unpersist()
    return _write


def knowledge_ingest_sink(path: str, text_col: str = "content"):
    """``foreachBatch`` form of ``store()``: chunk and embed each micro-batch,
    append it as its own ``batch_id`` partition (under ``tenant``), so a
    replayed batch replaces itself."""
    from tidewatch.functions.text import chunks, embed_udf
    from tidewatch.sources.sinks import write_batch_idempotent

    def _write(batch_df: DataFrame, batch_id: int) -> None:
        keep = [c for c in batch_df.columns if c != text_col]
        pieces = batch_df.select(*keep, F.posexplode(chunks(text_col)).alias("chunk_no", "content"))
        rows = pieces.select("*", embed_udf()("content").alias("embedding"))
        write_batch_idempotent(rows, path, batch_id, partition_cols=("tenant",))
    return _write
