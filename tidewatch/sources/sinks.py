"""Sinks: derived topics, consumer tables, alert envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_messages(df: DataFrame, key_col: str, topic: str | None = None) -> DataFrame:
    """Rows -> ``(topic, key, value)`` with the whole row as a JSON object."""
    cols = [F.lit(topic).alias("topic")] if topic else []
    return df.select(*cols, F.col(key_col).cast("string").alias("key"),
                     F.to_json(F.struct(*df.columns)).alias("value"))


def write_messages(df: DataFrame, path: str | None = None, kafka_bootstrap: str | None = None,
                   topic: str | None = None) -> None:
    """Batch write of keyed JSON messages to Kafka or to a parquet topic folder."""
    if kafka_bootstrap:
        df.select("key", "value").write.format("kafka") \
            .option("kafka.bootstrap.servers", kafka_bootstrap).option("topic", topic).save()
    else:
        df.write.mode("append").parquet(path)


def stream_messages(df: DataFrame, checkpoint: str, path: str | None = None, kafka_bootstrap: str | None = None,
                    topic: str | None = None, key_col: str | None = None, **trigger):
    """Streaming write of rows as keyed JSON messages to Kafka or to a parquet topic folder: the started
    query.  ``key_col`` turns plain rows into messages first; ``trigger`` as in ``DataStreamWriter.trigger``."""
    messages = to_messages(df, key_col, topic) if key_col else df
    out = messages.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if trigger:
        out = out.trigger(**trigger)
    if kafka_bootstrap:
        # a topic column of the messages decides; without one the option does
        out = out.format("kafka").option("kafka.bootstrap.servers", kafka_bootstrap)
        return (out if "topic" in messages.columns else out.option("topic", topic)).start()
    return out.format("parquet").start(path)


def write_batch_idempotent(df: DataFrame, path: str, batch_id: int, partition_cols=()) -> None:
    """Write one micro-batch as ``batch_id=<n>`` partition; a replay of the same
    batch overwrites only its own partition, so retries never duplicate rows."""
    out = df.withColumn("batch_id", F.lit(int(batch_id)))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", *partition_cols).parquet(path))


def table_sink(path: str, partition_cols=()):
    """``foreachBatch`` function writing each micro-batch idempotently."""
    def _write(batch_df: DataFrame, batch_id: int) -> None:
        write_batch_idempotent(batch_df, path, batch_id, partition_cols)
    return _write


def alert_envelope(alerts: DataFrame, cell_id: str, cell_name: str, now: Column | None = None) -> DataFrame:
    """Add ``timestamp, cell_id, cell_name`` to alerts only where missing."""
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    fill = {"timestamp": now, "cell_id": F.lit(cell_id), "cell_name": F.lit(cell_name)}
    out = alerts
    for name, value in fill.items():
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), value))
        else:
            out = out.withColumn(name, value)
    return out
