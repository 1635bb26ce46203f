"""Event-log sources: topic envelope -> typed rows.

A topic is either Kafka (``format="kafka"``, needs the connector jar on the
cluster) or a folder of JSON/parquet message files laid out like the Kafka
envelope (``topic, partition, offset, timestamp, key, value``).  The same
``decode`` runs on a batch or a streaming DataFrame.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.exprs import event_time

ENVELOPE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

# Telemetry schemas (FIXTURES.md §1); field lists of the producers.
FLOW_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.LongType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("bytes_sent", T.LongType()),
    T.StructField("bytes_received", T.LongType()),
    T.StructField("packets", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("application", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("vlan_id", T.IntegerType()),
    T.StructField("direction", T.StringType()),
])

SYSLOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("facility", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("event_type", T.StringType()),
])

INTERFACE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("speed_mbps", T.IntegerType()),
    T.StructField("utilization_percent", T.DoubleType()),
    T.StructField("errors_in", T.IntegerType()),
    T.StructField("errors_out", T.IntegerType()),
])

DEVICE_STATUS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("firmware_version", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("cpu_percent", T.DoubleType()),
    T.StructField("memory_percent", T.DoubleType()),
    T.StructField("temperature_celsius", T.DoubleType()),
    T.StructField("uptime_seconds", T.LongType()),
    T.StructField("interfaces", T.ArrayType(INTERFACE)),
    T.StructField("config_changed", T.BooleanType()),
    T.StructField("last_config_change", T.StringType()),
])


def decode(messages: DataFrame, schema: T.StructType, keep_envelope=("topic", "partition", "offset"),
           time_field: str | None = "timestamp", with_errors: bool = False) -> DataFrame:
    """``from_json(value)`` with an explicit schema.

    Undecodable values (not a JSON object) are dropped, or, with
    ``with_errors=True``, kept with ``_parse_error`` set so the caller can
    route them to a dead-letter sink.  ``event_time`` is derived from the
    text timestamp when ``time_field`` is given.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    # Only values that open a JSON object are parsed; any other line is
    # undecodable without running the parser over it.
    is_object = F.substring(F.ltrim("value", F.lit(" \t\r\n")), 1, 1) == "{"
    parsed = messages.select(*keep_envelope, "value", F.when(is_object, F.from_json(
        "value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).alias("_e"))
    ok = F.col("_e").isNotNull() & F.col("_e._corrupt").isNull()
    fields = [F.col("_e." + f.name).alias(f.name) for f in schema.fields]
    # Rows come out of a generator: projections do not collapse into it and
    # the validity test cannot be pushed below it, so each value is parsed once
    # (a plain select + filter would inline from_json into every field and the filter).
    if with_errors:
        gen = F.inline(F.array(F.struct(*fields, F.col("value").alias("value"), (~ok).alias("_parse_error"))))
    else:
        gen = F.inline(F.when(ok, F.array(F.struct(*fields))))
    out = parsed.select(*keep_envelope, gen)
    if time_field:
        out = out.withColumn("event_time", event_time(time_field))
    return out


def read_topic_files(spark: SparkSession, path: str, streaming: bool = False,
                     fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Envelope rows from message files (the stand-in for a topic)."""
    if streaming:
        r = spark.readStream.schema(ENVELOPE).format(fmt)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.load(path)
    return spark.read.schema(ENVELOPE).format(fmt).load(path)


def read_kafka(spark: SparkSession, bootstrap: str, topics: list[str], streaming: bool,
               starting: str | dict = "latest", ending: str | dict | None = None) -> DataFrame:
    """Kafka topics in the envelope layout (needs the spark-sql-kafka package)."""
    r = (spark.readStream if streaming else spark.read).format("kafka") \
        .option("kafka.bootstrap.servers", bootstrap).option("subscribe", ",".join(topics))
    r = r.option("startingOffsets", starting if isinstance(starting, str) else json.dumps(starting))
    if ending is not None and not streaming:
        r = r.option("endingOffsets", ending if isinstance(ending, str) else json.dumps(ending))
    return r.load().select(
        "topic", "partition", "offset", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _in_partition(topic: str, partition) -> Column:
    return F.col("topic").eqNullSafe(topic) & F.col("partition").eqNullSafe(int(partition))


def offset_range(messages: DataFrame, starting: str | dict = "earliest",
                 ending: str | dict = "latest") -> DataFrame:
    """Bounded replay of an envelope table, with Kafka's offset-spec semantics.

    ``starting``/``ending`` are ``"earliest"``/``"latest"`` or
    ``{topic: {partition: offset}}``; ``-2`` means earliest and ``-1``
    latest.  A batch read from ``"latest"`` holds no rows.  Ending offsets
    are exclusive.  The spec becomes a plain predicate, so it reaches the
    file scan as a pushed filter.  Rows without a topic, partition or offset
    are outside every bound and stay.  On a stream, ``starting="latest"`` is
    the source's affair and no predicate.
    """
    if (starting == "latest" or ending == "earliest") and not messages.isStreaming:
        return messages.limit(0)
    cond = F.lit(True)
    for spec, is_start in ((starting, True), (ending, False)):
        if isinstance(spec, dict):
            for topic, parts in spec.items():
                for part, off in parts.items():
                    if off in (-2, -1):
                        if (off == -1) == is_start:
                            cond = cond & ~_in_partition(topic, part)
                        continue
                    bound = (F.col("offset") >= off) if is_start else (F.col("offset") < off)
                    cond = cond & (~_in_partition(topic, part) | F.coalesce(bound, F.lit(True)))
    return messages.filter(cond)


def union_topics(frames: dict[str, DataFrame]) -> DataFrame:
    """One consumer over several topics with different fields: by-name union plus ``topic``."""
    out = None
    for topic, df in frames.items():
        df = df.select(F.lit(topic).alias("topic"), *df.columns)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_events(spark: SparkSession, source: str, schema: T.StructType, streaming: bool = False,
                start: str | dict = "earliest", end: str | dict = "latest", topics: list[str] | None = None,
                bootstrap: str | None = None, fmt: str = "parquet", with_errors: bool = False) -> DataFrame:
    """Topic(s) -> typed rows, batch or stream, from one definition.

    ``source`` is a Kafka bootstrap list when ``bootstrap`` is set (``topics``
    subscribed, Kafka offset specs for ``start``/``end``), otherwise a folder
    of envelope files (offset specs become predicates; a stream reads the files
    present and new ones, from the ``start`` offsets on).  Undecodable values are dropped, or kept
    with ``_parse_error`` for a dead-letter sink.
    """
    if bootstrap:
        msgs = read_kafka(spark, bootstrap, topics or [source], streaming, start, None if streaming else end)
    else:
        msgs = read_topic_files(spark, source, streaming=streaming, fmt=fmt)
        msgs = offset_range(msgs, start, "latest" if streaming else end)
        if topics:
            msgs = msgs.filter(F.col("topic").isin(*topics))
    return decode(msgs, schema, with_errors=with_errors)
