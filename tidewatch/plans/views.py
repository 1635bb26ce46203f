"""Fixture views over the driver tables (FIXTURES.md §3), as Spark plans.

Each view is a pure DataFrame expression of one or two driver tables, so its
work grows with them.  The DuckDB twins used by the oracles live in
``tidewatch.plans.oracle_views`` and must stay row-for-row equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tables import load
from tidewatch.operators.numbering import sequence_number


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def v_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    h = F.col("user_id") % 30
    is_err = F.col("event_type") == "error"
    third = F.col("event_id") % 3 == 0
    src_ip = F.when(is_err, F.concat(F.lit("198.51.100."), _s(F.col("user_id") % 8 + 1))) \
        .otherwise(F.concat(F.lit("10.0."), _s(h % 3 + 1), F.lit("."), _s(h + 10)))
    dst_ip = F.when(is_err | third, F.concat(F.lit("10.0.2."), _s(F.col("event_id") % 4 + 10))) \
        .otherwise(F.concat(F.lit("203.0.113."), _s(F.col("event_id") % 6 + 1)))
    bytes_sent = F.floor(F.col("value") * 1000).cast("bigint")
    return ev.select(
        "event_id",
        "user_id",
        F.col("ts").alias("event_time"),
        src_ip.alias("src_ip"),
        dst_ip.alias("dst_ip"),
        F.when((F.col("event_type") == "view") & third, F.lit(22).cast("bigint"))
         .otherwise(F.col("event_id") * 7919 % 1024).alias("dst_port"),
        bytes_sent.alias("bytes_sent"),
        F.when(is_err, F.lit(0).cast("bigint")).otherwise(bytes_sent.cast("bigint") / 2)
         .cast("bigint").alias("bytes_received"),
        (_k() + 1).alias("packets"),
        F.col("event_type").alias("application"),
        (F.col("event_id") % 20).alias("device_id"),
        F.when(is_err, "inbound").when(third, "internal").otherwise("outbound").alias("direction"),
    )


SYSLOG_TYPES = {  # fixed values: event_type of the driver table -> syslog event type
    "error": "auth_failure",
    "click": "firewall_allow",
    "view": "auth_success",
    "signup": "vpn_connect",
    "purchase": "firewall_deny",
}


def v_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    fl = v_flows(spark, sf_dir)
    et = F.col("application")
    mapped = F.lit(None).cast("string")
    for source_type, syslog_type in reversed(list(SYSLOG_TYPES.items())):
        mapped = F.when(et == source_type, syslog_type).otherwise(mapped)
    out = fl.select("event_id", "user_id", "event_time", mapped.alias("event_type"),
                    F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("destination_ip"))
    return out.select(
        "*",
        F.when(F.col("event_type") == "auth_failure", "error")
         .when(F.col("event_type") == "firewall_deny", "warning").otherwise("info").alias("severity"),
        F.when(F.col("event_type") == "firewall_allow", "allow")
         .when(F.col("event_type") == "firewall_deny", "deny").otherwise("info").alias("action"),
        F.concat_ws(" ", "event_type", "source_ip", F.lit("->"), "destination_ip").alias("message"),
    )


def v_device_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("*", _k().alias("_k"))   # props parsed once
    k = F.col("_k")
    iface = F.transform(
        F.sequence(F.lit(0), F.lit(5)),
        lambda i: F.struct(
            F.concat(F.lit("eth"), i.cast("string")).alias("name"),
            F.when((F.col("event_id") + i) % 20 == 0, "down").otherwise("up").alias("status"),
            F.lit(1000).alias("speed_mbps"),
            ((F.col("event_id") * 7 + i * 13) % 100).cast("double").alias("utilization_percent"),
            F.lit(0).alias("errors_in"),
            F.lit(0).alias("errors_out"),
        ))
    # Text timestamps in the two formats the device producer uses.
    ts_text = F.when(F.col("event_id") % 2 == 0,
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return ev.select(
        "event_id",
        F.col("ts").alias("event_time"),
        ts_text.alias("timestamp"),
        (F.col("user_id") % 20).alias("device_id"),
        F.least(F.col("value") / 4, F.lit(99.0)).alias("cpu_percent"),
        k.cast("double").alias("memory_percent"),
        F.when((F.col("event_type") == "error") & (k < 10), "offline").otherwise("online").alias("status"),
        F.when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd"))
         .alias("last_config_change"),
        (F.lit(30) + k % 50).cast("double").alias("temperature_celsius"),
        iface.alias("interfaces"),
    )


def v_devices(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """Device inventory: 20 rows, ids 0-19, literals of our own."""
    i = F.col("id")
    return spark.range(20).select(
        i.alias("device_id"),
        F.when(i % 4 == 0, "firewall").when(i % 4 == 1, "switch").when(i % 4 == 2, "router")
         .otherwise("access_point").alias("device_type"),
        F.when(i % 3 == 0, "Acme").when(i % 3 == 1, "Northwind").otherwise("Globex").alias("manufacturer"),
        F.concat(F.lit("M-"), _s(i + 100)).alias("model"),
        F.concat(F.lit("1."), _s(i % 5), F.lit(".0")).alias("firmware_version"),
        F.concat(F.lit("10.0."), _s(i % 3 + 1), F.lit("."), _s(i + 1)).alias("ip_address"),
        F.concat(F.lit("rack-"), _s(F.floor(i / 5))).alias("location"),
        F.when(i % 4 == 3, F.lit(None)).otherwise((i % 3 + 1) * 100).cast("int").alias("vlan_id"),
    )


def v_messages(spark: SparkSession, sf_dir: str, offsets: bool = True) -> DataFrame:
    """Topic log envelope. Offsets are dense per (topic, partition) by (ts, event_id); jobs that
    read no offsets leave them out and so need no numbering."""
    ev = load(spark, sf_dir, "events")
    base = ev.select(
        F.concat(F.lit("network."), F.col("event_type")).alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("ts").alias("timestamp"),
        "event_id",
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
    )
    if not offsets:
        return base
    return sequence_number(base, ["topic", "partition"], ["timestamp", "event_id"], "offset")


def v_knowledge(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Every document as an entry; those without an embedding have a null vector.  Jobs that read
    no vectors leave them out, and with them the join."""
    docs = load(spark, sf_dir, "documents")
    created = F.expr("timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    if vectors:
        emb = load(spark, sf_dir, "embeddings")
        docs = docs.join(emb, docs.doc_id == emb.vec_id, "left")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("category"),
        F.col("lang").alias("tenant"),
        *(["embedding"] if vectors else []),
        F.concat(F.lit('{"ip":"10.0.'), _s(F.col("doc_id") % 3 + 1), F.lit("."), _s(F.col("doc_id") % 30 + 10),
                 F.lit('","source":"'), F.col("source"), F.lit('"}')).alias("metadata"),
        created.alias("created_at"),
        F.when(F.col("doc_id") % 4 == 0, F.expr("timestampadd(DAY, 1, timestampadd(MINUTE, doc_id, "
                                                  "TIMESTAMP_NTZ'2024-01-01 00:00:00'))"))
         .alias("expires_at"),
    )


def v_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of search queries: every benchmark passage, whole, with the vector of its id."""
    items, emb = load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "embeddings")
    return items.join(emb, items.item_id == emb.vec_id, "left").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query_text"), F.col("embedding").alias("query_vec"))


def v_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    k = _k()
    n = F.col("event_id") % 3
    tb = F.concat(
        F.lit("Traceback (most recent call last):\n  File consumer, in process_event\n"),
        F.col("event_type"), F.lit("Error: failed on event "), _s("event_id"),
        F.when(n >= 1, F.concat(F.lit("\n  at stage_a\nCaused by: IOError: link "), _s(F.col("event_id") % 7)))
         .otherwise(F.lit("")),
        F.when(n >= 2, F.concat(F.lit("\n  at stage_b\nCaused by: ConnectError: port "),
                                _s(F.col("event_id") % 11))).otherwise(F.lit("")),
    )
    return ev.filter(k < 5).select(
        F.col("ts").alias("timestamp"),
        (F.col("user_id") % 5).alias("cell_id"),
        (F.col("user_id") % 6).alias("consumer_id"),
        F.concat(F.col("event_type"), F.lit(" failed on event "), _s("event_id")).alias("error"),
        F.col("event_type").alias("error_type"),
        tb.alias("traceback"),
        F.col("props").alias("event"),
        "event_id",
    )


def v_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = load(spark, sf_dir, "conversations")
    ntok = F.floor(F.length("text") / 4).cast("bigint")
    return cv.select(
        "conv_id", "turn",
        (F.col("conv_id") % 5).alias("cell_id"),
        F.col("role").alias("entry_type"),
        F.when(F.col("role") == "assistant", "reply").otherwise("message").alias("decision_type"),
        F.col("text").alias("message"),
        ntok.alias("input_tokens"),
        F.when(F.col("role") == "assistant", ntok).otherwise(F.lit(0).cast("bigint")).alias("output_tokens"),
    )


def _topic(c: Column) -> Column:
    return F.concat(F.lit("t"), _s(c))


def v_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("consumer_id"),
        (key % 100).alias("cell_id"),
        F.array(_topic(key % 97), _topic(key * 7 % 111 + 100)).alias("source_topics"),
        _topic(key * 31 % 220 + 40).alias("output_topic"),
        F.when(F.col("p_size") % 2 == 0, "flink_sql").otherwise("python").alias("runtime"),
    )


KNOWN_SOURCES = ("t0", "t1", "t2")  # fixed values: external source topics of v_registry


def v_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    reg = v_registry(spark, sf_dir).groupBy("cell_id").agg(F.count("*").alias("consumers"))
    key = F.col("s_suppkey")
    cells = s.select(
        key.alias("cell_id"),
        F.col("s_name").alias("name"),
        F.repeat(F.col("s_name"), 10).alias("directive"),
        F.when(key % 3 == 0, "active").when(key % 3 == 1, "paused").otherwise("terminated").alias("status"),
        F.expr("timestampadd(HOUR, s_suppkey, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"),
    )
    return cells.join(reg, "cell_id", "left").select(
        "cell_id", "name", "directive", "status", "created_at",
        F.coalesce("consumers", F.lit(0).cast("bigint")).alias("consumers"))


def v_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    rr = F.col("l_quantity").cast("bigint")
    return li.select(
        F.col("l_suppkey").alias("job"),
        F.col("l_linenumber").alias("operator"),
        rr.alias("read_records"),
        F.floor(rr / 2).cast("bigint").alias("write_records"),
        F.floor("l_extendedprice").cast("bigint").alias("read_bytes"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint").alias("write_bytes"),
    )
