"""Threat and health detections.

Each rule is a DataFrame transform with its thresholds as parameters.  The
defaults follow the telemetry producers (1-minute windows, 60 s rates, a
30 s poll interval); the registered fixture queries pass day windows.
Windowed rules are grouped aggregates (partial aggregation before the
shuffle); per-device rules use the hot-key-safe helpers of ``windows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import epoch_micros
from tidewatch.operators import windows as W
from tidewatch.operators.aggregates import distinct_count
from tidewatch.operators.joins import interval_join


def port_scan(flows: DataFrame, window: str = "1 minute", min_ports: int = 20,
              streaming: bool = False, keys: tuple[str, ...] = ("src_ip", "dst_ip"),
              min_silent_share: float = 0.0) -> DataFrame:
    """Per source, destination and window: flows that got no bytes back, to >= min_ports distinct
    ports, where they are at least ``min_silent_share`` of the pair's flows."""
    silent = F.col("bytes_received") == 0
    if not min_silent_share:
        flows = flows.filter(silent)          # reaches the scan
    out = W.tumble(flows, "event_time", window, list(keys),
                   [distinct_count(F.when(silent, F.col("dst_port")), streaming).alias("distinct_ports"),
                    F.count(F.when(silent, 1)).alias("flows"), F.count("*").alias("_all")],
                   having=F.col("distinct_ports") >= min_ports)
    return out.filter(F.col("flows") >= F.col("_all") * min_silent_share).drop("_all")


def exfiltration(flows: DataFrame, window: str = "1 minute", min_window_bytes: int = 500_000,
                 min_flow_bytes: int | None = None, baseline_factor: float | None = None,
                 history: int = 7, min_history: int = 3) -> DataFrame:
    """Outbound volume per source and window above a threshold, or one flow above
    ``min_flow_bytes``, or (batch) ``baseline_factor`` times the mean of the source's last
    ``history`` windows, of which there must be ``min_history``.  The baseline reads one row
    per source and window, so a source holds at most (time span / window) rows."""
    out = flows.filter(F.col("direction") == "outbound")
    totals = W.tumble(out, "event_time", window, ["src_ip"],
                      [F.sum("bytes_sent").alias("total_bytes"), F.count("*").alias("flows"),
                       F.max("bytes_sent").alias("max_flow_bytes")])
    cond = F.col("total_bytes") >= min_window_bytes
    if min_flow_bytes is not None:
        cond = cond | (F.col("max_flow_bytes") >= min_flow_bytes)
    if baseline_factor is None:
        return totals.filter(cond)
    past = Window.partitionBy("src_ip").orderBy("window_start").rowsBetween(-history, -1)
    with_past = totals.select("*", F.count("total_bytes").over(past).alias("_n"), F.avg("total_bytes").over(past).alias("_mean"))
    above = (F.col("_n") >= min_history) & (F.col("total_bytes") >= F.col("_mean") * baseline_factor)
    return with_past.filter(cond | above).drop("_n", "_mean")


def lateral_movement(flows: DataFrame, window: str = "3 minutes", min_targets: int = 3,
                     port: int = 22, src_prefix: str = "10.0.3.", dst_prefix: str = "10.0.2.",
                     streaming: bool = False) -> DataFrame:
    """IoT VLAN -> server VLAN on SSH to several targets within a window."""
    hops = flows.filter(F.col("src_ip").startswith(src_prefix) & F.col("dst_ip").startswith(dst_prefix)
                        & (F.col("dst_port") == port))
    if streaming:
        out = W.tumble_distinct(hops, "event_time", window, ["src_ip"], "dst_ip", "targets", {"flows": F.lit(1)})
    else:
        out = W.tumble(hops, "event_time", window, ["src_ip"],
                       [distinct_count("dst_ip").alias("targets"), F.count("*").alias("flows")])
    return out.filter(F.col("targets") >= min_targets)


def ddos(flows: DataFrame, window: str = "1 minute", min_sources: int = 20,
         streaming: bool = False, min_packets: int = 0) -> DataFrame:
    """Per destination and window: inbound flows from many distinct sources, with at least
    ``min_packets`` packets.  A stream keeps one state row per source, not a set of them."""
    inbound = flows.filter(F.col("direction") == "inbound")
    if streaming:
        out = W.tumble_distinct(inbound, "event_time", window, ["dst_ip"], "src_ip", "sources",
                                {"packets": F.col("packets"), "flows": F.lit(1)})
    else:
        out = W.tumble(inbound, "event_time", window, ["dst_ip"],
                       [distinct_count("src_ip").alias("sources"), F.sum("packets").alias("packets"),
                        F.count("*").alias("flows")])
    return out.filter((F.col("sources") >= min_sources) & (F.col("packets") >= min_packets))


def brute_force(syslog: DataFrame, window: str = "1 minute", min_failures: int = 5) -> DataFrame:
    """``auth_failure`` events per (source, destination) and window."""
    fails = syslog.filter(F.col("event_type") == "auth_failure")
    return W.tumble(fails, "event_time", window, ["source_ip", "destination_ip"],
                    [F.count("*").alias("failures")], having=F.col("failures") >= min_failures)


def threat_correlated(detections: DataFrame, syslog: DataFrame, window_s: int, slack_s: int = 300,
                      critical_at: int = 5) -> DataFrame:
    """Flow-side detections joined with deny/failure syslog of the same source
    from the window start to ``slack_s`` after the window end; severity by count."""
    bad = syslog.filter(F.col("event_type").isin("auth_failure", "firewall_deny")) \
        .select(F.col("source_ip"), F.col("event_time").alias("syslog_time"), "event_id")
    j = interval_join(detections, bad, [("src_ip", "source_ip")], "window_start", "syslog_time",
                      0, window_s + slack_s, bucket_seconds=min(3600, window_s + slack_s))
    keys = [c for c in detections.columns]
    return j.groupBy(*keys).agg(F.count("event_id").alias("correlated_events")).select(
        *keys, "correlated_events",
        F.when(F.col("correlated_events") >= critical_at, "critical").otherwise("high").alias("severity"))


def threat_correlated_stream(flows: DataFrame, syslog: DataFrame, window: str = "1 minute", window_s: int = 60,
                             min_ports: int = 20, slack_s: int = 300, critical_at: int = 5) -> DataFrame:
    """Port scans correlated with syslog as one streaming query: windowed aggregate, interval join,
    aggregate.  Both inputs carry a watermark on ``event_time``; ``window_time`` hands it from one operator
    to the next, so every state is bounded by it.  Rows as ``threat_correlated(port_scan(...), ...)``, once
    the watermark has passed the window and the slack."""
    scans = (flows.filter(F.col("bytes_received") == 0)
             .groupBy(F.window("event_time", window).alias("_w"), "src_ip", "dst_ip")
             .agg(distinct_count("dst_port", flows.isStreaming).alias("distinct_ports"), F.count("*").alias("flows"))
             .filter(F.col("distinct_ports") >= min_ports)
             .select(F.window_time("_w").alias("_scan"), "src_ip", "dst_ip", "distinct_ports", "flows"))
    bad = syslog.filter(F.col("event_type").isin("auth_failure", "firewall_deny")) \
        .select("source_ip", F.col("event_time").alias("_seen"), F.col("event_id").alias("_event"))
    # a window's time is one microsecond before its end
    tick = F.expr("INTERVAL 1 MICROSECOND")
    near = ((F.col("_seen") >= F.col("_scan") + tick - F.expr(f"INTERVAL {int(window_s)} SECONDS"))
            & (F.col("_seen") <= F.col("_scan") + tick + F.expr(f"INTERVAL {int(slack_s)} SECONDS")))
    joined = scans.join(bad, (F.col("src_ip") == F.col("source_ip")) & near)
    out = joined.groupBy(F.window("_scan", window).alias("window"), "src_ip", "dst_ip", "distinct_ports", "flows") \
        .agg(F.count("_event").alias("correlated_events"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "src_ip",
                      "dst_ip", "distinct_ports", "flows", "correlated_events",
                      F.when(F.col("correlated_events") >= critical_at, "critical").otherwise("high").alias("severity"))


def device_offline(polls: DataFrame, max_gap_s: int = 60) -> DataFrame:
    """Polls reporting ``offline``, and polls followed by silence longer than ``max_gap_s``
    (2 x the 30 s poll interval by default)."""
    nxt = W.next_in_key(polls.select("device_id", "event_id", "event_time", "status"),
                        ["device_id"], ["event_time", "event_id"], ["event_time"])
    gap = epoch_micros(nxt, "next_event_time") - epoch_micros(nxt, "event_time")
    gap_s = F.floor(gap / 1_000_000).cast("bigint")
    reasons = F.array_compact(F.array(F.when(F.col("status") == "offline", F.lit("offline")),
                                      F.when(gap_s > max_gap_s, F.lit("silent"))))
    return nxt.select("device_id", "event_id", "event_time", F.explode(reasons).alias("reason"),
                      gap_s.alias("gap_seconds"))


def cpu_spike(polls: DataFrame, min_cpu: float = 85.0, min_memory: float = 80.0) -> DataFrame:
    """Rising edge of (cpu >= min_cpu and memory >= min_memory) per device."""
    hot = (F.col("cpu_percent") >= min_cpu) & (F.col("memory_percent") >= min_memory)
    base = polls.select("device_id", "event_id", "event_time", "cpu_percent", "memory_percent",
                        hot.alias("spike"))
    prev = W.previous_in_key(base, ["device_id"], ["event_time", "event_id"], ["spike"])
    return prev.filter(F.col("spike") & ~F.coalesce(F.col("prev_spike"), F.lit(False))) \
               .drop("spike", "prev_spike")


def config_change(polls: DataFrame) -> DataFrame:
    """``config_changed`` set, or ``last_config_change`` differs from the previous poll's."""
    cols = ["device_id", "event_id", "event_time", "last_config_change"]
    flag = F.col("config_changed") if "config_changed" in polls.columns else F.lit(False)
    base = polls.select(*cols, F.coalesce(flag, F.lit(False)).alias("_flag"))
    prev = W.previous_in_key(base, ["device_id"], ["event_time", "event_id"], ["last_config_change"])
    changed = F.col("last_config_change").isNotNull() & \
        ~F.col("last_config_change").eqNullSafe(F.col("prev_last_config_change"))
    return prev.filter(F.col("_flag") | changed).select(
        *cols, F.col("prev_last_config_change").alias("previous_change"))


def high_rate(flows: DataFrame, seconds: int = 60, threshold: int = 100) -> DataFrame:
    """Alert rows where a source exceeded ``threshold`` events in the trailing window."""
    rate = W.rate_in_range(flows.select("event_id", "src_ip", "event_time"), "src_ip", "event_time",
                           seconds, "count")
    return rate.filter(F.col("count") > threshold).select(
        F.lit("high_rate").alias("alert_type"), F.lit("high").alias("severity"), "src_ip", "count",
        "event_time", "event_id")


def zscore_anomalies(totals: DataFrame, key: str, order: str, value: str, history: int = 7,
                     min_history: int = 3, min_abs_z: float = 2.0) -> DataFrame:
    """z-score of each window's volume against that key's trailing ``history`` windows.

    The input is already one row per (key, window), so each key holds at most
    (time span / window) rows: the window function is bounded per key.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-history, -1)
    scored = totals.select("*", F.count(value).over(w).alias("n_history"),
                           F.avg(value).over(w).alias("baseline_mean"),
                           F.stddev_pop(value).over(w).alias("baseline_std"))
    z = (F.col(value) - F.col("baseline_mean")) / F.col("baseline_std")
    return scored.filter((F.col("n_history") >= min_history) & (F.col("baseline_std") > 0)) \
        .select(*totals.columns, F.round("baseline_mean", 4).alias("baseline_mean"),
                F.round(z, 4).alias("z")).filter(F.abs(F.col("z")) >= min_abs_z)


def health_score(cpu: Column, memory: Column, temperature: Column, down_ifaces: Column) -> Column:
    """0-100 health: CPU, memory, heat above 40 C and interfaces down lower it."""
    raw = (F.lit(100.0) - cpu * 0.4 - memory * 0.3 - F.greatest(temperature - 40.0, F.lit(0.0)) * 0.2
           - down_ifaces * 10.0)
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 2)


def device_health(polls: DataFrame, max_ifaces: int = 4) -> DataFrame:
    """Latest health score per device (``max_by`` over the poll order: partial aggregation)."""
    down = F.size(F.filter(F.slice("interfaces", 1, max_ifaces), lambda x: x["status"] == "down"))
    scored = polls.select("device_id", "event_id", "event_time",
                          health_score(F.col("cpu_percent"), F.col("memory_percent"),
                                       F.col("temperature_celsius"), down).alias("health_score"))
    order = F.struct("event_time", "event_id")
    return scored.groupBy("device_id").agg(F.max_by("health_score", order).alias("health_score"),
                                           F.max("event_time").alias("event_time"),
                                           F.round(F.avg("health_score"), 2).alias("mean_health"))
