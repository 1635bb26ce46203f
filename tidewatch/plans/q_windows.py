"""§2.5 windows over the fixture views.

The driver's events span 30 days with one event every few minutes, so the
registered queries pass day-scale windows; the operator defaults keep the
reference's widths (1 minute tumble, 60 s rate, 5 s watermark).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import windows as W
from tidewatch.operators import patterns as P
from tidewatch.plans import views as V
from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql

DAY_US = 86_400_000_000


def flow_summary(spark, sf_dir, size="1 day", min_flows=12):
    """The reference's flagship job: bytes and flows per source per tumbling window."""
    return W.tumble(V.v_flows(spark, sf_dir), "event_time", size, ["src_ip"],
                    [F.sum("bytes_sent").alias("total_bytes"), F.count("*").alias("flow_count")],
                    having=F.col("flow_count") > min_flows)


register("win_tumble", sql("""
SELECT time_bucket(INTERVAL 1 DAY, event_time) AS window_start,
       time_bucket(INTERVAL 1 DAY, event_time) + INTERVAL 1 DAY AS window_end,
       src_ip, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes, count(*) AS flow_count
FROM v_flows GROUP BY ALL HAVING count(*) > 12""", "v_flows"))(flow_summary)


@register("win_hop", sql(f"""
SELECT make_timestamp(b * {DAY_US}) AS window_start, make_timestamp(b * {DAY_US} + 2 * {DAY_US}) AS window_end,
       src_ip, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes, count(*) AS flow_count
FROM (SELECT *, epoch_us(event_time) // {DAY_US} - i AS b FROM v_flows, range(2) t(i))
GROUP BY ALL HAVING count(*) > 24""", "v_flows"))
def win_hop(spark, sf_dir):
    return W.hop(V.v_flows(spark, sf_dir), "event_time", "2 days", "1 day", ["src_ip"],
                 [F.sum("bytes_sent").alias("total_bytes"), F.count("*").alias("flow_count")],
                 having=F.col("flow_count") > 24)


@register("win_session", sql("""
SELECT min(event_time) AS window_start, max(event_time) + INTERVAL 6 HOUR AS window_end, user_id,
       count(*) AS events, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR event_time - prev > INTERVAL 6 HOUR THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, lag(event_time) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS prev
            FROM v_flows))
GROUP BY user_id, sid""", "v_flows"))
def win_session(spark, sf_dir):
    return W.session(V.v_flows(spark, sf_dir), "event_time", "6 hours", ["user_id"],
                     [F.count("*").alias("events"), F.sum("bytes_sent").alias("total_bytes")],
                     order_cols=["event_time", "event_id"])


def _rate(spark, sf_dir, hours=6):
    fl = V.v_flows(spark, sf_dir).select("event_id", "src_ip", "event_time")
    return W.rate_in_range(fl, "src_ip", "event_time", hours * 3600, "rate")


RATE_SQL = """
SELECT event_id, src_ip, event_time,
  count(*) OVER (PARTITION BY src_ip ORDER BY event_time
                 RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS rate
FROM v_flows"""


@register("win_rate_range", sql("SELECT * FROM rate WHERE rate >= 5", "v_flows", ctes=(("rate", RATE_SQL),)))
def win_rate_range(spark, sf_dir):
    return _rate(spark, sf_dir).filter(F.col("rate") >= 5)


@register("win_lag_change", sql("""
SELECT device_id, event_id, event_time, status, prev_status FROM (
  SELECT device_id, event_id, event_time, status,
         lag(status) OVER (PARTITION BY device_id ORDER BY event_time, event_id) AS prev_status
  FROM v_device_status)
WHERE prev_status IS NOT NULL AND prev_status <> status""", "v_device_status"))
def win_lag_change(spark, sf_dir):
    ds = V.v_device_status(spark, sf_dir).select("device_id", "event_id", "event_time", "status")
    out = W.previous_in_key(ds, ["device_id"], ["event_time", "event_id"], ["status"])
    return out.filter(F.col("prev_status").isNotNull() & (F.col("prev_status") != F.col("status")))


@register("win_ranked_tail", sql("""
SELECT conv_id, turn, entry_type, input_tokens, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM v_decisions)
WHERE rn <= 3""", "v_decisions"))
def win_ranked_tail(spark, sf_dir):
    d = V.v_decisions(spark, sf_dir).select("conv_id", "turn", "entry_type", "input_tokens")
    return W.ranked_tail(d, ["conv_id"], ["turn"], 3)


SEQ_SQL = """
SELECT user_id, min(event_time) AS run_start, max(event_time) AS run_end, count(*) AS failures,
       arg_max(next_type, rn_all) AS next_type, arg_max(next_time, rn_all) AS success_time
FROM (SELECT *, rn_all - rn_fail AS island FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS rn_fail
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS rn_all,
               lead(event_type) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS next_type,
               lead(event_time) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS next_time
        FROM v_syslog)
  WHERE event_type = 'auth_failure'))
GROUP BY user_id, island
HAVING count(*) >= 3 AND arg_max(next_type, rn_all) = 'auth_success'
   AND arg_max(next_time, rn_all) <= min(event_time) + INTERVAL 1 DAY"""


FAILURES_THEN_SUCCESS = P.Pattern((P.Step("failure", "event_type = 'auth_failure'", 3, None),
                                   P.Step("success", "event_type = 'auth_success'")), within_s=86_400)


@register("win_match_sequence", sql(SEQ_SQL, "v_syslog"))
def win_match_sequence(spark, sf_dir):
    sl = V.v_syslog(spark, sf_dir).select("user_id", "event_id", "event_time", "event_type")
    found = P.match_pattern(sl, FAILURES_THEN_SUCCESS, ["user_id"], ["event_time", "event_id"])
    return found.select("user_id", F.col("failure_first").alias("run_start"), F.col("failure_last").alias("run_end"),
                        F.col("failure_rows").alias("failures"), F.lit("auth_success").alias("next_type"),
                        F.col("success_first").alias("success_time"))


# the same patterns as regular expressions over one letter an event; the letters exclude each other, so greedy
# matching needs no way back
PATTERNS = {
    "probe": (P.Pattern((P.Step("allowed", "event_type = 'firewall_allow'", 2, None),
                         P.Step("denied", "event_type IN ('firewall_deny', 'auth_failure')"))), "A{2,}[DF]"),
    "session": (P.Pattern((P.Step("login", "event_type = 'auth_success'"),
                           P.Step("traffic", "event_type = 'firewall_allow'", 0, None),
                           P.Step("leave", "event_type = 'vpn_connect'"))), "SA*V"),
    "triple_failure": (P.Pattern((P.Step("failure", "event_type = 'auth_failure'", 3, 3),)), "F{3}"),
}


@register("win_match_patterns", sql(" UNION ALL ".join(f"""
SELECT user_id, '{name}' AS pattern, len(m) AS matches, CAST(list_sum(list_transform(m, lambda x: length(x))) AS BIGINT) AS events
FROM (SELECT user_id, regexp_extract_all(line, '{regex}') AS m FROM lines) WHERE len(m) > 0"""
    for name, (_, regex) in PATTERNS.items()), "v_syslog", ctes=(("lines", """
SELECT user_id, string_agg(CASE event_type WHEN 'auth_failure' THEN 'F' WHEN 'auth_success' THEN 'S' WHEN 'firewall_allow'
       THEN 'A' WHEN 'firewall_deny' THEN 'D' ELSE 'V' END, '' ORDER BY event_time, event_id) AS line
FROM v_syslog GROUP BY user_id"""),)))
def win_match_patterns(spark, sf_dir):
    """Three patterns given as data: matches and matched events a user."""
    sl = V.v_syslog(spark, sf_dir).select("user_id", "event_id", "event_time", "event_type")
    out = None
    for name, (pattern, _) in PATTERNS.items():
        found = P.match_pattern(sl, pattern, ["user_id"], ["event_time", "event_id"])
        rows = sum((F.col(f"{s.name}_rows") for s in pattern.steps), F.lit(0))
        one = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("matches"), F.sum(rows).alias("events")) \
            .select("user_id", F.lit(name).alias("pattern"), "matches", F.col("events").cast("bigint").alias("events"))
        out = one if out is None else out.unionByName(one)
    return out
