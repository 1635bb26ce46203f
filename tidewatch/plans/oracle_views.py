"""DuckDB twins of ``tidewatch.plans.views`` for the oracle SQL.

``sql(body, *views)`` prefixes a query with the CTEs it needs.  Integer
division is ``//``; casts to BIGINT always go through ``floor`` because DuckDB
rounds where Spark truncates.
"""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], body: str) -> None:
    VIEWS[name] = (deps, body)


_view("v_flows", (), f"""
SELECT event_id, user_id, ts AS event_time,
  CASE WHEN event_type = 'error' THEN '198.51.100.' || (user_id % 8 + 1)
       ELSE '10.0.' || (user_id % 30 % 3 + 1) || '.' || (user_id % 30 + 10) END AS src_ip,
  CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN '10.0.2.' || (event_id % 4 + 10)
       ELSE '203.0.113.' || (event_id % 6 + 1) END AS dst_ip,
  CAST(CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 22 ELSE event_id * 7919 % 1024 END AS BIGINT)
    AS dst_port,
  CAST(floor(value * 1000) AS BIGINT) AS bytes_sent,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value * 1000) AS BIGINT) // 2 END AS BIGINT)
    AS bytes_received,
  {K} + 1 AS packets,
  event_type AS application,
  event_id % 20 AS device_id,
  CASE WHEN event_type = 'error' THEN 'inbound' WHEN event_id % 3 = 0 THEN 'internal'
       ELSE 'outbound' END AS direction
FROM events""")

_view("v_syslog", ("v_flows",), """
SELECT *,
  CASE WHEN event_type = 'auth_failure' THEN 'error' WHEN event_type = 'firewall_deny' THEN 'warning'
       ELSE 'info' END AS severity,
  CASE WHEN event_type = 'firewall_allow' THEN 'allow' WHEN event_type = 'firewall_deny' THEN 'deny'
       ELSE 'info' END AS action,
  event_type || ' ' || source_ip || ' -> ' || destination_ip AS message
FROM (
  SELECT event_id, user_id, event_time,
    CASE application WHEN 'error' THEN 'auth_failure' WHEN 'click' THEN 'firewall_allow'
      WHEN 'view' THEN 'auth_success' WHEN 'signup' THEN 'vpn_connect'
      WHEN 'purchase' THEN 'firewall_deny' END AS event_type,
    src_ip AS source_ip, dst_ip AS destination_ip
  FROM v_flows)""")

_view("v_device_status", (), f"""
SELECT event_id, ts AS event_time,
  CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g')
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS "timestamp",
  user_id % 20 AS device_id,
  least(value / 4, 99.0) AS cpu_percent,
  CAST({K} AS DOUBLE) AS memory_percent,
  CASE WHEN event_type = 'error' AND {K} < 10 THEN 'offline' ELSE 'online' END AS status,
  CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d') END AS last_config_change,
  CAST(30 + {K} % 50 AS DOUBLE) AS temperature_celsius,
  list_transform(range(6), lambda i: struct_pack(
      name := 'eth' || i,
      status := CASE WHEN (event_id + i) % 20 = 0 THEN 'down' ELSE 'up' END,
      speed_mbps := 1000,
      utilization_percent := CAST((event_id * 7 + i * 13) % 100 AS DOUBLE),
      errors_in := 0, errors_out := 0)) AS interfaces
FROM events""")

_view("v_devices", (), """
SELECT range AS device_id,
  CASE range % 4 WHEN 0 THEN 'firewall' WHEN 1 THEN 'switch' WHEN 2 THEN 'router'
       ELSE 'access_point' END AS device_type,
  CASE range % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Northwind' ELSE 'Globex' END AS manufacturer,
  'M-' || (range + 100) AS model,
  '1.' || (range % 5) || '.0' AS firmware_version,
  '10.0.' || (range % 3 + 1) || '.' || (range + 1) AS ip_address,
  'rack-' || (range // 5) AS location,
  CAST(CASE WHEN range % 4 = 3 THEN NULL ELSE (range % 3 + 1) * 100 END AS INTEGER) AS vlan_id
FROM range(20)""")

_view("v_messages", (), """
SELECT 'network.' || event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition",
  ts AS "timestamp", event_id, CAST(user_id AS VARCHAR) AS key, props AS value,
  row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS "offset"
FROM events""")

_view("v_knowledge", (), """
SELECT d.doc_id AS id, d.text AS content, d.source AS category, d.lang AS tenant, e.embedding,
  '{"ip":"10.0.' || (d.doc_id % 3 + 1) || '.' || (d.doc_id % 30 + 10) || '","source":"' || d.source || '"}'
    AS metadata,
  TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 MINUTE AS created_at,
  CASE WHEN d.doc_id % 4 = 0
       THEN TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 MINUTE + INTERVAL 1 DAY END AS expires_at
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")

TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0)"


def tokens_sql(c: str) -> str:
    return TOKENS.format(c=c)


_view("v_queries", (), """
SELECT b.item_id AS qid, b.text AS query_text, e.embedding AS query_vec
FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id""")

_view("v_dlq", (), f"""
SELECT ts AS "timestamp", user_id % 5 AS cell_id, user_id % 6 AS consumer_id,
  event_type || ' failed on event ' || event_id AS error,
  event_type AS error_type,
  'Traceback (most recent call last):' || chr(10) || '  File consumer, in process_event' || chr(10)
    || event_type || 'Error: failed on event ' || event_id
    || CASE WHEN event_id % 3 >= 1 THEN chr(10) || '  at stage_a' || chr(10) || 'Caused by: IOError: link '
            || (event_id % 7) ELSE '' END
    || CASE WHEN event_id % 3 >= 2 THEN chr(10) || '  at stage_b' || chr(10) || 'Caused by: ConnectError: port '
            || (event_id % 11) ELSE '' END AS traceback,
  props AS event, event_id
FROM events WHERE {K} < 5""")

_view("v_decisions", (), """
SELECT conv_id, turn, conv_id % 5 AS cell_id, role AS entry_type,
  CASE WHEN role = 'assistant' THEN 'reply' ELSE 'message' END AS decision_type,
  text AS message,
  CAST(length(text) // 4 AS BIGINT) AS input_tokens,
  CAST(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS BIGINT) AS output_tokens
FROM conversations""")

_view("v_registry", (), """
SELECT p_partkey AS consumer_id, p_partkey % 100 AS cell_id,
  ['t' || (p_partkey % 97), 't' || (p_partkey * 7 % 111 + 100)] AS source_topics,
  't' || (p_partkey * 31 % 220 + 40) AS output_topic,
  CASE WHEN p_size % 2 = 0 THEN 'flink_sql' ELSE 'python' END AS runtime
FROM part""")

_view("v_cells", ("v_registry",), """
SELECT s.s_suppkey AS cell_id, s.s_name AS name, repeat(s.s_name, 10) AS directive,
  CASE s.s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' ELSE 'terminated' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' + s.s_suppkey * INTERVAL 1 HOUR AS created_at,
  CAST(coalesce(r.consumers, 0) AS BIGINT) AS consumers
FROM supplier s LEFT JOIN (SELECT cell_id, count(*) AS consumers FROM v_registry GROUP BY cell_id) r
  ON r.cell_id = s.s_suppkey""")

_view("v_metrics", (), """
SELECT l_suppkey AS job, l_linenumber AS operator,
  CAST(floor(l_quantity) AS BIGINT) AS read_records,
  CAST(floor(floor(l_quantity) / 2) AS BIGINT) AS write_records,
  CAST(floor(l_extendedprice) AS BIGINT) AS read_bytes,
  CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS write_bytes
FROM lineitem""")


def _resolve(names, out: list[str]) -> None:
    for n in names:
        deps, _ = VIEWS[n]
        _resolve(deps, out)
        if n not in out:
            out.append(n)


def sql(body: str, *views: str, ctes: tuple[tuple[str, str], ...] = ()) -> str:
    """``WITH <views...>, <ctes...> <body>``."""
    order: list[str] = []
    _resolve(views, order)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
