"""User event functions: null keys, errors as dead letters, in batch and as a stream."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import state as ST
from tidewatch.streaming import processors as P
from tidewatch.streaming import runner as R

T0 = datetime(2024, 5, 1)
SCHEMA = "key long, ts timestamp_ntz, id long, v long"
OUT = "key long, id long, n long"


def rule():
    """A user function (made here, so that it travels by value)."""
    def count_or_raise(event, state):
        if event["v"] == 13:
            raise ValueError(f"bad event {event['id']}")
        state["n"] = state.get("n", 0) + 1
        return [{"key": event["key"], "id": event["id"], "n": state["n"]}]
    return count_or_raise


def rows():
    return [(None if i % 3 == 0 else i % 3, T0 + timedelta(seconds=i), i, 13 if i % 10 == 4 else i) for i in range(40)]


def expected():
    n, alerts, dead = {}, set(), set()
    for key, _, i, v in rows():
        if v == 13:
            dead.add(i)
        else:
            n[key] = n.get(key, 0) + 1
            alerts.add((key, i, n[key]))
    return alerts, dead


def check(out):
    alerts, dead = expected()
    got = out.collect()
    key = lambda k: None if k is None or k != k else int(k)
    assert {(key(r.key), r.id, r.n) for r in got if r.error_type is None} == alerts
    letters = [r for r in got if r.error_type is not None]
    assert {json.loads(r.event)["id"] for r in letters} == dead
    for r in letters:
        assert r.error_type == "ValueError" and r.error.startswith("bad event") and "count_or_raise" in r.traceback


def test_batch(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    check(ST.process_events(df, ["key"], ["ts", "id"], rule(), OUT, capture_errors=True))


def test_errors_fail_the_job_unless_captured(spark):
    import pytest
    df = spark.createDataFrame(rows(), SCHEMA)
    with pytest.raises(Exception, match="bad event"):
        ST.process_events(df, ["key"], ["ts", "id"], rule(), OUT).collect()


def test_stream(spark):
    src, out, ck = (R.fresh_dir(spark, k) for k in ("ev", "out", "ck"))
    df = spark.createDataFrame(rows(), SCHEMA)
    for lo in (0, 15, 30):
        df.filter((F.col("id") >= lo) & (F.col("id") < lo + 15)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = R.run_available_now(P.process_events_stream(stream, ["key"], ["ts", "id"], rule(), OUT,
                                                    capture_errors=True), out, ck)
    got = spark.read.parquet(out).collect()
    alerts, dead = expected()
    assert {(r.key, r.id) for r in got if r.error_type is None} == {(k, i) for k, i, _ in alerts}
    assert {json.loads(r.event)["id"] for r in got if r.error_type} == dead
    assert sum(p.numInputRows for p in R.progress_of(q)) == df.count()


def test_ordered_stream_takes_null_keys_and_times(spark):
    """Rows without a time become dead letters, or are left out where errors are not captured."""
    from tidewatch.streaming.ordered import process_in_order
    schema = SCHEMA.replace("timestamp_ntz", "timestamp")
    given = [(k, None if i in (7, 8) else t, i, v) for k, t, i, v in rows() if v != 13]
    src = R.fresh_dir(spark, "ev")
    for lo in (0, 15, 30):
        spark.createDataFrame([r for r in given if lo <= r[2] < lo + 15], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(9, T0 + timedelta(days=1), 999, 1)], schema).coalesce(1).write.mode("append").parquet(src)
    timed = [r for r in given if r[1] is not None]
    for capture in (True, False):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = R.fresh_dir(spark, "out")
        R.run_available_now(process_in_order(stream, ["key"], "ts", ["ts", "id"], rule(), OUT, "60 seconds", capture_errors=capture),
                            out, R.fresh_dir(spark, "ck"))
        got = spark.read.parquet(out).collect()
        want, n = set(), {}
        for k, _, i, _ in timed:
            n[k] = n.get(k, 0) + 1
            want.add((k, i, n[k]))
        assert {(r.key, r.id, r.n) for r in got if not capture or r.error_type is None} == want
        if capture:
            letters = [r for r in got if r.error_type is not None]
            assert {json.loads(r.event)["id"] for r in letters} == {7, 8} and {r.error_type for r in letters} == {"MissingTime"}


def test_producer_records_decode(spark):
    """One literal message per producer: names as device ids, all fields."""
    from tidewatch.sources import events as E
    flow = {"timestamp": "2024-05-01 10:00:00.123", "src_ip": "10.0.1.5", "dst_ip": "8.8.8.8", "src_port": 40000,
            "dst_port": 53, "protocol": "UDP", "bytes_sent": 120, "bytes_received": 400, "packets": 2, "duration_ms": 15,
            "application": "DNS", "device_id": "fw-edge-01", "vlan_id": 100, "direction": "outbound"}
    status = {"timestamp": "2024-05-01 10:00:00.123", "device_id": "sw-core-01", "device_type": "switch",
              "manufacturer": "Acme", "model": "M-1", "firmware_version": "1.0", "ip_address": "10.0.0.2",
              "location": "rack-1", "status": "online", "cpu_percent": 12.5, "memory_percent": 40.0,
              "temperature_celsius": 41.5, "uptime_seconds": 1000, "config_changed": False,
              "last_config_change": "2024-04-01T00:00:00Z",
              "interfaces": [{"name": "eth0", "status": "up", "speed_mbps": 1000, "utilization_percent": 3.5,
                              "errors_in": 0, "errors_out": 1}]}
    syslog = {"timestamp": "2024-05-01 10:00:00.123", "device_id": "fw-edge-01", "device_type": "firewall",
              "severity": "warning", "facility": "auth", "message": "denied", "source_ip": "1.2.3.4",
              "destination_ip": "10.0.2.10", "rule_name": None, "action": "deny", "event_type": "firewall_deny"}
    for record, schema in ((flow, E.FLOW_SCHEMA), (status, E.DEVICE_STATUS_SCHEMA), (syslog, E.SYSLOG_SCHEMA)):
        msgs = spark.createDataFrame([("t", 0, 1, T0, "k", json.dumps(record))], E.ENVELOPE)
        got = E.decode(msgs, schema, with_errors=True).first()
        assert got._parse_error is False and got.event_time == datetime(2024, 5, 1, 10, 0, 0, 123000)
        for name, value in record.items():
            have = got[name]
            assert (have[0].asDict() == value[0]) if name == "interfaces" else have == value
    odd = spark.createDataFrame([(None, None, None, T0, "k", "{}"), ("t", 0, 5, T0, "k", "{}"), ("t", 0, 50, T0, "k", "{}")], E.ENVELOPE)
    assert E.offset_range(odd, {"t": {0: 10}}, {"t": {0: 60}}).count() == 2
