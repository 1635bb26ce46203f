"""Labelled injection: quiet background plus one planted instance of each
anomaly; every detector (at its producer-scale defaults) finds exactly its own."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.exprs import direction
from tidewatch.operators import detect as D

T0 = datetime(2024, 3, 1, 12, 0, 0)
FLOW_COLS = ("event_id long, event_time timestamp_ntz, src_ip string, dst_ip string, dst_port long, "
             "bytes_sent long, bytes_received long, packets long, label string")


@pytest.fixture(scope="module")
def flows(spark):
    rnd = random.Random(42)
    rows, eid = [], 0

    def add(t, src, dst, port, sent, recv, pk, label):
        nonlocal eid
        rows.append((eid, t, src, dst, port, sent, recv, pk, label))
        eid += 1

    for _ in range(300):  # quiet background: internal clients to the internet
        add(T0 + timedelta(seconds=rnd.uniform(0, 600)), f"10.0.1.{rnd.randint(10, 40)}",
            f"203.0.113.{rnd.randint(1, 50)}", rnd.choice([443, 80, 53]), rnd.randint(100, 50_000),
            rnd.randint(100, 200_000), rnd.randint(1, 200), "normal")
    for p in range(25):   # port scan: one minute, no replies, many ports
        add(T0 + timedelta(seconds=60 + p), "10.0.1.66", "10.0.2.5", 1000 + p, rnd.randint(40, 120), 0, 1, "port_scan")
    for i in range(3):    # exfiltration: 2 MB out in one minute
        add(T0 + timedelta(seconds=200 + i), "10.0.1.77", "203.0.113.99", 443, 700_000, 500, 900, "data_exfiltration")
    for i in range(5):    # lateral movement: IoT to servers on SSH
        add(T0 + timedelta(seconds=300 + 10 * i), "10.0.3.15", f"10.0.2.{20 + i}", 22, 1500, 300, 10, "lateral_movement")
    for i in range(30):   # ddos: many external sources, one target
        add(T0 + timedelta(seconds=420 + i), f"198.51.100.{i + 1}", "10.0.2.10", 80, 200, 100, 1000, "ddos")
    df = spark.createDataFrame(rows, FLOW_COLS)
    return df.withColumn("direction", direction("src_ip", "dst_ip"))


def _labels(df, key, value):
    return sorted({r[key] for r in df.collect()}), value


def test_port_scan(flows):
    got = D.port_scan(flows)
    assert [r.src_ip for r in got.collect()] == ["10.0.1.66"]


def test_exfiltration(flows):
    got = D.exfiltration(flows)
    assert [r.src_ip for r in got.collect()] == ["10.0.1.77"]


def test_lateral_movement(flows):
    got = D.lateral_movement(flows)
    assert [r.src_ip for r in got.collect()] == ["10.0.3.15"]


def test_ddos(flows):
    got = D.ddos(flows)
    assert [r.dst_ip for r in got.collect()] == ["10.0.2.10"]


def test_brute_force(spark):
    rows = [(i, T0 + timedelta(seconds=5 * i), "198.51.100.7", "10.0.2.30", "auth_failure") for i in range(8)]
    rows += [(100 + i, T0 + timedelta(seconds=40 * i), f"10.0.1.{i}", "10.0.2.30",
              "auth_failure" if i % 4 == 0 else "auth_success") for i in range(20)]
    sl = spark.createDataFrame(rows, "event_id long, event_time timestamp_ntz, source_ip string, "
                                     "destination_ip string, event_type string")
    got = D.brute_force(sl)
    assert [(r.source_ip, r.failures) for r in got.collect()] == [("198.51.100.7", 8)]


@pytest.fixture(scope="module")
def polls(spark):
    rows, eid = [], 0
    for dev in ["fw-1", "sw-2", "rt-3", "sw-4", "ap-5"]:
        for k in range(20):
            t = T0 + timedelta(seconds=30 * k)
            if dev == "sw-2" and 8 <= k < 18:
                continue                                   # silent for 5 minutes
            status = "offline" if dev == "fw-1" and k == 10 else "online"
            cpu, mem = (92.0, 85.0) if dev == "rt-3" and k in (12, 13) else (20.0, 40.0)
            lcc = "2024-03-01T12:05:00Z" if dev == "sw-4" and k >= 10 else None
            rows.append((eid, dev, t, status, cpu, mem, 45.0, lcc, False))
            eid += 1
    return spark.createDataFrame(rows, "event_id long, device_id string, event_time timestamp_ntz, status string, "
                                       "cpu_percent double, memory_percent double, temperature_celsius double, "
                                       "last_config_change string, config_changed boolean")


def test_device_offline(polls):
    got = {(r.device_id, r.reason) for r in D.device_offline(polls).collect()}
    assert got == {("fw-1", "offline"), ("sw-2", "silent")}


def test_cpu_spike_rising_edge(polls):
    got = [(r.device_id) for r in D.cpu_spike(polls).collect()]
    assert got == ["rt-3"]


def test_config_change(polls):
    got = [(r.device_id, r.previous_change) for r in D.config_change(polls).collect()]
    assert got == [("sw-4", None)]


def test_detectors_find_no_other_label(flows):
    found = set()
    for det, key in ((D.port_scan, "src_ip"), (D.exfiltration, "src_ip"), (D.lateral_movement, "src_ip")):
        ips = {r[key] for r in det(flows).collect()}
        labels = {r.label for r in flows.filter(F.col("src_ip").isin(*ips)).select("label").distinct().collect()}
        assert len(labels) == 1 and "normal" not in labels
        found |= labels
    assert found == {"port_scan", "data_exfiltration", "lateral_movement"}
