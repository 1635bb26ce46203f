"""Event functions with a knowledge argument: alerts, entries, table rows and texts from one pass, batch = stream."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import effects as EF
from tidewatch.operators import state as ST
from tidewatch.session import materialized
from tidewatch.streaming import effects as SE
from tidewatch.streaming import runner as R
from test_ordered_streams import shuffled_topic

T0 = datetime(2024, 5, 1)
SCHEMA = "src_ip string, event_time timestamp, event_id long, size long"
ORDER = ["event_time", "event_id"]
ALERTS = "src_ip string, event_id long, note string"
SEEN = EF.KnowledgeTable("seen", {"ip": "string", "parity": "int"}, {
    "n": ("bigint", "add"), "smallest": ("bigint", "least"), "largest": ("bigint", "greatest"),
    "latest": ("bigint", "replace"), "first_id": ("bigint", "first")})


def rule():
    def fn(event, state, knowledge):
        if event["size"] == 13:
            raise ValueError("unlucky")
        state["n"] = state.get("n", 0) + 1
        ip, i = event["src_ip"], event["event_id"]
        knowledge.upsert("seen", {"ip": ip, "parity": None if i % 5 == 0 else i % 2}, n=1, smallest=event["size"],
                         largest=event["size"], latest=event["size"] if i % 3 else None, first_id=i)
        knowledge.set(f"last/{ip}", {"id": i, "n": state["n"]})
        if state["n"] % 10 == 0:
            knowledge.store(f"{ip} \"reached\" {state['n']}\nevents", "milestone", {"ip": ip})
            return [{"src_ip": ip, "event_id": i, "note": "tenth"}]
        return []
    return fn


def events(n=400, null_key=True):
    rng = random.Random(2)
    return [(rng.choice(["a", "a", "b", None] if null_key else ["a", "a", "b"]), T0 + timedelta(seconds=rng.randint(0, 900)), i,
             rng.randint(1, 60)) for i in range(n)]


def model(rows):
    fn, out = rule(), {"alerts": set(), "dead": set(), "entries": {}, "texts": set(), "table": {}}
    states, latest = {}, {}
    for src, at, i, size in sorted(rows, key=lambda r: r[1:3]):
        k = EF.Knowledge({"seen": SEEN})
        try:
            found = fn({"src_ip": src, "event_time": at, "event_id": i, "size": size}, states.setdefault(src, {}), k)
        except ValueError:
            out["dead"].add(i)
            continue
        out["alerts"] |= {(a["src_ip"], a["event_id"], a["note"]) for a in found}
        for kind, target, key, value in k.writes:
            if kind == "set":
                out["entries"][target] = json.loads(value)
            elif kind == "store":
                out["texts"].add((json.loads(value), target, json.loads(key)["ip"]))
            else:
                key, v = tuple(json.loads(key).values()), json.loads(value)
                old = out["table"].get(key)
                latest[key] = v["latest"] if v["latest"] is not None else latest.get(key)
                out["table"][key] = (1, v["smallest"], v["largest"], latest[key], i) if old is None else (
                    old[0] + 1, min(old[1], v["smallest"]), max(old[2], v["largest"]), latest[key], old[4])
    return out


def check(want, alerts, dead, entries, texts, table):
    assert {tuple(r) for r in alerts.collect()} == want["alerts"]
    letters = dead.collect()
    assert {json.loads(r.event)["event_id"] for r in letters} == want["dead"]
    assert all(r.error_type == "ValueError" and "unlucky" in r.traceback for r in letters)
    assert {r.key: json.loads(r.value) for r in entries.collect()} == want["entries"]
    assert {(r.content, r.category, json.loads(r.metadata)["ip"]) for r in texts.collect()} == want["texts"]
    assert {(r.ip, r.parity): tuple(r)[2:] for r in table.collect()} == want["table"]


def test_batch(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.col("event_time").cast("timestamp_ntz")).repartition(4)
    out = EF.process_with_knowledge(df, ["src_ip"], ORDER, rule(), ALERTS, [SEEN], capture_errors=True)
    kept = EF.split(materialized(out.frame), out)
    check(model(rows), kept.alerts(), kept.dead_letters(), EF.entry_rows(kept.entries()), kept.texts(),
          EF.table_rows(kept.changes("seen"), SEEN))
    assert EF.table_rows(kept.changes("seen"), SEEN).schema.simpleString() == \
        "struct<ip:string,parity:int,n:bigint,smallest:bigint,largest:bigint,latest:bigint,first_id:bigint>"


def test_stream(spark):
    rows = events()
    src = shuffled_topic(spark, rows + [("end", T0 + timedelta(seconds=4000), 9999, 1)], SCHEMA, disorder_s=60)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = EF.process_with_knowledge(stream, ["src_ip"], ORDER, rule(), ALERTS, [SEEN], capture_errors=True, delay="90 seconds")
    base = R.fresh_dir(spark, "effects")
    R.run_foreach_batch(out.frame, SE.effects_sink(base, out), R.fresh_dir(spark, "ck"))
    read = lambda name: spark.read.parquet(f"{base}/{name}").drop("batch_id")
    check(model(rows), read("alerts"), read("dead_letters"), SE.entries_now(spark, f"{base}/entries"), read("texts"),
          SE.table_now(spark, f"{base}/tables/seen", SEEN))


def test_replayed_batches_change_nothing(spark):
    df = spark.createDataFrame(events(120), SCHEMA)
    out = EF.process_with_knowledge(df, ["src_ip"], ORDER, rule(), ALERTS, [SEEN], capture_errors=True)
    base, sink = R.fresh_dir(spark, "effects"), None
    sink = SE.effects_sink(base, out)
    frame = materialized(out.frame)
    for batch in (0, 1, 1, 0):
        sink(frame.where(F.col("at_event_id") % 2 == batch), batch)
    whole = EF.split(frame, out)
    assert sorted(map(str, SE.table_now(spark, f"{base}/tables/seen", SEEN).collect())) == \
        sorted(map(str, EF.table_rows(whole.changes("seen"), SEEN).collect()))
    assert spark.read.parquet(f"{base}/alerts").count() == whole.alerts().count()


def test_reference_example_gives_alerts_and_scores(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), T0 + timedelta(seconds=rng.randint(0, 600)), i, 1) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    schema = ST.RATE_RESET_SCHEMA.replace("timestamp_ntz", "timestamp")
    out = EF.process_with_knowledge(df, ["src_ip"], ORDER, EF.scored_rate(60, 20), schema, [EF.IP_SCORES])
    alerts = out.alerts().collect()
    scores = {r.ip: (r.score, r.event_count) for r in EF.table_rows(out.changes("ip_scores"), EF.IP_SCORES).collect()}
    assert alerts and scores == {ip: (float(sum(a.src_ip == ip for a in alerts)), 21) for ip in {a.src_ip for a in alerts}}


def test_undeclared_writes_are_refused():
    k = EF.Knowledge({"seen": SEEN})
    for args, values in ((("other", {}), {}), (("seen", {"ip": "a"}), {}), (("seen", {"ip": "a", "parity": 1}), {"oops": 1})):
        with pytest.raises(KeyError):
            k.upsert(*args, **values)
    with pytest.raises(ValueError):
        EF.KnowledgeTable("t", {"k": "string"}, {"v": ("int", "median")})
