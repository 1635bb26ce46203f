"""Hand-built cases with hand-derived expectations for the reference's rules
(the DuckDB oracles check engine agreement; these check the rules themselves)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators import audit as AU
from tidewatch.operators import search as S

REG = "consumer_id long, cell_id long, source_topics array<string>, output_topic string, runtime string"


def test_lineage_rules(spark):
    reg = spark.createDataFrame([
        (1, 7, ["network.flows"], "traffic.summary", "flink_sql"),     # feeds consumer 2
        (2, 7, ["traffic.summary"], "threats.detected", "python"),    # python output: never "unwired"
        (3, 7, ["network.syslog", "ghost.topic"], "alerts.x", "flink_sql"),  # orphan input + unwired output
        (4, 7, ["network.flows"], "alerts.x", "python"),              # shares alerts.x with 3
        (5, 8, ["network.flows"], "out.y", "python"),                 # a clean cell
    ], REG)
    rows = {(r.cell_id, r.kind, r.topic, r.consumer_id, r.n)
            for r in AU.lineage(reg, ("network.flows", "network.syslog", "network.device.status")).collect()}
    assert (7, "intermediate", "traffic.summary", None, None) in rows
    assert (7, "external_source", "network.flows", None, None) in rows
    assert (7, "external_source", "ghost.topic", None, None) in rows
    assert (7, "unwired_output", "alerts.x", 3, None) in rows
    assert not any(k == "unwired_output" and t == "threats.detected" for _, k, t, _, _ in rows)
    assert (7, "orphan_input", "ghost.topic", 3, None) in rows
    assert not any(k == "orphan_input" and t.startswith("network.") for _, k, t, _, _ in rows if t)
    assert {(c, n) for cell, k, t, c, n in rows if k == "shared_output"} == {(3, 2), (4, 2)}
    # warnings: unwired (1) + orphan (1) + shared topic (1)
    assert (7, "unhealthy", None, None, 3) in rows and (8, "healthy", None, None, 0) in rows


def test_consumer_health_rule_order(spark):
    consumers = spark.createDataFrame([
        (1, "flink_sql", 10, 0, 0), (2, "flink_sql", 11, 0, 0), (3, "flink_sql", 12, 0, 0),
        (4, "flink_sql", 99, 0, 0), (5, "python", 0, 1, 1), (6, "python", 0, 2, 2), (7, "python", 0, 3, 3)],
        "consumer_id long, runtime string, job_id long, dlq_key long, event_key long")
    jobs = spark.createDataFrame([(10, 5, "FAILED"), (11, 0, "RUNNING"), (12, 9, "RUNNING")],
                                 "job_id long, records_in long, state string")
    dlq = spark.createDataFrame([(1, 4)], "dlq_key long, errors long")           # consumer 5 has errors...
    events = spark.createDataFrame([(1, 10), (3, 8)], "event_key long, events_processed long")
    got = {r.consumer_id: r.status for r in AU.consumer_health(consumers, jobs, dlq, events).collect()}
    assert got == {1: "failed", 2: "no_records", 3: "healthy", 4: "no_job",
                   5: "dlq_errors",            # ...which wins over its events
                   6: "no_events", 7: "healthy"}


def test_root_cause_rules(spark):
    cases = [
        ("Top error\n  at a\nCaused by: IOError: x\n  at b\n  Caused by: OSError: deepest  ", "OSError: deepest"),
        ("Only line " + "z" * 400 + "\nsecond", ("Only line " + "z" * 400)[:300]),
        ("Caused by:NoSpace", "Caused by:NoSpace"),      # the prefix is removed only with its space
        ("", ""),
    ]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    got = [r[0] for r in df.select(X.root_cause("t")).collect()]
    assert got == [want for _, want in cases]


def test_token_budget_notice(spark):
    short, long = "a" * 16000, "b" * 16004 + "c" * 100
    df = spark.createDataFrame([(short,), (long,)], "t string")
    out = [r[0] for r in df.select(X.pack_to_budget("t")).collect()]
    assert out[0] == short                                   # 4000 tokens: within budget
    est = len(long) // 4
    assert out[1] == long[:15800] + f"\n\n[Truncated: showing ~4000 of ~{est} tokens. Narrow your query for complete results.]"


def test_rrf_keeps_worst_rank_of_repeated_content(spark):
    corpus = spark.createDataFrame([(1, "dup"), (2, "dup"), (3, "solo")], "id long, content string")
    vec = spark.createDataFrame([(9, 1, 0.9, 0), (9, 3, 0.5, 1), (9, 2, 0.4, 2)],
                                "qid long, id long, similarity double, rank long")
    fts = spark.createDataFrame([(9, 3, 0.2, 0)], "qid long, id long, score double, rank long")
    fused = {r.content: r for r in S.fuse_ranked(vec, fts, corpus).collect()}
    assert fused["dup"].vector_rank == 2 and fused["dup"].id == 1      # worst rank, first hit's row
    scored = S.fuse_ranked(vec, fts, corpus).select("content", S.rrf(["vector_rank", "fts_rank"]).alias("r"))
    r = {x.content: x.r for x in scored.collect()}
    assert r["dup"] == 1 / 62 and r["solo"] == 1 / 61 + 1 / 60
    assert S.candidates(5) == 20 and S.candidates(3) == 20 and S.candidates(8) == 32
