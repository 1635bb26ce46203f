"""Edge cases: empty input, missing and null fields,
equal timestamps, window edges, the exact session gap, late and duplicate events."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import joins as J
from tidewatch.operators import search as S
from tidewatch.operators import windows as W
from tidewatch.operators.numbering import sequence_number
from tidewatch.sources import events as E
from tidewatch.streaming import runner as R

T0 = datetime(2024, 5, 1, 12, 0, 0)
SCHEMA = "id long, key string, ts timestamp_ntz, v long"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_empty_inputs(spark):
    empty = _df(spark, [])
    assert W.tumble(empty, "ts", "1 minute", ["key"], [F.count("*").alias("n")]).count() == 0
    assert W.session(empty, "ts", "5 minutes", ["key"], [F.count("*").alias("n")]).count() == 0
    assert sequence_number(empty, ["key"], ["ts", "id"]).count() == 0
    assert W.rate_in_range(empty, "key", "ts", 60).count() == 0
    assert J.interval_join(empty, empty.select(F.col("key").alias("k2"), F.col("ts").alias("t2")),
                           [("key", "k2")], "ts", "t2", -60, 60).count() == 0
    kb = spark.createDataFrame([], "id long, content string, embedding array<float>")
    q = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0])], "qid long, query_text string, query_vec array<float>")
    assert S.fts_topk(kb, q, 5).count() == 0
    assert S.semantic_topk(kb, q, 5).count() == 0


def test_session_gap_is_inclusive_and_equal_timestamps(spark):
    gap = timedelta(minutes=5)
    rows = [(1, "a", T0, 1), (2, "a", T0 + gap, 1),              # exactly one gap apart: same session
            (3, "a", T0 + 2 * gap + timedelta(microseconds=1), 1),  # just over: new session
            (4, "a", T0 + 2 * gap + timedelta(microseconds=1), 1)]  # equal timestamp
    s = W.session(_df(spark, rows), "ts", "5 minutes", ["key"], [F.count("*").alias("n")],
                  order_cols=["ts", "id"])
    assert sorted(r.n for r in s.collect()) == [2, 2]
    # Spark's session_window (the streaming form) agrees on the inclusive gap
    sw = _df(spark, rows).groupBy(F.session_window("ts", "5 minutes"), "key").count()
    assert sorted(r["count"] for r in sw.collect()) == [2, 2]


def test_window_edges(spark):
    rows = [(1, "a", T0, 1), (2, "a", T0 + timedelta(minutes=1), 1), (3, "a", T0 + timedelta(seconds=59.999999), 1)]
    t = W.tumble(_df(spark, rows), "ts", "1 minute", ["key"], [F.count("*").alias("n")])
    got = {(r.window_start, r.n) for r in t.collect()}
    assert got == {(T0, 2), (T0 + timedelta(minutes=1), 1)}   # an event at the end opens the next window


def test_sequence_ties_broken_by_id(spark):
    rows = [(i, "a", T0, 0) for i in (5, 3, 9, 1)]
    got = [r.id for r in sequence_number(_df(spark, rows), ["key"], ["ts", "id"]).orderBy("seq").collect()]
    assert got == [1, 3, 5, 9]


def test_undecodable_missing_field_and_nulls(spark):
    good = json.dumps({"timestamp": "2024-05-01 12:00:00.000", "src_ip": "10.0.1.5", "bytes_sent": 10})
    missing = json.dumps({"timestamp": "2024-05-01 12:00:01.000", "src_ip": "10.0.1.6"})     # no bytes_sent
    rows = [("network.flows", 0, 0, good), ("network.flows", 0, 1, "{not json"), ("network.flows", 0, 2, missing),
            ("network.flows", 0, 3, None)]
    msgs = spark.createDataFrame(rows, "topic string, partition int, offset long, value string")
    tagged = E.decode(msgs, E.FLOW_SCHEMA, with_errors=True).select("offset", "bytes_sent", "_parse_error")
    got = {r.offset: (r.bytes_sent, r._parse_error) for r in tagged.collect()}
    assert got == {0: (10, False), 1: (None, True), 2: (None, False), 3: (None, True)}
    from tidewatch.functions.exprs import with_default
    dec = E.decode(msgs, E.FLOW_SCHEMA).select(with_default("bytes_sent", 0).alias("b"))
    assert sorted(r.b for r in dec.collect()) == [0, 10]


def test_late_event_dropped_and_duplicate_removed_in_stream(spark):
    src, out, ck = R.fresh_dir(spark, "t"), R.fresh_dir(spark, "s"), R.fresh_dir(spark, "c")
    schema = "id long, key string, ts timestamp"
    first = [(1, "a", T0), (2, "a", T0 + timedelta(hours=3)), (2, "a", T0 + timedelta(hours=3))]   # duplicate
    late = [(3, "a", T0 + timedelta(minutes=1))]                                                   # behind watermark

    def build():
        s = spark.readStream.schema(schema).parquet(src).withWatermark("ts", "1 hour")
        s = s.dropDuplicatesWithinWatermark(["id"])
        return s.groupBy(F.window("ts", "1 hour"), "key").count()
    for batch in (first, late):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        q = R.run_available_now(build(), out, ck)
    rows = spark.read.parquet(out).collect()
    # only the first hour's window is closed; it holds one event, the late one was dropped
    assert [(r.window.start.replace(tzinfo=None), r["count"]) for r in rows] == [(T0, 1)]
    assert q is not None


def test_duplicate_content_fused_once(spark):
    kb = spark.createDataFrame(
        [(1, "same words here", [1.0, 0.0]), (2, "same words here", [0.9, 0.1]), (3, "other text", [0.0, 1.0])],
        "id long, content string, embedding array<float>")
    q = spark.createDataFrame([(7, "same words", [1.0, 0.0])], "qid long, query_text string, query_vec array<float>")
    h = S.hybrid(kb, q, 5).collect()
    contents = [r.content for r in h]
    assert len(contents) == len(set(contents))
    top = min(h, key=lambda r: r["rank"])
    assert top.id == 1                       # representative: first vector hit with that content


def test_dead_letters_of_expressions_have_all_parts(spark):
    import json
    from tidewatch.operators import state as ST
    df = spark.createDataFrame([(1, 10, 2), (2, 5, 0), (3, None, 1)], "id long, a long, b long")
    good, bad = ST.dlq_split(df, [(F.col("a").isNull(), "MissingValue", F.lit("a is null")),
                                  (F.col("b") == 0, "ZeroDivisionError", F.concat(F.lit("row "), F.col("id").cast("string")))])
    assert [r.id for r in good.collect()] == [1] and good.columns == df.columns
    letters = {r.id: r for r in bad.collect()}
    assert {i: (r.error_type, r.error) for i, r in letters.items()} == {2: ("ZeroDivisionError", "row 2"), 3: ("MissingValue", "a is null")}
    assert letters[2].traceback == "check 2 (ZeroDivisionError): row 2" and json.loads(letters[2].event) == {"id": 2, "a": 5, "b": 0}


def test_streaming_write_of_messages(spark):
    import json
    from tidewatch.sources import sinks as S
    from tidewatch.streaming.runner import fresh_dir
    src, out = fresh_dir(spark, "src"), fresh_dir(spark, "out")
    rows = [(f"10.0.0.{i % 3}", i) for i in range(20)]
    spark.createDataFrame(rows, "src_ip string, n long").write.parquet(src)
    stream = spark.readStream.schema("src_ip string, n long").parquet(src)
    S.stream_messages(stream, fresh_dir(spark, "ck"), path=out, topic="alerts", key_col="src_ip", availableNow=True).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert {(r.topic, r.key, json.loads(r.value)["n"]) for r in got} == {("alerts", k, n) for k, n in rows}
