"""Plain-Python models and properties for the rows-only and custom operators."""

from __future__ import annotations

import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions.text import chunks
from tidewatch.operators import joins as J
from tidewatch.operators import state as ST
from tidewatch.operators import windows as W
from tidewatch.operators.numbering import sequence_number
from tidewatch.operators.vector import cosine_topk
from tidewatch.plans import views as V

from conftest import SF_SMALL

T0 = datetime(2024, 1, 1)


# ------------------------------------------------------------------ chunking

@pytest.fixture
def chunk_text(spark):
    def run(text, max_tokens=250, overlap=50):
        return spark.createDataFrame([(text,)], "t string").select(chunks("t", max_tokens, overlap)).first()[0]
    return run


def test_chunk_short_text_is_whole(chunk_text):
    assert chunk_text("a" * 1000) == ["a" * 1000]


def test_chunk_header_rule_first(chunk_text):
    sec = "## head\n" + "word " * 150
    text = sec + "\n" + sec + "\n\n" + sec
    chunks = chunk_text(text, 250, 50)
    # three header sections of ~190 tokens: each boundary starts a new chunk
    assert len(chunks) == 3
    assert chunks[0] == sec.rstrip("\n") or chunks[0].startswith("## head")
    # each later chunk starts with the 50 carried words of the previous chunk
    carried = " ".join(chunks[0].split()[-50:])
    assert chunks[1].startswith(carried + "\n")


def test_chunk_paragraphs_then_lines_then_sentences(chunk_text):
    para = ("x" * 400 + "\n\n") * 4
    assert len(chunk_text(para, 250, 50)) == 2        # 100 tokens per piece, two fit per chunk
    lines = ("y" * 400 + "\n") * 4
    assert len(chunk_text(lines, 250, 50)) == 2
    sents = "Short one. " * 200
    out = chunk_text(sents.strip(), 250, 50)
    assert len(out) > 1 and all(len(c.split()) <= 50 + 260 for c in out)


def test_chunk_overlap_is_at_most_50_words(chunk_text):
    random.seed(3)
    text = "\n".join(" ".join(random.choice("abcdefg") * 3 for _ in range(60)) for _ in range(40))
    chunks = chunk_text(text, 250, 50)
    for prev, nxt in zip(chunks, chunks[1:]):
        head = nxt.split("\n", 1)[0]
        assert len(head.split()) <= 50
        assert head.split() == prev.split()[-len(head.split()):]


def test_chunk_oversized_piece_not_split(chunk_text):
    text = "z" * 5000 + "\n" + "short"
    chunks = chunk_text(text, 250, 50)
    assert chunks[0] == "z" * 5000


# --------------------------------------------------------- rate with reset

def _rate_reset_model(events, window_s, threshold):
    out, lists = [], {}
    for key, t, eid in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        lst = lists.setdefault(key, [])
        lst.append(t)
        lst[:] = [x for x in lst if (t - x).total_seconds() < window_s]
        if len(lst) > threshold:
            out.append((key, eid, len(lst)))
            lists[key] = []
    return sorted(out)


def test_rate_with_reset_matches_model(spark):
    fl = V.v_flows(spark, SF_SMALL).select("event_id", "event_time", "src_ip")
    got = ST.process_events(fl, ["src_ip"], ["event_time", "event_id"], ST.rate_with_reset(6 * 3600, 2),
                            ST.RATE_RESET_SCHEMA)
    got = sorted((r.src_ip, r.event_id, r["count"]) for r in got.collect())
    rows = [(r.src_ip, r.event_time, r.event_id) for r in fl.collect()]
    assert got == _rate_reset_model(rows, 6 * 3600, 2)
    assert got, "fixture should raise alerts"
    segmented = ST.process_events(fl, ["src_ip"], ["event_time", "event_id"], ST.rate_with_reset(6 * 3600, 2),
                                  ST.RATE_RESET_SCHEMA, independent_after_s=6 * 3600)
    assert sorted((r.src_ip, r.event_id, r["count"]) for r in segmented.collect()) == got


# ------------------------------------------------- hot-key safe operators

def _skewed(spark, n=3000):
    random.seed(11)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{random.randint(0, 40)}"
        rows.append((i, key, T0 + timedelta(seconds=random.randint(0, 36 * 3600)), random.choice("ab")))
    return spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, v string")


def test_sequence_number_equals_row_number(spark):
    df = _skewed(spark)
    got = sequence_number(df, ["key"], ["ts", "id"], "seq")
    ref = df.select("id", (F.row_number().over(Window.partitionBy("key").orderBy("ts", "id")) - 1).alias("ref"))
    bad = got.join(ref, "id").filter("seq != ref").count()
    assert bad == 0


def test_previous_and_runs(spark):
    df = _skewed(spark)
    got = W.previous_in_key(df, ["key"], ["ts", "id"], ["v"]).select("id", "prev_v")
    ref = df.select("id", F.lag("v").over(Window.partitionBy("key").orderBy("ts", "id")).alias("r"))
    assert got.join(ref, "id").filter(~F.col("prev_v").eqNullSafe(F.col("r"))).count() == 0


def test_rate_in_range_equals_window(spark):
    df = _skewed(spark)
    got = W.rate_in_range(df, "key", "ts", 600, "rate").select("id", "rate")
    w = Window.partitionBy("key").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-600_000_000, 0)
    ref = df.select("id", F.count("*").over(w).alias("r"))
    assert got.join(ref, "id").filter("rate != r").count() == 0


@pytest.mark.parametrize("how,bucket", [("inner", None), ("left", None), ("inner", 120), ("left", 120)])
def test_interval_join_equals_naive(spark, how, bucket):
    left = _skewed(spark).select(F.col("id").alias("lid"), "key", F.col("ts").alias("lt"))
    right = _skewed(spark, 1500).select(F.col("id").alias("rid"), F.col("key").alias("rkey"), F.col("ts").alias("rt"))
    got = J.interval_join(left, right, [("key", "rkey")], "lt", "rt", -300, 900, how, bucket).select("lid", "rid")
    cond = (left.key == right.rkey) & (right.rt >= left.lt - F.expr("INTERVAL 300 SECONDS")) \
        & (right.rt <= left.lt + F.expr("INTERVAL 900 SECONDS"))
    ref = left.join(right, cond, how).select("lid", "rid")
    assert sorted(got.collect()) == sorted(ref.collect())


# ---------------------------------------------------------------- properties

def test_kv_upsert_order_insensitive(spark):
    rows = [("a", "1", T0, 1), ("a", "2", T0 + timedelta(1), 2), ("b", "x", T0, 3), ("a", "3", T0 + timedelta(1), 4)]
    df = spark.createDataFrame(rows, "key string, value string, updated_at timestamp_ntz, seq long")
    shuffled = spark.createDataFrame(list(reversed(rows)), df.schema).repartition(3)
    a = sorted(ST.kv_latest(df, "key", "value", "updated_at", "seq").collect())
    b = sorted(ST.kv_latest(shuffled, "key", "value", "updated_at", "seq").collect())
    assert a == b and dict((r.key, r.value) for r in a) == {"a": "3", "b": "x"}


def test_dlq_split_partitions_input(spark):
    from tidewatch.plans.q_state import route_flows
    good, bad = route_flows(spark, SF_SMALL)
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert good.count() + bad.count() == events + docs


def test_cosine_topk_brute_force(spark):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(300, 16)).astype(np.float32)
    queries = rng.normal(size=(4, 16)).astype(np.float32)
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, embedding array<float>")
    qdf = spark.createDataFrame([(100 + j, v.tolist()) for j, v in enumerate(queries)], "qid long, query_vec array<float>")
    got = cosine_topk(cdf.repartition(5), qdf, 7).collect()
    c = corpus.astype(np.float64) / np.linalg.norm(corpus.astype(np.float64), axis=1, keepdims=True)
    for j, q in enumerate(queries.astype(np.float64)):
        sims = c @ (q / np.linalg.norm(q))
        want = list(np.lexsort((np.arange(300), -sims))[:7])
        have = [r.id for r in sorted((r for r in got if r.qid == 100 + j), key=lambda r: r["rank"])]
        assert have == want


def test_rrf_is_monotone_in_rank():
    from tidewatch.operators.search import RRF_K
    scores = [1.0 / (RRF_K + r) for r in range(50)]
    assert all(a > b for a, b in zip(scores, scores[1:]))


def test_hybrid_topk_within_candidates(spark):
    from tidewatch.operators import search as S
    kb, q = V.v_knowledge(spark, SF_SMALL), V.v_queries(spark, SF_SMALL)
    top = {(r.qid, r.id) for r in S.hybrid(kb, q, 5).collect()}
    n = S.candidates(5)
    cands = {(r.qid, r.id) for r in S.semantic_topk(kb, q, n).collect()}
    cands |= {(r.qid, r.id) for r in S.fts_topk(kb, q, n).collect()}
    content = {r.id: r.content for r in kb.select("id", "content").collect()}
    by_content = {(qid, content[i]) for qid, i in cands}
    assert all((qid, content[i]) in by_content for qid, i in top)


def test_vector_search_takes_odd_rows(spark):
    """Null, ragged and gapped vectors are nobody's neighbours; blocks of queries change nothing."""
    from tidewatch.operators import vector as VEC
    kb = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, "b"), (3, [1.0], "c"), (4, [0.0, None], "d"),
                                (5, [0.0, 2.0], "e"), (6, [1.0, 0.0], "f"), (None, [1.0, 0.0], "g")],
                               "id long, embedding array<float>, tag string")
    # the smallest id has a vector of another length; each length is searched among its own
    q = spark.createDataFrame([(0, [2.0])] + [(i, [1.0, 0.1 * i]) for i in range(1, 8)] + [
        (90, None), (91, [1.0, 2.0, 3.0]), (92, [float("nan"), 1.0])], "qid long, query_vec array<float>")
    want = sorted([(0, 3, 0)] + [(i, r, n) for i in range(1, 8) for n, r in enumerate((1, 6))])
    for block in (VEC.QUERY_BLOCK, 2):
        old, VEC.QUERY_BLOCK = VEC.QUERY_BLOCK, block
        try:
            got = VEC.in_blocks(q, "qid", lambda b: VEC.cosine_topk(kb, b, 2, carry=("tag",)), block)
            assert sorted((r.qid, r.id, r["rank"]) for r in got.collect()) == want
            assert {(r.id, r.tag) for r in got.collect()} == {(1, "a"), (3, "c"), (6, "f")}
        finally:
            VEC.QUERY_BLOCK = old
    assert {(r.id, r.pattern_id) for r in VEC.best_match(kb, q, 0.5).collect()} == {(1, 1), (3, 0), (6, 1), (5, 7)}


def test_search_pipeline_keyword_and_category(spark):
    from tidewatch.operators import search as S
    kb = V.v_knowledge(spark, SF_SMALL).filter("embedding is not null")
    word = "keyword"
    q = V.v_queries(spark, SF_SMALL).limit(3).withColumn(word, F.lit("the"))
    n = S.candidates(5)
    by_text = {(r.qid, r.id) for r in S.fused_lists(kb, q, n).filter("fts_rank is not null").collect()}
    by_word = {(r.qid, r.id) for r in S.fused_lists(kb, q, n, keyword_col=word).filter("fts_rank is not null").collect()}
    assert by_word - by_text
    assert S.search_pipeline(kb, q, 3, keyword_col=word).count() == 9
    some = kb.select("category").first()[0]
    got = S.semantic_topk(kb, q, 2, category=some).join(kb.select("id", "category"), "id")
    assert {r.category for r in got.collect()} == {some}


def test_approx_distinct_error_bound(spark):
    from tidewatch.operators.aggregates import distinct_count
    fl = V.v_flows(spark, "/root/testdata/sf0.01")
    got = fl.groupBy("dst_ip").agg(distinct_count("event_id", approx=True).alias("a"),
                                   distinct_count("event_id").alias("e")).collect()
    assert all(abs(r.a - r.e) <= 0.1 * r.e for r in got)


def test_ordered_scans_ignore_session_time_zone(spark):
    """NTZ epochs are computed without the session time zone (DST-safe)."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [(i, "k", T0 + timedelta(days=69, hours=i % 5, minutes=i)) for i in range(200)]  # spans a DST switch
        df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
        got = sequence_number(df, ["key"], ["ts", "id"], "seq")
        ref = df.select("id", (F.row_number().over(Window.partitionBy("key").orderBy("ts", "id")) - 1).alias("ref"))
        assert got.join(ref, "id").filter("seq != ref").count() == 0
        rate = W.rate_in_range(df, "key", "ts", 3600, "r")
        wall_us = F.expr("unix_date(cast(ts AS DATE)) * 86400000000L + (hour(ts) * 3600L + minute(ts) * 60L)"
                         " * 1000000L + cast(date_part('SECOND', ts) * 1000000 AS BIGINT)")
        w = Window.partitionBy("key").orderBy(wall_us).rangeBetween(-3_600_000_000, 0)
        ref2 = df.select("id", F.count("*").over(w).alias("r2"))
        assert rate.join(ref2, "id").filter("r != r2").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_sessionize_equals_per_key_window(spark):
    df = _skewed(spark)
    got = W.sessionize(df, ["key"], "ts", "20 minutes", ["ts", "id"]).select("id", "_session")
    w = Window.partitionBy("key").orderBy("ts", "id")
    prev = F.lag("ts").over(w)
    start = (prev.isNull() | (F.col("ts") > prev + F.expr("INTERVAL 20 MINUTES"))).cast("int")
    ref = df.select("*", start.alias("s")).select(
        "id", (F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("ref"))
    assert got.join(ref, "id").filter("_session != ref").count() == 0


def test_embedder_memory_does_not_grow_with_the_vocabulary(monkeypatch):
    import tracemalloc
    from tidewatch.functions import text as TX
    texts = [" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(100)]
    few = texts[:3] + ["", None, "one", "a b a b", " . "]
    want = TX.hashed_embed(few)
    tracemalloc.start()
    try:
        TX.hashed_embed(texts)
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(TX, "_HASHES_KEPT", 10)
    monkeypatch.setattr(TX, "_WORDS_AT_ONCE", 3)
    assert (TX.hashed_embed(few) == want).all()
