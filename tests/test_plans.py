"""Plan checks over every registered query: no cross products, top-k windows
limited before the shuffle, predicates pushed into the parquet scans."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as entry

from conftest import SF_SMALL

QUERIES = entry.queries()


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", [
    "dedup_recent_prefix", "tail_log", "win_ranked_tail", "dlq_tail", "kb_semantic_search", "kb_fts_search",
    "kb_hybrid_rrf", "kb_rerank", "kb_search_pipeline", "kb_relevance_gate", "kb_filtered_vector", "kb_cross_tenant",
    "kb_ann_search", "join_fuse_full"])
def test_topk_windows_limit_before_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    tree = plan.split("\n\n")[0]
    # a partial WindowGroupLimit below the exchange, a final one above it
    assert tree.count("WindowGroupLimit") >= 2, tree


def test_predicates_reach_the_scan(spark):
    plan = plan_of(QUERIES["kb_cross_tenant"](spark, SF_SMALL))
    assert "EqualTo(lang,fr)" in plan
    plan = plan_of(QUERIES["filter_predicates"](spark, SF_SMALL))
    assert "EqualTo(source,src3)" in plan
    plan = plan_of(QUERIES["win_tumble"](spark, SF_SMALL))
    # only the columns the summary needs are read (no props, no event_id)
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan


def test_text_search_reads_postings(spark):
    """With the stored index no text is read, shuffled or tokenized."""
    for name in ("kb_fts_search", "kb_inverted_index"):
        plan = plan_of(QUERIES[name](spark, SF_SMALL))
        schemas = [x for x in plan.split("\n") if x.startswith("ReadSchema")]
        assert schemas and not any("text" in x or "content" in x for x in schemas), schemas
        assert "tf:bigint" in plan or "coll_freq:bigint" in plan


def test_text_search_without_index_moves_no_text(spark):
    """A document verifies its queries in the scan stage: only (query, id, score) is shuffled."""
    from tidewatch.operators import search as S
    from tidewatch.plans import views as V
    plan = plan_of(S.fts_topk(V.v_knowledge(spark, SF_SMALL, False), V.v_queries(spark, SF_SMALL), 5))
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    shuffles = [x for x in plan.split("\n(") if "hashpartitioning(qid" in x]
    assert shuffles and not any("content#" in x or "text#" in x or "_toks#" in x for x in shuffles)


def test_scan_counts(spark):
    """Reads of the events table per query: one ordered scan where no key is large."""
    for name, scans in (("det_device_offline", 1), ("det_cpu_spike", 1), ("win_lag_change", 1), ("win_session", 1),
                        ("agg_status_rollup", 1), ("classify_topic", 5)):
        plan = plan_of(QUERIES[name](spark, SF_SMALL)).split("\n\n")[0]
        assert plan.count("Scan parquet") <= scans + (2 if name == "agg_status_rollup" else 0), (name, plan)


EXPENSIVE = ("from_json(", "split(", "regexp_extract_all(", "get_json_object(", "to_json(")
SIDE_EFFECT_KEYS = {"resume_checkpoint", "win_watermark_late", "sink_table", "kb_ingest"}


def _calls(section: str, name: str) -> list[str]:
    out, start = [], 0
    while (i := section.find(name, start)) >= 0:
        out.append(section[i:i + 80])
        start = i + 1
    return out


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SIDE_EFFECT_KEYS))
def test_expensive_expressions_evaluated_once(spark, name):
    """Catalyst can inline a parse or tokenizer into several consumers (or infer
    a filter that repeats it); the operators are written so that it does not."""
    import re
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    for sec in re.split(r"\n\(\d+\) ", plan)[1:]:
        head = sec.split("\n", 1)[0]
        if not head.startswith(("Project", "Filter", "HashAggregate", "Generate")):
            continue
        for fn in EXPENSIVE:
            calls = [c for c in _calls(sec, fn) if "query_text" not in c]   # the query batch is small
            assert len(calls) == len(set(calls)), f"{head}: {fn} evaluated {len(calls)}x"


@pytest.mark.parametrize("name", ["join_fuse_full", "kb_hybrid_rrf", "kb_rerank", "kb_relevance_gate", "kb_search_pipeline"])
def test_hybrid_search_joins_vectors_without_texts(spark, name):
    """The join of documents and embeddings moves ids and vectors only."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    shuffles = [x for x in plan.split("\n(") if "hashpartitioning(doc_id" in x]
    assert not any("text#" in x for x in shuffles), shuffles
