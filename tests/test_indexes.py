"""The stored indexes of the knowledge base: vectors in cells, postings in buckets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ann
from tidewatch.operators import search as S
from tidewatch.operators import text_index as TI
from tidewatch.operators.vector import cosine_topk
from tidewatch.plans import views as V
from tidewatch.session import scratch_path
from tidewatch.streaming.runner import fresh_dir


def found(df):
    return sorted((r.qid, r.id, r.similarity, r["rank"]) for r in df.collect())


def clustered(n, groups=60, dim=24, seed=3):
    """Rows around a few directions, as text embeddings are; ids shuffled, some vectors repeated."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dim))
    x[n // 2:n // 2 + 40] = x[0]
    return [(int(i), [float(v) for v in row]) for i, row in zip(rng.permutation(n), x)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(clustered(4000), "id long, embedding array<float>").repartition(6).cache()


@pytest.fixture(scope="module")
def questions(spark, corpus):
    return corpus.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("query_vec")).cache()


@pytest.fixture(scope="module")
def index(spark, corpus):
    path = fresh_dir(spark, "ann")
    ann.build(corpus, path)
    return ann.Index(spark, path)            # as a later run opens it


def test_index_is_exact_and_scores_few_pairs(corpus, questions, index):
    counts = {}
    got = found(index.search(questions, 5, counts=counts))
    assert got == found(cosine_topk(corpus, questions, 5))
    pairs = corpus.count() * questions.count()
    assert counts["by_code"] < 0.5 * pairs and counts["by_vector"] < 0.01 * pairs


def test_few_cells_reach_the_recall(corpus, questions, index):
    """The nearest three cells of a query: recall at 5 of 0.9 and more, under 10 % of pairs compared."""
    exact = {r[:2] for r in found(cosine_topk(corpus, questions, 5))}
    counts = {}
    got = {r[:2] for r in found(index.search(questions, 5, probes=3, counts=counts))}
    assert len(exact & got) / len(exact) >= 0.9
    assert counts["by_code"] + counts["by_vector"] < 0.1 * corpus.count() * questions.count()


def test_index_on_the_table(spark):
    """Every 20th row as a query against all rows of the embeddings table."""
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vec"))
    counts = {}
    index = ann.build(emb, fresh_dir(spark, "ann"), id_col="vec_id")
    got = found(index.search(q, 5, counts=counts))
    assert got == found(cosine_topk(emb, q, 5, id_col="vec_id").withColumnRenamed("vec_id", "id"))
    assert counts["by_vector"] < 0.1 * emb.count() * q.count()


def test_new_rows_are_a_segment(spark, corpus, questions):
    path = fresh_dir(spark, "ann")
    index = ann.build(corpus.where("id < 3000"), path)
    index.add(corpus.where("id >= 3000"))
    assert found(ann.Index(spark, path).search(questions, 5)) == found(cosine_topk(corpus, questions, 5))
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(9, [1.0])], "id long, embedding array<float>"))


def test_slices_and_query_blocks_change_nothing(corpus, questions, index, monkeypatch):
    monkeypatch.setattr(ann, "SLICE_ROWS", 30)
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", 70)
    assert found(index.search(questions, 3)) == found(cosine_topk(corpus, questions, 3))


def test_index_takes_odd_rows(spark):
    kb = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, None]), (5, [0.0, 2.0]), (6, [1.0, 0.0]),
                                (None, [1.0, 0.0]), (7, []), (8, [float("nan"), 1.0]), (9, [0.0, 0.0])],
                               "id long, embedding array<float>")
    q = spark.createDataFrame([(0, [2.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (90, None), (91, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])],
                              "qid long, query_vec array<float>")
    index = ann.build(kb, fresh_dir(spark, "ann"))
    assert found(index.search(q, 2)) == found(cosine_topk(kb, q, 2))
    empty = ann.build(kb.where("id > 99"), fresh_dir(spark, "ann"))
    assert empty.search(q, 2).count() == 0 and index.search(q.limit(0), 2).count() == 0


# -- postings

def texts(spark, n=200, seed=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Straße", "Été", "the"]
    rows = [(i, " ".join(["the"] * rng.randint(0, 3) + [rng.choice(words) for _ in range(rng.randint(1, 30))])) for i in range(n)]
    return spark.createDataFrame(rows + [(900, None), (901, " .,; "), (902, "the the THE")], "id long, content string").repartition(5)


QUESTIONS = [(1, "the"), (2, "w1 w2"), (3, "The, w5; w5"), (4, "absent w1"), (5, None), (6, " - "), (7, "straße"), (8, "w1 w2 w3 w4 w5")]


def hits(df):
    return sorted((r.qid, r.id, r.score, r["rank"]) for r in df.collect())


def test_postings_answer_as_the_texts_do(spark):
    kb = texts(spark)
    q = spark.createDataFrame(QUESTIONS, "qid long, query_text string")
    index = TI.build(kb, fresh_dir(spark, "ti"), buckets=4)
    for k in (3, 1000):
        assert hits(index.search(q, k)) == hits(S.fts_topk(kb, q, k))
    assert {r[0] for r in hits(index.search(q, 3))} >= {1, 2, 3, 7}
    stats = {r.token: (r.doc_freq, r.coll_freq) for r in index.token_stats().collect()}
    rows = [(r.id, (r.content or "").lower().replace(".,;", "").split()) for r in kb.collect()]
    assert stats["the"] == (sum("the" in w for _, w in rows), sum(w.count("the") for _, w in rows))


def test_shuffled_joins_answer_alike(spark, monkeypatch):
    """Above the size that is broadcast the same rows come out."""
    from tidewatch.operators import joins
    kb, q = texts(spark), spark.createDataFrame(QUESTIONS, "qid long, query_text string")
    index = TI.build(kb, fresh_dir(spark, "ti"), buckets=4)
    want = hits(index.search(q, 10))
    monkeypatch.setattr(joins.small_side, "__defaults__", (0,))
    assert hits(index.search(q, 10)) == want


def test_segments_add_up(spark):
    kb = texts(spark)
    q = spark.createDataFrame(QUESTIONS, "qid long, query_text string")
    path = fresh_dir(spark, "ti")
    index = TI.build(kb.where("id < 120"), path, buckets=4)
    index.write_segment(kb.where("id >= 120"), 1)
    index.write_segment(kb.where("id >= 120"), 1)          # a retry
    again = TI.TextIndex(spark, path, buckets=4)
    assert hits(again.search(q, 1000)) == hits(S.fts_topk(kb, q, 1000))
    whole = TI.build(kb, fresh_dir(spark, "ti"), buckets=4)
    assert sorted(map(tuple, again.token_stats().collect())) == sorted(map(tuple, whole.token_stats().collect()))


def test_stored_index_follows_its_table(spark, tmp_path):
    """The registered queries reuse an index of an unchanged table and build one for a changed table."""
    from tidewatch.plans.q_knowledge import text_index
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.where("doc_id < 50").write.parquet(str(tmp_path / "documents.parquet"))
    first = text_index(spark, str(tmp_path))
    assert text_index(spark, str(tmp_path)).path == first.path
    source.where("doc_id < 80").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    second = text_index(spark, str(tmp_path))
    assert second.path != first.path
    assert second.postings().select("id").distinct().count() > first.postings().select("id").distinct().count()
    assert scratch_path(spark, "kb/") in second.path


def test_hybrid_with_an_index(spark):
    kb, q = V.v_knowledge(spark, "/root/testdata/sf0.001"), V.v_queries(spark, "/root/testdata/sf0.001")
    index = TI.build(kb, fresh_dir(spark, "ti"))
    rows = lambda df: sorted((r.qid, r.id, r.rrf_score) for r in df.collect())
    assert rows(S.hybrid(kb, q, 5, index=index)) == rows(S.hybrid(kb, q, 5))


def test_terms_are_counted_in_their_own_row(spark):
    """Only rows whose id repeats are aggregated; the counts are those of one aggregation over all."""
    from tidewatch.functions.text import tokens
    kb = texts(spark)
    assert "hashpartitioning" not in TI.term_counts(kb)._jdf.queryExecution().executedPlan().toString()
    odd = kb.unionByName(spark.createDataFrame(
        [(1, "a b a"), (1, "a c c"), (2, "x"), (None, "n n"), (None, "n m"), (None, None)], "id long, content string"))
    for df in (kb, odd):
        want = (df.select("id", tokens("content").alias("t")).select("id", F.size("t").cast("long").alias("n_tokens"), F.explode("t").alias("token"))
                .groupBy("token", "id", "n_tokens").agg(F.count(F.lit(1)).alias("tf")).select("token", "id", "tf", "n_tokens"))
        got = TI.term_counts(df)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_large_lookups_shuffle_only_wanted_postings(spark, monkeypatch):
    kb, q = texts(spark), spark.createDataFrame(QUESTIONS, "qid long, query_text string")
    index = TI.build(kb, fresh_dir(spark, "ti"), buckets=4)
    posts = index.postings().select("bucket", "token", "id", "tf")
    wanted = posts.where("id in (3, 4, 900) and token <> 'the'").select("bucket", "token", "id").withColumn("qid", F.lit(1))
    plan = index._look_up(wanted, posts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2, plan
    want = hits(index.search(q, 10))
    for most in ("BROADCAST_IDS", "BROADCAST_ROWS"):           # sets too large to broadcast: the same rows
        monkeypatch.setattr(TI, most, 0)
        assert hits(index.search(q, 10)) == want
