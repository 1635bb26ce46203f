"""Full-text search, rank fusion, dedupe and re-ranking.

Everything runs set-based over a *batch* of queries (qid, query_text,
query_vec) at once: one plan from the query table to the top-k per query.
Candidate lists are cut with ``row_number() <= n`` (a partial limit before
the shuffle) before the expensive steps, so fusion and re-ranking only see n
rows per query.  Queries are taken in bounded blocks (``vector.in_blocks``);
what depends on a block's queries may be broadcast, text is never shuffled.

Deviation: the reference's Postgres ``ts_rank`` with English stemming and
stop words is not reproduced.  Lexemes are lower-cased letter/digit runs;
a document matches when it holds every query lexeme; its rank is the sum
of the query lexemes' term frequencies divided by its token count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import jaccard, tokens
from tidewatch.operators.text_index import TextIndex
from tidewatch.operators.vector import QueryBlock, cosine_topk, in_blocks
from tidewatch.operators.windows import top_per_group

# Fixed values of the reference's retrieval.
RRF_K = 60                 # reciprocal-rank constant; ranks are 0-based
SIMILARITY_GATE = 0.25     # relevance gate on cosine similarity
RRF_GATE = 0.015           # relevance gate on the fused score
DEDUPE_PREFIX = 100        # characters of content that key a "topic"


def candidates(k: int) -> int:
    """Candidates fetched per side for a top-k request: max(4k, 20)."""
    return max(4 * k, 20)


def _top(df: DataFrame, qid: str, score: str, id_col: str, n: int) -> DataFrame:
    return top_per_group(df, [qid], [F.col(score).desc(), F.col(id_col).asc()], n, "rank", [id_col])


def fts_topk(corpus: DataFrame, queries: DataFrame | QueryBlock, k: int, id_col: str = "id",
             text_col: str = "content", qid: str = "qid", qtext: str = "query_text",
             index: TextIndex | None = None) -> DataFrame:
    """(qid, id, score, rank): documents holding all query lexemes, best k per query.

    With an ``index`` of the corpus its postings are read and no text.  Without one, each query is filed under its longest lexeme.  A document looks up only those of its
    lexemes that some query of the block is filed under, and verifies these queries in the scan
    stage; only matches are shuffled.  Null or blank texts and queries match nothing.
    """
    if index is not None:
        asked = queries.frame if isinstance(queries, QueryBlock) else queries
        return index.search(asked, k, qid, qtext).withColumnRenamed("id", id_col)

    def search(block: QueryBlock) -> DataFrame:
        q = block.frame.select(qid, F.array_distinct(tokens(qtext)).alias("_terms")).filter(F.size("_terms") > 0)
        longest = F.array_max(F.transform("_terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
        filed = q.select(qid, "_terms", longest.alias("_filed"))
        names = sorted({r[0] for r in filed.select("_filed").collect()})     # at most one per query of the block
        docs = corpus.select(id_col, tokens(text_col).alias("_toks"))
        known = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
        asked = docs.select(id_col, "_toks", F.explode_outer(F.array_intersect("_toks", known)).alias("_filed")) \
            .filter(F.col("_filed").isNotNull())
        pairs = asked.join(F.broadcast(filed), "_filed").filter(F.size(F.array_except("_terms", "_toks")) == 0)
        terms = F.col("_terms")
        score = F.size(F.filter("_toks", lambda t: F.array_contains(terms, t))) / F.size("_toks")
        return _top(pairs.select(qid, id_col, score.alias("score")), qid, "score", id_col, k)

    return in_blocks(queries, qid, search)


def semantic_topk(corpus: DataFrame, queries: DataFrame | QueryBlock, k: int, category: str | None = None,
                  id_col: str = "id", vec_col: str = "embedding", carry=()) -> DataFrame:
    """(qid, id, similarity = 1 - cosine distance, rank); optional category predicate,
    applied before scoring so it reaches the scan."""
    if category is not None:
        corpus = corpus.filter(F.col("category") == category)
    return cosine_topk(corpus, queries, k, id_col, vec_col, carry=tuple(carry))


def rrf(rank_cols: list[str], k: int = RRF_K) -> Column:
    terms = [F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0)) for c in rank_cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def with_content(cands: DataFrame, corpus: DataFrame, id_col: str = "id", extra=()) -> DataFrame:
    """Attach ``content`` (and ``extra`` corpus columns) to the cut candidate lists of one block of
    queries.  Their number is bounded by the block and the cut, so the list is broadcast and the
    texts are picked in the scan stage."""
    return corpus.select(id_col, "content", *extra).join(F.broadcast(cands), id_col)


def fuse_ranked(vector: DataFrame, fts: DataFrame, corpus: DataFrame, qid: str = "qid",
                id_col: str = "id", extra=()) -> DataFrame:
    """Full outer merge of two ranked lists keyed by (qid, content), as one aggregation: both
    lists are tagged, unioned and given their content by a single join.

    A content repeated inside one list keeps its *last* (worst) rank, as the reference's rank map
    does; the representative row is the first vector hit with that content, else the first
    full-text hit (``min_by`` skips the other list's null ranks)."""
    none_l, none_d = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    tagged = vector.select(qid, id_col, F.col("rank").alias("_vr"), "similarity",
                           none_l.alias("_fr"), none_d.alias("_score")) \
        .unionByName(fts.select(qid, id_col, none_l.alias("_vr"), none_d.alias("similarity"),
                                F.col("rank").alias("_fr"), F.col("score").alias("_score")))
    # extra columns follow the representative row: first vector hit, else first text hit
    fused = with_content(tagged, corpus, id_col, extra).groupBy(qid, "content").agg(
        F.max("_vr").alias("vector_rank"), F.min_by(id_col, "_vr").alias("_vid"),
        F.min_by("similarity", "_vr").alias("similarity"),
        F.max("_fr").alias("fts_rank"), F.min_by(id_col, "_fr").alias("_fid"),
        F.min_by("_score", "_fr").alias("fts_score"),
        *[F.coalesce(F.min_by(c, "_vr"), F.min_by(c, "_fr")).alias(c) for c in extra])
    return fused.select(qid, "content", F.coalesce("_vid", "_fid").alias(id_col), "vector_rank", "fts_rank",
                        "similarity", "fts_score", *extra)


def fused_lists(corpus: DataFrame, queries: DataFrame | QueryBlock, n: int, keyword_col: str | None = None,
                qid: str = "qid", id_col: str = "id", extra=(), index: TextIndex | None = None,
                texts: DataFrame | None = None) -> DataFrame:
    """Both sides' best ``n`` per query, merged (``fuse_ranked``).  The full-text side uses
    ``keyword_col`` of the query table where it is set, else the query text.  ``texts`` are the
    corpus's ids, contents and ``extra`` columns where they can be read without its vectors: if the
    vectors come by a join, that join then moves no text."""
    def search(block: QueryBlock) -> DataFrame:
        words = block
        if keyword_col is not None:
            words = QueryBlock(block.rows, block.frame.select(
                qid, F.coalesce(keyword_col, "query_text").alias("query_text")))
        contents = corpus if texts is None else texts
        return fuse_ranked(semantic_topk(corpus, block, n, id_col=id_col), fts_topk(contents, words, n, id_col, index=index),
                           contents, qid, id_col, extra)

    return in_blocks(queries, qid, search)


def hybrid(corpus: DataFrame, queries: DataFrame | QueryBlock, k: int, keyword_col: str | None = None,
           qid: str = "qid", id_col: str = "id", extra=(), index: TextIndex | None = None,
           texts: DataFrame | None = None) -> DataFrame:
    """Hybrid search: max(4k, 20) candidates from each side, fused with
    reciprocal-rank fusion, best k per query (ties: lower id)."""
    fused = fused_lists(corpus, queries, candidates(k), keyword_col, qid, id_col, extra, index, texts)
    return _top(fused.select("*", rrf(["vector_rank", "fts_rank"]).alias("rrf_score")), qid, "rrf_score", id_col, k)


def rerank(cands: DataFrame, queries: DataFrame | QueryBlock, k: int, qid: str = "qid", id_col: str = "id",
           scorer=None, order_col: str = "rank") -> DataFrame:
    """Score (query, document) pairs and keep the best k per query.

    Default scorer: token Jaccard (pure SQL).  ``scorer(query_text, content)``
    may return any Column, e.g. a cross-encoder pandas UDF.  Ties keep the
    prior candidate order."""
    def score(block: QueryBlock) -> DataFrame:
        pairs = cands.join(F.broadcast(block.frame.select(qid, "query_text")), qid)
        if scorer:
            scored = pairs.select(*cands.columns, scorer(F.col("query_text"), F.col("content")).alias("relevance_score"))
        else:
            # token sets computed once per pair, then both set sizes read them
            sets = pairs.select("*", F.array_distinct(tokens("query_text")).alias("_qs"),
                                F.array_distinct(tokens("content")).alias("_ds"))
            scored = sets.select(*cands.columns, jaccard(F.col("_qs"), F.col("_ds")).alias("relevance_score"))
        return top_per_group(scored, [qid], [F.col("relevance_score").desc(), F.col(order_col).asc()], k, "rerank",
                             [id_col])

    return in_blocks(queries, qid, score)


def dedupe_recent(cands: DataFrame, qid: str | None = "qid", created: str = "created_at",
                  order_col: str = "rank", key_len: int = DEDUPE_PREFIX, key_order: bool = True) -> DataFrame:
    """One candidate per (query, first ``key_len`` characters), or per prefix alone without ``qid``:
    strictly newest wins, else the first in candidate order.  With ``key_order`` each survivor keeps
    the position of its key's first appearance; without, the cut is limited before the shuffle."""
    keys = [*([qid] if qid else []), F.substring("content", 1, key_len)]
    w = Window.partitionBy(*keys).orderBy(F.col(created).desc(), F.col(order_col).asc())
    first = [F.min(order_col).over(Window.partitionBy(*keys)).alias("key_order")] if key_order else []
    return cands.select("*", F.row_number().over(w).alias("_rn"), *first).filter("_rn = 1").drop("_rn")


def search_pipeline(corpus: DataFrame, queries: DataFrame | QueryBlock, k: int = 5, qid: str = "qid",
                    id_col: str = "id", scorer=None, keyword_col: str | None = None, index: TextIndex | None = None,
                    texts: DataFrame | None = None) -> DataFrame:
    """Hybrid retrieval at max(4k, 20) (full-text side by ``keyword_col`` if given), dedupe by content
    prefix, re-rank, cut to k."""
    def search(block: QueryBlock) -> DataFrame:
        fused = hybrid(corpus, block, candidates(k), keyword_col, qid, id_col, ("created_at",), index, texts)
        return rerank(dedupe_recent(fused, qid), block, k, qid, id_col, scorer, order_col="key_order")

    return in_blocks(queries, qid, search)


def relevance_gate(results: DataFrame, sim_gate: float = SIMILARITY_GATE, rrf_gate: float = RRF_GATE) -> DataFrame:
    """Keep results with similarity > 0.25 or fused score > 0.015."""
    return results.filter((F.coalesce("similarity", F.lit(0.0)) > sim_gate) | (F.col("rrf_score") > rrf_gate))


def not_expired(df: DataFrame, as_of: Column, col: str = "expires_at") -> DataFrame:
    """TTL: entries without expiry or expiring after ``as_of`` (the declared-only column)."""
    return df.filter(F.col(col).isNull() | (F.col(col) > as_of))
