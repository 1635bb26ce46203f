"""§2.9 knowledge base over v_knowledge (all documents) and v_queries (all benchmark passages)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewatch.functions import text as TX
from tidewatch.operators import ann as ANN
from tidewatch.operators import search as S
from tidewatch.operators import text_index as TI
from tidewatch.operators import vector as VEC
from tidewatch.session import scratch_path
from tidewatch.sources.tables import load, TABLES
from tidewatch.plans import views as V
from tidewatch.plans.catalog import register
from tidewatch.plans.oracle_views import sql, tokens_sql
from tidewatch.plans.q_joins import IP_SCORES_SQL, ip_scores

COS = "list_cosine_similarity(CAST(k.embedding AS DOUBLE[]), CAST(q.query_vec AS DOUBLE[]))"


def sem_sql(n: int, where: str = "TRUE") -> str:
    return f"""
SELECT qid, id, content, sim AS similarity, rank FROM (
  SELECT q.qid, k.id, k.content, {COS} AS sim,
         row_number() OVER (PARTITION BY q.qid ORDER BY {COS} DESC, k.id) - 1 AS rank
  FROM (SELECT * FROM v_queries WHERE query_vec IS NOT NULL) q
  CROSS JOIN (SELECT * FROM v_knowledge WHERE embedding IS NOT NULL AND {where}) k) WHERE rank < {n}"""


def fts_sql(n: int) -> str:
    return f"""
SELECT qid, id, content, score, rank FROM (
  SELECT per.qid, per.id, k.content, CAST(per.tf_sum AS DOUBLE) / per.n_tokens AS score,
         row_number() OVER (PARTITION BY per.qid ORDER BY CAST(per.tf_sum AS DOUBLE) / per.n_tokens DESC, per.id) - 1
           AS rank
  FROM (SELECT qid, id, count(*) AS matched, sum(tf) AS tf_sum, max(n_tokens) AS n_tokens FROM (
          SELECT qt.qid, dt.id, dt.token, count(*) AS tf, max(dt.n_tokens) AS n_tokens
          FROM (SELECT id, unnest(toks) AS token, len(toks) AS n_tokens
                FROM (SELECT id, {tokens_sql('content')} AS toks FROM v_knowledge)) dt
          JOIN (SELECT qid, unnest(list_distinct({tokens_sql('query_text')})) AS token FROM v_queries) qt
            ON qt.token = dt.token
          GROUP BY ALL) GROUP BY qid, id) per
  JOIN (SELECT qid, len(list_distinct({tokens_sql('query_text')})) AS n_terms FROM v_queries) nt
    ON nt.qid = per.qid AND nt.n_terms = per.matched AND nt.n_terms > 0
  JOIN v_knowledge k ON k.id = per.id) WHERE rank < {n}"""


FUSED_SQL = """
SELECT coalesce(v.qid, f.qid) AS qid, coalesce(v.content, f.content) AS content, coalesce(v.vid, f.fid) AS id,
       v.vector_rank, f.fts_rank, v.similarity, f.fts_score,
       coalesce(1.0::DOUBLE / (60 + v.vector_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + f.fts_rank), 0.0) AS rrf_score
FROM (SELECT qid, content, max(rank) AS vector_rank, arg_min(id, rank) AS vid, arg_min(similarity, rank) AS similarity
      FROM sem GROUP BY qid, content) v
FULL OUTER JOIN (SELECT qid, content, max(rank) AS fts_rank, arg_min(id, rank) AS fid, arg_min(score, rank) AS fts_score
                 FROM fts GROUP BY qid, content) f
  ON v.qid = f.qid AND v.content = f.content"""


def hybrid_ctes(k: int):
    n = S.candidates(k)
    top = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, id) - 1 AS rank
              FROM fused) WHERE rank < {k}"""
    return (("sem", sem_sql(n)), ("fts", fts_sql(n)), ("fused", FUSED_SQL), ("hybrid", top))


def _kb(spark, sf_dir, vectors=True):
    return V.v_knowledge(spark, sf_dir, vectors)


def _q(spark, sf_dir):
    return V.v_queries(spark, sf_dir)


def text_index(spark, sf_dir):
    """The stored postings of the knowledge view.  They are built at first use and kept below the shared
    folder under a name made of the table's files, their sizes and times, so a changed table gets a
    new index; a last written mark tells a whole index from an interrupted build."""
    m = F.col("_metadata")
    files = load(spark, sf_dir, "documents").select(F.xxhash64(
        m["file_path"], m["file_size"], m["file_modification_time"].cast("string")).cast("decimal(38,0)").alias("h"))
    state = files.agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).first()
    path = scratch_path(spark, f"kb/text-index-{state['n']}-{abs(state['h'] or 0)}")
    try:
        spark.read.schema("id bigint").parquet(f"{path}/whole")
    except AnalysisException:
        TI.build(_kb(spark, sf_dir, vectors=False), path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/whole")
    return TI.TextIndex(spark, path)


def _stored(spark, sf_dir):
    """What the hybrid searches read besides the vectors: the postings, and the texts without the join that
    gives the vectors."""
    return {"index": text_index(spark, sf_dir), "texts": _kb(spark, sf_dir, vectors=False)}


@register("kb_semantic_search", sql("SELECT qid, id, round(similarity, 6) AS similarity, rank FROM sem",
                                    "v_knowledge", "v_queries", ctes=(("sem", sem_sql(5)),)))
def kb_semantic_search(spark, sf_dir):
    r = S.semantic_topk(_kb(spark, sf_dir), _q(spark, sf_dir), 5)
    return r.select("qid", "id", F.round("similarity", 6).alias("similarity"), "rank")


@register("kb_fts_search", sql("SELECT qid, id, score, rank FROM fts", "v_knowledge", "v_queries",
                               ctes=(("fts", fts_sql(5)),)))
def kb_fts_search(spark, sf_dir):
    return text_index(spark, sf_dir).search(_q(spark, sf_dir), 5)


@register("kb_inverted_index", sql(f"""
SELECT token, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS coll_freq FROM (
  SELECT token, id, count(*) AS tf FROM (SELECT id, unnest({tokens_sql('content')}) AS token FROM v_knowledge)
  GROUP BY ALL) GROUP BY token""", "v_knowledge"))
def kb_inverted_index(spark, sf_dir):
    return text_index(spark, sf_dir).token_stats().select("token", "doc_freq", "coll_freq")


@register("join_fuse_full", sql("""
SELECT qid, id, vector_rank, fts_rank, round(similarity, 6) AS similarity FROM fused""",
    "v_knowledge", "v_queries", ctes=hybrid_ctes(5)[:3]))
def join_fuse_full(spark, sf_dir):
    fused = S.fused_lists(_kb(spark, sf_dir), _q(spark, sf_dir), S.candidates(5), **_stored(spark, sf_dir))
    return fused.select("qid", "id", "vector_rank", "fts_rank", F.round("similarity", 6).alias("similarity"))


@register("kb_hybrid_rrf", sql("""
SELECT qid, id, round(rrf_score, 10) AS rrf_score, round(similarity, 6) AS similarity, rank FROM hybrid""",
    "v_knowledge", "v_queries", ctes=hybrid_ctes(5)))
def kb_hybrid_rrf(spark, sf_dir):
    h = S.hybrid(_kb(spark, sf_dir), _q(spark, sf_dir), 5, **_stored(spark, sf_dir))
    return h.select("qid", "id", F.round("rrf_score", 10).alias("rrf_score"),
                    F.round("similarity", 6).alias("similarity"), "rank")


JACCARD = (f"CAST(len(list_intersect(list_distinct({tokens_sql('q.query_text')}), list_distinct({tokens_sql('h.content')})))"
           f" AS DOUBLE) / nullif(len(list_distinct(list_concat(list_distinct({tokens_sql('q.query_text')}),"
           f" list_distinct({tokens_sql('h.content')})))), 0)")


@register("kb_rerank", sql(f"""
SELECT qid, id, round(relevance_score, 6) AS relevance_score, rerank FROM (
  SELECT h.qid, h.id, coalesce({JACCARD}, 0.0) AS relevance_score,
         row_number() OVER (PARTITION BY h.qid ORDER BY coalesce({JACCARD}, 0.0) DESC, h.rank) - 1 AS rerank
  FROM hybrid h JOIN v_queries q ON q.qid = h.qid) WHERE rerank < 5""",
    "v_knowledge", "v_queries", ctes=hybrid_ctes(20)))
def kb_rerank(spark, sf_dir):
    kb, q = _kb(spark, sf_dir), _q(spark, sf_dir)
    cands = S.hybrid(kb, q, 20, **_stored(spark, sf_dir))
    r = S.rerank(cands, q, 5)
    return r.select("qid", "id", F.round("relevance_score", 6).alias("relevance_score"), "rerank")


@register("kb_search_pipeline", sql(f"""
SELECT qid, id, round(relevance_score, 4) AS relevance_score, rerank FROM (
  SELECT h.qid, h.id, coalesce({JACCARD}, 0.0) AS relevance_score,
         row_number() OVER (PARTITION BY h.qid ORDER BY coalesce({JACCARD}, 0.0) DESC, h.key_order) - 1 AS rerank
  FROM (SELECT * FROM (
          SELECT hy.*, kk.created_at,
                 row_number() OVER (PARTITION BY hy.qid, substr(hy.content, 1, 100)
                                    ORDER BY kk.created_at DESC, hy.rank) AS rn,
                 min(hy.rank) OVER (PARTITION BY hy.qid, substr(hy.content, 1, 100)) AS key_order
          FROM hybrid hy JOIN v_knowledge kk ON kk.id = hy.id) WHERE rn = 1) h
  JOIN v_queries q ON q.qid = h.qid) WHERE rerank < 5""",
    "v_knowledge", "v_queries", ctes=hybrid_ctes(20)))
def kb_search_pipeline(spark, sf_dir):
    r = S.search_pipeline(_kb(spark, sf_dir), _q(spark, sf_dir), 5, **_stored(spark, sf_dir))
    return r.select("qid", "id", F.round("relevance_score", 4).alias("relevance_score"), "rerank")


@register("kb_relevance_gate", sql("""
SELECT qid, id, round(similarity, 6) AS similarity, round(rrf_score, 10) AS rrf_score FROM hybrid
WHERE coalesce(similarity, 0.0) > 0.25 OR rrf_score > 0.015""", "v_knowledge", "v_queries", ctes=hybrid_ctes(3)))
def kb_relevance_gate(spark, sf_dir):
    h = S.relevance_gate(S.hybrid(_kb(spark, sf_dir), _q(spark, sf_dir), 3, **_stored(spark, sf_dir)))
    return h.select("qid", "id", F.round("similarity", 6).alias("similarity"),
                    F.round("rrf_score", 10).alias("rrf_score"))


FILTER_WHERE = (f"list_contains({tokens_sql('content')}, 'the') AND json_extract_string(metadata, '$.ip') IN "
                f"(SELECT src_ip FROM ip_scores WHERE threat_score > 20)")


@register("kb_filtered_vector", sql("SELECT qid, id, round(similarity, 6) AS similarity, rank FROM sem",
    "v_knowledge", "v_queries", "v_flows", ctes=(("ip_scores", IP_SCORES_SQL), ("sem", sem_sql(10, FILTER_WHERE)))))
def kb_filtered_vector(spark, sf_dir):
    """Vector order + FTS predicate + join on a JSON field + numeric filter, filters before scoring."""
    kb = _kb(spark, sf_dir)
    hot = ip_scores(spark, sf_dir).filter(F.col("threat_score") > 20).select(F.col("src_ip").alias("_ip"))
    cand = kb.filter(F.array_contains(TX.tokens("content"), "the")) \
             .join(hot, F.get_json_object("metadata", "$.ip") == F.col("_ip"), "left_semi")
    r = VEC.cosine_topk(cand, _q(spark, sf_dir), 10)
    return r.select("qid", "id", F.round("similarity", 6).alias("similarity"), "rank")


@register("kb_cross_tenant", sql("""
SELECT qid, id, 'fr' AS tenant, round(similarity, 6) AS similarity, rank FROM sem""",
    "v_knowledge", "v_queries", ctes=(("sem", sem_sql(5, "tenant = 'fr'")),)))
def kb_cross_tenant(spark, sf_dir, tenant="fr"):
    """Read-only search in another cell's knowledge: the same search with a tenant predicate."""
    kb = _kb(spark, sf_dir).filter(F.col("tenant") == tenant)
    r = VEC.cosine_topk(kb, _q(spark, sf_dir), 5, carry=("tenant",))
    return r.select("qid", "id", "tenant", F.round("similarity", 6).alias("similarity"), "rank")


@register("join_pattern_match", sql(f"""
SELECT id, pattern_id, round(similarity, 6) AS similarity FROM (
  SELECT k.id, q.qid AS pattern_id, {COS} AS similarity,
         row_number() OVER (PARTITION BY k.id ORDER BY {COS} DESC, q.qid) AS rn
  FROM (SELECT * FROM v_knowledge WHERE embedding IS NOT NULL) k
  CROSS JOIN (SELECT * FROM v_queries WHERE query_vec IS NOT NULL) q) WHERE rn = 1 AND similarity > 0.3""", "v_knowledge", "v_queries"))
def join_pattern_match(spark, sf_dir):
    m = VEC.best_match(_kb(spark, sf_dir), _q(spark, sf_dir), 0.3)
    return m.select("id", "pattern_id", F.round("similarity", 6).alias("similarity"))


@register("kb_ttl", sql("""
SELECT id, expires_at FROM v_knowledge WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-02 04:00:00'""",
    "v_knowledge"))
def kb_ttl(spark, sf_dir):
    kb = _kb(spark, sf_dir, vectors=False)
    return S.not_expired(kb, F.lit("2024-01-02 04:00:00").cast("timestamp_ntz")).select("id", "expires_at")


# ---- ingest, index and statistics ----

# the fold of chunks_sql: the first piece opens the first chunk, each step closes it or adds a piece
CHUNK_SQL = r"""
SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk_no, unnest(c) AS chunk FROM (
  SELECT doc_id, CASE WHEN length(text) // 4 <= 250 THEN [text] ELSE list_append(f.closed, f.open) END AS c FROM (
    SELECT doc_id, text, list_reduce(list_transform(pieces, lambda p: struct_pack(
        closed := CAST([] AS VARCHAR[]), open := p, size := length(p) // 4)),
      lambda a, b: CASE WHEN a.size + b.size > 250
        THEN struct_pack(closed := list_append(a.closed, a.open),
                         open := array_to_string(list_filter(regexp_split_to_array(a.open, '\s+'),
                                   lambda w: w <> '')[-50:], ' ') || chr(10) || b.open, size := 50 + b.size)
        ELSE struct_pack(closed := a.closed, open := a.open || chr(10) || b.open, size := a.size + b.size) END) AS f
    FROM (SELECT doc_id, text, CASE
        WHEN contains(text, chr(10) || '##') THEN string_split(replace(text, chr(10) || '##', chr(1) || '##'), chr(1))
        WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10))
        WHEN contains(text, chr(10)) THEN string_split(text, chr(10))
        ELSE string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS pieces
      FROM documents WHERE text IS NOT NULL)))"""


@register("kb_chunk", "SELECT doc_id, chunk_no, CAST(length(chunk) AS INTEGER) AS chunk_chars, chunk FROM ("
                      + CHUNK_SQL + ")")
def kb_chunk(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(TX.chunks("text")).alias("chunk_no", "chunk")) \
               .select("doc_id", "chunk_no", F.length("chunk").alias("chunk_chars"), "chunk")


# the embedder's rule in SQL; a vector is compared by its length, its non-zero places and a weighted sum
EMBED_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)),
        lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
h AS (SELECT doc_id, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % 384 AS b,
             CASE WHEN substr(md5(f), 9, 1) >= '8' THEN 1 ELSE -1 END AS s FROM f),
v AS (SELECT doc_id, b, CAST(sum(s) AS DOUBLE) AS v FROM h GROUP BY ALL HAVING sum(s) <> 0),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM v GROUP BY doc_id),
d AS (SELECT v.doc_id, count(*) AS nonzero, list(CAST(CAST(v / n AS FLOAT) AS DOUBLE) * (b + 1) ORDER BY b) AS terms
      FROM v JOIN n USING (doc_id) GROUP BY v.doc_id)
SELECT o.doc_id, 384 AS dimensions, CAST(coalesce(nonzero, 0) AS INTEGER) AS nonzero,
       coalesce(list_reduce(terms, lambda x, y: x + y), 0.0) AS weighted_sum
FROM documents o LEFT JOIN d USING (doc_id)"""


@register("kb_embed", EMBED_SQL)
def kb_embed(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    vectors = docs.select("doc_id", TX.embed_udf()("text").alias("v"))
    term = lambda s, x: F.struct((s["at"] + 1).alias("at"), (s["sum"] + x.cast("double") * s["at"]).alias("sum"))
    total = F.aggregate("v", F.struct(F.lit(1).alias("at"), F.lit(0.0).alias("sum")), term, lambda s: s["sum"])
    return vectors.select("doc_id", F.size("v").alias("dimensions"), F.size(F.filter("v", lambda x: x != 0)).alias("nonzero"),
                          total.alias("weighted_sum"))


def ingest(chunks_df, path: str, tenant_col: str = "tenant"):
    """``store()``: chunk -> embed -> append, partitioned by tenant."""
    chunks_df.write.mode("append").partitionBy(tenant_col).parquet(path)


@register("kb_ingest", f"""
SELECT c.doc_id, c.chunk_no, c.chunk AS content, d.source AS category, d.lang AS tenant, 384 AS dimensions,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at
FROM ({CHUNK_SQL}) c JOIN documents d USING (doc_id)""")
def kb_ingest(spark, sf_dir):
    """Chunks written with their embeddings, partitioned by tenant, and read back (the vectors'
    length stands for them in the result)."""
    docs = load(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id"), F.col("source").alias("category"), F.col("lang").alias("tenant"),
                         F.posexplode(TX.chunks("text")).alias("chunk_no", "content"))
    rows = chunks.select("doc_id", "chunk_no", "content", "category", "tenant",
                         TX.embed_udf()("content").alias("embedding"),
                         F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    path = scratch_path(spark, f"kb/knowledge-{uuid.uuid4().hex}")
    rows.write.mode("overwrite").partitionBy("tenant").parquet(path)
    return spark.read.parquet(path).select("doc_id", "chunk_no", "content", "category", "tenant",
                                           F.size("embedding").alias("dimensions"), "created_at")


@register("kb_ann_search", sql("SELECT qid, id, round(similarity, 6) AS similarity, rank FROM sem",
                               "v_knowledge", "v_queries", ctes=(("sem", sem_sql(5)),)))
def kb_ann_search(spark, sf_dir):
    """Build the index, open it again and search it: exact, as every cut is by a proven bound."""
    path = scratch_path(spark, f"kb/ann-{uuid.uuid4().hex}")
    ANN.build(_kb(spark, sf_dir).select("id", "embedding"), path)
    r = ANN.Index(spark, path).search(_q(spark, sf_dir), 5)
    return r.select("qid", "id", F.round("similarity", 6).alias("similarity"), "rank")


def table_stats(spark, sf_dir, names=TABLES):
    """Rows, bytes on disk and index kinds per table, as one union of small aggregates."""
    out = None
    for name in names:
        df = load(spark, sf_dir, name)
        kinds = []
        if any(str(f.dataType).startswith("ArrayType(FloatType") for f in df.schema.fields):
            kinds.append("vector")
        if any(str(f.dataType) == "StringType()" and f.name in ("text", "content", "html") for f in df.schema.fields):
            kinds.append("fts")
        # rows and bytes in one pass: per data file, then summed (no join)
        per_file = df.groupBy(F.col("_metadata.file_path").alias("p")).agg(
            F.count("*").alias("n"), F.max("_metadata.file_size").alias("s"))
        one = per_file.agg(F.sum("n").alias("rows"), F.sum("s").alias("size_bytes")).select(
            F.lit(name).alias("table"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
            F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"),
            F.lit(",".join(kinds)).alias("indexes"))
        out = one if out is None else out.unionByName(one)
    human = F.when(F.col("size_bytes") < 1024, F.format_string("%.1f B", F.col("size_bytes").cast("double"))) \
        .when(F.col("size_bytes") < 1024 ** 2, F.format_string("%.1f KB", F.col("size_bytes") / 1024)) \
        .when(F.col("size_bytes") < 1024 ** 3, F.format_string("%.1f MB", F.col("size_bytes") / 1024 ** 2)) \
        .otherwise(F.format_string("%.1f GB", F.col("size_bytes") / 1024 ** 3))
    return out.select("*", human.alias("size"))


ROWS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES)


@register("kb_stats", f"""
SELECT "table", rows, CASE "table" WHEN 'documents' THEN 'fts' WHEN 'benchmark' THEN 'fts' WHEN 'pages' THEN 'fts'
    WHEN 'conversations' THEN 'fts' WHEN 'embeddings' THEN 'vector' ELSE '' END AS indexes FROM ({ROWS_SQL})
UNION ALL
SELECT 'documents/' || source, count(*), 'category' FROM documents WHERE source IS NOT NULL GROUP BY source""")
def kb_stats(spark, sf_dir):
    """Rows and index kinds of every table, then entries per category (sizes: ``table_stats``)."""
    docs = load(spark, sf_dir, "documents")
    tables = table_stats(spark, sf_dir).select("table", "rows", "indexes")
    per = docs.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("rows"))
    return tables.unionByName(per.select(F.concat(F.lit("documents/"), "source").alias("table"), "rows",
                                         F.lit("category").alias("indexes")))


@register("kb_describe_schema", f"""
SELECT c.table_name AS "table", c.column_name AS "column",
  CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
    WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'DATE' THEN 'date' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(c.data_type) END AS type,
  true AS nullable, r.rows
FROM duckdb_columns() c JOIN ({ROWS_SQL}) r ON r."table" = c.table_name""")
def kb_describe_schema(spark, sf_dir):
    """Tables, columns, types and nullability from the catalog, with row counts."""
    rows = []
    counts = None
    for name in TABLES:
        df = load(spark, sf_dir, name)
        df.createOrReplaceTempView(f"kb_{name}")
        for c in spark.catalog.listColumns(f"kb_{name}"):
            rows.append((name, c.name, c.dataType, bool(c.nullable)))
        n = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = n if counts is None else counts.unionByName(n)
    cols = spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")
    return cols.join(counts, "table")
