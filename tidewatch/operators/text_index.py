"""Stored full-text index: postings bucketed by token, in segments.

``build`` tokenises every text once and writes (token, id, tf, n_tokens) partitioned by segment and
by a hash bucket of the token, with a small table of token statistics.  A search never reads a text:
each query fetches the postings of its rarest lexeme, and only for these documents the other
lexemes' postings are looked up.  New documents are a new segment; nothing is rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import tokens
from tidewatch.operators.joins import BROADCAST_ROWS, small_side
from tidewatch.operators.windows import top_per_group
from tidewatch.session import materialized

BUCKETS = 32
#: Ids up to which a set of documents is broadcast (a long each).
BROADCAST_IDS = 1_000_000

_POSTINGS = "token string, id bigint, tf bigint, n_tokens bigint, segment int, bucket int"
_TOKENS = "token string, doc_freq bigint, coll_freq bigint, segment int, bucket int"


def term_counts(corpus: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(token, id, tf, n_tokens): a document's lexemes with their frequency and its length.  Null
    and blank texts have none.

    A text's lexemes are counted in its own row, as the runs of their sorted array, so nothing is
    shuffled.  Only rows whose id repeats are merged by an aggregation (same id, same length)."""
    docs = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    repeated = materialized(docs.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id")))
    if repeated.isEmpty():
        return _row_counts(docs)
    known = small_side(repeated)
    same = F.col("id").eqNullSafe(F.col("_id"))
    merged = _row_counts(docs.join(known, same, "left_semi")).groupBy("token", "id", "n_tokens").agg(F.sum("tf").alias("tf"))
    return _row_counts(docs.join(known, same, "left_anti")).unionByName(merged)


def _row_counts(docs: DataFrame) -> DataFrame:
    """Counts of each row of (id, _text) by itself."""
    # no filter on the array and the outer form of inline: else Spark tokenizes every text a second time
    toks = docs.select("id", F.sort_array(tokens("_text")).alias("_t"))
    first = F.filter(F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.size("_t") - 1)),
                     lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    runs = toks.select("id", "_t", first.alias("_first"))
    each = F.transform("_first", lambda i, n: F.struct(
        F.get("_t", i).alias("token"),
        (F.coalesce(F.get("_first", n + 1), F.size("_t")) - i).cast("long").alias("tf")))
    return runs.select("id", F.size("_t").cast("long").alias("n_tokens"), F.inline_outer(each)).where(
        F.col("token").isNotNull()).select("token", "id", "tf", "n_tokens")


class TextIndex:
    """Postings and token statistics under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, token: str = "token") -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def write_segment(self, corpus: DataFrame, segment: int, id_col: str = "id", text_col: str = "content") -> None:
        """Index the corpus as this segment; writing a segment again replaces it, so a retry is safe.
        Ids must not repeat across segments."""
        counts = term_counts(corpus, id_col, text_col).withColumn("bucket", self._bucket())
        target = f"{self.path}/postings/segment={segment}"
        # one group of files a bucket; a bucket with a very frequent token is split
        counts.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        stats = self._read("postings", _POSTINGS).where(F.col("segment") == segment).groupBy("bucket", "token").agg(
            F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("coll_freq"))
        stats.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket") \
            .parquet(f"{self.path}/tokens/segment={segment}")

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")

    def postings(self) -> DataFrame:
        return self._read("postings", _POSTINGS)

    def token_stats(self, asked: DataFrame | None = None) -> DataFrame:
        """(bucket, token, doc_freq, coll_freq) over all segments, of all tokens or of those in ``asked``."""
        stats = self._read("tokens", _TOKENS)
        if asked is not None:
            stats = stats.join(asked, ["bucket", "token"], "left_semi")
        return stats.groupBy("bucket", "token").agg(
            F.sum("doc_freq").alias("doc_freq"), F.sum("coll_freq").alias("coll_freq"))

    def _look_up(self, wanted: DataFrame, posts: DataFrame) -> DataFrame:
        """``wanted`` (bucket, token, id, ...) joined with its postings.  In their scan the postings are first cut
        to the wanted documents and tokens, as far as these can be broadcast: only the rest is shuffled."""
        wanted = materialized(wanted)
        for keys, most in ((["id"], BROADCAST_IDS), (["bucket", "token"], BROADCAST_ROWS)):
            asked = materialized(wanted.select(*keys).distinct())
            if asked.count() <= most:
                posts = posts.join(F.broadcast(asked), keys, "left_semi")
        return wanted.join(posts, ["bucket", "token", "id"])

    def matches(self, queries: DataFrame, qid: str = "qid", qtext: str = "query_text") -> DataFrame:
        """(qid, id, score): documents that hold every lexeme of the query; score = their occurrences
        / the document's tokens.  Null and blank queries match nothing."""
        terms = (queries.select(qid, F.array_distinct(tokens(qtext)).alias("_terms"))
                 .select(qid, F.size("_terms").alias("_need"), F.explode_outer("_terms").alias("token"))
                 .where(F.col("token").isNotNull()).withColumn("bucket", self._bucket()))
        # a query with a lexeme that no document has drops out when its known lexemes are counted
        terms = small_side(terms)
        found = terms.join(self.token_stats(terms.select("bucket", "token")), ["bucket", "token"])
        known = found.groupBy(qid, "_need").agg(
            F.min(F.struct("doc_freq", "token", "bucket")).alias("_rare"),
            F.collect_list(F.struct("token", "bucket")).alias("_terms")).where(F.size("_terms") == F.col("_need"))
        asked = known.select(qid, "_terms", "_need", F.col("_rare.token").alias("token"),
                             F.col("_rare.bucket").alias("bucket"))
        posts = self.postings().select("bucket", "token", "id", "tf", "n_tokens")
        rare = materialized(small_side(asked).join(posts, ["bucket", "token"]).select(
            qid, "id", "n_tokens", "_need", F.col("tf").alias("_tf"),
            F.filter("_terms", lambda t: t["token"] != F.col("token")).alias("_others")))
        alone = rare.where(F.col("_need") == 1).select(qid, "id", "n_tokens", "_tf")
        others = rare.where(F.col("_need") > 1).select(qid, "id", "n_tokens", "_need", "_tf",
                                                       F.inline("_others").alias("token", "bucket"))
        rest = (self._look_up(others, posts.select("bucket", "token", "id", "tf"))
                .groupBy(qid, "id", "n_tokens", "_need", "_tf")
                .agg(F.sum("tf").alias("_more"), F.count(F.lit(1)).alias("_met"))
                .where(F.col("_met") == F.col("_need") - 1)
                .select(qid, "id", "n_tokens", (F.col("_tf") + F.col("_more")).alias("_tf")))
        return alone.unionByName(rest).select(qid, "id", (F.col("_tf") / F.col("n_tokens")).alias("score"))

    def search(self, queries: DataFrame, k: int, qid: str = "qid", qtext: str = "query_text") -> DataFrame:
        """(qid, id, score, rank from 0): the k best matches of every query, ties by id."""
        return top_per_group(self.matches(queries, qid, qtext), [qid], [F.col("score").desc(), F.col("id").asc()], k,
                             "rank", ["id"])


def build(corpus: DataFrame, path: str, id_col: str = "id", text_col: str = "content",
          buckets: int = BUCKETS) -> TextIndex:
    """Index ``corpus`` under ``path`` as segment 0."""
    index = TextIndex(corpus.sparkSession, path, buckets)
    index.write_segment(corpus, 0, id_col, text_col)
    return index
