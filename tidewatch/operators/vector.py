"""Vector search over ``array<float>`` columns.

The query side (a batch of search queries, or a pattern library) is cut into
blocks by a hash of its id, and each block is broadcast as one matrix: a
block is bounded, the number of queries is not.  Each task scores its slice
of the corpus with a numpy matrix product and keeps only the best ``k`` per
query (ties: lower id first), so no query x document pair is ever
materialised or shuffled; a ``row_number`` over those partial candidates (at
most #tasks x k rows per query) gives the exact top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.operators.windows import top_per_group
from tidewatch.session import ship_package

QUERY_BLOCK = 4096
_SCORES_AT_ONCE = 4_000_000
#: Cosines are compared to 12 places, so equal vectors tie whatever the order of summation.
PLACES = 12


@dataclass
class QueryBlock:
    """A bounded part of a query table: its rows on the driver and as a local relation."""
    rows: list
    frame: DataFrame


def in_blocks(queries: DataFrame | QueryBlock, qid: str, step: Callable[[QueryBlock], DataFrame],
              block: int = QUERY_BLOCK) -> DataFrame:
    """Union of ``step`` over blocks of about ``block`` queries (all rows of an id are in one
    block); a block passed in is taken as it is, so nested searches bind their queries once."""
    if isinstance(queries, QueryBlock):
        return step(queries)
    blocks = max(1, -(-queries.count() // block))
    out = None
    for k in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == k)
        rows = part.collect()
        found = step(QueryBlock(rows, queries.sparkSession.createDataFrame(rows, queries.schema)))
        out = found if out is None else out.unionByName(found)
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return m / norms


def _matrices(rows: list, qid: str, qvec: str) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Ids of a block by (vector length, id), and per length the place of its first id and the unit
    vectors.  Queries without an id or vector, or with gaps in it, have no neighbours."""
    usable = sorted((len(r[qvec]), r[qid], r[qvec]) for r in rows
                    if r[qid] is not None and r[qvec] and np.isfinite(np.array(r[qvec], dtype=np.float64)).all())
    ids = np.array([i for _, i, _ in usable], dtype=np.int64)
    groups, at = [], 0
    for _, of_length in groupby(usable, key=lambda x: x[0]):
        m = unit_rows(np.array([v for _, _, v in of_length], dtype=np.float64))
        groups.append((at, m))
        at += len(m)
    return ids, groups


def _vectors(batch: pa.RecordBatch, vec_col: str, id_col: str, dim: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows with an id and a vector of this length without gaps, and the unit vectors."""
    lengths = pc.list_value_length(batch.column(vec_col))
    fit = pc.and_(pc.fill_null(pc.equal(lengths, dim), False), pc.is_valid(batch.column(id_col)))
    batch = batch.filter(fit)
    flat = batch.column(vec_col).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    m = flat.reshape(len(batch), dim)
    whole = np.isfinite(m).all(axis=1)
    if not whole.all():
        batch, m = batch.filter(pa.array(whole)), m[whole]
    return batch, unit_rows(m)


def _slices(batches: Iterator[pa.RecordBatch], vec_col: str, id_col: str, groups: list[tuple[int, np.ndarray]]):
    """(place of the first query, rows, rows x queries cosines) per vector length, a bounded number
    of scores at a time."""
    for b in batches:
        for first, queries in groups:
            step = max(1, _SCORES_AT_ONCE // max(1, len(queries)))
            for at in range(0, len(b), step):
                part, m = _vectors(b.slice(at, step), vec_col, id_col, queries.shape[1])
                if len(part):
                    yield first, part, np.round(m @ queries.T, PLACES)


def _cut(query: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best per query (cosine down, id up)."""
    order = np.lexsort((ids, -sims, query))
    q = query[order]
    first = np.searchsorted(q, q, "left")
    return order[np.arange(len(q)) - first < k]


def cosine_topk(corpus: DataFrame, queries: DataFrame | QueryBlock, k: int, id_col: str = "id",
                vec_col: str = "embedding", qid: str = "qid", qvec: str = "query_vec",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """Exact top-k cosine neighbours per query: (qid, id, *carry, similarity, rank 0-based).

    Corpus rows without an id, without a vector, or with one of another length or with gaps are
    nobody's neighbours."""
    spark = corpus.sparkSession
    ship_package(spark)
    src = corpus.select(id_col, vec_col, *carry).filter(F.col(vec_col).isNotNull())
    schema = T.StructType([T.StructField(qid, T.LongType()), T.StructField(id_col, T.LongType()),
                           *[src.schema[c] for c in carry], T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def search(block: QueryBlock) -> DataFrame:
        shared = spark.sparkContext.broadcast(_matrices(block.rows, qid, qvec))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, groups = shared.value
            query = ids = sims = rest = None
            for first, rows, scores in _slices(batches, vec_col, id_col, groups):
                if len(rows) > k:      # all that reach the k-th best, ties included
                    kth = -np.partition(-scores, k - 1, axis=0)[k - 1]
                    at, which = np.nonzero(scores >= kth)
                else:
                    at, which = (x.ravel() for x in np.indices(scores.shape))
                row_ids = rows.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
                found = rows.select(list(carry)).take(pa.array(at)) if carry else None
                new = which + first, row_ids[at], scores[at, which]
                query, ids, sims = new if query is None else (
                    np.concatenate(x) for x in zip((query, ids, sims), new))
                if carry:
                    rest = pa.Table.from_batches([found]) if rest is None else pa.concat_tables(
                        [rest, pa.Table.from_batches([found])])
                keep = _cut(query, ids, sims, k)
                query, ids, sims = query[keep], ids[keep], sims[keep]
                rest = rest.take(pa.array(keep)) if carry else None
            if query is not None:
                columns = [rest.column(c).combine_chunks().cast(arrow.field(c).type) for c in carry]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(ids), *columns, pa.array(sims)],
                                                 schema=arrow)

        partial = src.mapInArrow(part, schema)
        return top_per_group(partial, [qid], [F.col("similarity").desc(), F.col(id_col).asc()], k, "rank", [id_col])

    return in_blocks(queries, qid, search)


def best_match(items: DataFrame, patterns: DataFrame, threshold: float, id_col: str = "id",
               vec_col: str = "embedding", pid: str = "qid", pvec: str = "query_vec") -> DataFrame:
    """Per item, the most similar pattern (ties: lower pattern id) if its cosine
    exceeds ``threshold``: (id, pattern_id, similarity).  Row-local up to one block of patterns;
    the blocks of a larger library are merged by one aggregation."""
    spark = items.sparkSession
    ship_package(spark)
    src = items.select(id_col, vec_col).filter(F.col(vec_col).isNotNull())
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("pattern_id", T.LongType()),
                           T.StructField("similarity", T.DoubleType())])
    arrow, blocks = to_arrow_schema(schema), []

    def match(block: QueryBlock) -> DataFrame:
        shared = spark.sparkContext.broadcast(_matrices(block.rows, pid, pvec))
        blocks.append(block)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p_ids, groups = shared.value
            for first, rows, scores in _slices(batches, vec_col, id_col, groups):
                best = np.argmax(scores, axis=1)                 # by id: ties take the lower
                score = scores[np.arange(len(rows)), best]
                best = best + first
                keep = score > threshold
                yield pa.RecordBatch.from_arrays(
                    [rows.column(id_col).cast(pa.int64()).filter(pa.array(keep)), pa.array(p_ids[best[keep]]),
                     pa.array(score[keep])], schema=arrow)

        return src.mapInArrow(part, schema)

    found = in_blocks(patterns, pid, match)
    if len(blocks) == 1:
        return found
    top = F.max(F.struct("similarity", (-F.col("pattern_id")).alias("p"))).alias("m")
    return found.groupBy(id_col).agg(top).select(id_col, (-F.col("m.p")).alias("pattern_id"),
                                                 F.col("m.similarity").alias("similarity"))
