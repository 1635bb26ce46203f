"""Filter interaction audit: what each order of a set of filters removes, step by step.

A document's fate depends on which filters it fails, not on its text, so documents are counted
per part and failure mask first (at most 2^k masks a part).  Over the masks, the removal step
in every order is a min-plus matrix product: mask matrix (0 where the filter fails, infinite
elsewhere) and position matrix of the orders (inverse permutations), combined by minimum.
The steps then scatter the counts into (order, step).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import first_columns, python_ready, texts

LETTERS = "ABCDE"
MIN_WORDS = 200                     # A fails below
MIN_DISTINCT_PERCENT = 50           # B fails below
MAX_CAPITAL_PERCENT = 3             # C fails above
MARKS = b"#$%&*|"                   # D fails on any
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUATION = bytes(range(0x80, 0xC0))   # UTF-8 bytes that start no character


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: filters A to D that the text fails."""
    words = text.split()
    n, distinct = len(words), len(set(words))
    chars = len(text) if text.isascii() else len(text.translate(None, CONTINUATION))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    marked = any(m in text for m in (MARKS[i:i + 1] for i in range(len(MARKS))))
    return ((n < MIN_WORDS) | (100 * distinct < MIN_DISTINCT_PERCENT * n) << 1
            | (100 * capitals > MAX_CAPITAL_PERCENT * chars) << 2 | marked << 3)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks, digests = [], []
        for text in texts(b, "text"):
            masks.append(text_mask(text or b""))
            digests.append(hashlib.sha256(text or b"").digest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            names=["doc_id", "part", "mask", "digest"])


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask of filters A to D, and the text's SHA-256, one narrow row per document."""
    python_ready(docs.sparkSession)
    rows = first_columns(docs, doc_id=id_col, text=text_col, part=part_col).select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(_judged, "doc_id bigint, part string, mask int, digest binary")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per failure mask, bits 0 to 4 for filters A to E.

    E needs the smallest id per text.  Rows are first counted per (doc, text), then per text with
    the smallest id and its rows, so a text that a third of all rows share arrives as a few
    counted rows.  A null doc_id has no smaller one and is smaller than none, and has no labels.
    """
    docs = masked(docs, id_col, text_col, part_col)
    # rows without an id would all meet in one task of the join: their text spreads them
    docs = docs.withColumn("_spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    flags = (labels.select(labels[id_col].cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
             .groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                    F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .withColumn("_spread", F.lit(0).cast("long")))
    rows = (docs.join(flags, ["doc_id", "_spread"], "left")
            .groupBy("doc_id", "_spread", "part", "mask", "digest",
                     F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
            .agg(F.count(F.lit(1)).alias("n")))
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    # the kinds of one text (its parts and label values) meet once more
    each = kinds.withColumn("least", F.min("first.doc_id").over(W.partitionBy("digest")))
    own = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("nameless")
    split = each.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), own.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n")))))
    return split.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def orders(letters: str = LETTERS) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def positions(named: list[str], letters: str = LETTERS) -> np.ndarray:
    """Filters x orders: the step (from 1) at which an order applies a filter."""
    return np.array([[o.index(f) + 1 for o in named] for f in letters])


def removal_steps(masks: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Masks x orders: step that removes a document (one past the last if none does), as the
    min-plus product of the mask matrix and the position matrix."""
    k = len(position)
    fails = (masks[:, None] >> np.arange(k)) & 1
    cost = np.where(fails == 1, 0, k + 1)                      # "infinite": beyond every step
    return np.minimum((cost[:, :, None] + position[None, :, :]).min(axis=1), k + 1)


_AUDIT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
          "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step from (part, mask, n, good, toxic).  A part is one small
    group: it has at most 2^k masks."""
    python_ready(counts.sparkSession)
    named = orders(letters)
    position = positions(named, letters)
    k, m = len(letters), len(named)

    def of_part(table: pa.Table) -> pa.Table:
        masks, n, good, toxic = (table.column(c).to_numpy() for c in ("mask", "n", "good", "toxic"))
        step = removal_steps(masks, position)
        at = (np.broadcast_to(np.arange(m), step.shape), step)

        def scatter(weight: np.ndarray) -> np.ndarray:
            out = np.zeros((m, k + 2), dtype=np.int64)
            np.add.at(out, at, np.broadcast_to(weight[:, None], step.shape))
            return out[:, 1:k + 1]

        removed = scatter(n)
        redundant = np.zeros((m, k + 2), dtype=np.int64)
        unique = np.zeros(k, dtype=np.int64)
        shapley = np.zeros(k, dtype=np.int64)
        for f in range(k):
            hit = (masks >> f) & 1 == 1
            late = hit[:, None] & (step < position[f][None, :])
            np.add.at(redundant, (np.arange(m), position[f]), (n[:, None] * late).sum(axis=0))
            unique[f] = n[masks == 1 << f].sum()
            shapley[f] = removed[np.arange(m), position[f] - 1].sum()
        filter_at = np.array([[letters.index(c) for c in o] for o in named])
        total = n.sum()
        columns = [[table.column("part")[0].as_py()] * (m * k), np.repeat(named, k), np.tile(np.arange(1, k + 1), m),
                   total - removed.cumsum(axis=1), removed, redundant[:, 1:k + 1], unique[filter_at], scatter(good),
                   scatter(toxic), shapley[filter_at]]
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        return pa.table([pa.array(c if isinstance(c, list) else c.ravel().tolist(), t) for c, t in zip(columns, kinds)],
                        names=[x.split()[0] for x in _AUDIT.split(", ")])

    return counts.groupBy("part").applyInArrow(of_part, _AUDIT)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """Filters A to E over whole texts in all 120 orders.

    Null text is empty; a null part is the empty string.  Repeated rows count as often as they
    occur and are no copies of each other (their id is not smaller); a document with several label
    rows is good or toxic if one says so.  An empty table has no parts and gives no rows.  Extra
    columns are not read.
    """
    return audit(failure_counts(docs, labels, id_col, text_col, part_col))
