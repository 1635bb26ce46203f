"""Proportional stratified interleaving: every shard gets the corpus' mixture of sources.

Rows are shuffled by a seeded hash inside their source, ranked there, and sorted by the
fraction rank / source size; equal cuts of that order hold every source in proportion.
Both orders are computed in chunks (a chunk is a range of the sort key) with running
bases from a small table of counts, so neither a source that holds most rows nor the
whole corpus is ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import first_columns, ranked_in_chunks, saved, shuffle_partitions


def _chunk_of(fraction: Column, chunks: int) -> Column:
    return F.floor(fraction * chunks).cast("int")


def interleave(docs: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source", chunks: int | None = None) -> DataFrame:
    """Shard and slot of every row, law ``rows``: shard sizes differ by one row at most.

    Returns doc_id, source, size (UTF-8 bytes of the text plus 8), text_crc32, fraction,
    shard and slot (gapless from 0 in each shard, in interleaved order).

    Null text counts no bytes (crc 0 as of the empty text); a null source is a source of its
    own; null doc_ids and repeated rows are rows like any other: ties of the seeded hash are
    ordered by doc_id, size and text_crc32, and rows that agree in all of these are
    interchangeable.  Equal texts are not kept together: a group of copies may exceed a
    shard, and the mixture and the row law come first.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    chunks = chunks or 4 * shuffle_partitions(spark)
    rows = first_columns(docs, doc_id=id_col, _text=text_col, source=source_col)
    text = F.coalesce("_text", F.lit(""))
    # one narrow row a document, kept: the texts are read and checksummed once
    rows = saved(rows.select(
        "doc_id", "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")))
    # the seeded hash as a number in [0, 1): 53 bits of it.  Rows without an id are spread by their texts
    own = F.xxhash64(F.lit(seed), F.col("doc_id"))
    seeded = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "size", "text_crc32")).otherwise(own)
    shuffled = F.shiftrightunsigned(seeded, 11) / F.lit(float(2 ** 53))
    rows = rows.withColumn("_key", shuffled).withColumn("_chunk", _chunk_of(F.col("_key"), chunks))
    ties = ["doc_id", "size", "text_crc32"]
    rows = ranked_in_chunks(rows, ["_stratum"], "_chunk", ["_key", *ties], "_rank")
    sizes = rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_of"))
    rows = (rows.join(sizes, "_stratum")
            .withColumn("fraction", (F.col("_rank") + 0.5) / F.col("_of"))
            .withColumn("_chunk", _chunk_of(F.col("fraction"), chunks))
            .withColumn("_all", F.lit(0)))
    rows = ranked_in_chunks(rows, ["_all"], "_chunk", ["fraction", "_stratum", *ties], "_at")
    total = rows.count()
    shard = F.expr(f"(_at * {shards}) div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    return (rows.withColumn("shard", shard)
            .select("doc_id", "source", "size", "text_crc32", "fraction",
                    F.col("shard").cast("int").alias("shard"), (F.col("_at") - first).alias("slot")))
