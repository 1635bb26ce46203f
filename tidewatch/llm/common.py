"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import ensure_checkpoint_dir, ship_package

#: ASCII white space as the operators' contracts fix it: space and \t \n \v \f \r.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"

ASCII_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, *ASCII_LETTERS)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def python_ready(spark: SparkSession) -> None:
    """Executors that run a Python function of this package must be able to import it."""
    ship_package(spark)


def saved(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder: later reads
    neither recompute it nor depend on one executor's disk."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_bytes(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` separates at exactly this white space."""
    return text.split() if text else []


def texts(batch: pa.RecordBatch | pa.Table, column: str) -> Iterator[bytes | None]:
    """A string column as UTF-8 bytes, one value at a time."""
    for v in batch.column(column).cast(pa.large_binary()):
        yield v.as_py()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until the table has no such column."""
    out = []
    for name in names:
        while name.lower() in (c.lower() for c in df.columns):
            name += "_"
        out.append(name)
    return out


def first_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named input columns, under fixed names: extra columns, whatever they are
    called, cannot clash with an operator's own."""
    return df.select(*[df[src].alias(name) for name, src in wanted.items()])


def ranked_in_chunks(df: DataFrame, keys: list[str], chunk: str, order: list, out: str) -> DataFrame:
    """Rank from 0 within ``keys`` in the order (chunk, order).  The chunk must rise with
    the order; a window holds one chunk, and bases come from the chunks' counts.
    ``keys`` and ``chunk`` must not be null."""
    counts = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(*keys, chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = df.withColumn("_local", F.row_number().over(W.partitionBy(*keys, chunk).orderBy(*order)))
    return (local.join(bases, [*keys, chunk])
            .withColumn(out, F.col("_base") + F.col("_local") - 1)
            .drop("_local", "_base"))
