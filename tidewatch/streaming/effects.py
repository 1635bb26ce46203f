"""Sinks for event functions that write knowledge, and the tables that their writes make.

Each micro-batch adds its own partition of changes (a replay overwrites that partition alone); nothing
written before is read or rewritten.  A table is the fold of its changes; ``compact`` replaces old
partitions by one folded one where the log gets long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.effects import Effects, KnowledgeTable, entry_rows, fold_changes, split, table_rows
from tidewatch.sources.sinks import write_batch_idempotent


def effects_sink(base: str, like: Effects):
    """``foreachBatch`` function: alerts, dead letters, texts, key-value entries and table changes of one
    persisted micro-batch, each below ``base`` under its name."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            parts = split(batch, like)
            write_batch_idempotent(parts.alerts(), f"{base}/alerts", batch_id)
            write_batch_idempotent(parts.dead_letters(), f"{base}/dead_letters", batch_id)
            write_batch_idempotent(parts.texts(), f"{base}/texts", batch_id)
            write_batch_idempotent(parts.entries(), f"{base}/entries", batch_id)
            for name in like.tables:
                write_batch_idempotent(parts.changes(name), f"{base}/tables/{name}", batch_id)
        finally:
            batch.unpersist()
    return write


def changes_sink(path: str, spec: KnowledgeTable, to_changes):
    """``foreachBatch`` function for one table: ``to_changes(batch)`` gives its changes."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch_idempotent(fold_changes(to_changes(batch), spec), path, batch_id)
    return write


def _changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")


def table_now(spark: SparkSession, path: str, spec: KnowledgeTable) -> DataFrame:
    """The table as of the last written micro-batch."""
    return table_rows(_changes(spark, path), spec)


def entries_now(spark: SparkSession, path: str) -> DataFrame:
    return entry_rows(_changes(spark, path))


def compact(spark: SparkSession, path: str, target: str, spec: KnowledgeTable) -> None:
    """A copy of the log below ``target`` as a single partition (number -1, before every micro-batch):
    one row a key.  The stream goes on with the copy once its reader and writer are pointed there."""
    write_batch_idempotent(fold_changes(_changes(spark, path), spec), target, -1)
