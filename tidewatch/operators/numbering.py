"""Ordered per-key scans (row numbers, running sums, lag/lead) without a per-key task.

``row_number() / sum() / lag() OVER (PARTITION BY key ORDER BY t, ...)`` sends each key to a single
task, so a topic-partition or a device holding a third of a log would be scanned by one core.  Here
only keys of at most ``ROWS_PER_CHUNK`` rows are one window.  A larger key is cut into time chunks of
about equal row counts, at quantiles of its own times; every window runs inside a chunk, and what
crosses chunk boundaries (running totals, the last or first value of the neighbouring chunk) comes from
a table with one row per chunk of a large key: at most one for every ``ROWS_PER_CHUNK`` rows, however
sparse or dense the keys are.  Without large keys there is no such table and no second scan.

Key sizes and cuts are computed when a scan is set up (one aggregate over the key columns, one over the
large keys' times) and kept in the shared folder, so a recomputed task cuts the same chunks.  Scans
chained on kept chunk columns (``keep_chunk=True``) reuse one hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import epoch_micros
from tidewatch.operators.joins import small_side
from tidewatch.session import materialized

ROWS_PER_CHUNK = 100_000
#: Quantiles taken of a large key's times; a key is cut into at most one chunk more.
_QUANTILES = 1023
_ACCURACY = 20_000

# Private columns of a chunked table.
_GROUP = "__tidewatch_group"
_CHUNK = "__tidewatch_chunk"
_LARGE = "__tidewatch_large"
_BEFORE_ALL = -1             # chunk of a large key's rows without a time: they come first, as in SQL


def _cuts(df: DataFrame, group_cols: list[str], time: Column) -> DataFrame | None:
    """(group, cuts) of the keys with more than ``ROWS_PER_CHUNK`` rows; None if there are none."""
    keyed = df.select(F.struct(*group_cols).alias(_GROUP), time.alias("__t"))
    large = materialized(keyed.groupBy(_GROUP).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > ROWS_PER_CHUNK))
    if large.isEmpty():
        return None
    picks = [i / (_QUANTILES + 1) for i in range(1, _QUANTILES + 1)]
    found = keyed.join(small_side(large), _GROUP).groupBy(_GROUP, "__n").agg(
        F.percentile_approx("__t", picks, _ACCURACY).alias("__q"))
    chunks = F.least(F.ceil(F.col("__n") / ROWS_PER_CHUNK), F.lit(_QUANTILES + 1)).cast("int")
    # every (quantiles / chunks)-th quantile, each once
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(chunks - 1, F.lit(1))),
                       lambda i: F.get("__q", (F.floor(i * (_QUANTILES + 1) / chunks) - 1).cast("int")))
    return materialized(found.select(_GROUP, F.array_distinct(cuts).alias("__tidewatch_cuts")))


class Chunks:
    """A table with its (group, chunk) columns.

    The group is a struct of the key columns and the chunk is never null, so rows with null keys
    or null times are partitioned, joined and ordered like any others (a null key equals
    another null key, as in ``PARTITION BY``).
    """

    def __init__(self, df: DataFrame, group_cols: list[str], order_cols: list[str]):
        self.added = _CHUNK not in df.columns
        self.whole = False                    # no key has more than one chunk
        if self.added:
            time = epoch_micros(df, order_cols[0])
            cuts = _cuts(df, group_cols, time)
            self.whole = cuts is None
            df = df.select("*", F.struct(*group_cols).alias(_GROUP))
            if cuts is None:
                df = df.select("*", F.lit(0).alias(_CHUNK), F.lit(False).alias(_LARGE))
            else:
                at = F.when(time.isNull(), _BEFORE_ALL).otherwise(F.size(F.filter("__tidewatch_cuts", lambda c: c < time)))
                df = df.join(small_side(cuts), _GROUP, "left").select(
                    *df.columns, F.when(F.col("__tidewatch_cuts").isNull(), 0).otherwise(at).alias(_CHUNK),
                    F.col("__tidewatch_cuts").isNotNull().alias(_LARGE))
        self.df = df
        self.keys = [_GROUP, _CHUNK]

    def inside(self, order_cols: list[str]):
        """Window over one chunk."""
        return Window.partitionBy(*self.keys).orderBy(*order_cols)

    def across(self):
        """Window over the chunks of a group (one row each)."""
        return Window.partitionBy(_GROUP).orderBy(_CHUNK)

    def table(self, df: DataFrame, *aggregates: Column) -> DataFrame:
        """One row per chunk of the large keys."""
        return df.where(_LARGE).groupBy(*self.keys).agg(*aggregates)

    def with_table(self, df: DataFrame, table: DataFrame) -> DataFrame:
        """Rows with their chunk's row of a table of large keys' chunks; nulls for all others."""
        return df.join(table, self.keys, "left")

    def finish(self, out: DataFrame, keep_chunk: bool = False) -> DataFrame:
        return out.drop(*self.keys, _LARGE) if self.added and not keep_chunk else out


def running_sum(df: DataFrame, group_cols: list[str], order_cols: list[str], value: Column | str,
                name: str, keep_chunk: bool = False) -> DataFrame:
    """``sum(value) OVER (PARTITION BY group ORDER BY order ROWS UNBOUNDED PRECEDING)``.

    The first order column must be a timestamp; the order should be total.
    """
    c = Chunks(df, group_cols, order_cols)
    v = value if isinstance(value, Column) else F.col(value)
    w = c.inside(order_cols).rowsBetween(Window.unboundedPreceding, 0)
    if c.whole:
        return c.finish(c.df.select("*", F.sum(v).over(w).alias(name)), keep_chunk)
    local = c.df.select("*", F.sum(v).over(w).alias("__local"))
    totals = c.table(c.df.select(*c.keys, _LARGE, v.alias("__v")), F.sum("__v").alias("__total"))
    before = c.across().rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*c.keys, F.sum("__total").over(before).alias("__base"))
    out = c.with_table(local, bases).select(
        *c.df.columns, (F.coalesce("__base", F.lit(0)) + F.col("__local")).alias(name))
    return c.finish(out, keep_chunk)


def sequence_number(df: DataFrame, group_cols: list[str], order_cols: list[str],
                    name: str = "seq", keep_chunk: bool = False) -> DataFrame:
    """Dense 0-based row numbers per group in ``order_cols`` order."""
    out = running_sum(df, group_cols, order_cols, F.lit(1), "__rs", keep_chunk)
    return out.withColumn(name, F.col("__rs") - 1).drop("__rs")


def neighbour_values(df: DataFrame, group_cols: list[str], order_cols: list[str], value_cols: list[str],
                     direction: int, prefix: str, keep_chunk: bool = False) -> DataFrame:
    """``lag`` (direction -1) or ``lead`` (+1) of each value column per group."""
    c = Chunks(df, group_cols, order_cols)
    w = c.inside(order_cols)
    shift = F.lag if direction < 0 else F.lead
    if c.whole:
        return c.finish(c.df.select("*", *[shift(x).over(w).alias(prefix + x) for x in value_cols]), keep_chunk)
    local = c.df.select("*", *[shift(x).over(w).alias("__n_" + x) for x in value_cols],
                        shift(F.lit(1)).over(w).isNull().alias("__edge"))
    pick = F.max_by if direction < 0 else F.min_by          # last row before / first row after
    ends = c.table(c.df, *[pick(x, F.struct(*order_cols)).alias("__e_" + x) for x in value_cols])
    carry = ends.select(*c.keys, *[shift("__e_" + x).over(c.across()).alias("__c_" + x) for x in value_cols])
    out = c.with_table(local, carry).select(
        *c.df.columns, *[F.when(F.col("__edge"), F.col("__c_" + x)).otherwise(F.col("__n_" + x)).alias(prefix + x)
                         for x in value_cols])
    return c.finish(out, keep_chunk)
