"""Event-time windows and analytic windows.

Every function is ``DataFrame -> DataFrame`` with no action inside, so the
same call works on a batch DataFrame and on a streaming one (where Spark
allows the operator in streaming).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import epoch_micros
from tidewatch.operators.numbering import Chunks, neighbour_values, running_sum


def _flatten(df: DataFrame, wcol: str = "window") -> DataFrame:
    rest = [c for c in df.columns if c != wcol]
    return df.select(F.col(f"{wcol}.start").alias("window_start"),
                     F.col(f"{wcol}.end").alias("window_end"), *rest)


def tumble(df: DataFrame, time_col: str, size: str, keys: list[str], aggs: list[Column],
           having: Column | None = None) -> DataFrame:
    """``GROUP BY TUMBLE(time_col, size), keys`` with flattened window bounds."""
    out = _flatten(df.groupBy(F.window(time_col, size).alias("window"), *keys).agg(*aggs))
    return out.filter(having) if having is not None else out


def tumble_distinct(df: DataFrame, time_col: str, size: str, keys: list[str], value: str, distinct: str,
                    sums: dict[str, Column]) -> DataFrame:
    """Tumbling windows with an exact distinct count of ``value`` (nulls not counted) that a stream
    can keep: one state row per (window, keys, value), spread by all of these, and a second
    aggregation that counts them.  ``sums`` are further columns, as sums of row expressions."""
    first = df.groupBy(F.window(time_col, size).alias("w"), *keys, value).agg(
        *[F.sum(c).alias(name) for name, c in sums.items()])
    second = first.groupBy(F.window(F.window_time("w"), size).alias("window"), *keys).agg(
        F.count(value).alias(distinct), *[F.sum(name).alias(name) for name in sums])
    return _flatten(second)


def hop(df: DataFrame, time_col: str, size: str, slide: str, keys: list[str],
        aggs: list[Column], having: Column | None = None) -> DataFrame:
    """``HOP`` (sliding) windows: each row counts in size/slide windows."""
    out = _flatten(df.groupBy(F.window(time_col, size, slide).alias("window"), *keys).agg(*aggs))
    return out.filter(having) if having is not None else out


def session(df: DataFrame, time_col: str, gap: str, keys: list[str], aggs: list[Column],
            having: Column | None = None, order_cols: list[str] | None = None) -> DataFrame:
    """``SESSION`` windows: rows at most ``gap`` apart share a session
    (window_start = first row, window_end = last row + gap).

    Streams use ``session_window`` (state per key is incremental).  In batch,
    ``session_window`` would cluster each key into one task, so sessions are
    built as gaps-and-islands on chunked per-key scans instead
    (``sessionize``), then aggregated with partial aggregation.
    """
    if df.isStreaming:
        out = _flatten(df.groupBy(F.session_window(time_col, gap).alias("window"), *keys).agg(*aggs))
    else:
        s = sessionize(df, keys, time_col, gap, order_cols).filter(F.col(time_col).isNotNull())
        out = s.groupBy(*keys, "_session").agg(F.min(time_col).alias("window_start"),
                                               F.max(time_col).alias("_last"), *aggs)
        out = out.select("window_start", (F.col("_last") + F.expr(f"INTERVAL {gap}")).alias("window_end"),
                         *keys, *[c for c in out.columns if c not in ("window_start", "_last", "_session", *keys)])
    return out.filter(having) if having is not None else out


def sessionize(df: DataFrame, keys: list[str], time_col: str, gap: str,
               order_cols: list[str] | None = None) -> DataFrame:
    """Adds ``_session``: the 0-based session index of each row within its key.

    A row starts a session when the key's previous row is more than ``gap`` earlier.  Starts are
    counted inside each chunk (``numbering``); for keys of several chunks a small table (first time,
    last time, inner starts) decides whether a chunk's first row starts a session and how many starts
    precede the chunk.  No large key is one task.  Rows with null keys form a key of their own; rows
    without a time get no session (null).
    """
    order = order_cols or [time_col]
    c = Chunks(df, keys, order)
    interval = F.expr(f"INTERVAL {gap}")
    at, w = F.col(time_col), c.inside(order)
    prev = F.lag(time_col).over(w)
    local = c.df.select("*", F.coalesce(at > prev + interval, F.lit(False)).cast("long").alias("__inner"))
    local = local.select("*", F.sum("__inner").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"))
    if c.whole:
        return local.select(*df.columns, F.when(at.isNotNull(), F.col("__upto")).alias("_session"))
    ends = c.table(local, F.min(time_col).alias("__first"), F.max(time_col).alias("__last"),
                   F.sum("__inner").alias("__inner_n"))
    prev_last = F.lag("__last").over(c.across())
    # rows without a time have a chunk of their own, which starts nothing
    starts = F.col("__first").isNotNull() & F.coalesce(F.col("__first") > prev_last + interval, F.lit(True))
    ends = ends.select(*c.keys, "__inner_n", starts.cast("long").alias("__head"))
    carry = ends.select(*c.keys, "__head", F.coalesce(F.sum(F.col("__inner_n") + F.col("__head")).over(
        c.across().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    number = F.coalesce(F.col("__before") + F.col("__head"), F.lit(1)) + F.col("__upto") - 1
    return c.with_table(local, carry).select(*df.columns, F.when(at.isNotNull(), number).alias("_session"))


def with_watermark(df: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Bounded disorder.  Streams need a TIMESTAMP (not NTZ) event time."""
    if df.isStreaming:
        return df.withWatermark(time_col, delay)
    return df


def rate_in_range(df: DataFrame, key: str, time_col: str, seconds: int,
                  name: str = "rate") -> DataFrame:
    """Rows of the same key in ``[t - seconds, t]`` for every row (peers included).

    Equivalent to ``count(*) OVER (PARTITION BY key ORDER BY t RANGE seconds
    PRECEDING)`` but partitioned by (key, time bucket): each row is copied
    once into the next bucket as context, so a hot key is spread over its
    buckets instead of landing in one task.
    """
    epoch = epoch_micros(df, time_col)
    width = int(seconds) * 1_000_000
    based = df.select("*", F.floor(epoch / width).alias("_b"), epoch.alias("_us"))
    own = based.select("*", F.lit(True).alias("_own"))
    # rows without a time are each other's peers and nobody's context
    ctx = based.filter(F.col("_b").isNotNull()).select(*[c for c in based.columns if c != "_b"], (F.col("_b") + 1).alias("_b"),
                       F.lit(False).alias("_own"))
    both = own.unionByName(ctx)
    w = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-width, 0)
    return (both.select("*", F.count(F.lit(1)).over(w).alias(name))
            .filter("_own").drop("_b", "_us", "_own"))


def previous_in_key(df: DataFrame, keys: list[str], order_cols: list[str],
                    value_cols: list[str], prefix: str = "prev_", keep_chunk: bool = False) -> DataFrame:
    """``lag(value) OVER (PARTITION BY keys ORDER BY order_cols)`` for each value,
    as a chunked scan (see ``numbering``): no key is handled by a single task."""
    return neighbour_values(df, keys, order_cols, value_cols, -1, prefix, keep_chunk=keep_chunk)


def next_in_key(df: DataFrame, keys: list[str], order_cols: list[str],
                value_cols: list[str], prefix: str = "next_", keep_chunk: bool = False) -> DataFrame:
    """``lead`` counterpart of ``previous_in_key``."""
    return neighbour_values(df, keys, order_cols, value_cols, +1, prefix, keep_chunk=keep_chunk)


def changed_from_previous(df: DataFrame, keys: list[str], order_cols: list[str],
                          value_col: str) -> DataFrame:
    """Rows whose ``value_col`` differs (null-safe) from the key's previous row."""
    out = previous_in_key(df, keys, order_cols, [value_col])
    prev = F.col("prev_" + value_col)
    return out.filter(prev.isNotNull() | F.col(value_col).isNotNull()) \
              .filter(~F.col(value_col).eqNullSafe(prev))


# Spark plans a partial limit before the shuffle only for row_number() <= n up to this n.
GROUP_LIMIT = 1000


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str, spread: list[str]
                  ) -> DataFrame:
    """Best ``n`` rows per key, numbered from 0.

    The cut is on ``row_number()`` itself, so each map task ships at most n rows per key.  For
    an n beyond Spark's partial limit, every key is first cut in slices of the ``spread``
    columns' hash, so no task ranks all rows of a key.
    """
    if n > GROUP_LIMIT:
        slice_ = F.pmod(F.xxhash64(*spread), F.lit(256))
        cut = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order))
        df = df.select("*", slice_.alias("__slice")).select("*", cut.alias("__cut")).filter(F.col("__cut") <= n) \
            .drop("__slice", "__cut")
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cut = df.select("*", rn.alias("__rn")).filter(F.col("__rn") <= n)
    return cut.select(*df.columns, (F.col("__rn") - 1).cast("bigint").alias(name))


def ranked_tail(df: DataFrame, keys: list[str], order_desc: list[str], n: int,
                name: str = "rn") -> DataFrame:
    """Last ``n`` rows per key (newest first numbered 1).

    ``row_number() <= n`` lets Spark place a partial WindowGroupLimit before
    the shuffle, so each map task ships at most n rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_desc])
    return df.select("*", F.row_number().over(w).cast("bigint").alias(name)).filter(F.col(name) <= n)


def runs(df: DataFrame, keys: list[str], order_cols: list[str], flag: Column,
         min_len: int, time_col: str) -> DataFrame:
    """Maximal runs of consecutive flagged rows per key, of length >= min_len.

    Gaps-and-islands: the running count of unflagged rows is constant inside
    a run of flagged rows, so it names the run; one chunked scan.
    """
    base = df.select("*", flag.alias("_flag"))
    isl = running_sum(base, keys, order_cols, (~F.col("_flag")).cast("long"), "_island")
    return (isl.filter("_flag").groupBy(*keys, "_island")
            .agg(F.count("*").alias("run_length"), F.min(time_col).alias("run_start"),
                 F.max(time_col).alias("run_end"))
            .filter(F.col("run_length") >= min_len).drop("_island"))
