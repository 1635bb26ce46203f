"""Joins.

Physical strategy stays Catalyst's; these helpers only shape the logical
plan so that it scales: interval joins get a time-bucket equi-key (a key
with a third of the rows is then spread over its buckets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import epoch_micros
from tidewatch.session import materialized

_US = 1_000_000


def interval_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]],
                  left_time: str, right_time: str, lower_s: int, upper_s: int,
                  how: str = "inner", bucket_seconds: int | None = None) -> DataFrame:
    """``left JOIN right ON keys AND right_time BETWEEN left_time + lower AND left_time + upper``.

    Both bounds are seconds, inclusive, and may be negative.  The left side
    is bucketed by ``floor(left_time / width)`` with ``width = upper - lower``;
    each right row is copied to the (at most two) left buckets it can match.
    The join is then an equi-join on (keys, bucket) plus the exact time
    predicate: exact for inner and left-outer joins, and no key funnels into
    one task.  On streams the time predicate also bounds the join state.

    ``bucket_seconds`` narrows the buckets for wide intervals: each right row
    is then copied to ceil(span / width) + 1 buckets, and a (key, bucket)
    group holds at most ``width`` of a hot key's time line.
    """
    width = max(int(bucket_seconds or (upper_s - lower_s)), 1) * _US
    lcols, rcols = left.columns, right.columns
    l2 = left.select(*lcols, F.floor(epoch_micros(left, left_time) / width).alias("_jb"))
    rt = epoch_micros(right, right_time)
    lo = F.floor((rt - int(upper_s) * _US) / width)
    hi = F.floor((rt - int(lower_s) * _US) / width)
    r2 = right.select(*rcols, F.explode(F.sequence(lo, hi)).alias("_rb"))
    cond = F.col("_jb") == F.col("_rb")
    for lk, rk in on:
        cond = cond & (l2[lk] == r2[rk])
    lt = l2[left_time]
    cond = cond & (r2[right_time] >= lt + F.expr(f"INTERVAL {int(lower_s)} SECONDS")) \
                & (r2[right_time] <= lt + F.expr(f"INTERVAL {int(upper_s)} SECONDS"))
    return l2.join(r2, cond, how).drop("_jb", "_rb")


#: Rows up to which a side of checked size is broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` computed once and counted: marked for broadcast up to ``rows`` rows, else left to a
    shuffled join."""
    df = materialized(df)
    return F.broadcast(df) if df.count() <= rows else df


def semi(df: DataFrame, known: DataFrame, on) -> DataFrame:
    """Rows whose key is already known (``EXISTS``)."""
    return df.join(known, on, "left_semi")


def anti(df: DataFrame, known: DataFrame, on) -> DataFrame:
    """Rows whose key is new (``NOT EXISTS``)."""
    return df.join(known, on, "left_anti")
