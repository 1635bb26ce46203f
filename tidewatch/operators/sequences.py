"""Sequence patterns without MATCH_RECOGNIZE.

Pattern: at least ``min_failures`` consecutive failure rows of one key,
immediately followed by a success row no later than ``within`` after the
first failure.  Ordering is (time, id).  Batch form: gaps-and-islands over
chunked per-key scans (``numbering``); on a stream the same pattern is
``state.failures_then_success_rule`` applied by ``streaming.ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.numbering import running_sum
from tidewatch.operators.windows import next_in_key


def failures_then_success(df: DataFrame, keys: list[str], order_cols: list[str], time_col: str,
                          is_failure: Column, success_value: str, min_failures: int = 3,
                          within: str = "1 minute", type_col: str = "event_type") -> DataFrame:
    flagged = df.select("*", is_failure.alias("_fail"))
    nxt = next_in_key(flagged, keys, order_cols, [type_col, time_col], "_next_", keep_chunk=True)
    # a run of failures shares the running count of non-failures before it
    isl = running_sum(nxt, keys, order_cols, (~F.col("_fail")).cast("long"), "_island", keep_chunk=True)
    order = F.struct(*order_cols)
    runs = isl.filter("_fail").groupBy(*keys, "_island").agg(
        F.min(time_col).alias("run_start"),
        F.max(time_col).alias("run_end"),
        F.count("*").alias("failures"),
        F.max_by("_next_" + type_col, order).alias("next_type"),
        F.max_by("_next_" + time_col, order).alias("success_time"),
    )
    return runs.filter(
        (F.col("failures") >= min_failures) & (F.col("next_type") == success_value)
        & (F.col("success_time") <= F.col("run_start") + F.expr(f"INTERVAL {within}"))
    ).drop("_island")
