"""Stored sketches: distinct counts, quantiles and moments that roll up without raw rows.

``window_sketches`` reduces raw rows to one row per (key, window) that holds a HyperLogLog sketch per
counted column, a KLL sketch per measured column, and exact count, sum and sum of squares.  The table is
kept; ``roll_up`` merges its rows into longer windows (or any coarser key), and ``estimates`` reads the
numbers off.  A late or further batch is one more set of rows: merging takes them as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL_BITS = 12       # 2^12 registers: standard error 1.6 %, exact up to some hundred values


def window_sketches(df: DataFrame, time_col: str, size: str, keys: list[str], distinct: list[str] = (),
                    values: list[str] = ()) -> DataFrame:
    """(window_start, keys, n, per distinct column ``_hll``, per value column ``_kll``, ``_sum``, ``_sq``).
    Null values count in ``n`` only; a stream needs a watermark on ``time_col``."""
    number = lambda v: F.col(v).cast("double")
    out = df.groupBy(F.window(time_col, size).alias("_w"), *keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.hll_sketch_agg(F.col(c).cast("string"), HLL_BITS).alias(f"{c}_hll") for c in distinct],
        *[x for v in values for x in (F.kll_sketch_agg_double(number(v)).alias(f"{v}_kll"), F.sum(number(v)).alias(f"{v}_sum"),
                                      F.sum(number(v) * number(v)).alias(f"{v}_sq"), F.count(v).alias(f"{v}_n"))])
    return out.select(F.col("_w.start").alias("window_start"), *[c for c in out.columns if c != "_w"])


def roll_up(sketches: DataFrame, size: str | None, keys: list[str]) -> DataFrame:
    """Stored rows merged into windows of ``size`` (a multiple of theirs; None: all time) and fewer keys."""
    kept = [c for c in sketches.columns if c == "n" or c.endswith(("_hll", "_kll", "_sum", "_sq", "_n"))]
    merge = {"_hll": F.hll_union_agg, "_kll": F.kll_merge_agg_double}
    aggs = [next((m(c) for end, m in merge.items() if c.endswith(end)), F.sum(c)).alias(c) for c in kept]
    if size is None:
        return sketches.groupBy(*keys).agg(*aggs)
    out = sketches.groupBy(F.window("window_start", size).alias("_w"), *keys).agg(*aggs)
    return out.select(F.col("_w.start").alias("window_start"), *[c for c in out.columns if c != "_w"])


def estimates(rolled: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Numbers of sketched rows: ``<c>_distinct``, and ``<v>_mean``, ``<v>_stddev`` (population), ``<v>_p50``."""
    out = [c for c in rolled.columns if not c.endswith(("_hll", "_kll", "_sum", "_sq", "_n"))]
    cols = [F.col(c) for c in out]
    for c in rolled.columns:
        if c.endswith("_hll"):
            cols.append(F.hll_sketch_estimate(c).alias(f"{c[:-4]}_distinct"))
        if c.endswith("_kll"):
            v = c[:-4]
            n, mean = F.col(f"{v}_n"), F.col(f"{v}_sum") / F.col(f"{v}_n")
            cols += [mean.alias(f"{v}_mean"), F.sqrt(F.greatest(F.col(f"{v}_sq") / n - mean * mean, F.lit(0.0))).alias(f"{v}_stddev")]
            cols += [F.when(n > 0, F.kll_sketch_get_quantile_double(c, F.lit(p))).alias(f"{v}_p{round(p * 100)}") for p in percentiles]
    return rolled.select(*cols)
