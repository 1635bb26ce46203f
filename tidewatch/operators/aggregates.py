"""Aggregations.  All are partial/final hash aggregates: the
map side combines before the shuffle, so a hot key ships one partial row per
task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import topic_type


def having(df: DataFrame, keys: list, aggs: list[Column], cond: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs).filter(cond)


def distinct_count(col: Column | str, streaming: bool = False, approx: bool = False,
                   rsd: float = 0.05) -> Column:
    """Distinct values per group.  Streaming aggregations reject
    ``count(DISTINCT)``, so the exact streaming form is ``size(collect_set)``
    (state holds the set: use it for bounded domains such as ports); the
    approximate form is the HyperLogLog++ sketch for unbounded domains."""
    if approx:
        return F.approx_count_distinct(col, rsd)
    if streaming:
        return F.size(F.collect_set(col))
    return F.count_distinct(F.col(col) if isinstance(col, str) else col)


def topic_stats(messages: DataFrame) -> DataFrame:
    """Per topic: partitions and messages = sum over partitions of (high - low)."""
    per_part = messages.groupBy("topic", "partition").agg(
        (F.max("offset") + 1).alias("high"), F.min("offset").alias("low"))
    return per_part.groupBy("topic").agg(
        F.count("*").alias("partitions"),
        F.sum(F.col("high") - F.col("low")).alias("messages"),
    ).select("topic", topic_type("topic").alias("type"), "partitions", "messages")


def baseline(df: DataFrame, keys: list[str], value: str, percentiles=(0.5, 0.95),
             accuracy: int = 10000) -> DataFrame:
    """n, mean, population stddev and approximate percentiles per key.
    ``percentile_approx`` keeps a bounded sketch per group, unlike an exact
    percentile, which would hold every value of a hot key."""
    pct = F.percentile_approx(value, list(percentiles), accuracy)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"),
                                F.stddev_pop(value).alias("stddev"), pct.alias("_p"))
    names = [f"p{int(round(p * 100))}" for p in percentiles]
    return out.select(*keys, "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"),
                      *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])


def top_values_json(df: DataFrame, key: str, value: str, k: int = 3,
                    value_name: str | None = None, count_name: str = "flows") -> DataFrame:
    """Per key, the ``k`` most frequent values with counts as a JSON array,
    most frequent first (ties by value).  Lists are bounded by k."""
    value_name = value_name or value
    counts = df.groupBy(key, value).agg(F.count("*").alias(count_name))
    w = Window.partitionBy(key).orderBy(F.col(count_name).desc(), F.col(value).asc())
    top = counts.select("*", F.row_number().over(w).alias("_rn")).filter(F.col("_rn") <= k)
    items = F.array_sort(F.collect_list(F.struct("_rn", F.col(value).alias(value_name), count_name)))
    return top.groupBy(key).agg(items.alias("_items")).select(
        key, F.to_json(F.transform("_items", lambda x: F.struct(x[value_name].alias(value_name),
                                                                 x[count_name].alias(count_name))))
        .alias("top_" + value_name + "s"))
