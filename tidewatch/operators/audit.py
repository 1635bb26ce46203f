"""Pipeline audit, decision log and panels as jobs over tables.

Every rule runs for all cells (pipelines) at once, keyed by ``cell_id``,
so thousands of pipelines are one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.windows import ranked_tail


def lineage(registry: DataFrame, known_sources: tuple[str, ...]) -> DataFrame:
    """Topology findings per cell: (cell_id, kind, topic, consumer_id, n).

    kinds: external_source, intermediate, unwired_output (stream-SQL
    consumers only), orphan_input, shared_output (one row per writer, n =
    writers), and one ``healthy``/``unhealthy`` row per cell with n = warnings.
    """
    # one row per use of a topic; every consumer has an output row, if only without a topic
    output = F.when(F.col("output_topic") != "", F.col("output_topic"))
    uses = F.concat(F.transform(F.coalesce("source_topics", F.array()), lambda t: F.struct(t.alias("topic"), F.lit(True).alias("reads"))),
                    F.array(F.struct(output.alias("topic"), F.lit(False).alias("reads"))))
    uses = registry.select("cell_id", "consumer_id", "runtime", F.inline(uses)) \
        .withColumn("writes", ~F.col("reads") & F.col("topic").isNotNull())
    topics = uses.filter("reads or writes").groupBy("cell_id", "topic").agg(
        F.count(F.when(F.col("reads"), 1)).alias("n_readers"), F.count(F.when(F.col("writes"), 1)).alias("n_writers"))
    kinds = lambda *pairs: F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in pairs]))
    none, read, written = F.lit(None).cast("bigint"), F.col("n_readers") > 0, F.col("n_writers") > 0
    of_topic = topics.select(
        "cell_id", "topic", none.alias("consumer_id"), none.alias("n"),
        kinds(("external_source", read & ~written), ("intermediate", read & written)).alias("kinds"),
        (F.col("n_writers") > 1).cast("bigint").alias("warnings"))
    unwired = F.col("writes") & (F.col("runtime") == "flink_sql") & ~F.coalesce(read, F.lit(False))
    orphan = F.col("reads") & ~F.col("topic").isin(*known_sources) & ~F.coalesce(written, F.lit(False))
    shared = F.col("writes") & (F.col("n_writers") > 1)
    of_use = uses.join(topics, ["cell_id", "topic"], "left").select(
        "cell_id", "topic", "consumer_id",
        F.when(shared, F.col("n_writers")).alias("n"),
        kinds(("unwired_output", unwired), ("orphan_input", orphan), ("shared_output", shared)).alias("kinds"),
        (F.coalesce(unwired, F.lit(False)).cast("bigint") + F.coalesce(orphan, F.lit(False)).cast("bigint")).alias("warnings"))
    found = of_topic.unionByName(of_use)
    findings = found.select("cell_id", F.explode("kinds").alias("kind"), "topic", "consumer_id", "n") \
        .withColumn("n", F.when(F.col("kind") == "shared_output", F.col("n")))
    per_cell = found.groupBy("cell_id").agg(F.sum("warnings").alias("n")).select(
        "cell_id", F.when(F.col("n") == 0, "healthy").otherwise("unhealthy").alias("kind"),
        F.lit(None).cast("string").alias("topic"), none.alias("consumer_id"), "n")
    return findings.unionByName(per_cell)


def consumer_health(consumers: DataFrame, job_metrics: DataFrame, dlq_errors: DataFrame,
                    events: DataFrame) -> DataFrame:
    """Classify each consumer, in the reference's rule order.

    Stream-SQL consumers: no job -> ``no_job``; job FAILED/CANCELED ->
    ``failed``; 0 records read -> ``no_records``; else healthy.  Python
    consumers: DLQ errors -> ``dlq_errors``; 0 events -> ``no_events``; else
    healthy.  All lookups are joins against per-job / per-consumer aggregates.
    """
    j = consumers.join(job_metrics, "job_id", "left").join(dlq_errors, "dlq_key", "left") \
        .join(events, "event_key", "left")
    flink = F.col("runtime") == "flink_sql"
    status = (F.when(flink & F.col("state").isNull(), "no_job")
              .when(flink & F.col("state").isin("FAILED", "CANCELED"), "failed")
              .when(flink & (F.coalesce("records_in", F.lit(0)) == 0), "no_records")
              .when(flink, "healthy")
              .when(F.coalesce("errors", F.lit(0)) > 0, "dlq_errors")
              .when(F.coalesce("events_processed", F.lit(0)) == 0, "no_events")
              .otherwise("healthy"))
    return j.select("consumer_id", "runtime", status.alias("status"),
                    F.coalesce("records_in", F.lit(0)).cast("bigint").alias("records_in"),
                    F.coalesce("events_processed", F.lit(0)).cast("bigint").alias("events_processed"),
                    F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"))


def decision_query(log: DataFrame, type_filter: str | None, last: int = 20, per: str = "cell_id",
                   order=("conv_id", "turn")) -> DataFrame:
    """Filter by entry or decision type, last N per cell, long fields cut."""
    typ = F.coalesce("entry_type", "decision_type")
    if type_filter:
        log = log.filter((F.col("entry_type") == type_filter) | (F.col("decision_type") == type_filter))
    slim = log.select(per, *order, typ.alias("type"), F.substring("message", 1, 150).alias("message"))
    return ranked_tail(slim, [per], list(order), last)


def decision_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("cell_id", "entry_type").agg(
        F.count("*").alias("entries"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"))


def registry_list(cells: DataFrame, active_only: bool = True, cut: int = 80) -> DataFrame:
    """Registry in creation order; directive cut to 80 characters plus '...'."""
    d = F.col("directive")
    short = F.when(F.length(d) > cut, F.concat(F.substring(d, 1, cut), F.lit("..."))).otherwise(d)
    out = cells.filter(F.col("status") != "terminated") if active_only else cells
    return out.select("cell_id", "name", short.alias("directive"), "status", "created_at", "consumers") \
              .orderBy("created_at", "cell_id")


def panel_snapshot(df: DataFrame, label: str, series: list[str]) -> DataFrame:
    """Panel contract: first column = labels, remaining columns = series."""
    return df.select(F.col(label).alias("label"),
                     *[F.col(s).alias(f"series_{i + 1}") for i, s in enumerate(series)])


def panel_append(points: DataFrame, ts: str, max_points: int = 100) -> DataFrame:
    """Time-series panel: only the newest ``max_points`` points, oldest first
    (a top-k: TakeOrderedAndProject keeps max_points rows per task)."""
    return points.orderBy(F.col(ts).desc()).limit(max_points).orderBy(ts)
