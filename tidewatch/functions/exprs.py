"""Column expressions.  All built-in Spark functions, so they
stay inside whole-stage codegen; none needs a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# Timestamp text formats of the telemetry producers.
TS_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
              "yyyy-MM-dd HH:mm:ss")


def event_time(c, formats=TS_FORMATS) -> Column:
    """Text -> TIMESTAMP_NTZ (UTC wall clock), first format that parses; null if none."""
    parsed = [F.try_to_timestamp(_c(c), F.lit(f)) for f in formats]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def epoch_micros(df, col: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp column, independent of the
    session time zone for TIMESTAMP_NTZ (wall-clock UTC) columns."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        # calendar fields only: casts and timestampdiff would pass through the session zone
        c = f"`{col}`"
        return F.expr(f"unix_date(cast({c} AS DATE)) * 86400000000L"
                      f" + (hour({c}) * 3600L + minute({c}) * 60L) * 1000000L"
                      f" + cast(date_part('SECOND', {c}) * 1000000 AS BIGINT)")
    return F.unix_micros(F.col(col))


def json_path(c, path: str) -> Column:
    """``metadata->>'field'``: text of a JSON path, null when absent."""
    return F.get_json_object(_c(c), path)


def with_default(c, default) -> Column:
    """``event.get(field, default)``."""
    return F.coalesce(_c(c), F.lit(default))


# Internal subnets and their VLANs and names.
VLANS = (("10.0.1.", 100, "corporate"), ("10.0.2.", 200, "servers"), ("10.0.3.", 300, "iot_guest"))


def vlan_id(ip) -> Column:
    e = F.lit(0)
    for prefix, vid, _ in reversed(VLANS):
        e = F.when(_c(ip).startswith(prefix), F.lit(vid)).otherwise(e)
    return e


def vlan_name(ip) -> Column:
    e = F.lit("external")
    for prefix, _, name in reversed(VLANS):
        e = F.when(_c(ip).startswith(prefix), F.lit(name)).otherwise(e)
    return e


def is_internal(ip) -> Column:
    return _c(ip).startswith("10.")


def direction(src_ip, dst_ip) -> Column:
    """internal -> internal: internal; internal -> external: outbound; external source: inbound."""
    return (F.when(~is_internal(src_ip), "inbound")
            .when(is_internal(dst_ip), "internal").otherwise("outbound"))


# Topic naming of the pipeline.
SOURCE_PREFIX = "network."
DECISIONS_PREFIX = "agent.decisions"
DLQ_PREFIX = "dlq."
DERIVED_TOPICS = ("threats.detected", "traffic.anomalies", "device.health.scores")


def topic_type(topic) -> Column:
    t = _c(topic)
    return (F.when(t.startswith(SOURCE_PREFIX), "source")
            .when(t.startswith(DECISIONS_PREFIX), "decisions")
            .when(t.startswith(DLQ_PREFIX), "dlq")
            .when(t.isin(*DERIVED_TOPICS), "derived")
            .otherwise("other"))


def estimated_tokens(text) -> Column:
    """Rough token count: 4 characters per token."""
    return F.floor(F.length(_c(text)) / 4).cast("bigint")


# Result budget, notice reserve and notice text.
TOKEN_BUDGET = 4000
NOTICE_TOKENS = 50
NOTICE = "\n\n[Truncated: showing ~{budget} of ~{estimated} tokens. Narrow your query for complete results.]"


def pack_to_budget(text, budget: int = TOKEN_BUDGET) -> Column:
    """Cut text to ``(budget - 50) * 4`` characters and append the notice when over budget."""
    est = estimated_tokens(text)
    head, tail = NOTICE.split("{budget}")
    mid, end = tail.split("{estimated}")
    notice = F.concat(F.lit(head + str(budget) + mid), est.cast("string"), F.lit(end))
    cut = F.substring(_c(text), 1, (budget - NOTICE_TOKENS) * 4)
    return F.when(est <= budget, _c(text)).otherwise(F.concat(cut, notice))


CAUSED_BY = r"(?m)^[ \t]*(Caused by:.*?)[ \t\r]*$"


def root_cause(trace) -> Column:
    """Deepest ``Caused by:`` line of an exception text (stripped, first ``"Caused by: "``
    removed), else its first line cut to 300 characters."""
    causes = F.regexp_extract_all(_c(trace), F.lit(CAUSED_BY), 1)
    # one regex pass: the last match or null (no Caused-by line), then the first line
    deepest = F.regexp_replace(F.try_element_at(causes, F.lit(-1)), r"^(.*?)Caused by: (.*)$", "$1$2")
    first = F.substring(F.substring_index(_c(trace), "\n", 1), 1, 300)
    return F.coalesce(deepest, first)
