"""Keyed state, upserts and dead letters, batch forms.

The streaming forms (``transformWithStateInPandas``, ``foreachBatch``
snapshots) are in ``tidewatch.streaming``; both share the user functions
defined here.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import ship_package

EventFn = Callable[[dict, dict], list]


ERROR_FIELDS = [T.StructField(n, T.StringType()) for n in ("error", "error_type", "traceback", "event")]


def with_error_fields(schema: T.StructType) -> T.StructType:
    """Alert schema plus the dead-letter fields, all nullable."""
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], *ERROR_FIELDS])


def apply_event(fn: EventFn, event: dict, state: dict, names: list[str], capture: bool) -> list[dict]:
    """Alerts of one event.  With ``capture`` a raising function gives one dead letter (error, its
    type, the traceback, the event as JSON) and the next event goes on with the state as it is."""
    try:
        return list(fn(event, state) or ())
    except Exception as e:
        if not capture:
            raise
        import json
        import traceback
        return [{**dict.fromkeys(names), "error": str(e), "error_type": type(e).__name__,
                 "traceback": traceback.format_exc(), "event": json.dumps(event, default=str)}]


def same_key(a: tuple | None, b: tuple) -> bool:
    """Equal key values, a missing one (None or NaN from Arrow) equal to another missing one."""
    return a is not None and all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def process_events(df: DataFrame, key_cols: list[str], order_cols: list[str], fn: EventFn,
                   output_schema: T.StructType | str, init: Callable[[dict], None] | None = None,
                   num_partitions: int | None = None, independent_after_s: float | None = None,
                   capture_errors: bool = False) -> DataFrame:
    """Run ``fn(event, state) -> list[alert dict]`` over every event, in
    ``order_cols`` order per key, with a fresh ``state`` dict per key (after
    ``init(state)``).  Rows whose key is null form one key.  Lookups in a
    knowledge table are joined in as columns before the call.

    Rows are hash-partitioned by key and sorted inside each partition, then
    streamed through ``mapInPandas`` in Arrow batches: only the current
    key's state is held, never a whole group.

    ``capture_errors``: an event on which the function raises becomes a dead letter
    (``error``, ``error_type``, ``traceback``, ``event`` set, alert columns null) instead of
    failing the job; alerts have null error fields (``error_type IS NULL`` splits them).

    ``independent_after_s``: when the function's state provably empties after
    a quiet gap of that many seconds (true of sliding-window rules), each key's
    timeline is cut at such gaps and the segments run in parallel, with the
    same results; a hot key then spreads over its segments.
    """
    ship_package(df.sparkSession)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if independent_after_s is not None:
        from tidewatch.operators.windows import sessionize
        # a new segment starts when ts >= previous ts + gap (1 microsecond under "more than")
        gap = f"{float(independent_after_s) - 1e-6:.6f} seconds"
        df = sessionize(df, key_cols, order_cols[0], gap, order_cols).withColumnRenamed("_session", "_segment")
        key_cols = [*key_cols, "_segment"]
    schema = output_schema if isinstance(output_schema, T.StructType) else T._parse_datatype_string(output_schema)
    if capture_errors:
        schema = with_error_fields(schema)
    names = [f.name for f in schema.fields]
    ordered = df.repartition(n, *key_cols).sortWithinPartitions(*key_cols, *order_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            keys = list(zip(*[pdf[c] for c in key_cols]))
            for k, rec in zip(keys, pdf.to_dict("records")):
                if not same_key(current, k):
                    current, state = k, {}
                    if init:
                        init(state)
                out.extend(apply_event(fn, rec, state, names, capture_errors))
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)

    return ordered.mapInPandas(run, schema)


def seconds_of(ts) -> float:
    return pd.Timestamp(ts).value / 1e9


def rate_with_reset(window_s: float = 60.0, threshold: int = 100, key: str = "src_ip") -> EventFn:
    """The reference consumer's rule, on event time: keep the key's event
    times of the last ``window_s`` seconds (strictly younger), alert when
    more than ``threshold`` remain and then clear the list."""
    def fn(event: dict, state: dict) -> list:
        now = seconds_of(event["event_time"])
        times = state.setdefault("times", deque())
        times.append(now)
        while times and not (now - times[0] < window_s):
            times.popleft()
        count = len(times)
        if count > threshold:
            state["times"] = deque()
            return [{"alert_type": "high_rate", "severity": "high", key: event[key], "count": count,
                     "event_time": event["event_time"], "event_id": event["event_id"]}]
        return []
    return fn


RATE_RESET_SCHEMA = ("alert_type string, severity string, src_ip string, count bigint, "
                     "event_time timestamp_ntz, event_id bigint")


def first_contact(src: str = "src_ip", dst: str = "dst_ip") -> EventFn:
    """Alert the first time a source talks to a destination."""
    def fn(event: dict, state: dict) -> list:
        seen = state.setdefault("seen", set())
        if event[dst] in seen:
            return []
        seen.add(event[dst])
        return [{"alert_type": "new_destination", src: event[src], dst: event[dst],
                 "event_id": event["event_id"], "event_time": event["event_time"]}]
    return fn


FIRST_CONTACT_SCHEMA = "alert_type string, src_ip string, dst_ip string, event_id bigint, event_time timestamp_ntz"


def kv_latest(writes: DataFrame, key: str, value: str, updated_at: str, tiebreak: str | None = None) -> DataFrame:
    """Key-value state from a log of writes: last write wins (partial ``max_by``)."""
    order = F.struct(updated_at, tiebreak) if tiebreak else F.col(updated_at)
    return writes.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(updated_at).alias(updated_at))


def accumulate_upsert(snapshot: DataFrame, batch: DataFrame, keys: list[str], add=(), least=(), greatest=(),
                      replace=()) -> DataFrame:
    """``INSERT ... ON CONFLICT DO UPDATE``: full outer join of the snapshot
    with the batch aggregate (a null key value equals another); ``add`` columns sum, ``least``/``greatest`` keep
    the extreme, ``replace`` takes the batch value when present."""
    s, b = snapshot.alias("s"), batch.alias("b")
    cond = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    j = s.join(b, cond, "full_outer")
    cols = [F.coalesce(F.col(f"s.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    cols += [(F.coalesce(F.col(f"s.{c}"), F.lit(0)) + F.coalesce(F.col(f"b.{c}"), F.lit(0))).alias(c) for c in add]
    cols += [F.least(F.col(f"s.{c}"), F.col(f"b.{c}")).alias(c) for c in least]
    cols += [F.greatest(F.col(f"s.{c}"), F.col(f"b.{c}")).alias(c) for c in greatest]
    cols += [F.coalesce(F.col(f"b.{c}"), F.col(f"s.{c}")).alias(c) for c in replace]
    return j.select(*cols)


def dlq_tag(df: DataFrame, checks: list[tuple[Column, str, Column]]) -> DataFrame:
    """Adds ``error_type`` and ``error`` (null for good rows).

    ``checks`` are ``(is_error, error_type, message)``; the first failing
    check names the error.  Errors come from ``try_*`` expressions and
    validations, so tagging stays JVM-side and needs one pass.
    """
    etype, emsg = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, name, msg in reversed(checks):
        etype = F.when(cond, F.lit(name)).otherwise(etype)
        emsg = F.when(cond, msg).otherwise(emsg)
    return df.select("*", etype.alias("error_type"), emsg.alias("error"))


def dlq_split(df: DataFrame, checks: list[tuple[Column, str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, dead letters).  Write both from one persisted
    micro-batch (``streaming.runner.dlq_sink``) so the input is read once.

    A dead letter has all four parts: error, error_type, ``traceback`` (an expression has no stack: the
    check that failed, with its place in the list) and ``event``, the row as JSON."""
    names = [c for c in df.columns if not c.startswith("_")]
    tagged = dlq_tag(df, checks)
    good = tagged.filter(F.col("error_type").isNull()).drop("error_type", "error")
    trace = F.lit(None).cast("string")
    for n, (_, name, _) in reversed(list(enumerate(checks, 1))):
        trace = F.when(F.col("error_type") == name, F.concat(F.lit(f"check {n} ({name}): "), F.col("error"))).otherwise(trace)
    bad = tagged.filter(F.col("error_type").isNotNull()).select(
        *tagged.columns, trace.alias("traceback"), F.to_json(F.struct(*names)).alias("event"))
    return good, bad


# ---- row-ordered rules as event functions: the same rule in batch (process_events) and on a
# stream (streaming.ordered.process_in_order)

POLL_ALERT_SCHEMA = "device_id bigint, event_id bigint, reason string"


def _alert(event: dict, reason: str) -> dict:
    return {"device_id": event["device_id"], "event_id": event["event_id"], "reason": reason}


def poll_changes(min_cpu: float = 85.0, min_memory: float = 80.0) -> EventFn:
    """Offline polls, rising edges of load, and changed configuration dates of a device."""
    def fn(event: dict, state: dict) -> list:
        out = [_alert(event, "offline")] if event["status"] == "offline" else []
        cpu, memory = event["cpu_percent"], event["memory_percent"]
        hot = cpu is not None and memory is not None and cpu >= min_cpu and memory >= min_memory
        if hot and not state.get("hot"):
            out.append(_alert(event, "cpu_spike"))
        change = event["last_config_change"]
        if change is not None and change != state.get("change"):
            out.append(_alert(event, "config_change"))
        state["hot"], state["change"] = hot, change
        return out
    return fn


def silent_poll(event: dict) -> list[dict]:
    """The poll that a device's silence follows."""
    return [_alert(event, "silent")]


SEQUENCE_SCHEMA = "source_ip string, run_start_id bigint, failures bigint, success_id bigint"


def failures_then_success_rule(min_failures: int, within_s: float, failure: str = "auth_failure",
                               success: str = "auth_success") -> EventFn:
    """A run of failures directly followed by a success no later than ``within_s`` after its start."""
    def fn(event: dict, state: dict) -> list:
        run, out = state.get("run"), []
        if event["event_type"] == failure:
            state["run"] = run + [event["event_id"]] if run else [event["event_id"]]
            if not run:
                state["start"] = seconds_of(event["event_time"])
            return out
        if run and len(run) >= min_failures and event["event_type"] == success \
                and seconds_of(event["event_time"]) <= state["start"] + within_s:
            out = [{"source_ip": event["source_ip"], "run_start_id": run[0], "failures": len(run),
                    "success_id": event["event_id"]}]
        state["run"] = None
        return out
    return fn
