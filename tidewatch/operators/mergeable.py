"""Event functions that a hot key does not send to one task.

A plain event function (``operators.state.process_events``) is sequential per key.  A
``Mergeable`` one also tells what a run of events does to *any* state before it: ``summarise`` reads
the run once, ``advance`` applies the summary to a state.  Rows are then dealt by ranges of (key,
order), so a key that holds half of them spreads over half of the tasks:

1. only keys that cross from one range into the next are summarised, one summary a range;
2. a fold over a key's summaries gives the state at the start of each of its ranges;
3. every range runs the plain function from its start state.

The tables that pass between the ranges have at most one row a range, whatever the data.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.operators.state import EventFn, apply_event, first_contact, rate_with_reset, seconds_of, with_error_fields
from tidewatch.session import materialized, ship_package

#: Bytes of start states up to which they are broadcast; beyond, they travel with the rows.
BROADCAST_BYTES = 64_000_000

_PART = "__part"
_STATE = "__state"


@dataclass(frozen=True)
class Mergeable:
    """``fn(event, state) -> alerts`` with ``advance(state, summarise(events))`` leaving the state that
    running ``fn`` over the events would leave.  Summaries and states are pickled."""
    fn: EventFn
    summarise: Callable[[Iterable[dict]], Any]
    advance: Callable[[dict, Any], None]
    init: Callable[[dict], None] | None = None

    def start(self) -> dict:
        state: dict = {}
        if self.init:
            self.init(state)
        return state


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _plain(value):
    """NaN keys are one key, as in SQL."""
    return "NaN" if isinstance(value, float) and value != value else value


def process_mergeable(df: DataFrame, key_cols: list[str], order_cols: list[str], rule: Mergeable,
                      output_schema: T.StructType | str, capture_errors: bool = False,
                      ranges: int | None = None) -> DataFrame:
    """Run the rule over every event in ``order_cols`` order per key; the same rows as
    ``process_events(df, key_cols, order_cols, rule.fn, ...)``.

    Null keys are one key and null order values come first.  The order should be total.  ``ranges``
    sets the number of ranges (default: the shuffle partitions).  With ``capture_errors`` a raising
    event becomes a dead letter; ``summarise`` must then take such events as ``fn`` does.
    """
    spark = df.sparkSession
    ship_package(spark)
    schema = output_schema if isinstance(output_schema, T.StructType) else T._parse_datatype_string(output_schema)
    if capture_errors:
        schema = with_error_fields(schema)
    names, arrow = [f.name for f in schema.fields], to_arrow_schema(schema)
    by = [*key_cols, *order_cols]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    ordered = materialized(dealt.sortWithinPartitions(*by)).withColumn(_PART, F.spark_partition_id())
    carried = _start_states(ordered, key_cols, rule)

    def run(rows: Iterator[dict], states: dict[int, bytes] | None) -> Iterator[pa.RecordBatch]:
        """Rows by (range, key); ``states``: start states by range, else a range's state comes first."""
        out: list[dict] = []
        for part, of_part in groupby(rows, key=lambda r: r[_PART]):
            pending = states.get(part) if states is not None else None
            for _, events in groupby(of_part, key=lambda r: tuple(_plain(r[c]) for c in key_cols)):
                state = None
                for e in events:
                    e.pop(_PART)
                    if states is None and (given := e.pop(_STATE)) is not None:
                        pending = given           # a row that only brings the state of its key
                        continue
                    if state is None:
                        state = pickle.loads(pending) if pending is not None else rule.start()
                        pending = None
                    out += apply_event(rule.fn, e, state, names, capture_errors)
                if len(out) > 10_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema=arrow)

    if carried is None:
        return ordered.mapInArrow(lambda batches: run(_records(batches), {}), schema)
    size = carried.agg(F.sum(F.octet_length(_STATE))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r[_PART]: bytes(r[_STATE]) for r in carried.collect()})
        return ordered.mapInArrow(lambda batches: run(_records(batches), shared.value), schema)
    # a row with the state stands before its range's first rows
    first = ordered.groupBy(_PART).agg(F.min(F.struct(*by)).alias("_first"))
    heads = carried.join(first, _PART).select(_PART, _STATE, *[F.col(f"_first.{c}").alias(c) for c in key_cols])
    both = ordered.withColumn(_STATE, F.lit(None).cast("binary")).unionByName(heads, allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = both.repartition(n, _PART).sortWithinPartitions(_PART, *key_cols, F.col(_STATE).isNull(), *order_cols)
    return placed.mapInArrow(lambda batches: run(_records(batches), None), schema)


def _start_states(ordered: DataFrame, key_cols: list[str], rule: Mergeable) -> DataFrame | None:
    """(range, state) for ranges whose first key began in an earlier one; None if there are none."""
    key = F.struct(*key_cols)
    ends = ordered.groupBy(_PART).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    # one row a range: small on any cluster
    over = Window.orderBy(_PART)
    ends = ends.select(_PART, "_first", "_last", F.lead("_first").over(over).alias("_next"),
                       F.lag("_last").over(over).alias("_before"), F.lead(_PART).over(over).alias("_to"))
    goes_on, comes_in = F.col("_last").eqNullSafe(F.col("_next")), F.col("_first").eqNullSafe(F.col("_before"))
    # a chain is a key's ranges; it begins where the key does
    whole = F.col("_first").eqNullSafe(F.col("_last"))
    begins = goes_on & F.col("_next").isNotNull() & ~(whole & comes_in & F.col("_before").isNotNull())
    ends = ends.withColumn("_chain", F.sum(begins.cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    crossing = materialized(ends.where(goes_on & F.col("_next").isNotNull()).select(_PART, "_last", "_to", "_chain"))
    if crossing.isEmpty():
        return None
    rows = (ordered.join(F.broadcast(crossing), _PART).where(key.eqNullSafe(F.col("_last"))).drop("_last"))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, to, chain), events in groupby(_records(batches), key=lambda r: (r[_PART], r["_to"], r["_chain"])):
            summary = rule.summarise(_without(events))
            yield pa.RecordBatch.from_pylist([{"_chain": chain, _PART: part, "_to": to, "_summary": pickle.dumps(summary)}],
                                             schema=summed)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, links in groupby(_records(batches), key=lambda r: r["_chain"]):
            state = rule.start()
            for link in links:
                rule.advance(state, pickle.loads(link["_summary"]))
                yield pa.RecordBatch.from_pylist([{_PART: link["_to"], _STATE: pickle.dumps(state)}], schema=started)

    summed = pa.schema([("_chain", pa.int64()), (_PART, pa.int32()), ("_to", pa.int32()), ("_summary", pa.binary())])
    started = pa.schema([(_PART, pa.int32()), (_STATE, pa.binary())])
    links = rows.mapInArrow(summaries, f"_chain bigint, {_PART} int, _to int, _summary binary")
    return materialized(links.repartition("_chain").sortWithinPartitions("_chain", _PART)
                        .mapInArrow(fold, f"{_PART} int, {_STATE} binary"))


def _without(events: Iterator[dict]) -> Iterator[dict]:
    for e in events:
        for name in (_PART, "_to", "_chain"):
            e.pop(name)
        yield e


# ---- the library's own rules

def mergeable_first_contact(src: str = "src_ip", dst: str = "dst_ip") -> Mergeable:
    """``state.first_contact``: a run adds its destinations to the seen ones."""
    def advance(state: dict, summary: set) -> None:
        state.setdefault("seen", set()).update(summary)
    return Mergeable(first_contact(src, dst), lambda events: {e[dst] for e in events}, advance)


def mergeable_rate_with_reset(window_s: float = 60.0, threshold: int = 100, key: str = "src_ip") -> Mergeable:
    """``state.rate_with_reset``.  After an alert at event i the next one is at the first event j >
    i + threshold whose own window holds more than ``threshold`` events, so the chain of alerts inside a
    run is known for every place where it can start; times before the run matter only up to its first
    ``threshold`` events."""

    def summarise(events: Iterable[dict]) -> dict:
        times = [seconds_of(e["event_time"]) for e in events]
        n = len(times)
        full, left = [], 0                      # events whose window, inside the run, is over the threshold
        for i, now in enumerate(times):
            while not now - times[left] < window_s:
                left += 1
            if i - left + 1 > threshold:
                full.append(i)
        last_after: dict[int, int] = {}         # last alert of the chain that starts with an alert here
        for i in reversed(full):
            at = bisect_left(full, i + threshold + 1)
            last_after[i] = last_after[full[at]] if at < len(full) else i
        ends = {}
        for i in range(min(threshold, n)):      # an alert here needs times before the run
            at = bisect_left(full, i + threshold + 1)
            ends[i] = last_after[full[at]] if at < len(full) else i
        return {"n": n, "head": times[:threshold], "tail": times[max(0, n - threshold):],
                "ends": ends, "last": last_after[full[0]] if full else None}

    def advance(state: dict, run: dict) -> None:
        if not run["n"]:
            return
        before = list(state.get("times", ()))
        last, left, own = None, 0, 0
        for i, now in enumerate(run["head"]):   # no window inside the run is full as early as this
            while left < len(before) and not now - before[left] < window_s:
                left += 1
            while not now - run["head"][own] < window_s:
                own += 1
            if len(before) - left + i + 1 - own > threshold:
                last = run["ends"][i]
                break
        if last is None:
            last = run["last"]
        now, n = run["tail"][-1], run["n"]
        kept = [] if last is not None else [t for t in before if now - t < window_s]
        base = n - len(run["tail"])             # place of the first tail time in the run
        since = -1 if last is None else last
        kept += [t for i, t in enumerate(run["tail"], base) if i > since and now - t < window_s]
        state["times"] = deque(kept)

    return Mergeable(rate_with_reset(window_s, threshold, key), summarise, advance)
