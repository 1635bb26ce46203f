"""Event functions applied in event-time order on a stream.

Micro-batches bring a key's rows in any order, within the watermark's delay.  The
processor keeps them in a typed list state and applies the function only to rows that
the watermark has passed, sorted as the batch form sorts them, when an event-time timer
fires.  So ``lag``-like rules, sequences and rates give what their batch forms give, and
a key's silence is noticed without a next event.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.state import EventFn, apply_event, with_error_fields
from tidewatch.session import ship_package

_BLOB = T.StructType([T.StructField("blob", T.BinaryType())])
_EPOCH = datetime(1970, 1, 1)


def _micros(ts: datetime) -> int:
    if ts.tzinfo is not None:
        ts = ts.astimezone(timezone.utc).replace(tzinfo=None)
    d = ts - _EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def timeless(event: dict, names: list[str], time_col: str) -> dict:
    """Dead letter of an event without a time: it has no place in the order."""
    return {**dict.fromkeys(names), "error": f"no {time_col}", "error_type": "MissingTime",
            "event": json.dumps(event, default=str)}


class OrderedEvents(StatefulProcessor):
    def __init__(self, fn: EventFn, schema: T.StructType, names: list[str], time_col: str, order_cols: list[str],
                 capture_errors: bool, silence_s: float | None, on_silence: Callable | None,
                 start: Callable[[dict], None] | None = None):
        self.fn, self.schema, self.names = fn, schema, names
        self.columns = [f.name for f in schema.fields]
        self.time_col, self.order_cols, self.capture_errors = time_col, order_cols, capture_errors
        self.silence = None if silence_s is None else int(silence_s * 1_000_000)
        self.on_silence, self.start = on_silence, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.user = handle.getValueState("user", _BLOB)

    def _wake_at(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest, dead = None, []
        at = self.columns.index(self.time_col)
        for pdf in rows:
            plain = pdf[self.columns].astype(object)
            values = [tuple(r) for r in plain.where(plain.notna(), None).itertuples(index=False, name=None)]
            timed = [v for v in values if v[at] is not None]
            if self.capture_errors:
                dead += [timeless(dict(zip(self.columns, v)), self.names, self.time_col) for v in values if v[at] is None]
            if timed:
                self.waiting.appendList(timed)
                first = min(_micros(v[at]) for v in timed)
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake_at(earliest)
        if dead:
            yield pd.DataFrame(dead, columns=self.names, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = [dict(zip(self.columns, r)) for r in self.waiting.get()]
        due = [e for e in events if _micros(e[self.time_col]) <= passed]
        later = [e for e in events if _micros(e[self.time_col]) > passed]
        if self.user.exists():
            state, last, told = pickle.loads(self.user.get()[0])
        else:
            state, last, told = {}, None, False
            if self.start:
                self.start(state)
        out = []
        none_first = lambda e: tuple((e[c] is not None, e[c]) for c in self.order_cols)
        for e in sorted(due, key=none_first):
            if self._silent(last, _micros(e[self.time_col]), told):
                out += self.on_silence(last)
            out += apply_event(self.fn, e, state, self.names, self.capture_errors)
            last, told = e, False
        if self._silent(last, passed, told):
            out += self.on_silence(last)
            told = True
        if later:
            self.waiting.put([tuple(e[c] for c in self.columns) for e in later])
            self._wake_at(min(_micros(e[self.time_col]) for e in later))
        else:
            self.waiting.clear()
        if self.silence is not None and last is not None and not told:
            self._wake_at(_micros(last[self.time_col]) + self.silence + 1000)
        self.user.update((pickle.dumps((state, last, told)),))
        if out:
            yield pd.DataFrame(out, columns=self.names, dtype=object)

    def _silent(self, last: dict | None, now: int, told: bool) -> bool:
        return self.silence is not None and last is not None and not told and now - _micros(last[self.time_col]) > self.silence

    def close(self) -> None:
        pass


def process_in_order(df: DataFrame, key_cols: list[str], time_col: str, order_cols: list[str], fn: EventFn,
                     output_schema: T.StructType | str, delay: str, capture_errors: bool = False,
                     silence_s: float | None = None, on_silence: Callable[[dict], list[dict]] | None = None,
                     init: Callable[[dict], None] | None = None) -> DataFrame:
    """``operators.state.process_events`` on a stream, rows in event-time order.

    Rows wait until the watermark (``delay`` behind the newest event) has passed them; rows that
    come later still are dropped.  Rows without a time never fall due: with ``capture_errors`` they
    become dead letters (``MissingTime``), else they are left out.  ``on_silence(last event)`` gives alerts once a key has had no event
    for more than ``silence_s`` seconds.  ``time_col`` must be a TIMESTAMP.
    """
    ship_package(df.sparkSession)
    schema = output_schema if isinstance(output_schema, T.StructType) else T._parse_datatype_string(output_schema)
    if capture_errors:
        schema = with_error_fields(schema)
    processor = OrderedEvents(fn, df.schema, [f.name for f in schema.fields], time_col, order_cols, capture_errors,
                              silence_s, on_silence, init)
    return (df.withWatermark(time_col, delay).groupBy(*key_cols)
            .transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append",
                                        timeMode="EventTime"))
