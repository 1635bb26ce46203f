"""Stateful stream operators (``transformWithStateInPandas``, RocksDB state).

``EventFunctionProcessor`` runs the same ``fn(event, state) -> alerts``
user functions as the batch ``operators.state.process_events``: the key's
state dict lives in a ``ValueState`` between micro-batches, and each
micro-batch's rows of a key are applied in event order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.state import apply_event, with_error_fields
from tidewatch.session import ship_package

_BLOB = T.StructType([T.StructField("blob", T.BinaryType())])


class EventFunctionProcessor(StatefulProcessor):
    def __init__(self, fn, output_schema: T.StructType, order_cols: list[str], init=None, capture_errors=False):
        self.fn, self.init_fn, self.capture_errors = fn, init, capture_errors
        self.order_cols = order_cols
        self.names = [f.name for f in output_schema.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("user_state", _BLOB)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            st = pickle.loads(self.state.get()[0])
        else:
            st = {}
            if self.init_fn:
                self.init_fn(st)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order_cols, kind="stable")
        out = []
        for rec in batch.to_dict("records"):
            out.extend(apply_event(self.fn, rec, st, self.names, self.capture_errors))
        self.state.update((pickle.dumps(st),))
        yield pd.DataFrame(out, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def process_events_stream(df: DataFrame, key_cols: list[str], order_cols: list[str], fn,
                          output_schema: T.StructType | str, init=None, capture_errors: bool = False) -> DataFrame:
    """``capture_errors`` as in the batch form: raising events come out as dead letters."""
    ship_package(df.sparkSession)
    schema = output_schema if isinstance(output_schema, T.StructType) else T._parse_datatype_string(output_schema)
    if capture_errors:
        schema = with_error_fields(schema)
    proc = EventFunctionProcessor(fn, schema, order_cols, init, capture_errors)
    return df.groupBy(*key_cols).transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=schema, outputMode="Append", timeMode="None")
