"""Event functions that write knowledge: ``fn(event, state, knowledge) -> alerts``.

Inside the function ``knowledge`` only records what is to be written: key-value entries (``set``), rows to
merge into declared tables (``upsert``) and texts to keep (``store``).  Alerts, dead letters and writes leave
the one pass over the events as one typed table, in batch and on a stream alike; ``Effects`` splits it.
Lookups in a knowledge table are joined in as columns before the call.

A table's changes are folded with commutative aggregates over (event order, number of the write), so the
result depends on neither partitions nor micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.state import EventFn, process_events, with_error_fields

RULES = ("add", "least", "greatest", "replace", "first")


@dataclass(frozen=True)
class KnowledgeTable:
    """A table that event functions write.  ``keys``: key column -> type; ``values``: column ->
    (type, rule) with the rule a write follows where the key exists already: ``add`` to the old value, keep the
    ``least`` or ``greatest``, ``replace`` it, or keep the ``first``."""
    name: str
    keys: dict[str, str]
    values: dict[str, tuple[str, str]]

    def __post_init__(self):
        bad = {r for _, r in self.values.values()} - set(RULES)
        if bad:
            raise ValueError(f"unknown rules {sorted(bad)}")

    @property
    def key_schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in self.keys.items())

    @property
    def key_names(self) -> list[str]:
        return list(self.keys)

    @property
    def value_schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, (t, _) in self.values.items())


class Knowledge:
    """What one event's function call writes."""

    def __init__(self, tables: dict[str, KnowledgeTable]):
        self.tables, self.writes = tables, []

    def _write(self, kind: str, target: str | None, key, value) -> None:
        text = lambda v: None if v is None else json.dumps(v, default=str)
        self.writes.append((kind, target, text(key), text(value)))

    def set(self, key: str, value) -> None:
        """Key-value entry; the last write of a key in event order stays."""
        self._write("set", key, None, value)

    def upsert(self, table: str, key: dict, **values) -> None:
        """Row of a declared table; values left out stay as they are."""
        spec = self.tables[table]
        unknown = (set(key) ^ set(spec.key_names)) | (set(values) - set(spec.values))
        if unknown:
            raise KeyError(f"{table}: {sorted(unknown)}")
        self._write("upsert", table, key, values)

    def store(self, content: str, category: str, metadata: dict | None = None) -> None:
        """Text for the knowledge base (chunked and embedded where it is stored)."""
        self._write("store", category, metadata, content)


def effects_schema(alerts: T.StructType, events: T.StructType, order_cols: list[str]) -> T.StructType:
    """Alert columns, then what a write is and where it stands in the order of events."""
    fields = [*alerts.fields, *[T.StructField(n, T.StringType()) for n in ("effect", "target", "effect_key", "effect_value")],
              *[T.StructField(f"at_{c}", events[c].dataType) for c in order_cols], T.StructField("effect_no", T.IntegerType())]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields])


def recording(fn: Callable, tables: dict[str, KnowledgeTable], order_cols: list[str]) -> EventFn:
    """The function as a plain event function whose rows are its alerts and its writes."""
    def call(event: dict, state: dict) -> list[dict]:
        knowledge = Knowledge(tables)
        rows = [{**a, "effect": "alert"} for a in fn(event, state, knowledge) or ()]
        rows += [{"effect": kind, "target": target, "effect_key": key, "effect_value": value}
                 for kind, target, key, value in knowledge.writes]
        at = {f"at_{c}": event[c] for c in order_cols}
        return [{**r, **at, "effect_no": n} for n, r in enumerate(rows)]
    return call


@dataclass
class Effects:
    """The split of one effects table.  Read several parts from a kept table (``materialized``, or a
    persisted micro-batch): each part is a filter of it."""
    frame: DataFrame
    alert_columns: list[str]
    order_cols: list[str]
    tables: dict[str, KnowledgeTable]

    def _of(self, kind: str) -> DataFrame:
        return self.frame.where(F.col("effect") == kind)

    def _at(self) -> list[Column]:
        return [F.col(f"at_{c}") for c in self.order_cols] + [F.col("effect_no")]

    def alerts(self) -> DataFrame:
        return self._of("alert").select(*self.alert_columns)

    def dead_letters(self) -> DataFrame:
        """error, error_type, traceback and event (JSON) of events on which the function raised."""
        if "error_type" not in self.frame.columns:
            return self.frame.where("false").selectExpr(*[f"cast(null AS string) AS {c}" for c in (
                "error", "error_type", "traceback", "event")])
        return self.frame.where(F.col("error_type").isNotNull()).select("error", "error_type", "traceback", "event")

    def texts(self) -> DataFrame:
        """content, category and metadata (JSON) in the shape that the knowledge store takes."""
        return self._of("store").select(
            F.from_json(F.concat(F.lit('{"v":'), "effect_value", F.lit("}")), "v string")["v"].alias("content"),
            F.col("target").alias("category"), F.col("effect_key").alias("metadata"), *[f"at_{c}" for c in self.order_cols])

    def entries(self) -> DataFrame:
        """Key-value changes: key and the last write with its place in the order."""
        return self._of("set").groupBy(F.col("target").alias("key")).agg(
            F.max(F.struct(*self._at(), F.col("effect_value").alias("value"))).alias("last"))

    def changes(self, table: str) -> DataFrame:
        """Changes of a table, one row a key, in the form that ``fold_changes`` merges."""
        spec = self.tables[table]
        rows = self._of("upsert").where(F.col("target") == table).select(
            F.from_json("effect_key", spec.key_schema).alias("_k"),
            F.from_json("effect_value", spec.value_schema).alias("_v"), *self._at())
        rows = rows.select(*[F.col(f"_k.{c}").alias(c) for c in spec.key_names],
                           *[change(rule, F.col(f"_v.{c}"), self._at()).alias(c) for c, (_, rule) in spec.values.items()])
        return fold_changes(rows, spec)


def change(rule: str, value: Column, at: list[Column]) -> Column:
    """A write's value; with its place in the order where that decides."""
    if rule in ("replace", "first"):
        return F.when(value.isNotNull(), F.struct(*at, value.alias("value")))
    return value


def fold_changes(changes: DataFrame, spec: KnowledgeTable) -> DataFrame:
    """One change a key from any number of them: associative and commutative.  Null key values are
    equal."""
    how = {"add": F.sum, "least": F.min, "greatest": F.max, "replace": F.max, "first": F.min}
    return changes.groupBy(*spec.key_names).agg(*[how[rule](c).alias(c) for c, (_, rule) in spec.values.items()])


def table_rows(changes: DataFrame, spec: KnowledgeTable) -> DataFrame:
    """The table that all changes so far make."""
    folded = fold_changes(changes, spec)
    return folded.select(*spec.key_names, *[
        (F.col(f"{c}.value") if rule in ("replace", "first") else F.col(c)).cast(t).alias(c)
        for c, (t, rule) in spec.values.items()])


def entry_rows(entries: DataFrame) -> DataFrame:
    """(key, value JSON) of all key-value changes so far."""
    return entries.groupBy("key").agg(F.max("last").alias("last")).select("key", F.col("last.value").alias("value"))


def process_with_knowledge(df: DataFrame, key_cols: list[str], order_cols: list[str], fn: Callable,
                           output_schema: T.StructType | str, tables: list[KnowledgeTable] = (),
                           init: Callable[[dict], None] | None = None, capture_errors: bool = False,
                           delay: str | None = None, **options) -> Effects:
    """Run ``fn(event, state, knowledge)`` over every event in order per key.

    Batch: ``process_events`` (its ``options`` apply).  Stream: event order behind a watermark of ``delay``;
    write it with ``streaming.effects.effects_sink``.  With ``capture_errors`` an event on which the
    function raises writes nothing and becomes a dead letter."""
    alerts = output_schema if isinstance(output_schema, T.StructType) else T._parse_datatype_string(output_schema)
    named = {t.name: t for t in tables}
    schema = effects_schema(alerts, df.schema, order_cols)
    call = recording(fn, named, order_cols)
    if df.isStreaming:
        from tidewatch.streaming.ordered import process_in_order
        frame = process_in_order(df, key_cols, order_cols[0], order_cols, call, schema, delay or "5 seconds",
                                 capture_errors, init=init)
    else:
        frame = process_events(df, key_cols, order_cols, call, schema, init, capture_errors=capture_errors, **options)
    return Effects(frame, alerts.names, order_cols, named)


def split(frame: DataFrame, like: Effects) -> Effects:
    """The same split of another table of effects (a kept copy, a micro-batch)."""
    return Effects(frame, like.alert_columns, like.order_cols, like.tables)


# ---- the reference's example

IP_SCORES = KnowledgeTable("ip_scores", {"ip": "string"}, {"score": ("double", "add"), "event_count": ("bigint", "replace")})


def scored_rate(window_s: float = 60.0, threshold: int = 100) -> Callable:
    """Rate with reset that also keeps a score a source: one more at each alert, and the last count."""
    from tidewatch.operators.state import rate_with_reset
    rate = rate_with_reset(window_s, threshold)

    def fn(event: dict, state: dict, knowledge: Knowledge) -> list:
        alerts = rate(event, state)
        for a in alerts:
            knowledge.upsert("ip_scores", {"ip": a["src_ip"]}, score=1.0, event_count=a["count"])
        return alerts
    return fn
