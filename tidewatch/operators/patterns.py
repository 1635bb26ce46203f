"""Sequence patterns as data (the ``MATCH_RECOGNIZE`` stand-in).

A pattern is a list of named steps, each a row condition with a quantifier, and a time bound.  It is
compiled to a finite automaton over the rows of a key in event order.  What a run of rows does to
the automaton is a map state -> state; such maps compose, so a key's rows are matched in parallel ranges
(``operators.mergeable``), and the same automaton runs on a stream behind the watermark.

Matching is greedy and possessive: a step takes rows while its condition holds, up to its most, and is
never shortened afterwards.  A row that fits neither its step nor the next ends the attempt and may begin
a new one; matches do not overlap.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.mergeable import Mergeable, process_mergeable

_MASK = "step_mask"


@dataclass(frozen=True)
class Step:
    """``at_least`` to ``at_most`` (None: any number) consecutive rows for which ``where`` (SQL) holds."""
    name: str
    where: str
    at_least: int = 1
    at_most: int | None = 1


@dataclass(frozen=True)
class Pattern:
    """Steps in order; the whole match takes at most ``within_s`` seconds."""
    steps: tuple[Step, ...]
    within_s: float | None = None

    def __post_init__(self):
        for s in self.steps:
            if s.at_least < 0 or s.at_most == 0 or (s.at_most is not None and s.at_most < s.at_least):
                raise ValueError(f"step {s.name}: bad quantifier")
        if not self.steps or self.steps[-1].at_least < 1 or self.steps[-1].at_most != self.steps[-1].at_least:
            raise ValueError("the last step takes a fixed number of rows")
        if len({s.name for s in self.steps}) < len(self.steps):
            raise ValueError("step names repeat")


START = (0, 0)


class Automaton:
    """States (step, rows it has taken, as far as they matter); ``START`` is outside a match."""

    def __init__(self, pattern: Pattern):
        self.steps = pattern.steps
        self.cap = [max(s.at_least, 1) if s.at_most is None else s.at_most for s in self.steps]
        self.states = [START] + [(i, c) for i, cap in enumerate(self.cap) for c in range(1, cap + 1)]
        self.table = {(s, m): self._move(s, m) for s in self.states for m in range(1 << len(self.steps))}

    def _fits(self, state: tuple[int, int], mask: int) -> tuple[int, int] | None:
        i, c = state
        if mask >> i & 1 and (self.steps[i].at_most is None or c < self.steps[i].at_most):
            return i, min(c + 1, self.cap[i])
        while c >= self.steps[i].at_least and i + 1 < len(self.steps):
            i, c = i + 1, 0
            if mask >> i & 1:
                return i, 1
        return None

    def _move(self, state: tuple[int, int], mask: int) -> tuple[tuple[int, int], int | None, bool, bool]:
        """(next state, step that takes the row or None, the row begins an attempt, it ends a match)."""
        to, fresh = self._fits(state, mask), state == START
        if to is None and not fresh:
            to, fresh = self._fits(START, mask), True
        if to is None:
            return START, None, False, False
        done = to[0] == len(self.steps) - 1 and to[1] >= self.steps[-1].at_least
        return (START if done else to), to[0], fresh, done


def _micros(t) -> int:
    from tidewatch.operators.state import seconds_of
    return round(seconds_of(t) * 1_000_000)


def _taken(match: dict, step: str, event: dict, order: list[str]) -> None:
    n, first, _ = match.get(step, (0, event[order[0]], None))
    match[step] = (n + 1, first, event[order[0]])
    match["last"] = tuple(event[c] for c in order)
    match.setdefault("first", match["last"])


def _joined(before: dict, after: dict) -> dict:
    """One match from its rows before a run and those inside it."""
    out = {**before, **{k: v for k, v in after.items() if k != "first"}}
    for step in set(before) & set(after) - {"first", "last"}:
        out[step] = (before[step][0] + after[step][0], before[step][1], after[step][2])
    return out


def pattern_rule(pattern: Pattern, key_cols: list[str], order_cols: list[str]) -> Mergeable:
    """The pattern as a mergeable event function over rows with their step mask."""
    auto = Automaton(pattern)
    names = [s.name for s in pattern.steps]

    def alert(match: dict, event: dict) -> list[dict]:
        first, last = match["first"], match["last"]
        if pattern.within_s is not None and (
                first[0] is None or _micros(last[0]) - _micros(first[0]) > pattern.within_s * 1_000_000):
            return []
        out = {c: event[c] for c in key_cols}
        for c, a, b in zip(order_cols, first, last):
            out[f"first_{c}"], out[f"last_{c}"] = a, b
        for n in names:
            out[f"{n}_rows"], out[f"{n}_first"], out[f"{n}_last"] = match.get(n, (0, None, None))
        return [out]

    def fn(event: dict, state: dict) -> list[dict]:
        to, step, fresh, done = auto.table[state.get("at", START), event[_MASK]]
        match = {} if fresh else state.get("match") or {}
        state["at"], state["match"] = to, match
        if step is None:
            state["match"] = {}
            return []
        _taken(match, names[step], event, order_cols)
        if done:
            state["match"] = {}
            return alert(match, event)
        return []

    def summarise(events: Iterable[dict]) -> dict:
        """For every state before the run: the state after it, whether the open match began before the
        run, and its rows inside.  Attempts that meet are followed once."""
        tracks = [(s, s != START, {}, [s]) for s in auto.states]
        for event in events:
            moved: dict = {}
            for at, old, match, members in tracks:
                to, step, fresh, done = auto.table[at, event[_MASK]]
                old, match = (False, {}) if fresh or step is None or done else (old, match)
                if step is not None and not done:
                    if (to, fresh) in moved:               # an attempt that begins here
                        moved[to, fresh][3].extend(members)
                        continue
                    _taken(match, names[step], event, order_cols)
                key = (to, True) if fresh and not done else (to, None) if to == START else (to, id(match))
                if key in moved:
                    moved[key][3].extend(members)
                else:
                    moved[key] = (to, old, match, members)
            tracks = list(moved.values())
        return {s: (at, old, match) for at, old, match, members in tracks for s in members}

    def advance(state: dict, summary: dict) -> None:
        at, old, match = summary[state.get("at", START)]
        state["match"] = _joined(state.get("match") or {}, match) if old else dict(match)
        state["at"] = at

    return Mergeable(fn, summarise, advance)


def masked(df: DataFrame, pattern: Pattern, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Keys, order and the mask of the steps that a row fits (an unknown condition does not hold)."""
    mask: Column = F.lit(0)
    for i, s in enumerate(pattern.steps):
        mask = mask + F.when(F.expr(s.where), 1 << i).otherwise(0)
    return df.select(*key_cols, *order_cols, mask.cast("int").alias(_MASK))


def match_schema(df: DataFrame, pattern: Pattern, key_cols: list[str], order_cols: list[str]) -> T.StructType:
    """Keys, first_ and last_ of the order columns, and per step its rows, first and last time."""
    kind = lambda c: df.schema[c].dataType
    fields = [(c, kind(c)) for c in key_cols]
    for c in order_cols:
        fields += [(f"first_{c}", kind(c)), (f"last_{c}", kind(c))]
    for s in pattern.steps:
        fields += [(f"{s.name}_rows", T.LongType()), (f"{s.name}_first", kind(order_cols[0])), (f"{s.name}_last", kind(order_cols[0]))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def match_pattern(df: DataFrame, pattern: Pattern, key_cols: list[str], order_cols: list[str],
                  delay: str | None = None, ranges: int | None = None) -> DataFrame:
    """Matches of the pattern per key, rows ordered by ``order_cols`` (time first, total).

    Batch: in parallel ranges.  Stream: the same automaton in event order behind a watermark of ``delay``;
    rows with a null time are left out there, and come first in batch.  Null keys are one key."""
    rows = masked(df, pattern, key_cols, order_cols)
    rule = pattern_rule(pattern, key_cols, order_cols)
    schema = match_schema(df, pattern, key_cols, order_cols)
    if df.isStreaming:
        from tidewatch.streaming.ordered import process_in_order
        return process_in_order(rows, key_cols, order_cols[0], order_cols, rule.fn, schema, delay or "5 seconds")
    return process_mergeable(rows, key_cols, order_cols, rule, schema, ranges=ranges)
