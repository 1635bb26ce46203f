"""Mergeable event functions and sequence patterns equal their sequential forms, in batch and on a stream."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import mergeable as M
from tidewatch.operators import patterns as P
from tidewatch.operators import state as ST
from test_ordered_streams import run, shuffled_topic

T0 = datetime(2024, 5, 1)
FLOWS = "src_ip string, event_time timestamp_ntz, event_id long, dst_ip string"
ORDER = ["event_time", "event_id"]


def flows(n=3000, seed=5):
    """One source holds half of the rows, one is null; equal and null times."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 4 + ["a", "b", "c", None]),
             None if rng.random() < 0.01 else T0 + timedelta(seconds=rng.randint(0, 900)), i,
             f"d{rng.randint(0, 60)}") for i in range(n)]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_first_contact(spark, ranges):
    df = spark.createDataFrame(flows(), FLOWS).repartition(5)
    got = M.process_mergeable(df, ["src_ip"], ORDER, M.mergeable_first_contact(), ST.FIRST_CONTACT_SCHEMA, ranges=ranges)
    want = ST.process_events(df, ["src_ip"], ORDER, ST.first_contact(), ST.FIRST_CONTACT_SCHEMA)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("broadcast_bytes", [M.BROADCAST_BYTES, -1])
def test_rate_with_reset(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(M, "BROADCAST_BYTES", broadcast_bytes)     # states broadcast, or sent with the rows
    df = spark.createDataFrame([r for r in flows() if r[1] is not None], FLOWS).repartition(5)
    got = M.process_mergeable(df, ["src_ip"], ORDER, M.mergeable_rate_with_reset(30, 12), ST.RATE_RESET_SCHEMA, ranges=16)
    want = ST.process_events(df, ["src_ip"], ORDER, ST.rate_with_reset(30, 12), ST.RATE_RESET_SCHEMA)
    assert rows_of(got) == rows_of(want) and got.count() > 100


def test_no_task_reads_more_than_its_share(spark):
    """A source with half of the rows is spread over half of the ranges."""
    df = spark.createDataFrame(flows(8000), FLOWS).repartition(5)
    dealt = df.repartitionByRange(16, "src_ip", *ORDER).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 8000 / 16 * 1.6
    states = M._start_states(df.repartitionByRange(16, "src_ip", *ORDER).sortWithinPartitions("src_ip", *ORDER)
                             .withColumn(M._PART, F.spark_partition_id()), ["src_ip"], M.mergeable_first_contact())
    assert 5 <= states.count() < 16


def test_errors_become_dead_letters(spark):
    def count_or_raise(event, state):
        if event["event_id"] % 10 == 4:
            raise ValueError("bad")
        state["n"] = state.get("n", 0) + 1
        return [{"id": event["event_id"], "n": state["n"]}]

    def add(state, n):
        state["n"] = state.get("n", 0) + n
    rule = M.Mergeable(count_or_raise, lambda events: sum(e["event_id"] % 10 != 4 for e in events), add,
                       lambda state: state.update(n=100))
    df = spark.createDataFrame(flows(400), FLOWS).repartition(3)
    got = M.process_mergeable(df, ["src_ip"], ORDER, rule, "id long, n long", capture_errors=True, ranges=9)
    want = ST.process_events(df, ["src_ip"], ORDER, count_or_raise, "id long, n long", init=rule.init, capture_errors=True)
    short = lambda x: rows_of(x.select("id", "n", "error", "error_type"))
    assert short(got) == short(want) and got.where("error_type is not null").count() == 40


@pytest.mark.parametrize("window,threshold", [(5, 1), (5, 3), (40, 12), (1000, 30)])
def test_rate_summaries_equal_running_the_function(window, threshold):
    rng = random.Random(threshold)
    rule = M.mergeable_rate_with_reset(window, threshold)
    for _ in range(150):
        t, times = 0.0, []
        for _ in range(rng.randint(1, 120)):
            t += rng.choice([0, 0, 0.5, 1, 1, 3, 30 if rng.random() < 0.1 else 0])
            times.append(T0 + timedelta(seconds=t))
        events = [{"src_ip": "x", "event_time": at, "event_id": i} for i, at in enumerate(times)]
        cuts = sorted(rng.sample(range(len(events) + 1), min(len(events), rng.randint(0, 4))))
        want, got = {}, {}
        for e in events:
            rule.fn(e, want)
        for lo, hi in zip([0, *cuts], [*cuts, len(events)]):
            rule.advance(got, rule.summarise(events[lo:hi]))
        assert list(got.get("times", ())) == list(want.get("times", ()))


# -- patterns

LOG = "user string, event_time timestamp, event_id long, kind string"
PATTERNS = [
    P.Pattern((P.Step("bad", "kind = 'f'", 3, None), P.Step("good", "kind = 's'")), within_s=40),
    P.Pattern((P.Step("open", "kind IN ('s', 'v')"), P.Step("work", "kind = 'a'", 0, 4), P.Step("any", "kind <> 'a'", 1, 2),
               P.Step("end", "kind = 'd'"))),
    P.Pattern((P.Step("pair", "kind = 'f'", 2, 2),), within_s=5),
    P.Pattern((P.Step("maybe", "kind = 'v'", 0, 1), P.Step("run", "kind = 'a'", 1, None), P.Step("stop", "kind = 'f'"))),
]


def log(n=1500, seed=11):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "u1", "u2", None]), T0 + timedelta(seconds=rng.randint(0, n)), i,
             rng.choice(["f", "f", "f", "s", "a", "a", "v", "d", None])) for i in range(n)]


def fits(step, kind):
    return {"kind = 'f'": kind == "f", "kind = 's'": kind == "s", "kind IN ('s', 'v')": kind in ("s", "v"),
            "kind = 'a'": kind == "a", "kind <> 'a'": kind is not None and kind != "a", "kind = 'd'": kind == "d",
            "kind = 'v'": kind == "v"}[step.where]


def model(pattern, rows):
    """Row by row from every starting row: (user, first id, last id, rows per step)."""
    out = set()
    for user in {r[0] for r in rows}:
        line = sorted((r for r in rows if r[0] == user), key=lambda r: r[1:3])
        at = 0
        while at < len(line):
            k, counts = at, []
            for s in pattern.steps:
                n = 0
                while k < len(line) and (s.at_most is None or n < s.at_most) and fits(s, line[k][3]):
                    n, k = n + 1, k + 1
                counts.append(n)
                if n < s.at_least:
                    break
            if len(counts) == len(pattern.steps) and counts[-1] >= pattern.steps[-1].at_least:
                if pattern.within_s is None or (line[k - 1][1] - line[at][1]).total_seconds() <= pattern.within_s:
                    out.add((user, line[at][2], line[k - 1][2], tuple(counts)))
                at = k
            else:
                at = max(k, at + 1)          # the rows of a failed attempt are used up
    return out


def matches(df, pattern):
    return {(r.user, r.first_event_id, r.last_event_id, tuple(r[f"{s.name}_rows"] for s in pattern.steps)) for r in df.collect()}


@pytest.mark.parametrize("number", range(len(PATTERNS)))
def test_patterns_equal_a_row_model(spark, number):
    pattern, rows = PATTERNS[number], log()
    df = spark.createDataFrame(rows, LOG).withColumn("event_time", F.col("event_time").cast("timestamp_ntz")).repartition(4)
    want = model(pattern, rows)
    assert len(want) > 3
    for ranges in (1, 19):
        assert matches(P.match_pattern(df, pattern, ["user"], ORDER, ranges=ranges), pattern) == want


@pytest.mark.parametrize("number", range(len(PATTERNS)))
def test_pattern_maps_compose(number):
    """Runs cut anywhere give the states and open matches of one run."""
    pattern, rng = PATTERNS[number], random.Random(number)
    rule = P.pattern_rule(pattern, ["user"], ORDER)
    for _ in range(200):
        events = [{"user": "u", "event_time": T0 + timedelta(seconds=i), "event_id": i, P._MASK: rng.randrange(1 << len(pattern.steps))}
                  for i in range(rng.randint(0, 25))]
        cut = rng.randint(0, len(events))
        want, got = {}, {}
        for e in events:
            rule.fn(e, want)
        for part in (events[:cut], events[cut:]):
            rule.advance(got, rule.summarise(part))
        assert got["at"] == want.get("at", P.START) and (got["match"] or {}) == (want.get("match") or {})


def test_patterns_on_a_stream(spark):
    rows = [r for r in log(400) if r[0] is not None] + [("end", T0 + timedelta(seconds=5000), 99999, None)]
    src = shuffled_topic(spark, rows, LOG, disorder_s=60)
    for pattern in PATTERNS[:3]:
        got = run(spark, src, LOG, lambda s: P.match_pattern(s, pattern, ["user"], ORDER, delay="90 seconds"))  # noqa: B023
        assert matches(got, pattern) == model(pattern, rows)


def test_bad_patterns_are_refused():
    for steps in ((), (P.Step("a", "true", 1, None),), (P.Step("a", "true", 2, 1),), (P.Step("a", "true"), P.Step("a", "true"))):
        with pytest.raises(ValueError):
            P.Pattern(tuple(steps))
