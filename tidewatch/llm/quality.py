"""Quality rules: text statistics and a learned decision list, as Spark expressions.

Sequential covering: a rule is a conjunction of thresholds on statistics.  It is grown
condition by condition on two thirds of the labelled rows that no earlier rule covers
(the condition with the best information gain), pruned on the remaining third, and kept
if it is precise there; if not, its first condition is barred and the next best is tried.  Every count the search needs is a Spark aggregate over binned
statistics; the driver sees only (statistic, bin, class) totals, whose number does not
depend on the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE_CLASS, WORD_CLASS, first_columns, saved

REPEAT_WINDOW = 5

#: Shares the rules may use; every one is finite for every text.
FEATURES = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "exclaim_share": "n_exclaims / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every row's whole text, one narrow row each.

    Null text counts as empty (all zero).  Repeated rows and null ids are rows like any other.
    """
    rows = first_columns(docs, doc_id=id_col, _text=text_col)
    text = F.coalesce("_text", F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD_CLASS)))
    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    rows = rows.select(
        "doc_id", count("[#*$%&|<>]").alias("n_symbols"), count("[A-Z]").alias("n_capitals"),
        count("[!?]").alias("n_exclaims"), count("[0-9]").alias("n_digits"),
        lines.alias("_lines"), words.alias("_words"))
    rows = rows.select(
        "doc_id", "n_symbols", "n_capitals", "n_exclaims", "n_digits",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    k = REPEAT_WINDOW
    windows = F.when(F.size("_hashes") > k, F.transform(
        F.sequence(F.lit(0), F.size("_hashes") - k),
        lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(*[c for c in rows.columns if c != "_hashes"], windows.alias("_windows"))
    repeated = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered_by_repeats(F.col("_windows"), k))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
                       "n_capitals", "n_exclaims", "n_digits")


def _covered_by_repeats(windows: Column, k: int) -> Column:
    """Words that lie in a window found twice or more: sort (hash, place), keep those with an
    equal neighbour, and sum the widths of their union."""
    at = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(F.array(at), lambda s: F.filter(F.transform(s, lambda x, n: F.struct(
        x["i"].alias("i"), (F.coalesce(F.get(s, n - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(s, n + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
        lambda x: x["twice"]))[0]
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    step = lambda acc, i: F.struct(
        (acc["n"] + F.least(F.lit(k), i + k - acc["end"])).alias("n"), (i + k).alias("end"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-k).alias("end")), step, lambda acc: acc["n"])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool            # True: value > threshold, False: value <= threshold
    threshold: float

    def column(self, value: Column | None = None) -> Column:
        value = F.expr(FEATURES[self.feature]) if value is None else value
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self, named: bool = False) -> Column:
        """``named``: the statistics are columns of their own."""
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(F.col(c.feature) if named else None)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def learn_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                bins: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.95,
                min_rows: int = 5, false_alarm_cost: int = 20, max_failures: int = 6) -> list[Rule]:
    """Rules for low quality (label 0), in order.  Rows without a label, and ids whose labels
    disagree, teach nothing; without labels of both classes there are no rules.  A good row that
    a rule hits weighs ``false_alarm_cost`` times as much as a bad one.  After ``max_failures`` rules in a
    row that do not hold the list is complete."""
    marks = (labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("_label"))
             .where("_label is not null and doc_id is not null").groupBy("doc_id")
             .agg(F.min("_label").alias("_low"), F.max("_label").alias("_high")).where("_low = _high"))
    names = list(FEATURES)
    rows = stats.join(marks, "doc_id").select(
        (F.col("_low") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"),
        *[F.expr(FEATURES[f]).alias(f) for f in names])
    # thresholds: quantiles of each class, so that a rare class has its own
    picks = [i / bins for i in range(bins)]
    edges = rows.groupBy("bad").agg(*[F.percentile_approx(f, picks, 10_000).alias(f) for f in names]).collect()
    cuts = {f: sorted({float(v) for r in edges for v in r[f] or ()}) for f in names}
    binned = saved(rows.select("bad", "prune", *[_bin_of(f, cuts[f]) for f in names]).groupBy("bad", "prune", *names).agg(F.count(F.lit(1)).alias("n")))
    # the search reads this small table many times: as few tasks as its rows need
    binned = binned.coalesce(max(1, binned.count() // 100_000))

    def met(conditions: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, cut in conditions:
            out = out & (F.col(f) > cut if above else F.col(f) <= cut)
        return out

    def totals(where: Column, prune: bool) -> dict[tuple[str, int], tuple[int, int]]:
        """Per statistic and bin: rows of low and of good quality."""
        pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in names])
        found = (binned.where(where & (F.col("prune") == prune)).select("bad", "n", F.inline(pairs))
                 .groupBy("f", "b").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"),
                                        F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("q")).collect())
        return {(r["f"], r["b"]): (r["p"], r["q"]) for r in found}

    def candidates(found: dict) -> list[tuple[int, int, tuple[str, bool, int]]]:
        out = []
        for f in names:
            seen = sorted((b, pq) for (g, b), pq in found.items() if g == f)
            all_p, all_q = sum(pq[0] for _, pq in seen), sum(pq[1] for _, pq in seen)
            p = q = 0
            for b, (dp, dq) in seen[:-1]:
                p, q = p + dp, q + dq
                out += [(p, q, (f, False, b)), (all_p - p, all_q - q, (f, True, b))]
        return out

    def grown(banned: set[tuple[str, bool]]) -> list[tuple[str, bool, int]]:
        """Conditions of one rule, greedily by gain; the first is none of the banned ones."""
        conditions: list[tuple[str, bool, int]] = []
        while len(conditions) < max_conditions:
            found = totals(uncovered & met(conditions), prune=False)
            p0, q0 = (sum(found[k][i] for k in found if k[0] == names[0]) for i in (0, 1))
            if not p0 or not q0:
                break
            share = lambda p, q: p / (p + false_alarm_cost * q)
            gain = lambda p, q: p * (log2(share(p, q)) - log2(share(p0, q0))) if p else 0.0
            able = ((p, q, c) for p, q, c in candidates(found) if conditions or (c[:2] not in banned and 2 * p >= min_rows))
            best = max(((gain(p, q), c) for p, q, c in able), default=(0.0, None))
            if best[0] <= 1e-9:
                break
            conditions.append(best[1])
        return conditions

    rules: list[Rule] = []
    uncovered, banned = F.lit(True), set()
    while len(rules) < max_rules and len(banned) < max_failures:
        conditions = grown(banned)
        if not conditions:
            break
        first = conditions[0][:2]
        conditions = _pruned(binned, uncovered, conditions, met, min_rows, min_precision)
        if not conditions:
            banned.add(first)          # a rule that fails is none to build on; others may hold
            continue
        tightest = {(f, above): cut for f, above, cut in conditions}   # a later one is the tighter
        rules.append(Rule(tuple(Condition(f, above, cuts[f][cut]) for (f, above), cut in tightest.items())))
        uncovered, banned = uncovered & ~met(conditions), set()
    return _centred(rows, rules)


def _centred(rows: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Thresholds moved to the middle of the gap between the good rows they let pass and the bad
    rows they hit."""
    if not rules:
        return rules
    sums = []
    for i, rule in enumerate(rules):
        for j, c in enumerate(rule.conditions):
            value, hit = F.col(c.feature), F.col("bad") & rule.column(named=True)
            passed = ~F.col("bad") & ~c.column(value)
            near, far = (F.max, F.min) if c.above else (F.min, F.max)
            sums += [near(F.when(passed, value)).alias(f"good_{i}_{j}"), far(F.when(hit, value)).alias(f"bad_{i}_{j}")]
    found = rows.agg(*sums).first()

    def middle(c: Condition, good: float | None, bad: float | None) -> Condition:
        return c if good is None or bad is None else Condition(c.feature, c.above, (good + bad) / 2)

    return [Rule(tuple(middle(c, found[f"good_{i}_{j}"], found[f"bad_{i}_{j}"]) for j, c in enumerate(rule.conditions)))
            for i, rule in enumerate(rules)]


def _bin_of(feature: str, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    value = F.col(feature)
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    return F.size(F.filter(edges, lambda c: c < value)).alias(feature)


def _pruned(binned: DataFrame, uncovered: Column, conditions: list, met, min_rows: int, min_precision: float) -> list:
    """The part of the conditions that hits most low rows among those that hold: precise on the
    pruning rows, where it hits a low row at least, and precise on ``min_rows`` low rows in all.  Of
    equals the shorter; none if no part holds."""
    parts = [c for n in range(1, len(conditions) + 1) for c in combinations(conditions, n)]
    sums = []
    for i, part in enumerate(parts):
        for kind, which in (("prune", F.col("prune")), ("all", F.lit(True))):
            for name, bad in (("p", F.col("bad")), ("q", ~F.col("bad"))):
                sums.append(F.sum(F.when(met(list(part)) & which & bad, F.col("n")).otherwise(0)).alias(f"{name}_{kind}_{i}"))
    r = binned.where(uncovered).agg(*sums).first()
    holding = []
    for i, part in enumerate(parts):
        (p, q), (p_all, q_all) = ((r[f"p_{kind}_{i}"] or 0, r[f"q_{kind}_{i}"] or 0) for kind in ("prune", "all"))
        if p >= 1 and p >= min_precision * (p + q) and p_all >= min_rows and p_all >= min_precision * (p_all + q_all):
            holding.append((p_all - q_all, -len(part), -i, list(part)))
    return max(holding)[-1] if holding else []


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: number of the first rule that
    holds (from 1), 0 if none does."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), F.lit(1))
    for n, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), F.lit(n))
    return out.otherwise(F.lit(0))


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **learning) -> DataFrame:
    """Statistics, base_failed, kept and rule_no of every row.  The statistics of all rows are
    computed once and kept in the shared folder; the rules are learned from their labelled part.

    Null text counts as empty; null ids and repeated rows are judged like any others (ties of a
    threshold: ``>`` and ``<=`` leave none); an empty table gives no rows, and a table without labels of
    both classes no rules."""
    stats = saved(doc_stats(docs, id_col, text_col))
    rules = learn_rules(stats, labels, **learning)
    number = verdict(rules)
    return stats.select("*", base_failed().alias("base_failed"),
                        (~base_failed() & (number == 0)).alias("kept"), number.alias("rule_no"))
