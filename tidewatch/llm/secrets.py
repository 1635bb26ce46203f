"""Secret scans in one pass per row: fixed patterns plus a sliding-window entropy test.

Positions come from regular expressions alone: the text split at a pattern and the
pattern's matches alternate, so running lengths give every match its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import first_columns

# Fixed values of the contract.  The letters of `assign` match in either (ASCII) case.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE, ASSIGN_MIN = 2, 6
ACCESS = "AKIA[A-Z0-9]{16,}"       # AKIA and a run of 20 or more in all
HEX = "[0-9a-f]{24,}"              # maximal runs
BASE_KINDS = ("assign", "access", "hex")

#: Candidate strings of the entropy test: maximal runs as long as the window or longer.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: (class, the whole candidate must match, window entropy in bits from which it is a secret).
CLASSES = (("hexadecimal", "^[0-9A-Fa-f]+$", 3.0), ("capitals", "^[A-Z0-9]+$", 3.4), ("mixed", "", 3.7))
#: Well-known harmless strings: UUIDs, documentation keys, placeholders, paths of words, rules.
ALLOW = ("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", "(?i)example|sample|dummy|placeholder",
         "^/?([A-Za-z]+[/_-])+[A-Za-z]*$", "^[=_+/-]+$")

_SPAN = "array<struct<start:int,end:int,found:string>>"
SPANS = "array<struct<kind:string,start:int,end:int>>"


#: Matches are located in blocks, so that a text with very many of them does not copy one long
#: array per match.
_BLOCK = 256


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: str, found: Column) -> Column:
    """Matches with code point places; ``found`` are the pattern's matches in the text."""
    def place(acc, x):
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(
            start.alias("start"), end.alias("end"), x["found"].alias("found"))).alias("out"))

    def block(acc, part):
        start = F.struct(acc["at"].alias("at"), F.array().cast(_SPAN).alias("out"))
        return _bind(F.aggregate(part, start, place), lambda r: F.struct(
            r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

    def blocks(pairs):
        last = ((F.size(pairs) - 1) / F.lit(_BLOCK)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(pairs, k * _BLOCK + 1, F.lit(_BLOCK)))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.aggregate(parts, none, block, lambda acc: F.flatten(acc["out"]))

    # the text between matches and the matches alternate
    pairs = _bind(F.split(text, pattern, -1), lambda between: F.transform(
        found, lambda m, i: F.struct(F.get(between, i).alias("between"), m.alias("found"))))
    return F.when(F.size(found) > 0, _bind(pairs, blocks)).otherwise(F.array().cast(_SPAN))


def _n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def peak_entropy(text: Column, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy (bits per character) of any window of the string.

    The window slides by one character: one count rises, one falls, and the running
    sum of n * log2(n) changes by these two terms only.  Strings shorter than the
    window: 0.  Only characters of ALPHABET are expected.
    """
    place = lambda ch: F.instr(F.lit(ALPHABET), ch) - 1
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("s"),
                    F.lit(0.0).alias("peak"))

    def bumped(acc, at, by):
        n = F.get(acc["counts"], at)
        return F.struct(F.transform(acc["counts"], lambda c, i: F.when(i == at, c + by).otherwise(c)).alias("counts"),
                        (acc["s"] + _n_log_n(n + by) - _n_log_n(n)).alias("s"), acc["peak"].alias("peak"))

    def step(acc, x):
        entered = lambda a: _bind(bumped(a, x["into"], 1), scored)
        scored = lambda a: F.struct(
            a["counts"].alias("counts"), a["s"].alias("s"),
            F.when(x["full"], F.greatest(a["peak"], F.lit(_log2(window)) - a["s"] / window))
            .otherwise(a["peak"]).alias("peak"))
        left = F.when(x["out"] >= 0, bumped(acc, x["out"], -1)).otherwise(acc)
        return _bind(left, entered)

    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    moves = F.transform(F.array(F.transform(chars, place)), lambda at: F.transform(at, lambda c, i: F.struct(
        c.alias("into"), F.when(i >= window, F.get(at, i - window)).otherwise(F.lit(-1)).alias("out"),
        (i >= window - 1).alias("full"))))[0]
    return F.aggregate(moves, zero, step, lambda acc: acc["peak"])


def _log2(n: int) -> float:
    import math
    return math.log2(n)


def is_secret_like(found: Column) -> Column:
    """Entropy verdict on one candidate string: of its first fitting character class, unless
    it is on the allow list.  Strings without both a letter and a digit are words or numbers."""
    cheap = F.rlike(found, F.lit("[0-9]")) & F.rlike(found, F.lit("[A-Za-z]"))
    for pattern in ALLOW:
        cheap = cheap & ~F.rlike(found, F.lit(pattern))
    least = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(F.rlike(found, F.lit(pattern)), F.lit(bits)).otherwise(least)
    return F.when(cheap, peak_entropy(found) >= least).otherwise(F.lit(False))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
                 ) -> DataFrame:
    """Spans of every row: doc_id, text, base (spans of the fixed kinds) and spans (these and
    the entropy spans), each an array of (kind, start, end) in code points, end exclusive,
    ordered by start, then kind (assign, access, hex, entropy).

    ``keep`` names further input columns to pass through.  Null or empty text: no spans
    (text stays as it is).  An entropy span inside a base span is left out.  Repeated rows
    and null ids are rows like any other.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"),
                       *[docs[c].alias(f"_keep_{i}") for i, c in enumerate(keep or [])])
    carried = [c for c in rows.columns if c.startswith("_keep_")]
    text = F.coalesce("text", F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    rows = rows.select("doc_id", "text", *carried, *[
        F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in patterns.items()])
    # candidates are judged before they are located: most texts have none that pass
    rows = rows.withColumn("_worth", F.exists("_m_entropy", is_secret_like))
    located = {k: _located(text, p, F.col(f"_m_{k}")) for k, p in patterns.items()}
    rows = rows.select("doc_id", "text", *carried, *[
        (F.when(F.col("_worth"), c).otherwise(F.array().cast(_SPAN)) if k == "entropy" else c).alias(f"_s_{k}")
        for k, c in located.items()])
    long_enough = {"assign": lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, ASSIGN_VALUE)) >= ASSIGN_MIN}
    tagged = lambda kind, order, spans: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    base = F.array_sort(F.concat(*[
        tagged(k, n, F.filter(f"_s_{k}", long_enough[k]) if k in long_enough else F.col(f"_s_{k}"))
        for n, k in enumerate(BASE_KINDS)]))
    rows = rows.select("doc_id", "text", *carried, "_s_entropy", base.alias("_base"))
    added = F.filter("_s_entropy", lambda s: ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
                     & is_secret_like(s["found"]))
    whole = F.array_sort(F.concat("_base", tagged("entropy", len(BASE_KINDS), added)))
    out = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])).cast(SPANS)
    return rows.select("doc_id", "text", *[F.col(c).alias(k) for c, k in zip(carried, keep or [])],
                       out(F.col("_base")).alias("base"), out(whole).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mark``."""
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                                       F.lit(mark)).alias("out"))).otherwise(
        F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    tail = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, tail)).otherwise(text)
