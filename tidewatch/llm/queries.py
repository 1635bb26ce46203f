"""The operators as registered queries over the driver's tables, with their DuckDB twins
where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (audit, bpe, decontaminate, html_text, language, merkle, packing, quality, secrets, sharding,
                           simhash, substrings, url_rules)
from tidewatch.llm.common import ASCII_LETTERS
from tidewatch.sources.tables import load

#: (host/path, verdict) rules that the URL query's contract fixes.
HOST_RULES = [url_rules.prefix_rule(*r) for r in (
    ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(load(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"),
                      F.size("removed").alias("n_intervals"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "rule_no")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(load(spark, sf_dir, "pages"), HOST_RULES, list(url_rules.SITE_RULES))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(load(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"),
                        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
                        secrets.spans_text(F.col("spans")).alias("spans"))


def word_tokenizer() -> str:
    """Path of the public word-level BPE definition that the packing query's contract names."""
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096, end_id=1)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    prototypes = language.learn_prototypes(docs.where(language.fold(F.col("doc_id")) != 0))
    return (language.identify(docs, prototypes)
            .select("doc_id", (language.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=3, threshold=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(load(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check against a state in which every seventh row (by checksum of its id) has one more
    character counted."""
    docs = load(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(docs, altered={"n_chars": more})


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(load(spark, sf_dir, "documents"), word_tokenizer(), with_text=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def _audit_oracle() -> str:
    """Every document in every order: first failing step, then counts per (part, order, step)."""
    step = lambda f: f"strpos(o, '{f}')"
    fails = {
        "A": f"len(words) < {audit.MIN_WORDS}",
        "B": f"100 * len(list_distinct(words)) < {audit.MIN_DISTINCT_PERCENT} * len(words)",
        "C": f"100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {audit.MAX_CAPITAL_PERCENT} * length(text)",
        "D": f"regexp_matches(text, '[{audit.MARKS.decode()}]')",
        "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)",
    }
    flags = ", ".join(f"{c} AS f{f}" for f, c in fails.items())
    first = "least(" + ", ".join(f"CASE WHEN f{f} THEN {step(f)} ELSE 6 END" for f in fails) + ")"
    own = "(CASE substr(o, step, 1) " + " ".join(f"WHEN '{f}' THEN f{f}" for f in fails) + " END)"
    only = " + ".join(f"CAST(f{f} AS INTEGER)" for f in fails)
    letters = ", ".join(f"'{f}'" for f in fails)
    return f"""
WITH l AS (SELECT unnest([{letters}]) AS c),
orders AS (SELECT a.c || b.c || d.c || e.c || f.c AS o FROM l a, l b, l d, l e, l f
           WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                 list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
          FROM documents),
docs AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {flags}
         FROM texts LEFT JOIN marks USING (doc_id)),
kinds AS (SELECT part, good, toxic, fA, fB, fC, fD, fE, count(*) AS n FROM docs GROUP BY ALL),
fates AS (SELECT part, o, step, n, good, toxic, {first} AS gone, {own} AS own, {only} AS failed
          FROM kinds, orders, (SELECT unnest(range(1, 6)) AS step)),
steps AS (SELECT part, o, step,
                 coalesce(sum(n) FILTER (gone > step), 0) AS kept,
                 coalesce(sum(n) FILTER (gone = step), 0) AS removed,
                 coalesce(sum(n) FILTER (own AND gone < step), 0) AS redundant,
                 coalesce(sum(n) FILTER (own AND failed = 1), 0) AS unique_fails,
                 coalesce(sum(n) FILTER (gone = step AND good), 0) AS good_lost,
                 coalesce(sum(n) FILTER (gone = step AND toxic), 0) AS toxic_lost
          FROM fates GROUP BY part, o, step)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, substr(o, step, 1)) AS BIGINT) AS shapley
FROM steps"""


def _url_oracle() -> str:
    rules = [(r.name, r.verdict, r.pattern, 1) for r in HOST_RULES]
    rules += [(r.name, r.verdict, r.pattern, 0) for r in url_rules.SITE_RULES]
    values = ", ".join(f"('{n}', '{v}', '{p}', {k})" for n, v, p, k in rules)
    lower = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{ASCII_LETTERS[0]}', '{ASCII_LETTERS[1]}')"
    return f"""
WITH rules(rule, verdict, pattern, is_prefix) AS (VALUES {values}),
parts AS (SELECT page_id, row_number() OVER () AS row_no, {lower} AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT row_no, max(row(is_prefix, length(rule), rule, verdict)) AS best
         FROM parts JOIN rules ON regexp_matches(host || path, pattern) GROUP BY row_no)
SELECT page_id, host, path,
       CASE WHEN best[1] = 1 THEN best[3] END AS rule, coalesce(best[4], 'allow') AS verdict,
       CASE WHEN best[1] = 0 THEN best[3] END AS pattern
FROM parts LEFT JOIN fits USING (row_no)"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filters": op3_url_filters,
    "op4_secret_scans": op4_secret_scans,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_sharding": op9_sharding,
    "op10_html_extraction": op10_html_extraction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_bpe": op12_bpe,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {"op3_url_filters": _url_oracle(), "op13_filter_audit": _audit_oracle()}
