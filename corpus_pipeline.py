"""Training-corpus pipeline: language ID, near-dedup, decontamination, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, language, packing, secrets, simhash
from tidewatch.llm.queries import word_tokenizer
from tidewatch.session import scratch_path
from tidewatch.sources.tables import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected: null texts and texts without a letter.  A missing ``lang`` is filled with the predicted
    language (left null where no row teaches one).  A low cosine rejects nothing: short clean texts have
    one too, and chance decides about unrelated ones.  Prototypes are learned from the stage's own
    labelled rows; repeated rows and null ids are rows like any other; an empty table stays empty."""
    prototypes = language.learn_prototypes(docs)
    found = language.identify(docs, prototypes, keep=COLUMNS, untaught=None)
    kept = found.where(~F.col("lang_pred").eqNullSafe(language.UNKNOWN))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id (nulls last), of repeated rows
    one.  Texts without words are one group; an empty table stays empty."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS), shingle=3, threshold=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row on its own (repeated rows go together); null and
    empty texts hold none, and without items or documents nothing changes."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is replaced by a mark; n_chars follows where the text changed.  No row goes;
    null texts, null ids and repeated rows pass as they are, and overlapping spans are one mark."""
    found = secrets.find_secrets(docs, keep=["lang", "source", "n_chars"])
    changed = F.size("spans") > 0
    return (found.withColumn("_text", secrets.redacted(F.col("text"), F.col("spans")))
            .select("doc_id", F.col("_text").alias("text"), "lang", "source",
                    F.when(changed, F.length("_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 4096; a null text packs its end mark alone, repeated rows
    and null ids are packed like any others, and an empty table gives no places."""
    return packing.pack(docs, word_tokenizer(), capacity=4096, end_id=1)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Learned prototypes, fingerprints and tokenization are beyond SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    base = scratch_path(spark, f"corpus-pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
