"""A training corpus from raw documents, in stages: each is written as Parquet and read again as the next one's documents.

Language identification drops texts without letters or without a likely language; near-deduplication keeps the
least ``doc_id`` of each component; decontamination drops documents in which benchmark passages make a twentieth of all words;
the secret scan replaces secrets in the text and sets n_chars anew where it does; packing gives each piece of
each document left its place in a sequence. All stages but the last return the columns of ``documents``. Rows without a
``doc_id`` can't be linked and pass near-deduplication; of rows that repeat one, a single row passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import registry, secrets
from folioscope.llm.common import written
from folioscope.llm.decontamination import find_contamination, judged
from folioscope.llm.language import held_out, identify, learn
from folioscope.llm.near_duplicates import representatives
from folioscope.llm.packing import pack
from folioscope.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Below this mean probability no language is likely.
LEAST_SCORE = 0.3


def others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "doc_id")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = identify(docs, learn(docs.where(~held_out())), keep=others(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return representatives(docs, percent=85, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_contamination(docs, registry.table(spark, sf_dir, "benchmark"), keep=others(docs))
    return judged(found).where(~F.col("contaminated")).select(docs.columns)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(docs, secrets.train(secrets.samples(docs)))
    cleaned = scanned.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length(secrets.redact(F.col("text"), F.col("spans")))))
    return cleaned.withColumn("text", secrets.redact(F.col("text"), F.col("spans"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(docs, registry.vocabulary("byte_bpe_50k.json"), end_id=0, size=2048)


STAGES = [
    ("language identification", languages),
    ("near-deduplication", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_removal),
    ("best-fit packing", packing),
]

#: Sketches, networks and tokenizers are beyond SQL; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = registry.table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
