"""Queries of the training-data operators, with production parameters, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from .common import new_dir
from .decontamination import find_contamination, judged
from .language import held_out, identify, learn
from .near_duplicates import near_duplicates
from .neighbours import nearest
from .oracles import ORACLES
from .packing import pack
from . import html_text, secrets
from .repeats import removed, repeated_spans
from .token_counts import count_tokens
from .token_files import read_tokens, write_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), uri, vocabulary("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, uri, digest=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), k=20, trees=8, recall=0.95)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = learn(docs.where(~held_out()))
    return identify(docs, network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.scan(docs, secrets.train(secrets.samples(docs))))


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"), length=200)
    return removed(found).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), html_text.train())


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, size=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_token_counts, op3_fm_index_decontamination, op4_minhash_near_duplicates, op5_projection_forest, op6_language_id, op7_secret_scan, op8_suffix_repeats, op9_html_main_text, op10_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
