"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, fill_in_middle, html_templates, language_id, lm_scoring, merkle, minhash, secret_scan, sentencepiece_codec, suffix_dedup, token_counts, toxicity
from .common import table

#: Files of public tokenizers; the folder is a parameter of the queries.
BPE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file(BPE_FILE))


def op4_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.page_texts(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_FILE))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_all(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_digests(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_suffix_dedup, op3_token_counts, op4_html_templates, op5_sentencepiece, op6_merkle, op7_language_id, op8_toxicity, op9_lm_scoring,
                                   op10_decontaminate, op11_fill_in_middle, op12_secret_scan, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    """SQL of the same rows, where SQL can express the operator on whole tables."""
    return {"op1_minhash": minhash.ORACLE_SQL, "op6_merkle": merkle.ORACLE_SQL, "op11_fill_in_middle": fill_in_middle.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
