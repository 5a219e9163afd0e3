"""From raw documents to token ids: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with the
columns of ``documents``; the last returns their token ids. ``run`` stores each stage's
rows as Parquet and gives them to the next. Stages decide on rows with a null doc_id
and repeated rows like on others, keep further columns, and return empty tables for
empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levybook.llm import decontaminate, language_id, minhash, sentencepiece_codec, suffix_dedup
from levybook.llm.common import stored, table
from levybook.llm.queries import PIECE_FILE, tokenizer_file

#: Share of the posterior that the best language needs; below it no language is taken as known.
LEAST_SCORE = 0.5
#: Near duplicates: words of a shingle, and percent of shingles shared.
SHINGLE, PERCENT = 5, 80
#: A column that no table of documents has.
GROUP_KEY = "__near_duplicate_key"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without a letter or a clear language go. Without any label all stay."""
    model = language_id.fit(docs)
    if not model.names:
        return docs
    found = language_id.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates; those without a doc_id come last, in order of a hash of their text, and equal ones of them are one."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 3))
    gone = minhash.near_duplicates(docs.select(key.alias("doc_id"), "text"), SHINGLE, PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias(GROUP_KEY)).distinct()
    left = docs.withColumn(GROUP_KEY, key).join(gone, GROUP_KEY, "left_anti")
    named = left.where("doc_id IS NOT NULL").unionByName(left.where("doc_id IS NULL").dropDuplicates([GROUP_KEY, "text"]))
    return named.select(*docs.columns)


def first_occurrences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier place holds too; documents with nothing left go."""
    return suffix_dedup.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids, decoded, round_trip, checked of every document."""
    return sentencepiece_codec.encode_decode(docs, tokenizer_file(PIECE_FILE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("minhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", first_occurrences),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", token_ids),
]

#: SQL can express neither the learned language model nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
