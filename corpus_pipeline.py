"""From raw documents to training tokens: the stages in order, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwright.llm import bpe, decontamination, language, line_dedup, ngram_join
from shiftwright.llm.common import small_batches, table
from shiftwright.session import cut

# SQL cannot express the learned language model or the tokenizer; the stages are tested on small fixtures.
ORACLE_SQL = None

MIN_LANGUAGE_SCORE = 0.5
VOCABULARY = "word_bpe_49k.json"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters go, and those for which no language has half the likelihood.

    The model is learned from the documents themselves, where they name their language.
    """
    small_batches(spark)
    out = language.identify(docs, docs.select("doc_id", "text", "lang"), prefix="_found_")
    known = (F.col("_found_lang_pred") != language.UNKNOWN) & (F.col("_found_score") >= MIN_LANGUAGE_SCORE)
    return out.where(known).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; n_chars follows the text. No document goes."""
    out = line_dedup.dedup_lines(docs, prefix="_found_")
    changed = F.col("_found_n_dropped") > 0
    return out.select(*[
        F.when(changed, F.col("_found_kept_text")).otherwise(F.col("text")).alias(c) if c == "text"
        else F.when(changed, F.length("_found_kept_text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars"
        else F.col(c)
        for c in docs.columns
    ])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one of the smallest doc_id."""
    small_batches(spark)
    return ngram_join.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages to speak of."""
    small_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text."""
    small_batches(spark)
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY))
    return bpe.digests(out, "doc_id", "lang", "source", "ids")


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
