"""From raw documents to packed token sequences: the stages in order, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.llm import decontamination, line_dedup, near_dedup, packing, quality
from punctual.llm.common import stored, table, words_of


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of any repeated line that has a word; those left without a word go."""
    deduped = line_dedup.drop_repeated_lines(docs, least=1)
    changed = F.col("n_removed_lines") > 0
    left = deduped.where(~changed | (F.size(words_of(F.col("text"))) > 0))
    return left.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.one_of_each(docs).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found."""
    question, answer = decontamination.last_sentence(F.col("text"))
    # Ids may be missing or repeated, so rows are told apart by id and text.
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = decontamination.find_leaks(keyed, "__row", "text", table(spark, sf_dir, "benchmark"), "item_id", question, answer)
    leaks = stored(found.select(F.col("doc_id").alias("__row")).distinct())
    return keyed.join(leaks, "__row", "left_anti").select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their token ids."""
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", packed_sequences),
]

#: Near-duplicates and packing are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
