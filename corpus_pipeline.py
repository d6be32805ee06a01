"""A training corpus from raw documents: language, near duplicates, leaks, mixture, token ids.

Cases: null texts, and texts without a letter, go in the first stage; a null doc_id or source keeps its row (a null
source is a source of its own in the mixture); of equal or near equal texts one row stays, whatever its id; different
texts under one id all stay; other columns are kept up to the last stage, which returns the columns of the token
store; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, mixing, simhash_dedup, token_store
from millrace.llm.common import Scratch, freed, key_crc, table

#: A document stays if its language's posterior is at least this.
SURE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no certain language, go."""
    languages, weights = language_id.fit(docs, key_crc(F.col("doc_id")) % 5 != 0)
    return language_id.keep_known(spark, docs, languages, weights, SURE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return simhash_dedup.deduplicate(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed_rows(spark, docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, written as shards and read back."""
    return token_store.encode_and_read(spark, docs, added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Learned models, 64-bit fingerprints and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has read and written for itself is freed once its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs = given = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with freed():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not given:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
