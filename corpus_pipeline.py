"""Corpus pipeline: documents to token blocks, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; it is written as Parquet to the shared folder and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``. A stage judges what its
predecessor kept: statistics, groups and targets are those of its own input.

1. quality rules: documents that the rules reject go;
2. near-duplicates: one document of each SimHash class stays, the one of smallest id;
3. decontamination: documents with benchmark passages go;
4. mixing: documents are taken as often as the source weights want, some of them not at all;
5. token blocks: what is left is encoded, written in blocks and read back: id, start, tokens, checksum.

The order matters: near-duplicates are counted among good documents only, and the mix sees neither copies nor
contaminated text. No stage can be put in SQL: hashes, tokenizer and logarithms differ between engines, so the whole is
tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rtshop.llm import decontaminate, mixing, quality, simhash, token_blocks
from rtshop.llm.common import staged, table
from rtshop.llm.queries import BLOCK_VOCABULARY, vocabulary

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, trusted documents being those labelled good and not toxic."""
    return quality.keep_good(docs, quality.trusted_documents(table(spark, sf_dir, "labels")), distinct=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks of the mix, read back: a row for each document, repeats included."""
    return token_blocks.store_tokens(docs, vocabulary(BLOCK_VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_blocks", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; every stage before it is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
