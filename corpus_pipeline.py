"""A corpus from raw documents: quality, near duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, of whatever names, and keep rows as they
are but for the text and n_chars that repeated_passages cuts. Null texts count as empty. Rows may repeat and lack a
doc_id; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from laureate.llm import bpe, mixing, quality, simhash, suffix_dedup
from laureate.llm.common import read, shared_dir, stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Rows that repeat or lack a doc_id are scored each by its text; without labels of
    both kinds all stay."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more: that of the smallest doc_id.
    Near ones are found by SimHash fingerprints and checked by their shingles. Empty, blank and null texts are one group."""
    return simhash.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes that repeat anywhere, which stay in none; a text may become empty, and null ones stay null."""
    return suffix_dedup.cleaned(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's target asks; a null source is one too. Rows of one doc_id are taken alike; those without
    one by their text."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, as digests, with what they decode to; one row per row, copies too. A null text has no tokens."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [("quality", good), ("near_duplicates", distinct), ("repeated_passages", unrepeated), ("mix", mixed), ("bpe", tokens)]

#: SQL cannot express the hashes, suffix keys and token merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    path = shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"{path}/{name}")
    return docs
