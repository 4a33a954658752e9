"""The corpus pipeline: documents to packed sequences in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that
the stage before it kept; its result is written as Parquet and read again as
the next stage's documents. All but the last return the columns of
``documents`` (the mix repeats a row as often as it takes it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercato.llm import exact_dedup, language_id, mixing, packing, simhash
from mercato.llm.common import ship, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a recognised language go.

    A null text, an empty one and one without letters go. Each row is judged
    by its own text, so repeated rows and rows with a null doc_id stay or go
    alike. A null lang is not learned from; where no row can be learned from,
    no language is recognised. An empty table stays empty."""
    ship(spark)
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts, the one with the smallest doc_id stays.

    A null text equals an empty one. Null doc_ids come after all others; of
    repeated rows one stays. An empty table stays empty."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each component of near copies, one document stays: the
    one with the smallest doc_id, null ids last, one row of repeated ones.

    Texts without words (null ones too) have the zero fingerprint and are
    linked like any other. An empty table stays empty."""
    ship(spark)
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document as often as the mix takes it.

    A null source is a source, the last in order. Documents without words
    weigh nothing and are not taken; repeated rows and null doc_ids are
    documents of their own. An empty table stays empty."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the mix packed into sequences, one row per piece.

    A null text counts as empty and is packed as its end token alone; a row
    that the mix repeats is packed as often. An empty table gives no pieces."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None  # a string kernel and SimHash are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
