"""From raw documents to packed sequences: quality, near-duplicates, repeated strings, source mix, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyloom.llm.arrays import file_row, numbers_rows
from policyloom.llm.minhash import drop_near_duplicates
from policyloom.llm.mixing import mixed_documents
from policyloom.llm.packing import pack
from policyloom.llm.quality import good_documents
from policyloom.llm.suffixes import without_repeats
from policyloom.session import ensure_checkpoint_dir, temporary_tables


def _row(docs: DataFrame) -> Column | None:
    """Rows of files are known by their places in them, so their texts need not be written again with numbers."""
    row = file_row()
    return row if numbers_rows(docs, row) else None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts fail, repeated rows share their verdict."""
    return good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, repeated rows included; texts without words are no one's copy."""
    return drop_near_duplicates(docs, row=_row(docs))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the characters of repeated strings; null texts stay null, n_chars is made to match."""
    return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a null source being a source; texts without words are not taken."""
    return mixed_documents(docs, row=_row(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that fill the sequences; a null text is packed as its end token alone, an empty table has no pieces."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]
#: Sketches, compression and tokenizers are beyond SQL: the tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again as the next one's documents.

    What a stage wrote on its way is removed once its rows are there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline/{uuid.uuid4()}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
