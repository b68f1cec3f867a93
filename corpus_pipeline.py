"""Quality rules, line dedup, SimHash near-dedup, secret scans and best-fit packing over ``documents``.

Each stage is written as Parquet below the shared checkpoint folder and read again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attribix.llm import fuzzy_lines, packing, quality_rules, queries, secrets, simhash_trie
from attribix.llm.shared import prepared, staged, table

#: SQL has no counterpart of SimHash or of the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep."""
    prepared(spark)
    return quality_rules.kept_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepared(spark)
    return simhash_trie.one_of_each(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one occurrence of each group of like lines; a document may be left empty."""
    prepared(spark)
    return fuzzy_lines.kept_lines(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    prepared(spark)
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    prepared(spark)
    rows = packing.packed(docs, public_tokenizers.path(queries.WORD_VOCABULARY))
    return rows.select(
        "doc_id", "piece", "start", "length", queries.crc32_of(F.col("ids"), F.col("width")).alias("ids_crc32"),
        "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules_stage),
    ("line_dedup", lines_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
