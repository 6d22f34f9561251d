"""Corpus preparation in five stages, each one operator over all that the stage before kept.

quality rules, exact dedup, near dedup, mixing and packing. Stages return the columns of documents, but for the last, which
returns packed pieces. Mixing repeats a document's row once per copy; packing then treats each row as a document.

A stage decides on whole rows and never joins a verdict back by doc_id. So in every stage rows that share an id but not a
text are documents of their own, and a null id is an id like any other. Null and empty texts fail the quality rules; later
stages alone treat them as equal (exact dedup), without words (near dedup), of size 0 and so not taken (mixing), and as the
end id alone (packing). Rows equal in all columns are judged alike (quality), one text (exact and near dedup) or documents of
their own (mixing, packing). Empty tables pass as empty tables; columns other than those of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import circulant_minhash, cutting_stock, entropy_mix, extendible_dedup, quality_crf
from linkloom.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the line CRF keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_crf.kept_rows(docs, COLUMNS, quality_crf.train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest id."""
    return extendible_dedup.survivors(docs, COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, that of the smallest id; rows without words stay."""
    return circulant_minhash.survivors(docs, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; rows of no copies go."""
    return entropy_mix.mixed_rows(docs, COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return cutting_stock.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", packing),
]
#: Line labelling, MinHash and tokenization have no SQL form; tests/llm/test_pipeline.py holds run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
