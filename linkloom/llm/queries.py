"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitplane_ids, circulant_minhash, compact_windows, cutting_stock, entropy_mix, extendible_dedup, host_suffix, langid_unigram, quality_crf, warc_zstd


#: Units that a worker keeps in the encoding queries, where nothing else takes its memory.
UNITS = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_crf.quality_lines(docs, quality_crf.train(docs, _table(spark, sf_dir, "labels")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.warc_round_trip(_table(spark, sf_dir, "pages"), least=0)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_suffix.extract(_table(spark, sf_dir, "pages"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.entropy_mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(_table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_dedup(_table(spark, sf_dir, "documents"), shingle=4, threshold=80)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock.pack(_table(spark, sf_dir, "documents"), capacity=2048, end_id=1, cached=UNITS)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_unigram.identify(_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane_ids.ids_round_trip(_table(spark, sf_dir, "documents"), end_id=2, bits=False, cached=UNITS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_crf": op1,
    "op2_warc_zstd": op2,
    "op3_extendible_dedup": op3,
    "op4_host_suffix": op4,
    "op5_entropy_mix": op5,
    "op6_compact_windows": op6,
    "op7_circulant_minhash": op7,
    "op8_cutting_stock": op8,
    "op9_langid_unigram": op9,
    "op10_bitplane_ids": op10,
}
ORACLES: dict[str, str] = {"op3_extendible_dedup": extendible_dedup.ORACLE}
