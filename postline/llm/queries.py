"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postline.llm import embeddings, ledger, line_dedup, mixing, oracle, packing, quality, sharding, simhash, simplex, token_counts, toxicity, warc, whitening
from postline.llm.common import read


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures_of_pages(read(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding(read(spark, sf_dir, "documents"), shards=8)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packing(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.secrets(read(spark, sf_dir, "documents"))


def op11_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.clusters(read(spark, sf_dir, "embeddings"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"), keep="none", min_docs=10, min_chars=1)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_embeddings": op3_embeddings,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
    "op11_simplex": op11_simplex,
    "op12_lines": op12_lines,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = dict(oracle.QUERIES)
