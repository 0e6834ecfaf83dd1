"""The corpus pipeline: reject toxic documents, keep one of each near-duplicate group, redact secrets, mix sources, pack.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs; all but the last return the columns of documents. No row is
lost but by a stage's own decision, and every stage works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postline.llm import ledger, mixing, packing, simhash, toxicity
from postline.llm.common import cut, free_name, read


def _sized(docs: DataFrame, before: list[str]) -> DataFrame:
    """docs with n_chars made to fit a text that may have changed; the columns and their order stay."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in before])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, as they are.

    A null or empty text has the score of a text without features and ids may be null or repeated: each row is
    judged by its own text. Without a usable label nothing is toxic. An empty table stays empty.
    """
    scorer = toxicity.train(docs, read(spark, sf_dir, "labels"))
    score = free_name(docs, "__toxicity")
    return toxicity.with_score(docs, scorer, out=score).where(F.col(score) < 0.5).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (4-word shingles, 4 bits), as it is: the one of smallest id.

    Texts without a word form a group like any other; of rows with one id one stays; a
    row with a null id stays only where its group has no other. An empty table stays empty.
    """
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, the secrets in its text replaced and n_chars made to fit.

    Null and empty texts stay as they are; repeated rows stay repeated. An empty table stays empty.
    """
    return _sized(ledger.redact(docs), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, shard by shard; a copy taken in part has its first words, n_chars made to fit.

    A null source is a source, a null text has no words; without any word the mix is empty, and so
    it is for an empty table.
    """
    return _sized(mixing.mix(docs, shard_col=None), docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document's tokens and its place in a sequence.

    A null text is an empty one, of the end token alone; repeated rows are documents of their own. An empty table has no pieces.
    """
    return packing.packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", one_of_each_group),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: No stage can be stated in SQL as a whole; tests/llm/test_pipeline.py compares run() with a plain pass through the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
