"""A corpus pipeline of five stages, each an operator of ``codeframe.llm`` over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeframe.llm import byte_bpe, mixing, quality_pu, simhash, suffix_dedup
from codeframe.llm._common import drop_written, table, write_shared, written
from codeframe.session import share_code

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier predicts to be good."""
    share_code(spark)
    return quality_pu.keep_good(docs, quality_pu.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    share_code(spark)
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that start elsewhere too."""
    share_code(spark)
    return suffix_dedup.remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the temperature mix draws them: a row may come twice, or not at all."""
    share_code(spark)
    return mixing.drawn_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn row, with the digest of what they decode to."""
    share_code(spark)
    return byte_bpe.token_rows(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeats),
    ("source_mixing", mixture),
    ("byte_bpe", tokens),
]

#: SQL has neither a trained classifier nor these hashes; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written in the shared folder and read again.

    What a stage has written on its way goes once its rows are there, and its rows go once the
    next one's are.
    """
    docs, own = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = written()
        docs = write_shared(stage(spark, docs, sf_dir), name)
        after = written()
        drop_written(spark, before, after - 1)
        if own is not None:
            drop_written(spark, own, own + 1)
        own = after - 1
    return STAGES[-1][1](spark, docs, sf_dir)
