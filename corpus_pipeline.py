"""A corpus from raw documents to token ids: quality, exact copies, near copies, benchmark passages, BPE.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes what a stage returns as parquet in the
shared folder and gives the table as read again to the next one. All stages but the last return the columns of
``documents`` and only drop rows; the last returns doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows that stay.

Defined cases: null text counts as empty: judged, one of all empty texts stays, and it has no tokens; a null id is
smaller than any id among exact copies and takes no part in near copies; rows that share an id are judged by their own
texts by every stage but near dedup, for which they are one document; an empty table gives an empty result; further
columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskframe.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from maskframe.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(spark, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(spark, docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spark, docs, bpe.default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("bpe", bpe_stage),
]

#: A fitted classifier, signatures and a factorisation are beyond SQL; tests hold every stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
