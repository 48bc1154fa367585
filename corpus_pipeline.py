"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, byte-level BPE.

Each stage takes the rows that the stage before kept, drops what it rejects and returns the columns of ``documents``; the
last one returns a row of token counts and digests for each document left. Between stages the rows are written as Parquet
in the shared folder and read again.

Defined results: documents with null texts count as empty and pass; of documents without words one of each text stays;
very long texts are judged whole; rows of null id are kept and never have a label; exactly repeated rows leave one row at the
near duplicate stage, and of rows with equal ids and different texts each is judged by its own text; further columns, also
of names that the stages use themselves or that differ in case only, go through unchanged; an empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import byte_bpe, decontaminate, neardup, toxicity
from tidewatch.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The rows of run() depend on a learned classifier and on near-duplicate classes, which SQL cannot express.
ORACLE_SQL = None
