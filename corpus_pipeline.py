"""The corpus pipeline: language ID, near-duplicates, pseudonyms, packing.

Each stage takes all rows that the one before kept and is written as Parquet before the next reads
it; all but the last return the columns of documents.

Edge cases: a null text, or one without letters, goes in the first stage; rows without a doc_id
stay as they are and are packed under a null; rows repeated under one doc_id count once, while
different texts under one doc_id are different documents; texts of any length are taken whole; an
empty table gives no pieces; further columns are handed on, whatever their names.

Run as an application, the stages bound the batches of the session that they are given, unless
it has settings of its own (gazelark.llm.tables.WHOLE_TEXTS).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gazelark.llm import language, near_duplicates, packing, personal
from gazelark.llm.tables import bound_batches, own_session
from gazelark.shared import remove_folder, shared_folder
from gazelark.ship import ship


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    bound_batches(spark, dict(spark.conf.getAll))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that was learned, go."""
    _prepare(spark)
    return language.stage(spark, docs, sf_dir)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays."""
    _prepare(spark)
    return near_duplicates.stage(spark, docs, sf_dir)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers, dates and addresses are replaced in the texts."""
    _prepare(spark)
    return personal.stage(spark, docs, sf_dir)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens along the curve."""
    _prepare(spark)
    return packing.stage(spark, docs, sf_dir)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("pseudonyms", pseudonymise),
    ("packing", pack),
]

#: SQL can't express string kernels, MinHash or tokenisation; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    spark = own_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")  # what the next stage wrote stands for it
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
