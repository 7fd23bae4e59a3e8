"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's docs. A lost executor costs at most the
stage it was lost in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bulletria.llm.common import shared_dir
from bulletria.llm.language_id import keep_identified
from bulletria.llm.mixing import mix_sources
from bulletria.llm.near_dedup import deduplicate
from bulletria.llm.packing import pack
from bulletria.llm.suffix_dedup import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return deduplicate(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each passage of 50 words or more once."""
    return remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of characters from all sources; a document may come several times.

    Copies of a row are alike, so nothing later needs their numbers.
    """
    return mix_sources(docs).drop("copy_no")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the text of each bin, and the documents it is made of."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hyperdimensional cosines, components of a similarity graph and best fit can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
