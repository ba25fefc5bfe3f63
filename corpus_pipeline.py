"""Documents to packed sequences: the stages in order, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenframe.llm.mixing import mix
from lumenframe.llm.near_text import one_of_each
from lumenframe.llm.packing import pack
from lumenframe.llm.quality import fit, scorer
from lumenframe.llm.queries import LEVELS, WEIGHTS

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more: a null text counts as empty, labels without a document teach nothing, extra columns stay, an empty table gives no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(scorer(docs, fit(docs, labels))("text") >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: shingles of five words, similarity 0.8. Rows without words stay, repeated rows leave one, columns may have any name."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights of domains, languages and sources, each used once at most. Null levels are leaves of their own, rows equal in id and text are taken together."""
    return mix(docs, LEVELS, WEIGHTS, budget=0.9).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, with a checksum of the ids. A null text is empty, a null id stays, long texts are cut whole into pieces, other columns are left out."""
    pieces = pack(docs, BYTE_BPE)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
