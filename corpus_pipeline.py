"""From raw documents to packed training sequences, in stages; each stage is one operator of ``imputeflow.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imputeflow.llm.jaccard import keep_one
from imputeflow.llm.packing import pack
from imputeflow.llm.quality import keep_good
from imputeflow.llm.recompress import remove_repeats
from imputeflow.llm.shared import write_table
from imputeflow.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the forest keep."""
    ship_package(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship_package(spark)
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated passages; n_chars follows the text."""
    ship_package(spark)
    return remove_repeats(docs, counts=False).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of 2048 tokens."""
    ship_package(spark)
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", jaccard_join),
          ("substring dedup", substring_dedup), ("best-fit packing", best_fit_packing)]

ORACLE_SQL = None  # a forest and token ids can't be had in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
