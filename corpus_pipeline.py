"""A corpus pipeline over the documents table: quality, exact and near duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns them with the
columns of documents; the last returns the packed pieces. run() writes each stage's rows as Parquet into the shared
folder and reads them back, so no stage recomputes another and a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from latticeframe.llm.queries import table, tokenizer
from latticeframe.llm.shared import stored, without


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.resample(docs, table(spark, sf_dir, "labels"))
    return without(docs, judged.where(~F.col("selected")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grouped = jaccard_join.jaccard_components(docs, width=5, num=3, den=4)
    return without(docs, grouped.where(F.col("doc_id") != F.col("component_id")))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), max_len=4096, end_id=1)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_content),
    ("benchmark decontamination", clean_of_benchmark),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


ORACLE_SQL = None
