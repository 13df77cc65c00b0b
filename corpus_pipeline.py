"""A corpus pipeline: judge, clean, deduplicate, decontaminate and mix `documents`.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns the documents it
keeps with their columns; the last returns the mix.  `run` writes every stage as Parquet
and reads it again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve.llm import decontaminate, line_dedup, minmax_dedup, mixing, quality
from promptsieve.llm.tables import materialize

#: Documents scored below this are rejected.
LEAST_QUALITY = 0.5


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, trained on the labelled documents; what it rejects goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", F.col("quality").alias("label")
    )
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines found in ten documents or more go from all of them."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles; one document of each group stays."""
    return minmax_dedup.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights: the documents the mix takes words of, with the whole
    passes and the spans of words it takes."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", judge_quality),
    ("line dedup", drop_shared_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

#: The classifier and the signatures are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
