"""Stored evidence: detect a corpus once, decide it under new policies later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import DETECTOR_VERSION


def write_evidence(found: DataFrame, path: str) -> None:
    """Add the rows of `evidence()` under the current detector version."""
    (
        found.withColumn("detector_version", F.lit(DETECTOR_VERSION))
        .write.mode("append")
        .partitionBy("detector_version")
        .parquet(path)
    )


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence of the current detectors only; older rows are to be detected anew."""
    stored = spark.read.parquet(path)
    return stored.where(F.col("detector_version") == DETECTOR_VERSION).drop("detector_version")
