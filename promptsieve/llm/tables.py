"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.scratch import scratch


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result and read it back: computed once, lineage cut, and still
    there when executors are lost.

    Hashes do not compress, and a compressor per column of very many small files takes a
    lot of memory outside the heap; so only tables with texts are compressed.
    """
    texts = any(isinstance(f.dataType, (T.StringType, T.BinaryType)) for f in df.schema)
    path = scratch(df.sparkSession, purpose)
    df.write.option("compression", "zstd" if texts else "uncompressed").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
