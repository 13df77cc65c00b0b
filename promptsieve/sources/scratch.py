"""Where intermediate tables go: a folder every executor can reach."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .files import delete


@lru_cache(maxsize=1)
def _local_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="promptsieve-")  # goes when Python ends


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path below `spark.checkpoint.dir`, or else below the session's checkpoint
    folder.  Only local mode falls back on a temporary folder: on a cluster every executor
    would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder().name
    own = f"{root.rstrip('/')}/promptsieve/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_leave, spark, own)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


_OWN: set[str] = set()


def _leave(spark: SparkSession, folder: str) -> None:
    """Delete what the application has left, when its driver ends in good order."""
    try:
        delete(spark, folder)
    except Exception:  # the session has been stopped: the folder's own expiry must do
        logging.getLogger(__name__).info("left %s behind", folder)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.  Frames that are still to be
    computed from them can no longer be."""
    for own in list(_OWN):
        if own.endswith(f"/{spark.sparkContext.applicationId}"):
            delete(spark, own)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result and read it back: computed once, lineage cut, and
    still there when executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
