"""Windowed decision counts that know which input they cover.

What a file of the stream contributes is stored under that file.  Read again, by a retried
batch or under a new checkpoint, it replaces what it had contributed instead of adding to
it.  Rows too late for their window are counted on the side, so counted and late rows
always add up to the input.  Contributions are sums, so no state is kept but the horizon.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import exists, read_text, write_text
from .screening import stream_id

_KEY = ("window_start", "policy_id", "decision", "late")
_DDL = "source string, window_start timestamp, policy_id string, decision string, late boolean, n long, seq long"


def with_source(stream: DataFrame) -> DataFrame:
    """Add `source`, the file a row is from, and `modified`, when it was written; to be
    called on what the reader returns."""
    return stream.select("*", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_modification_time").alias("modified"))


def _horizons(batch: DataFrame, position: str, seen: dict | None) -> DataFrame:
    """(position, horizon): the newest instant, in microseconds, at smaller positions.

    `seen` is what earlier batches had: their largest position, the newest instant there,
    and the newest before it.
    """
    kind = batch.schema[position].dataType
    newest = batch.groupBy(F.col(position).cast("string").cast(kind).alias("position")).agg(
        F.max(F.unix_micros("ts")).alias("newest")
    )
    if seen is not None:
        rows = [(None, seen["before"]), (seen["position"], seen["own"])]
        earlier = batch.sparkSession.createDataFrame(rows, "position string, newest long")
        newest = newest.unionByName(earlier.withColumn("position", F.col("position").cast(kind)))
    newest = newest.groupBy("position").agg(F.max("newest").alias("newest"))
    # one row per delivery of a micro-batch
    earlier = W.orderBy(F.col("position").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    return newest.withColumn("horizon", F.max("newest").over(earlier))


def window_counts(
    batch: DataFrame, horizons: DataFrame, position: str, window: int, lateness: int
) -> DataFrame:
    """Decisions per source, window and policy; `late` where the window was over, and
    `lateness` seconds had passed, at the horizon of the row's position."""
    start = F.floor(F.unix_seconds("ts") / window) * window
    late = (start + window + lateness) * 1_000_000 <= F.col("horizon")
    known = horizons.select("position", "horizon")
    return (
        batch.join(known, batch[position].eqNullSafe(known["position"]), "left")
        .select(
            "source", F.timestamp_seconds(start).alias("window_start"), "policy_id", "decision",
            F.coalesce(late, F.lit(False)).alias("late"),
        )
        .groupBy("source", *_KEY)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_decisions(
    verdicts: DataFrame,
    path: str,
    checkpoint: str,
    position: str = "modified",
    window: int = 3_600,
    lateness: int = 600,
    **trigger,
):
    """Start counting a stream of verdicts with ts, policy_id, decision and `source`.

    `position` orders what arrives: by default files by their time, or a column of the
    input, such as the number of a delivery.  A row is late by what stood at smaller
    positions, so the counts do not depend on how the input is cut into micro-batches.
    """
    path = path.rstrip("/")

    def process(batch: DataFrame, batch_id: int) -> None:
        spark, stream = batch.sparkSession, stream_id(batch)
        marks = f"{path}/_seen/{stream}"
        before = read_text(spark, f"{marks}/{batch_id - 1}")
        seen = json.loads(before) if before else None
        # screened once; prompts and what else a verdict holds are not kept
        kept = dict.fromkeys(("source", "ts", "policy_id", "decision", position))
        batch = batch.select(*kept).persist()
        try:
            horizons = _horizons(batch, position, seen)
            counts = window_counts(batch, horizons, position, window, lateness)
            # the batch id alone orders the writes of one stream, the clock those of several
            clock = F.unix_micros(F.current_timestamp())
            counts.withColumn("seq", clock).write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={batch_id}")
            last = horizons.orderBy(F.col("position").desc_nulls_last()).select(
                F.col("position").cast("string").alias("position"), "newest", "horizon"
            ).first()
        finally:
            batch.unpersist()
        if last is not None:
            seen = {"position": last["position"], "own": last["newest"], "before": last["horizon"]}
        write_text(spark, f"{marks}/{batch_id}", json.dumps(seen) if seen else "")

    return (
        verdicts.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_window_counts(spark: SparkSession, path: str) -> DataFrame:
    """window_start, policy_id, decision, late, n: each source as it was last read."""
    if not exists(spark, path):
        return spark.createDataFrame([], _DDL).select(*_KEY, "n")
    stored = spark.read.schema(_DDL + ", stream string, batch long").parquet(path)
    write = F.struct("seq", "stream", "batch")
    last = stored.groupBy("source").agg(F.max(write).alias("last"))
    return (
        stored.join(last, "source")
        .where(write == F.col("last"))
        .groupBy(*_KEY)
        .agg(F.sum("n").alias("n"))
    )
