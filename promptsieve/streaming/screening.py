"""Streaming screening: the batch expressions over a stream of prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.injection import Scorer
from ..plans.screening import audit_rows, screen
from ..sources.audit_store import FAN, compact, vacuum, write_audit
from ..sources.policies import Policy


def read_stream(
    spark: SparkSession, path: str, ddl: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of parquet files below `path`; a glob also matches a single file."""
    reader = spark.readStream.schema(ddl)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def screen_stream(
    prompts: DataFrame,
    policies: Sequence[Policy] | None = None,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Stateless: the same plan as `screen`, row by row."""
    return screen(prompts, policies, scorer)


def stream_id(batch: DataFrame) -> str:
    """Inside `foreachBatch`, the id of the query: kept in its checkpoint, so it survives
    restarts, and new for a new checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def audit_sink(verdicts: DataFrame, path: str, checkpoint: str, **trigger):
    """Write verdicts to the audit table; a replayed micro-batch replaces itself, and
    streams with checkpoints of their own never touch each other's rows.  Small segments
    are merged every FAN micro-batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch)
        write_audit(audit_rows(batch), path, stream, batch_id)
        if batch_id % FAN == FAN - 1:
            compact(batch.sparkSession, path, stream)
            vacuum(batch.sparkSession, path)

    return (
        verdicts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def file_sink(rows: DataFrame, path: str, checkpoint: str, **trigger):
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def decision_counts_stream(
    verdicts: DataFrame, window: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Decisions per tumbling event-time window and policy.  Rows later than the
    watermark are dropped; state is one small row per open window and group.  In update
    mode every window comes out, also those still open when the input ends."""
    return (
        verdicts.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window), "policy_id", "decision")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "policy_id", "decision", "n")
    )


_WINDOW = ("window_start", "policy_id", "decision")


def counts_sink(counts: DataFrame, path: str, checkpoint: str, **trigger):
    """Each micro-batch writes the counts that changed; `read_counts` takes the last ones."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(
            f"{path.rstrip('/')}/stream={stream_id(batch)}/batch={batch_id}"
        )

    return (
        counts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every window; streams on one path count different rows."""
    stored = spark.read.schema(
        "window_start timestamp, policy_id string, decision string, n long, stream string, batch long"
    ).parquet(path)
    last = stored.groupBy(*_WINDOW, "stream").agg(F.max_by("n", "batch").alias("n"))
    return last.groupBy(*_WINDOW).agg(F.sum("n").alias("n"))
