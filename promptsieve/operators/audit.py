"""Lookups over audit records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.scratch import materialize
from .skew import hot_keys, lookup_join

DEFAULT_FEED = 50
MAX_FEED = 200


def feed_limit(limit: int | None = None) -> int:
    return min(max(1, DEFAULT_FEED if limit is None else limit), MAX_FEED)


def recent(audit: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest records: each task keeps its own top `limit`, one merges them."""
    return audit.orderBy(F.col("ts").desc(), F.col("request_id").desc()).limit(feed_limit(limit))


def feed(audit: DataFrame, limit: int | None = None) -> DataFrame:
    return recent(
        audit.select("request_id", "prompt", "policy_id", "decision", "ts"), limit
    )


def by_id(audit: DataFrame, request_id: str) -> DataFrame:
    return audit.where(F.col("request_id") == request_id)


def replays_of(audit: DataFrame, request_id: str) -> DataFrame:
    return audit.where(F.col("replay_of") == request_id).orderBy(
        F.col("ts").desc(), F.col("request_id").desc()
    )


def unknown_ids(requests: DataFrame, audit: DataFrame) -> DataFrame:
    """Requests for records that do not exist, with the problem they produce."""
    return requests.join(audit.select("request_id"), "request_id", "left_anti").withColumn(
        "detail",
        F.concat(F.lit("Audit record not found: '"), F.col("request_id"), F.lit("'")),
    )


def resolved(audit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The ids and `columns` of all records, written out: whatever reads them more than once
    decides once which write of a record is the last.  For narrow columns."""
    ids = [c for c in ("request_id", "replay_of") if c not in columns]
    return materialize(audit.select(*ids, *columns), "resolved")


def _hot_originals(audit: DataFrame):
    hot = hot_keys(audit, "replay_of")
    return F.col("replay_of").isin(hot) if hot else None


def replay_pairs(audit: DataFrame, columns: tuple[str, ...] = S.AUDIT_FIELDS) -> DataFrame:
    """(original, replay): each replay beside the record it replays."""
    originals = audit.select(
        F.col("request_id").alias("replay_of"), F.struct(*columns).alias("original")
    )
    replays = audit.where(F.col("replay_of").isNotNull()).select(
        "replay_of", "request_id", F.struct(*columns).alias("replay")
    )
    return lookup_join(
        replays,
        originals,
        ["replay_of"],
        hot=_hot_originals(audit),
        spread=["request_id"],
        how="inner",
    ).select("original", "replay")


def with_replays(audit: DataFrame, columns: tuple[str, ...] = S.AUDIT_FIELDS) -> DataFrame:
    """Every record with each of its replays, one row per replay; a record without
    replays keeps one row, its `replay` NULL.

    Rows, not a nested list: a record may have any number of replays.
    """
    record = audit.select("request_id", F.struct(*columns).alias("record"))
    replayed = audit.where(F.col("replay_of").isNotNull()).select(
        F.col("replay_of").alias("request_id")
    ).distinct()
    alone = record.join(replayed, "request_id", "left_anti").select(
        "record", F.lit(None).cast(record.schema["record"].dataType).alias("replay")
    )
    return replay_pairs(audit, columns).select(
        F.col("original").alias("record"), "replay"
    ).unionByName(alone)
