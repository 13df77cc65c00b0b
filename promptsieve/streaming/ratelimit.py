"""Streaming rate limiters whose counters expire with their window.

Two of them.  `rate_limit_stream` keeps all counters in a table that several streams share;
each micro-batch is limited by the distributed batch operator.  `rate_limit_keyed_stream`
keeps the counters of users and addresses as keyed state with event-time timers, which one
stream owns; only the global counter, a single key that keyed state would send through one
task, stays in the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ratelimit import (
    DAY,
    GLOBAL_TIER,
    HOUR,
    RateLimits,
    bucket_of,
    rate_limit,
    scope_of,
    stored_minutes,
    tier_denials,
    window_reset,
)
from ..sources.files import delete
from ..sources.scratch import scratch
from .counters import CounterStore
from .screening import stream_id

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limited_batch(
    batch: DataFrame,
    limits: RateLimits,
    used: DataFrame | None,
    horizon: int | None,
    minutes: DataFrame | None = None,
) -> DataFrame:
    """The batch with allowed, scope, retry_after_seconds and `late`.

    A window that was over before the batch neither counts nor denies (fail open);
    `late` marks requests that belong to one.
    """
    out = rate_limit(batch, limits, used, horizon, minutes)
    if horizon is None:
        return out.withColumn("late", F.lit(False))
    second = F.unix_seconds("ts")
    over = [
        window_reset(bucket_of(second, F.lit(w)), F.lit(w)) <= horizon for w in (HOUR, DAY)
    ]
    return out.withColumn("late", over[0] | over[1])


def _results(out: str, stream: str, batch_id: int) -> str:
    return f"{out.rstrip('/')}/stream={stream}/batch={batch_id}"


def rate_limit_stream(
    requests: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    limits: RateLimits = RateLimits(),
    **trigger,
):
    """Start the limiter over a stream of (request_id, ts, client_id, ip).

    Order within a micro-batch is (ts, request_id).  Results land in `out`, one folder
    per stream and micro-batch.  Streams with one `state` folder share their counters.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch)
        store = CounterStore(batch.sparkSession, state, stream)
        counts = store.before(batch_id)
        batch = batch.persist()  # read by several passes; recomputed from the source if lost
        try:
            minutes = stored_minutes(batch, limits, counts.horizon)
            limited_batch(batch, limits, counts.used, counts.horizon, minutes).write.mode(
                "overwrite"
            ).parquet(_results(out, stream, batch_id))
            store.add(batch_id, batch, limits, counts.horizon, minutes)
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# --- keyed state --------------------------------------------------------------------------

USER, ADDRESS = 0, 1
#: Slots that the identities of a day are dealt to by their hash; fixed for a checkpoint.  A slot
#: and day costs some 20 ms a batch besides its rows.
SLOTS = 16
_COUNTED = (
    "request_id string, ts timestamp, client_id string, ip string, kind int, tier int, "
    "late boolean, retry_after_seconds bigint"
)
_HOURS = DAY // HOUR
_NO_DAY = -(1 << 40)  # a null would turn its whole column into floats on the way


class DayCounter(StatefulProcessor):
    """What the users or addresses of one slot have asked for on one day: per identity the
    day's count and those of its hours.  A timer drops them when the day is over.

    A slot is worked off as arrays: a call of Python, a read and a write of state serve all
    its identities.  Within a batch the first requests of an identity by (ts, request_id)
    that a limit leaves room for are allowed.  Rows that can no longer be among them are told
    at once, so very many requests of one identity need memory for about `most` rows.
    """

    def __init__(self, limits: RateLimits, most: int = 10_000):
        self.most = most
        self.limits = {
            USER: (limits.user_per_hour, limits.user_per_day),
            ADDRESS: (limits.ip_per_hour, limits.ip_per_day),
        }

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "used binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, _, day = key
        if day == _NO_DAY:  # no instant, so no window: allowed, as in the batch operator
            for part in rows:
                if kind == USER:
                    yield part[["request_id", "ts", "client_id", "ip"]].assign(
                        kind=np.int32(kind), tier=pd.array([pd.NA] * len(part), dtype="Int32"),
                        late=False, retry_after_seconds=1,
                    )
            return
        newest = timerValues.getCurrentWatermarkInMs() // 1000
        resets = np.append(day * DAY + HOUR * np.arange(1, _HOURS + 1), (day + 1) * DAY)
        over = resets <= newest
        known = self.used.get() if not over[-1] else None
        places, used = _unpacked(known[0]) if known else ({}, np.zeros((0, _HOURS + 1), np.int64))
        limits = np.append(np.full(_HOURS, self.limits[kind][0]), self.limits[kind][1])
        held, seen, most = None, np.zeros_like(used), self.most
        for part in rows:
            codes, names = pd.factorize(part["client_id" if kind == USER else "ip"], use_na_sentinel=False)
            own = np.array([places.setdefault(None if pd.isna(w) else w, len(places)) for w in names])[codes]
            hour = part["second"].to_numpy() % DAY // HOUR
            more = ((0, len(places) - len(used)), (0, 0))
            used, seen = np.pad(used, more), np.pad(seen, more)
            np.add.at(seen, (own, hour), 1)
            np.add.at(seen, (own, _HOURS), 1)
            part = part.assign(_own=own, _hour=hour)
            held = part if held is None else pd.concat([held, part])
            if len(held) > most:
                held, denied = self._ranked(held, self._free(used, limits, over))
                gone = (denied[0] | over[held["_hour"]]) & (denied[1] | over[-1])
                yield from self._told(kind, held[gone], denied[:, gone], over, resets)
                held = held[~gone]
                most = max(self.most, 2 * len(held))  # sorted again only once it has doubled
        if held is not None:
            held, denied = self._ranked(held, self._free(used, limits, over))
            yield from self._told(kind, held, denied, over, resets)
        if over[-1]:
            return
        if not known:
            self.handle.registerTimer(int(resets[-1]) * 1000)
        self.used.update((_packed(places, used + np.where(over, 0, seen)),))

    @staticmethod
    def _free(used: np.ndarray, limits: np.ndarray, over: np.ndarray) -> np.ndarray:
        return np.where(over, np.iinfo(np.int64).max, np.maximum(limits - used, 0))

    @staticmethod
    def _ranked(rows: pd.DataFrame, free: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        """Rows in order, and whether their hour and their day have no room for them."""
        if len(rows) > 1:
            rows = rows.sort_values(["ts", "request_id"], kind="stable")
        own, hour = rows["_own"].to_numpy(), rows["_hour"].to_numpy()
        in_hour, in_day = _places(own * _HOURS + hour), _places(own)
        return rows, np.stack([in_hour >= free[own, hour], in_day >= free[own, -1]])

    @staticmethod
    def _told(kind, rows: pd.DataFrame, denied, over, resets) -> Iterator[pd.DataFrame]:
        """Of users all rows, of addresses those denied; `tier` is the first that denies."""
        if kind == ADDRESS:
            some = denied.any(axis=0)
            rows, denied = rows[some], denied[:, some]
        if not len(rows):
            return
        second, hour = rows["second"].to_numpy(), rows["_hour"].to_numpy()
        reset = np.where(denied[0], resets[hour], resets[-1])
        tier = pd.array(np.where(denied[0], 2 * kind, 2 * kind + 1), dtype="Int32")
        tier[~denied.any(axis=0)] = pd.NA
        yield pd.DataFrame(
            {
                "request_id": rows["request_id"].to_numpy(), "ts": rows["ts"].array,
                "client_id": rows["client_id"].to_numpy(), "ip": rows["ip"].to_numpy(),
                "kind": np.int32(kind), "tier": tier, "late": over[hour] | over[-1],
                "retry_after_seconds": np.maximum(1, reset - second),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter([])

    def close(self) -> None:
        pass


def _places(group: np.ndarray) -> np.ndarray:
    """The place of each row among those of its group, from 0, in the order of the rows."""
    order = np.argsort(group, kind="stable")
    _, first, size = np.unique(group[order], return_index=True, return_counts=True)
    place = np.empty(len(group), np.int64)
    place[order] = np.arange(len(group)) - np.repeat(first, size)
    return place


def _packed(places: dict, used: np.ndarray) -> bytes:
    """The counts of a slot's identities that are not 0, in Arrow's stream format."""
    who, place = np.nonzero(used)
    names = pa.DictionaryArray.from_arrays(who.astype(np.int32), pa.array(list(places), pa.string()))
    batch = pa.record_batch({"who": names, "place": place.astype(np.int8), "n": used[who, place]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(stored: bytes) -> tuple[dict, np.ndarray]:
    batch = pa.ipc.open_stream(bytes(stored)).read_next_batch()
    who = batch.column("who")
    places = {name: i for i, name in enumerate(who.dictionary.to_pylist())}
    used = np.zeros((len(places), _HOURS + 1), np.int64)
    used[who.indices.to_numpy(), batch.column("place").to_numpy()] = batch.column("n").to_numpy()
    return places, used


def count_keyed(
    requests: DataFrame, limits: RateLimits = RateLimits(), slots: int = SLOTS
) -> DataFrame:
    """The user and address tiers of a stream of requests, by keyed state: one key per slot of
    identities and day, as a key costs Python a call and several messages.

    The watermark is the newest instant of earlier batches.  It is not a column of what the
    state sees, so requests older than it are not dropped: they count as long as their
    window is open, and come out as `late` after.
    """
    second = F.unix_seconds("ts")
    who = F.inline(
        F.array(
            F.struct(F.lit(USER).alias("kind"), F.col("client_id").alias("who")),
            F.struct(F.lit(ADDRESS).alias("kind"), F.col("ip").alias("who")),
        )
    )
    rows = (
        requests.select("request_id", "ts", "client_id", "ip")
        .withWatermark("ts", "0 seconds")
        .select(
            "request_id", F.unix_micros("ts").alias("at"), F.coalesce(second, F.lit(0)).alias("second"),
            "client_id", "ip", F.coalesce(bucket_of(second, F.lit(DAY)), F.lit(_NO_DAY)).alias("day"), who,
        )
        .withColumn("ts", F.timestamp_micros("at"))
        .withColumn("slot", F.pmod(F.xxhash64("who"), F.lit(slots)))
        .drop("at", "who")
    )
    return rows.groupBy("kind", "slot", "day").transformWithStateInPandas(
        DayCounter(limits), _COUNTED, "append", "EventTime"
    )


def _joined(
    counted: DataFrame,
    limits: RateLimits,
    used: DataFrame | None,
    horizon: int | None,
    minutes: DataFrame | None = None,
) -> DataFrame:
    """One row per request out of the keyed tiers and the global one."""
    requests = counted.where(F.col("kind") == USER)
    overall = replace(limits, enforced=(GLOBAL_TIER,))
    denied = (
        counted.where("tier is not null")
        .select("request_id", "tier", "retry_after_seconds")
        .unionByName(
            tier_denials(requests, overall, used, horizon, minutes).select(
                "request_id", "tier", "retry_after_seconds"
            )
        )
    )
    if not limits.enabled:
        denied = denied.limit(0)
    first = denied.groupBy("request_id").agg(F.min(F.struct("tier", "retry_after_seconds")).alias("first"))
    return requests.select("request_id", "ts", "client_id", "ip", "late").join(
        first, "request_id", "left"
    ).select(
        "request_id", "ts", "client_id", "ip",
        F.col("first").isNull().alias("allowed"),
        scope_of(F.col("first.tier")).alias("scope"), "first.retry_after_seconds", "late",
    )


def rate_limit_keyed_stream(
    requests: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    limits: RateLimits = RateLimits(),
    slots: int = SLOTS,
    partitions: int | None = None,
    **trigger,
):
    """The limiter of `rate_limit_stream` with its user and address counters as keyed state
    in the checkpoint; the global counter is in `state`, shared with other streams there.

    `slots` and `partitions` are fixed for a checkpoint.  A partition of the state costs a Python
    worker and a store of its own in each batch, however few rows it gets, so there are as many as
    cores unless `partitions` or `spark.sql.shuffle.partitions` says fewer.
    """
    spark = requests.sparkSession
    overall = replace(limits, enforced=(GLOBAL_TIER,))

    def process(counted: DataFrame, batch_id: int) -> None:
        # The state must be read once.  What follows runs in the caller's session, as that of a
        # stream plans each shuffle with all partitions, however few rows there are.
        stored = scratch(spark, "counted")
        try:
            counted.write.parquet(stored)
            counted = spark.read.schema(_COUNTED).parquet(stored)
            n, newest = counted.agg(F.count(F.lit(1)), F.max(F.unix_seconds("ts"))).first()
            if not n:  # a batch in which only timers ran
                return
            stream = stream_id(counted)
            store = CounterStore(spark, state, stream)
            counts = store.before(batch_id)
            own = counted.where(F.col("kind") == USER)
            minutes = stored_minutes(own, overall, counts.horizon)
            _joined(counted, limits, counts.used, counts.horizon, minutes).write.mode(
                "overwrite"
            ).parquet(_results(out, stream, batch_id))
            store.add(batch_id, own, overall, counts.horizon, minutes, newest)
        finally:
            delete(spark, stored)

    cores = partitions or spark.sparkContext.defaultParallelism
    fixed = {  # when a query starts; no other store has timers
        _STATE_STORE: _ROCKSDB,
        _PARTITIONS: str(min(cores, int(spark.conf.get(_PARTITIONS)))),
    }
    before = {key: spark.conf.get(key, None) for key in fixed}
    for key, value in fixed.items():
        spark.conf.set(key, value)
    try:
        return (
            count_keyed(requests, limits, slots)
            .writeStream.foreachBatch(process)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
