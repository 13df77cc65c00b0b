"""Rate counters shared by several streams, stored as what each stream has counted itself.

A stream writes one small segment per micro-batch: the counters its requests touched, and by
how much.  What a counter stands at is the sum over the segments of all streams, so nothing
is counted twice however many streams follow each other, and a batch writes nothing for
counters it has not touched.  Old segments of a stream are folded, level by level, so their
number grows with the logarithm of the batches; what has expired meanwhile is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ratelimit import COUNTER, RateLimits, counters
from ..sources.files import delete, folders, read_text, write_text

_DDL = "tier int, counter string, bucket bigint, used bigint, expires_at bigint"


@dataclass(frozen=True, order=True)
class Segment:
    """Batches `first` to `last` of a stream."""

    stream: str
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"stream={self.stream}/segment={self.first}-{self.last}"


@dataclass(frozen=True)
class Counts:
    """What a batch starts from: counters, and the newest second its stream has seen."""

    used: DataFrame | None
    horizon: int | None


class CounterStore:
    """The counters of all streams on a folder, as one of these streams sees them.

    `fold` segments of one level become one of the next.  Folded segments are deleted
    `grace` batches later, as other streams may still be reading them.  A stream that is
    asked for the same batch again starts from the segments it used the first time, and
    writes over its own.  Windows are over for a stream once it has itself gone past them;
    a stream with a new checkpoint starts with none over.
    """

    def __init__(self, spark: SparkSession, folder: str, stream: str, fold: int = 16, grace: int = 16):
        self.spark, self.folder, self.stream = spark, folder.rstrip("/"), stream
        self.fold, self.grace = fold, grace

    def _path(self, segment: Segment) -> str:
        return f"{self.folder}/{segment.name}"

    def _newest(self, segment: Segment) -> str | None:
        """The newest second up to a segment, written last: None if it is incomplete."""
        return read_text(self.spark, f"{self._path(segment)}/newest")

    def _all(self, stream: str) -> list[Segment]:
        names = folders(self.spark, f"{self.folder}/stream={stream}", "segment=")
        return sorted(Segment(stream, *map(int, name.split("-"))) for name in names)

    def segments(self, stream: str, before: int | None = None) -> list[Segment]:
        """Complete segments that together cover each batch of a stream once, the widest
        first; only batches smaller than `before`, if given."""
        found: list[Segment] = []
        covered = -1
        for s in sorted(self._all(stream), key=lambda s: (s.first, -s.last)):
            if s.first > covered and (before is None or s.last < before) and self._newest(s) is not None:
                found.append(s)
                covered = s.last
        return found

    def _planned(self, batch_id: int) -> list[Segment]:
        """The segments a batch starts from, the same if it is tried again."""
        plan = f"{self.folder}/stream={self.stream}/plan={batch_id}"
        stored = read_text(self.spark, plan)
        if stored is not None:
            rows = [line.split(" ") for line in stored.split("\n") if line]
            found = [Segment(s, int(a), int(b)) for s, a, b in rows]
            if all(self._newest(s) is not None for s in found):
                return found
        found = self.segments(self.stream, batch_id)
        for other in folders(self.spark, self.folder, "stream="):
            if other != self.stream:
                found += self.segments(other)
        write_text(self.spark, plan, "\n".join(f"{s.stream} {s.first} {s.last}" for s in found))
        return found

    def read(self, segments: list[Segment]) -> DataFrame:
        """Counters summed over segments."""
        parts = self.spark.read.schema(_DDL).parquet(*[f"{self._path(s)}/counters" for s in segments])
        return parts.groupBy(*COUNTER, "expires_at").agg(F.sum("used").alias("used"))

    def before(self, batch_id: int) -> Counts:
        """What batch `batch_id` of this stream starts from."""
        found = self._planned(batch_id)
        own = [self._newest(s) for s in found if s.stream == self.stream]
        horizon = max((int(v) for v in own if v), default=None)
        if not found:
            return Counts(None, horizon)
        used = self.read(found)
        if horizon is not None:
            used = used.where(F.col("expires_at") > horizon)
        return Counts(used.select(*COUNTER, "used"), horizon)

    def _write(self, segment: Segment, rows: DataFrame, newest: int | None) -> None:
        path = self._path(segment)
        delete(self.spark, f"{path}/newest")  # incomplete until the end
        rows.select("tier", "counter", "bucket", "used", "expires_at").write.mode("overwrite").parquet(f"{path}/counters")
        write_text(self.spark, f"{path}/newest", "" if newest is None else str(newest))

    def add(
        self,
        batch_id: int,
        batch: DataFrame,
        limits: RateLimits,
        horizon: int | None,
        minutes: DataFrame | None = None,
        newest: int | None = None,
    ) -> None:
        """Store what a batch of requests (ts, client_id, ip) adds; `minutes` are its counts by
        minute and `newest` its last second, if they are at hand."""
        if newest is None:
            newest = batch.agg(F.max(F.unix_seconds("ts")).alias("s")).first()["s"]
        ends = [v for v in (newest, horizon) if v is not None]
        rows = counters(batch, limits, horizon, minutes)
        self._write(Segment(self.stream, batch_id, batch_id), rows, max(ends, default=None))
        delete(self.spark, f"{self.folder}/stream={self.stream}/plan={batch_id - 1}")
        self._compact(batch_id)

    def _compact(self, batch_id: int) -> None:
        """Delete what was folded long ago; fold each level that is full."""
        have = self._all(self.stream)
        for s in have:
            over = [w for w in have if w.first <= s.first and s.last <= w.last and w != s]
            if any(w.last < batch_id - self.grace and self._newest(w) is not None for w in over):
                delete(self.spark, self._path(s))
        while True:
            top = self.segments(self.stream, batch_id + 1)
            full = self._full(top)
            if not full:
                return
            newest = max((int(v) for s in full if (v := self._newest(s))), default=None)
            rows = self.read(full)
            if newest is not None:
                rows = rows.where(F.col("expires_at") > newest)
            self._write(Segment(self.stream, full[0].first, full[-1].last), rows, newest)

    def _level(self, segment: Segment) -> int:
        level, width = 0, segment.last - segment.first + 1
        while width >= self.fold:
            level, width = level + 1, width // self.fold
        return level

    def _full(self, top: list[Segment]) -> list[Segment]:
        """The last `fold` segments, if all are of one level."""
        last = top[-self.fold :]
        return last if len(last) == self.fold and len({self._level(s) for s in last}) == 1 else []
