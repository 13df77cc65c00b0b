"""The audit table: append-only segments under a list of commits, last write wins.

A batch of records is written into a segment of its own, in folders by day, and becomes
visible by its commit: one small file with the segment's name and days, put in place whole.
Readers see committed segments only.  Compaction merges small segments of a day; its commit
names what it replaces, so a reader sees either the parts or the whole.  Files that no commit
shows are deleted later, when no reader can still be at them.

Which write of a request is the last is decided on ids and order alone.  The few writes that
are superseded are then known by their address (day, file and row), and the table is read
without them: records are never shuffled to find that out.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from .files import delete, folders, read_text, write_text
from .scratch import materialize

#: Segments of one level and day that are merged into one of the next.
FAN = 16
#: Superseded writes up to this number are broadcast, as one number each; more are joined by
#: shuffle.
MAX_BROADCAST = 1 << 20
#: Seconds after which replaced files are deleted.
GRACE = 3_600

#: Which of several writes of a request is the last.
_ORDER = ("write_seq", "ts", "writer", "batch")
_ADDRESS = ("day", "file_name", "row_index")
_DDL = S.AUDIT_DDL + ", write_seq long, writer string, batch long, segment string, day date"


@dataclass(frozen=True)
class Commit:
    """What one commit shows (`segment` on `days`) and hides (`replaces`: segment and day;
    `dead`: segments of earlier tries).  Its writes have sequences from `low` to `seq`."""

    writer: str
    segment: str
    days: list[str]
    low: int
    seq: int
    level: int = 0
    replaces: list[list[str]] = field(default_factory=list)
    dead: list[str] = field(default_factory=list)
    at: int = 0  # clock, in seconds


def _name(writer: str, batch: int | str) -> str:
    return f"{writer}~{batch}"


def _commit(spark: SparkSession, path: str, name: str, commit: Commit) -> None:
    write_text(spark, f"{path}/_commits/{name}", json.dumps(asdict(commit)))


def commits(spark: SparkSession, path: str) -> dict[str, Commit]:
    """All commits of a table, by name."""
    found = {}
    for name in folders(spark, f"{path}/_commits", ""):
        text = None if name.endswith(".part") else read_text(spark, f"{path}/_commits/{name}")
        if text is not None:
            found[name] = Commit(**json.loads(text))
    return found


def _visible(found: dict[str, Commit]) -> dict[tuple[str, str], Commit]:
    """(segment, day) that readers see, and the commit that shows it."""
    hidden = {(s, d) for c in found.values() for s, d in c.replaces}
    return {(c.segment, d): c for c in found.values() for d in c.days if (c.segment, d) not in hidden}


def _now_ms() -> int:
    return time.time_ns() // 1_000_000


def _store(rows: DataFrame, path: str, segment: str, gather: bool) -> list[str]:
    """Write a segment; its days."""
    if gather:
        rows = rows.hint("rebalance", "day")
    where = f"{path}/segment={segment}"
    (
        rows.write.mode("overwrite")
        # Lookups by id skip files that cannot hold it.
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.bloom.filter.enabled#request_id", "true")
        .option("parquet.bloom.filter.enabled#replay_of", "true")
        .partitionBy("day")
        .parquet(where)
    )
    return folders(rows.sparkSession, where, "day=")


def write_audit(
    records: DataFrame,
    path: str,
    writer: str,
    batch: int,
    write_seq: int | None = None,
    gather: bool = False,
) -> None:
    """Add one batch of audit records.

    A batch belongs to (`writer`, `batch`): writing it again replaces it, so a retried
    micro-batch leaves no second copy, and no writer touches what another has written.  Of
    several records of a request the one with the largest `write_seq` counts, by default
    the clock in milliseconds, whoever wrote it.  `gather` brings the rows of a day together
    first, for batches that touch many days; AQE splits a day too large for one task.
    """
    spark, path = records.sparkSession, path.rstrip("/")
    if write_seq is None:
        write_seq = _now_ms()
    out = records.select(
        *S.AUDIT_FIELDS,
        F.lit(write_seq).cast("long").alias("write_seq"),
        F.lit(writer).alias("writer"),
        F.lit(batch).cast("long").alias("batch"),
        F.to_date("ts").alias("day"),
    )
    name = _name(writer, batch)
    before = read_text(spark, f"{path}/_commits/{name}")
    dead = []
    if before is not None:
        earlier = json.loads(before)
        dead = [*earlier["dead"], earlier["segment"]]
    segment = f"{name}~{uuid.uuid4().hex[:12]}"
    days = _store(out, path, segment, gather)
    _commit(
        spark, path, name,
        Commit(writer, segment, days, write_seq, write_seq, dead=dead, at=_now_ms() // 1000),
    )


def compact(spark: SparkSession, path: str, writer: str, fan: int = FAN) -> int:
    """Merge the segments of `writer` on each day, `fan` or more of one level at a time; the
    number of merges.  A record is rewritten once a level, so a day keeps a number of
    segments that grows with the logarithm of its batches."""
    path, merges = path.rstrip("/"), 0
    while True:
        by_level = defaultdict(list)
        for (segment, day), c in _visible(commits(spark, path)).items():
            if c.writer == writer:
                by_level[day, c.level].append((segment, c))
        full = [(day, level, parts) for (day, level), parts in by_level.items() if len(parts) >= fan]
        if not full:
            return merges
        for day, level, parts in full:
            pairs = [(segment, day) for segment, _ in parts]
            name = _name(writer, f"merge-{uuid.uuid4().hex[:12]}")
            rows = _scan(spark, path, pairs).drop("segment", *_ADDRESS[1:])
            days = _store(rows, path, name, gather=True)
            _commit(
                spark, path, name,
                Commit(
                    writer, name, days, min(c.low for _, c in parts), max(c.seq for _, c in parts),
                    level + 1, [list(p) for p in pairs], at=_now_ms() // 1000,
                ),
            )
            merges += 1


def vacuum(spark: SparkSession, path: str, grace: int = GRACE) -> None:
    """Delete what commits older than `grace` seconds have replaced, and their own files once
    nothing they show is left.  The newest batch of a writer keeps its commit, as it may be
    written again."""
    path = path.rstrip("/")
    found = commits(spark, path)
    old = [c for c in found.values() if c.at <= _now_ms() // 1000 - grace]
    hidden = {(s, d) for c in old for s, d in c.replaces}
    gone = set(hidden)
    for segment, day in hidden:
        delete(spark, f"{path}/segment={segment}/day={day}")
    for c in old:
        for segment in c.dead:
            delete(spark, f"{path}/segment={segment}")
    newest: dict[str, int] = {}
    for name in found:
        writer, batch = name.rsplit("~", 1)
        if batch.isdigit():
            newest[writer] = max(newest.get(writer, -1), int(batch))
    over = {
        c.segment: name
        for name, c in found.items()
        if c.days and all((c.segment, d) in gone for d in c.days)
        and name != _name(c.writer, newest.get(c.writer, -1))
    }
    # what hides a segment stays as long as the commit that would show it
    shown = {c.segment for c in found.values()} - set(over)
    while kept := {s for s, name in over.items() if any(r in shown for r, _ in found[name].replaces)}:
        shown |= kept
        over = {s: name for s, name in over.items() if s not in kept}
    for segment, name in sorted(over.items(), key=lambda item: found[item[1]].level):
        delete(spark, f"{path}/_commits/{name}")
        delete(spark, f"{path}/segment={segment}")


# --- reading --------------------------------------------------------------------------------


def _scan(spark: SparkSession, path: str, pairs) -> DataFrame:
    """All rows of some segments on some days, with their addresses."""
    paths = [f"{path}/segment={s}/day={d}" for s, d in sorted(pairs)]
    if not paths:
        return spark.createDataFrame([], _DDL + ", file_name string, row_index long")
    rows = spark.read.schema(_DDL).option("basePath", path).parquet(*paths)
    return rows.select("*", "_metadata.file_name", "_metadata.row_index")


def read_writes(spark: SparkSession, path: str) -> DataFrame:
    """Every write, superseded or not, with its `write_seq`."""
    path = path.rstrip("/")
    return _scan(spark, path, _visible(commits(spark, path))).select(*S.AUDIT_FIELDS, "write_seq")


def superseded(rows: DataFrame) -> DataFrame:
    """Addresses of the writes that a later one of the same request replaces.

    Ids are counted first; only requests written more than once are ordered, by narrow rows.
    """
    narrow = rows.select("request_id", *_ORDER, *_ADDRESS)
    again = (
        narrow.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("request_id")
    )
    several = narrow.join(again, "request_id", "left_semi")
    # the last write of each is found by an aggregate, so no request gathers in one task
    last = several.groupBy("request_id").agg(F.max(F.struct(*_ORDER, *_ADDRESS)).alias("last"))
    return (
        several.join(last, "request_id")
        .where(F.struct(*_ORDER, *_ADDRESS) != F.col("last"))
        .select(*_ADDRESS)
    )


_ROW_BITS = 36  # of a place: the number of a file, then the row in it


def _places(gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, places): the few files that hold superseded writes, numbered, and the number
    each of these writes is known by.  A number is a fraction of an address with its name."""
    files = gone.select(*_ADDRESS[:2]).distinct().coalesce(1)
    files = materialize(files.withColumn("_file", F.monotonically_increasing_id()), "files")
    same = [gone[c].eqNullSafe(files[c]) for c in _ADDRESS[:2]]
    return files, gone.join(F.broadcast(files), same).select(_place().alias("_place"))


def _place() -> Column:
    return F.shiftleft("_file", _ROW_BITS) + F.col("row_index")


def _without(
    rows: DataFrame, gone: DataFrame, files: DataFrame | None, places: DataFrame | None
) -> DataFrame:
    """The rows whose address is not among those of `gone`."""
    if places is None:
        same = [rows[c].eqNullSafe(gone[c]) for c in _ADDRESS]
        return rows.join(gone, same, "left_anti")
    same = [rows[c].eqNullSafe(files[c]) for c in _ADDRESS[:2]]
    placed = rows.join(F.broadcast(files), same, "left").select(*[rows[c] for c in rows.columns], _place().alias("_place"))
    return placed.join(F.broadcast(places), "_place", "left_anti")


_KNOWN: dict[tuple, tuple] = {}


def _superseded(spark: SparkSession, path: str, pairs: frozenset, fixed: Column | None):
    """The table of superseded addresses, its size, and what `_places` makes of it if it is to
    be broadcast; kept for the table as it stands."""
    key = (spark.sparkContext.applicationId, path, pairs)
    if fixed is None and key in _KNOWN:
        return _KNOWN[key]
    rows = _scan(spark, path, pairs)
    found = materialize(superseded(rows if fixed is None else rows.where(fixed)), "superseded")
    many = found.count()
    result = found, many, *(_places(found) if 0 < many <= MAX_BROADCAST else (None, None))
    if fixed is None:
        if len(_KNOWN) >= 64:
            _KNOWN.clear()
        _KNOWN[key] = result
    return result


def _within(day: str, first: str | None, last: str | None) -> bool:
    return (first is None or first <= day) and (last is None or day <= last) if day[:1].isdigit() else first is last is None


def read_audit(
    spark: SparkSession,
    path: str,
    first_day: str | None = None,
    last_day: str | None = None,
    fixed: Column | None = None,
) -> DataFrame:
    """Audit records in the contract's columns, one row per request: its last write.

    Day bounds choose folders; `fixed`, a condition on fields that every write of a
    request shares, such as `request_id` or `replay_of`, filters the scan.  A later write may
    have moved a request to another day, so the ids of other days are looked at as well, as
    far as their segments hold writes that are not older than those asked for.
    """
    path = path.rstrip("/")
    shown = _visible(commits(spark, path))
    chosen = {p for p in shown if _within(p[1], first_day, last_day)}
    least = min((shown[p].low for p in chosen), default=0)
    rivals = frozenset(chosen | {p for p, c in shown.items() if c.seq >= least})
    rows = _scan(spark, path, chosen)
    if fixed is not None:
        rows = rows.where(fixed)
    gone, many, files, places = _superseded(spark, path, rivals if chosen else frozenset(), fixed)
    if many:
        rows = _without(rows, gone, files, places)
    return rows.select(*S.AUDIT_FIELDS)


def read_recent(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The newest `limit` records, from the newest days that hold as many.

    Days are visited from the newest on until enough requests are in sight; older days are
    not opened, however many there are, but for segments with writes as new as these.
    """
    path = path.rstrip("/")
    order = (F.col("ts").desc(), F.col("request_id").desc())
    days = sorted({d for _, d in _visible(commits(spark, path)) if d[:1].isdigit()}, reverse=True)
    step, at = 1, 0
    while True:
        at += step
        first = days[at - 1] if at <= len(days) else None
        found = read_audit(spark, path, first_day=first)
        if first is None:
            return found.orderBy(*order).limit(limit)
        top = materialize(found.orderBy(*order).limit(limit), "recent")
        if top.count() >= limit:
            return top.orderBy(*order)
        step *= 2
