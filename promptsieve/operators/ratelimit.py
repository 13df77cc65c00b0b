"""Fixed-window rate limits and a sliding throttle over a traffic log.

Counters rise for every request in every tier, denied or not, so the n-th request of
a counter is denied exactly when n exceeds the tier's limit.  No counter is ranked
whole: per-minute counts locate the minute in which the limit is reached, and only
that minute is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .skew import HOT_SHARE, first_k, kth, lookup_join

HOUR = 3_600
DAY = 86_400
SLICE_SECONDS = 60  # divides both windows
THROTTLE_PARTS = 64  # of a throttle window


@dataclass(frozen=True)
class RateLimits:
    user_per_hour: int = 20
    user_per_day: int = 60
    ip_per_hour: int = 40
    ip_per_day: int = 120
    global_per_day: int = 2_000
    enabled: bool = True
    throttle_seconds: int = 60
    throttle_limit: int = 60
    enforced: tuple[int, ...] = (0, 1, 2, 3, 4)  # tiers, in order of precedence


COUNTER = ("tier", "counter", "bucket")
GLOBAL_TIER = 4


def identity(client_header: Column, forwarded_for: Column, remote_ip: Column) -> tuple[Column, Column]:
    """(client_id, ip): the client header, cut to 128 characters, else the address;
    the address is the first forwarded hop, else the remote one, else `unknown`."""

    def some(c: Column) -> Column:
        return F.when(c != "", c)

    ip = F.coalesce(
        some(F.trim(F.get(F.split(forwarded_for, ","), F.lit(0)))), some(remote_ip), F.lit("unknown")
    )
    return F.coalesce(some(F.substring(client_header, F.lit(1), F.lit(128))), ip), ip


def _tier_values(limits: RateLimits) -> list[tuple[str, int, int]]:
    """(scope, window, limit) of each tier, in order of precedence."""
    return [
        ("user/hour", HOUR, limits.user_per_hour),
        ("user/day", DAY, limits.user_per_day),
        ("ip/hour", HOUR, limits.ip_per_hour),
        ("ip/day", DAY, limits.ip_per_day),
        ("global/day", DAY, limits.global_per_day),
    ]


def scope_of(tier: Column, limits: RateLimits = RateLimits()) -> Column:
    """Name of a tier; NULL for none."""
    return F.get(F.array(*[F.lit(scope) for scope, _, _ in _tier_values(limits)]), tier)


def tiers(client_id: Column, ip: Column, limits: RateLimits) -> Column:
    """array<struct<tier, scope, counter, window, limit>> in order of precedence."""
    user = lambda unit: F.concat(F.lit("u:"), client_id, F.lit(unit))
    address = lambda unit: F.concat(F.lit("ip:"), ip, F.lit(unit))
    keys = (user(":h"), user(":d"), address(":h"), address(":d"), F.lit("g:all:d"))
    return F.array(
        *[
            F.struct(
                F.lit(rank).alias("tier"),
                F.lit(scope).alias("scope"),
                counter.alias("counter"),
                F.lit(window).alias("window"),
                F.lit(limit).alias("limit"),
            )
            for rank, (counter, (scope, window, limit)) in enumerate(zip(keys, _tier_values(limits)))
            if rank in limits.enforced
        ]
    )


def _named(limits: RateLimits) -> list[str]:
    """The columns that name the counters of the enforced tiers."""
    named = {"client_id": {0, 1}, "ip": {2, 3}}
    return [column for column, tiers in named.items() if tiers & set(limits.enforced)]


def _few(limits: RateLimits) -> bool:
    """Whether there is but one counter a day, that of the global tier: a table of counters is
    then broadcast whole, and as it is read only once it need not be written out."""
    return set(limits.enforced) == {GLOBAL_TIER}


def bucket_of(epoch_seconds: Column, window: Column) -> Column:
    return F.floor(epoch_seconds / window).cast("bigint")


def counter_key(counter: Column, bucket: Column) -> Column:
    return F.concat(counter, F.lit("#"), bucket.cast("string"))


def window_reset(bucket: Column, window: Column) -> Column:
    return (bucket + 1) * window


def retry_after(bucket: Column, window: Column, epoch_seconds: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), window_reset(bucket, window) - epoch_seconds)


def _per_tier(
    df: DataFrame, limits: RateLimits, horizon: int | None, *columns: str
) -> DataFrame:
    """One row per tier with its bucket; `df` holds client_id, ip and epoch `second`.

    Windows that were over at `horizon` (epoch seconds) are left out: they no longer
    count nor deny.
    """
    expanded = df.select(
        *columns,
        "second",
        F.inline(tiers(F.col("client_id"), F.col("ip"), limits)),
    ).withColumn("bucket", bucket_of(F.col("second"), F.col("window")))
    if horizon is None:
        return expanded
    return expanded.where(window_reset(F.col("bucket"), F.col("window")) > horizon)


def _minute_counts(
    requests: DataFrame, limits: RateLimits, horizon: int | None = None
) -> DataFrame:
    """Requests per counter and minute.  Pre-aggregated by minute and what names the counters
    before the five-fold expansion."""
    minute = F.floor(F.unix_seconds("ts") / SLICE_SECONDS) * SLICE_SECONDS
    by_identity = requests.groupBy(*_named(limits), minute.alias("second")).agg(
        F.count(F.lit(1)).alias("n")
    )
    tier = F.col("tier")
    scope, window, limit = (
        F.get(F.array(*[F.lit(t[i]) for t in _tier_values(limits)]), tier) for i in range(3)
    )
    return (
        _per_tier(by_identity, limits, horizon, "n")
        .groupBy("tier", "counter", F.col("second").alias("minute"))
        .agg(F.sum("n").alias("n"))
        .withColumns({"scope": scope, "window": window, "limit": limit})
        .withColumn("bucket", bucket_of(F.col("minute"), F.col("window")))
    )


def stored_minutes(
    requests: DataFrame, limits: RateLimits = RateLimits(), horizon: int | None = None
) -> DataFrame:
    """Requests per counter and minute, written out for what needs them more than once: the
    `minutes` of the functions below, for the same requests, limits and horizon."""
    return materialize(_minute_counts(requests, limits, horizon), "minutes")


def counters(
    requests: DataFrame,
    limits: RateLimits = RateLimits(),
    horizon: int | None = None,
    minutes: DataFrame | None = None,
) -> DataFrame:
    """Counter store after the whole log: one row per counter and window."""
    return (
        (_minute_counts(requests, limits, horizon) if minutes is None else minutes)
        .groupBy(*COUNTER, "scope", "window", "limit")
        .agg(F.sum("n").alias("used"))
        .withColumn("expires_at", window_reset(F.col("bucket"), F.col("window")))
    )


def _cut_minutes(
    requests: DataFrame,
    limits: RateLimits,
    used: DataFrame | None,
    horizon: int | None,
    minutes: DataFrame | None,
) -> DataFrame:
    """The minute in which each overrun counter reaches its limit: one row per counter.

    `first_denied` is the rank, within that minute, of its first denied request.
    `hot` and `hot_minute` mark counters and minutes holding a large share of the log.
    These have a row even where nothing is denied, with `first_denied` NULL, so that the
    requests of a busy counter within its limit are dropped where they are read.
    """
    counts = _minute_counts(requests, limits, horizon) if minutes is None else minutes
    if used is not None:
        counts = counts.join(used.select(*COUNTER, F.col("used").alias("_used")), [*COUNTER], "left")
    else:
        counts = counts.withColumn("_used", F.lit(0).cast("bigint"))
    # At most window / SLICE_SECONDS rows per counter: a day has 1440 minutes.
    by_minute = W.partitionBy(*COUNTER).orderBy("minute")
    running = by_minute.rowsBetween(W.unboundedPreceding, 0)
    # Every request counts once in each tier.
    total = counts.agg(F.sum("n")).scalar() / max(1, len(limits.enforced))
    return (
        counts.withColumns(
            {
                "_upto": F.coalesce("_used", F.lit(0)) + F.sum("n").over(running),
                "_first": F.row_number().over(by_minute) == 1,
                "_group": F.sum("n").over(W.partitionBy(*COUNTER)),
            }
        )
        .withColumn("_before", F.col("_upto") - F.col("n"))
        .withColumn("hot", F.col("_group") >= total * HOT_SHARE)
        .withColumn("hot_minute", F.col("n") >= total * HOT_SHARE)
        # Before this minute the limit held, or a carried-over counter was past it.
        .withColumn(
            "_cut",
            (F.col("_upto") > F.col("limit"))
            & ((F.col("_before") <= F.col("limit")) | F.col("_first")),
        )
        .where(F.col("_cut") | F.col("hot_minute") | (F.col("hot") & F.col("_first")))
        .select(
            *COUNTER,
            "minute",
            F.when(
                F.col("_cut"), F.greatest(F.col("limit") - F.col("_before") + 1, F.lit(1))
            ).alias("first_denied"),
            "hot",
            "hot_minute",
        )
    )


def _tier_rows(requests: DataFrame, limits: RateLimits, horizon: int | None) -> DataFrame:
    return _per_tier(
        requests.withColumn("second", F.unix_seconds("ts")), limits, horizon, "request_id", "ts"
    )


def _looked_up(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], limits: RateLimits, hot: str
) -> DataFrame:
    """Rows with the line of their counter in `table`."""
    if _few(limits):
        return rows.join(F.broadcast(table), list(keys))
    return lookup_join(rows, table, keys, hot=F.col(hot), spread=["request_id"], how="inner")


def cutoffs(
    requests: DataFrame,
    limits: RateLimits = RateLimits(),
    used: DataFrame | None = None,
    horizon: int | None = None,
    minutes: DataFrame | None = None,
) -> DataFrame:
    """First denied request (ts, request_id) of every counter that runs over; NULL for
    busy counters that do not.

    `used` holds counts carried over from earlier batches, as `counters` returns them.
    Both steps are written out: they are small, and each is read several times.  Where there are
    `_few` counters they are not, and busy ones that do not run over are left out.
    """
    cut_minutes = _cut_minutes(requests, limits, used, horizon, minutes)
    if not _few(limits):
        cut_minutes = materialize(cut_minutes, "cut-minutes")
    rows = _tier_rows(requests, limits, horizon).select(
        *COUNTER,
        "request_id",
        "ts",
        (F.floor(F.col("second") / SLICE_SECONDS) * SLICE_SECONDS).alias("minute"),
    )
    in_cut_minute = _looked_up(rows, cut_minutes, [*COUNTER, "minute"], limits, "hot_minute").where(
        F.col("first_denied").isNotNull()
    )
    found = kth(in_cut_minute, COUNTER, ["ts", "request_id"], F.col("first_denied")).select(
        *COUNTER, "hot", F.struct(F.col("ts"), F.col("request_id")).alias("cut")
    )
    if _few(limits):
        return found
    quiet = (
        cut_minutes.groupBy(*COUNTER)
        .agg(F.max("first_denied").alias("_denied"), F.max("hot").alias("hot"))
        .where(F.col("_denied").isNull() & F.col("hot"))
        .select(*COUNTER, "hot", F.lit(None).cast(found.schema["cut"].dataType).alias("cut"))
    )
    return materialize(found.unionByName(quiet), "cutoffs")


def tier_denials(
    requests: DataFrame,
    limits: RateLimits = RateLimits(),
    used: DataFrame | None = None,
    horizon: int | None = None,
    minutes: DataFrame | None = None,
) -> DataFrame:
    """(request_id, ts, tier, scope, retry_after_seconds) per denial of a tier."""
    return (
        _looked_up(
            _tier_rows(requests, limits, horizon),
            cutoffs(requests, limits, used, horizon, minutes),
            COUNTER,
            limits,
            "hot",
        )
        .where(F.struct("ts", "request_id") >= F.col("cut"))
        .select(
            "request_id",
            "ts",
            "tier",
            "scope",
            retry_after(F.col("bucket"), F.col("window"), F.col("second")).alias(
                "retry_after_seconds"
            ),
        )
    )


def denials(
    requests: DataFrame,
    limits: RateLimits = RateLimits(),
    used: DataFrame | None = None,
    horizon: int | None = None,
    minutes: DataFrame | None = None,
) -> DataFrame:
    """Denied requests with the scope of the first tier they breach.

    `requests` holds request_id (unique), ts, client_id and ip.  A disabled limiter
    denies nothing.
    """
    if not limits.enabled:
        requests = requests.limit(0)
    return (
        tier_denials(requests, limits, used, horizon, minutes)
        .groupBy("request_id")
        .agg(
            F.min_by(F.struct("scope", "retry_after_seconds"), "tier").alias("_first"),
            F.count(F.lit(1)).alias("breached_tiers"),
        )
        .select("request_id", "_first.*", "breached_tiers")
    )


def rate_limit(
    requests: DataFrame,
    limits: RateLimits = RateLimits(),
    used: DataFrame | None = None,
    horizon: int | None = None,
    minutes: DataFrame | None = None,
) -> DataFrame:
    """All requests with allowed, scope and retry_after_seconds.

    A request without a denial is allowed: a disabled or failing limiter fails open.
    """
    if not limits.enabled:
        return requests.withColumns(
            {
                "allowed": F.lit(True),
                "scope": F.lit(None).cast("string"),
                "retry_after_seconds": F.lit(None).cast("bigint"),
            }
        )
    denied = denials(requests, limits, used, horizon, minutes).drop("breached_tiers")
    return requests.join(denied, "request_id", "left").withColumn(
        "allowed", F.col("scope").isNull()
    )


def sliding_throttle(requests: DataFrame, limits: RateLimits = RateLimits()) -> DataFrame:
    """Requests over the sliding limit of their address: more than `throttle_limit`
    requests, itself included, in the `throttle_seconds` up to it.

    Counted per instant first.  An instant looks back into at most the previous slice,
    so an address is cut into slices of one window length, and these into parts, instead of
    sorted whole.
    """
    limit = F.lit(limits.throttle_limit)
    span = limits.throttle_seconds * 1_000_000
    micros = F.unix_micros("ts")
    instants = requests.groupBy("ip", micros.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    own = F.floor(F.col("at") / span)

    def event(slice_: Column, at: Column, delta: Column, kind: int) -> Column:
        return F.struct(
            slice_.alias("slice"), at.alias("at"), delta.alias("delta"), F.lit(kind).alias("kind")
        )

    # An instant counts in its own slice; in the next one it counts from the start and
    # leaves again once a whole window has passed.  A running sum then costs one pass,
    # where a sliding frame would be summed anew for every row.
    counted, carried, leaving = 0, 1, 2
    events = instants.select(
        "ip",
        "n",
        F.inline(
            F.array(
                event(own, F.col("at"), F.col("n"), counted),
                event(own + 1, F.col("at"), F.col("n"), carried),
                event(own + 1, F.col("at") + span, -F.col("n"), leaving),
            )
        ),
    )
    # Two levels of prefix sums: a slice is cut into parts, whose sums are few, so that one
    # busy address in one window is dealt to many tasks.
    part = ("ip", "slice", "part")
    events = events.withColumn("part", F.floor(F.col("at") / (span / THROTTLE_PARTS)))
    sums = events.groupBy(*part).agg(F.sum("delta").alias("delta"))
    earlier = W.partitionBy("ip", "slice").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*part, F.coalesce(F.sum("delta").over(earlier), F.lit(0)).alias("base"))
    upto = W.partitionBy(*part).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    total = instants.agg(F.sum("n")).scalar()
    over = (
        events.join(base, [*part])
        .withColumn("before", F.col("base") + F.sum("delta").over(upto) - F.col("n"))
        .where((F.col("kind") == counted) & (F.col("before") + F.col("n") > limit))
        .select(
            "ip",
            "at",
            F.greatest(limit - F.col("before"), F.lit(0)).alias("still_allowed"),
            (F.col("n") >= total * HOT_SHARE).alias("hot"),
        )
    )
    hits = lookup_join(
        requests.withColumn("at", micros),
        materialize(over, "over-limit"),
        ["ip", "at"],
        hot=F.col("hot"),
        spread=["request_id"],
        how="inner",
    ).drop("hot")
    # Only an instant that straddles the limit needs its requests ranked.
    straddles = F.col("still_allowed") > 0
    within = first_k(hits.where(straddles), ["ip", "at"], ["request_id"], F.col("still_allowed"))
    within = within.select("request_id")
    return hits.join(within, "request_id", "left_anti").drop("still_allowed", "at")
