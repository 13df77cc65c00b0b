"""Rate limits against a sequential model, on skewed logs with ties."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from promptsieve import RateLimits, rate_limit, sliding_throttle
from promptsieve.operators import ratelimit as R

LIMITS = RateLimits(4, 9, 6, 12, 150, throttle_seconds=60, throttle_limit=3)
START = datetime(2024, 3, 9, 22, 0, tzinfo=timezone.utc)
DDL = "request_id string, ts timestamp, client_id string, ip string"


def log(seed, n=900, hours=5):
    """A third of the requests from one client, many at the same instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.34 else f"u{rng.randint(0, 40)}"
        ip = "10.0.0.1" if user == "hot" or rng.random() < 0.1 else f"10.0.1.{rng.randint(0, 9)}"
        at = START + timedelta(seconds=rng.randint(0, hours * 3600))
        if rng.random() < 0.3:
            at = START + timedelta(minutes=17)
        rows.append((f"r{i:05d}", at, user, ip))
    return rows


def model(rows, limits):
    counts, out = defaultdict(int), {}
    for request_id, ts, user, ip in sorted(rows, key=lambda r: (r[1], r[0])):
        sec, denied = int(ts.timestamp()), None
        for scope, key, window, limit in (
            ("user/hour", ("u", user), 3600, limits.user_per_hour),
            ("user/day", ("u", user), 86400, limits.user_per_day),
            ("ip/hour", ("ip", ip), 3600, limits.ip_per_hour),
            ("ip/day", ("ip", ip), 86400, limits.ip_per_day),
            ("global/day", ("g",), 86400, limits.global_per_day),
        ):
            bucket = sec // window
            counts[scope, key, bucket] += 1
            if counts[scope, key, bucket] > limit and denied is None:
                denied = (scope, max(1, (bucket + 1) * window - sec))
        out[request_id] = denied
    return out, counts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_the_sequential_limiter(spark, seed):
    rows = log(seed)
    want, counts = model(rows, LIMITS)
    df = spark.createDataFrame(rows, DDL).repartition(5)
    got = {r.request_id: (r.scope, r.retry_after_seconds) if not r.allowed else None
           for r in rate_limit(df, LIMITS).collect()}
    assert got == want
    assert sum(v is not None for v in want.values()) > 100
    stored = R.counters(df, LIMITS)
    assert stored.agg(F.sum("used")).first()[0] == 5 * len(rows)
    assert stored.count() == len(counts)


def test_nothing_denied_and_disabled(spark):
    df = spark.createDataFrame(log(4, 50), DDL)
    loose = RateLimits(10**6, 10**6, 10**6, 10**6, 10**6)
    assert rate_limit(df, loose).where("NOT allowed").count() == 0
    off = RateLimits(1, 1, 1, 1, 1, enabled=False)
    assert rate_limit(df, off).where("allowed").count() == 50


def test_counts_carry_over(spark):
    rows = sorted(log(5), key=lambda r: (r[1], r[0]))
    want, _ = model(rows, LIMITS)
    first, second = rows[:400], rows[400:]
    used = R.counters(spark.createDataFrame(first, DDL), LIMITS)
    got = {r.request_id: r.scope for r in
           rate_limit(spark.createDataFrame(second, DDL), LIMITS, used).collect()}
    assert got == {r[0]: (want[r[0]] or (None,))[0] for r in second}


@pytest.mark.parametrize("seed", [1, 2])
def test_sliding_throttle(spark, seed):
    rng = random.Random(seed)
    rows = [(i, START + timedelta(seconds=rng.choice([0, 0, 7, rng.randint(0, 1800)])), c, ip)
            for i, _, c, ip in log(seed, 500)]
    arrived, want = defaultdict(list), set()
    for request_id, ts, _, ip in sorted(rows, key=lambda r: (r[1], r[0])):
        seen = arrived[ip]
        seen.append(ts)
        if sum(ts - t <= timedelta(seconds=LIMITS.throttle_seconds) for t in seen) > LIMITS.throttle_limit:
            want.add(request_id)
    df = spark.createDataFrame(rows, DDL).repartition(3)
    got = [r.request_id for r in sliding_throttle(df, LIMITS).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_windows_and_identity(spark):
    hour = 100 * 3600
    df = spark.createDataFrame(
        [(hour + 5, " 1.2.3.4 , 9.9.9.9", "me", "8.8.8.8"), (hour + 10, "", "", "8.8.8.8"),
         (hour + 3599, None, None, None), (hour, None, "x" * 200, "8.8.8.8")],
        "sec bigint, xff string, header string, remote string",
    )
    client, ip = R.identity(F.col("header"), F.col("xff"), F.col("remote"))
    bucket = R.bucket_of(F.col("sec"), F.lit(3600))
    got = df.select(
        client.alias("c"), ip.alias("i"), R.counter_key(F.lit("u:c:h"), bucket).alias("k"),
        R.window_reset(bucket, F.lit(3600)).alias("reset"),
        R.retry_after(bucket, F.lit(3600), F.col("sec")).alias("retry"),
    ).collect()
    assert [(r.c, r.i) for r in got] == [
        ("me", "1.2.3.4"), ("8.8.8.8", "8.8.8.8"), ("unknown", "unknown"), ("x" * 128, "8.8.8.8"),
    ]
    assert {r.k for r in got} == {"u:c:h#100"} and {r.reset for r in got} == {101 * 3600}
    assert [r.retry for r in got] == [3595, 3590, 1, 3600]


def test_busy_counter_within_its_limit_is_not_shuffled(spark):
    """Every request shares the global counter; its rows end at the broadcast of busy keys."""
    from promptsieve.operators.ratelimit import cutoffs, denials

    rows = spark.createDataFrame(log(5, 300), DDL)
    roomy = RateLimits(3, 10**9, 10**9, 10**9, 10**9)
    table = cutoffs(rows, roomy)
    assert table.where("hot and cut is null and tier = 4").count() >= 1
    want = {r.request_id for r in denials(rows, roomy).collect()}
    assert want and want == {r.request_id for r in rate_limit(rows, roomy).where("not allowed").collect()}


def test_disabled_limiter_denies_nothing(spark):
    from dataclasses import replace

    from promptsieve.operators.ratelimit import denials

    rows = spark.createDataFrame(log(5, 60), DDL)
    assert denials(rows, LIMITS).count() > 0
    assert denials(rows, replace(LIMITS, enabled=False)).count() == 0


@pytest.mark.parametrize("size", [40, 10**6])
def test_ranks_are_cut_in_parts_of_bounded_size(spark, monkeypatch, size):
    """One group holds nearly all rows, most at one instant; ranks up to its end are cut."""
    from promptsieve.operators import skew

    rng = random.Random(2)
    rows = [("hot", 5 if rng.random() < 0.8 else rng.randint(0, 9), f"r{i:04d}", 700) for i in range(900)]
    rows += [(f"k{i}", rng.randint(0, 3), f"s{i:04d}", 1 + i % 3) for i in range(60)]
    frame = spark.createDataFrame(rows, "key string, at int, id string, n int").repartition(4)
    tasks = []
    ranked = skew._ranked
    monkeypatch.setattr(skew, "_ranked", lambda rows, cut, *a: (tasks.append((rows, cut)), ranked(rows, cut, *a))[1])
    for limit in (700, 900, 901, 1):
        k = F.when(F.col("key") == "hot", F.lit(limit)).otherwise(F.col("n"))
        groups = defaultdict(list)
        for key, at, id_, n in rows:
            groups[key].append((at, id_, limit if key == "hot" else n))
        want = {key: sorted(g) for key, g in groups.items()}
        first = skew.first_k(frame, ["key"], ["at", "id"], k, size)
        assert first.columns == frame.columns
        assert sorted(r.id for r in first.collect()) == sorted(x[1] for g in want.values() for x in g[: g[0][2]])
        at = skew.kth(frame, ["key"], ["at", "id"], k, size).collect()
        assert {r.key: r.id for r in at} == {key: g[g[0][2] - 1][1] for key, g in want.items() if g[0][2] <= len(g)}
    for stored, cut in tasks:
        most = stored.join(cut, ["key", "_part"], "left_semi").groupBy("key", "_part").count().agg(F.max("count")).first()[0]
        assert most is None or most <= (3 * size if size < 900 else 900)


def test_one_address_holds_nearly_all_requests(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        at = START + timedelta(milliseconds=rng.choice([0, 500, rng.randint(0, 150_000)]))
        rows.append((f"r{i:05d}", at, "c", "10.0.0.1" if rng.random() < 0.9 else f"10.0.1.{i % 5}"))
    limits = RateLimits(throttle_seconds=60, throttle_limit=200)
    arrived, want = defaultdict(list), set()
    for request_id, ts, _, ip in sorted(rows, key=lambda r: (r[1], r[0])):
        arrived[ip].append(ts)
        if sum(ts - t <= timedelta(seconds=60) for t in arrived[ip]) > 200:
            want.add(request_id)
    found = sliding_throttle(spark.createDataFrame(rows, DDL).repartition(3), limits)
    got = [r.request_id for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_values_at_ranks(spark):
    """Weighted values over several parts against sorting them all."""
    from promptsieve.operators.skew import at_ranks

    rng = random.Random(8)
    rows = [(key, float(v), rng.randint(1, 5)) for key, n in (("a", 500), ("b", 3), ("c", 1)) for v in rng.sample(range(2000), n)]
    frame = spark.createDataFrame(rows, "key string, v double, n long").repartition(3)
    every = {k: sorted(v for key, v, n in rows if key == k for _ in range(n)) for k in "abc"}
    asked = [(k, r) for k in "abc" for r in {1, len(every[k]), (len(every[k]) + 1) // 2, len(every[k]) + 1}]
    ranks = spark.createDataFrame(asked, "key string, rank long")
    want = {(k, r): every[k][r - 1] for k, r in asked if r <= len(every[k])}
    for size in (30, 10**6):
        got = {(r.key, r["rank"]): r.v for r in at_ranks(frame, ["key"], "v", "n", ranks, size).collect()}
        assert got == want
