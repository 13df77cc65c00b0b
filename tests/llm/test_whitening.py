"""Whitening against LAPACK and exact integers."""

import math

import numpy as np
import pytest

from promptsieve.llm import whitening

ROWS = "vec_id long, embedding array<double>, n int, whitened string"


def _brute(vectors: dict) -> dict:
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in vectors.items()}
    n, width = len(x), len(next(iter(x.values())))
    sums = [sum(v[i] for v in x.values()) for i in range(width)]
    deviation = {k: sum((n * v[i] - sums[i]) ** 2 for i in range(width)) for k, v in x.items()}
    centred = np.array([[(n * v[i] - sums[i]) / n for i in range(width)] for v in x.values()])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return {"n": n, "deviation": deviation, "e": e[::-1], "white": dict(zip(x, centred @ q[:, ::-1]))}


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_spectrum(size):
    draw = np.random.default_rng(size)
    a = draw.normal(size=(size, size))
    for m in (
        a + a.T,
        np.diag(np.arange(size)) * 1.0,
        np.ones((size, size)),
        np.eye(size) * 3,
        np.zeros((size, size)),
        np.kron(np.eye(1 + size // 2), [[2.0, 1.0], [1.0, 2.0]])[:size, :size],
        (a * 10.0 ** -np.arange(size).clip(0, 12)) @ (a * 10.0 ** -np.arange(size).clip(0, 12)).T,
    ):
        e, v = whitening.spectrum(m)
        norm = max(np.linalg.norm(m), 1e-300)
        assert np.allclose(e, np.linalg.eigvalsh(m)[::-1], rtol=0, atol=1e-13 * norm)
        assert np.abs(v.T @ v - np.eye(size)).max() < 1e-13 * size
        assert np.linalg.norm(m @ v - v * e) < 1e-13 * size * norm


def test_polar():
    a = np.diag([3.0, -1e-9, 2.0, -5.0])
    assert np.allclose(whitening.polar(a), np.diag([1, -1, 1, -1]), atol=1e-12)
    assert whitening.polar(np.diag([1.0, 0.0])) is None


def test_whiten(spark):
    draw = np.random.default_rng(5)
    mix = draw.normal(size=(40, 40)) * np.linspace(0.2, 3, 40)
    good = {i: [float(c) for c in draw.normal(size=40) @ mix] for i in range(300)}
    good |= {1000: good[0], 1001: [0.0] * 40, 1002: [1e5] * 40}
    rows = [(k, v, 1, "clash") for k, v in good.items()]
    odd = [None, [], [1.0] * 39 + [None], [float("nan")] + [1.0] * 39, [float("inf")] * 40, [1.0, 2.0]]
    rows += [(2000 + i, v, 1, "clash") for i, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    want = _brute(good)
    found = whitening.whiten(frame).toPandas()
    assert len(found) == 32 * len(good) and (found["n"] == len(good)).all()
    assert found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-6
    for k, rows in found.groupby("vec_id"):
        assert {int(d) for d in rows["deviation"]} == {want["deviation"][k]}
    for c, rows in found.groupby("component"):
        ours = rows.set_index("vec_id")["whitened"].sort_index().to_numpy()
        theirs = np.array([want["white"][k][c - 1] for k in sorted(good)]) / np.sqrt(want["e"][c - 1])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-6
        assert np.allclose(rows["explained"], want["e"][c - 1] / want["e"].sum(), rtol=1e-9)


def test_whiten_without_variance(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (None, [1.0, 5.0], 0, "")], ROWS)
    found = whitening.whiten(frame).orderBy("component", "vec_id").collect()
    assert [(r.component, r.vec_id, r.whitened is None) for r in found] == [
        (1, None, False), (1, 1, False), (2, None, True), (2, 1, True),
    ]
    assert whitening.whiten(frame.limit(0)).count() == 0
    one = whitening.whiten(frame.limit(1)).collect()
    assert [(r.whitened, r.explained, int(r.deviation)) for r in one] == [(None, None, 0)] * 2


def test_entries_beyond_64_bits(spark):
    rows = [(1, [1e300, 0.0], 0, ""), (2, [-1e300, 0.5], 0, ""), (3, [3.0, 0.25], 0, "")]
    found = whitening.whiten(spark.createDataFrame(rows, ROWS)).where("component = 1").collect()
    x = [[2**62 + 10**6, 10**6], [-(2**62) + 10**6, 10**6 + 32], [10**6 + 192, 10**6 + 16]]
    sums = [sum(v[i] for v in x) for i in (0, 1)]
    want = [sum((3 * v[i] - sums[i]) ** 2 for i in (0, 1)) for v in x]
    got = {r.vec_id: r.deviation for r in found}
    assert [got[k + 1] and int(got[k + 1]) for k in range(3)] == [w if w < 10**38 else None for w in want]
