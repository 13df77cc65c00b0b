"""Whitening of vectors by spectral divide and conquer with QDWH polar decompositions.

Sums and products are gathered in whole numbers, so the covariance is exact whatever the
order of the tasks.  It is as large as one vector squared; its spectrum is divided on the
driver: the polar factor of V - mu I tells the eigenvectors above mu from those below, an
orthonormal basis of each side gives two smaller matrices, and so on down to single
components.  Mean and components are then broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Params:
    """An entry c counts as floor(scale * c) + offset; the first `components` are given."""

    scale: int = 64
    offset: int = 1_000_000
    components: int = 32


# --- QDWH ---------------------------------------------------------------------------------


def polar(a: np.ndarray, most: int = 40) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps
    on QR decompositions; None if the matrix is singular to rounding."""
    size = len(a)
    x = a / np.linalg.norm(a)
    try:
        least = 1 / np.linalg.norm(np.linalg.inv(x))  # below the smallest singular value
    except np.linalg.LinAlgError:
        return None
    if not least > 10 * size * EPS:
        return None
    one = np.eye(size)
    for _ in range(most):
        square = least * least
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        alpha = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, one]))
        after = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:size] @ q[size:].T)
        after = (after + after.T) / 2
        step = np.linalg.norm(after - x)
        x, least = after, min(1.0, least * (alpha + beta * square) / (1 + gamma * square))
        if step < np.cbrt(5 * EPS) and abs(1 - least) < 10 * EPS:
            return x if np.linalg.norm(x @ x - one) < 1e-10 * size else None
    return None


def _divide(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above some shift."""
    size = len(a)
    center = np.trace(a) / size  # strictly inside the spectrum, unless all of it is one value
    spread = np.linalg.norm(a - center * np.eye(size)) / np.sqrt(size)
    draw = np.random.default_rng(size)
    shifts = [float(np.median(np.diag(a))), center]
    shifts += [center + spread * s for t in (0.05, 0.11, 0.23, 0.37, 0.53, 0.71, 0.97) for s in (t, -t)]
    for shift in shifts:
        sign = polar(a - shift * np.eye(size))
        if sign is None:
            continue
        projector = (sign + np.eye(size)) / 2
        k = int(np.rint(np.trace(projector)))
        if not 0 < k < size:
            continue
        basis, _ = np.linalg.qr(projector @ draw.normal(size=(size, k)))
        basis, _ = np.linalg.qr(projector @ basis, mode="complete")
        return basis, k
    return None


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    size, tiny = len(a), 4 * EPS * np.linalg.norm(a)
    values, vectors = [], []
    open_ = [(a, np.eye(size))]
    while open_:
        part, basis = open_.pop()
        if np.linalg.norm(part - np.diag(np.diag(part))) <= tiny * np.sqrt(len(part)):
            values.append(np.diag(part))
            vectors.append(basis)
            continue
        found = _divide(part)
        if found is None:
            raise ArithmeticError("no shift divides the spectrum")
        q, k = found
        for side in (q[:, :k], q[:, k:]):
            below = side.T @ part @ side
            open_.append(((below + below.T) / 2, basis @ side))
    e, v = (np.concatenate(values), np.hstack(vectors)) if values else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order] / np.linalg.norm(v[:, order], axis=0)


# --- Spark --------------------------------------------------------------------------------


def _whole(batch: pa.RecordBatch, params: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x as a matrix) of the usable vectors of a batch, by length."""
    column = batch.column("embedding")
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    for width in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == width))
        value = np.floor(params.scale * flat[(ends[rows] - width)[:, None] + np.arange(width)])
        yield rows, np.clip(value, -(2.0**62), 2.0**62).astype(np.int64) + params.offset


def _sums(params: Params):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for rows, x in _whole(batch, params):
                have = found.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                have[0] += len(rows)
                high, low = x >> 31, x & (2**31 - 1)  # no sum of a batch leaves 64 bits
                have[1] = [
                    s + (int(h) << 31) + int(m) for s, h, m in zip(have[1], high.sum(0), low.sum(0))
                ]
        rows = [(w, i, n, Decimal(s)) for w, (n, sums) in found.items() for i, s in enumerate(sums)]
        yield _table(rows, [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38)], ["width", "i", "n", "s"])

    return add


def _table(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _products(params: Params, mean: np.ndarray):
    """Sums of y_i y_j over a task, y = x - floor(mean): exact whole numbers."""
    width = len(mean)
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]), object)
        for batch in batches:
            for _, x in _whole(batch, params):
                if x.shape[1] != width:
                    continue
                y = x - mean
                square = float(np.abs(y).max()) ** 2
                if square < 2.0**53:  # whole numbers below 2^53 add up exactly in doubles
                    step = int(min(2.0**53 // max(square, 1.0), len(y)))
                    for top in range(0, len(y), step):
                        z = y[top : top + step].astype(np.float64)
                        total += (z.T @ z)[upper].astype(np.int64).astype(object)
                else:
                    z = y.astype(object)
                    total += (z.T @ z)[upper]
        rows = [(int(i), int(j), Decimal(int(t))) for i, j, t in zip(*upper, total)]
        yield _table(rows, [pa.int32(), pa.int32(), pa.decimal128(38)], ["i", "j", "p"])

    return add


@dataclass(frozen=True)
class Whitening:
    """What a task needs to whiten a vector; its size depends on the vectors' length alone."""

    params: Params
    n: int
    sums: list[int]
    floor: np.ndarray  # floor of the mean
    rest: np.ndarray  # mean - floor
    values: np.ndarray  # eigenvalues of the components given
    vectors: np.ndarray  # columns
    explained: np.ndarray
    positive: np.ndarray  # eigenvalues that are not zero to rounding

    def apply(self, x: np.ndarray) -> np.ndarray:
        """One row per vector, one column per component; null space: NaN."""
        centred = (x - self.floor).astype(np.float64) - self.rest
        scale = np.where(self.positive, np.sqrt(np.where(self.positive, self.values, 1)), np.nan)
        return centred @ self.vectors / scale

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n x - S)^2."""
        y, rest = x - self.floor, [s - self.n * int(f) for s, f in zip(self.sums, self.floor)]
        most = self.n * int(np.abs(y).max(initial=0)) + self.n
        if most * most * x.shape[1] < 2**62:
            whole = ((self.n * y - np.array(rest, np.int64)) ** 2).sum(1)
            return pa.array(whole).cast(pa.decimal128(38))
        exact = ((self.n * y.astype(object) - np.array(rest, object)) ** 2).sum(1)
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38))


def fit(vectors: DataFrame, params: Params = Params()) -> Whitening | None:
    """The whitening of all usable vectors; None if there are none.

    What reaches the driver is one row per pair of dimensions.
    """
    sums = vectors.select("embedding").mapInArrow(
        _sums(params), "width int, i int, n long, s decimal(38,0)"
    )
    sums = sums.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    width = sums.where("i = 0").orderBy(F.desc("n"), F.desc("width")).select("width", "n").first()
    if width is None:
        return None
    rows = sums.where(F.col("width") == width["width"]).orderBy("i").collect()
    n, total = width["n"], [int(r["s"]) for r in rows]
    floor = np.array([s // n for s in total], np.int64)
    rest = [s % n for s in total]
    products = (
        vectors.select("embedding")
        .mapInArrow(_products(params, floor), "i int, j int, p decimal(38,0)")
        .groupBy("i", "j")
        .agg(F.sum("p").alias("p"))
        .collect()
    )
    cov = np.zeros((len(floor), len(floor)))
    for r in products:
        i, j = r["i"], r["j"]
        cov[i, j] = cov[j, i] = (n * int(r["p"]) - rest[i] * rest[j]) / (n * n)
    values, basis = spectrum(cov)
    trace, k = np.trace(cov), min(params.components, len(values))
    return Whitening(
        params, n, total, floor, np.array([r / n for r in rest]), values[:k], basis[:, :k],
        values[:k] / trace if trace > 0 else np.full(k, np.nan),
        values[:k] > 64 * len(floor) * EPS * max(trace, 0.0),
    )


def _moments(model: Whitening):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = int(model.positive.sum())
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, x in _whole(batch, model.params):
                if x.shape[1] == len(model.floor):
                    w = np.column_stack([np.ones(len(x)), model.apply(x)[:, :k]])
                    total += w.T @ w
        rows = [(i, j, total[i, j]) for i in range(k + 1) for j in range(i, k + 1)]
        yield _table(rows, [pa.int32(), pa.int32(), pa.float64()], ["i", "j", "p"])

    return add


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of what `model` gives, less the identity."""
    rows = (
        vectors.select("embedding").mapInArrow(_moments(model), "i int, j int, p double")
        .groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    )
    p = {(r["i"], r["j"]): r["p"] / model.n for r in rows}
    # the vectors are centred before; what is left of their mean is taken off as well
    found = [abs(v - p[0, i] * p[0, j] - (i == j)) for (i, j), v in p.items() if i]
    return max(found, default=None)


_ROW = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def _spread(model: Whitening):
    k = len(model.values)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _whole(batch, model.params):
                if x.shape[1] != len(model.floor):
                    continue
                of = pa.array(np.repeat(np.arange(len(rows)), k))
                each = lambda values: pa.array(np.tile(values, len(rows)))
                white = model.apply(x).ravel()
                share = np.tile(model.explained, len(rows))
                yield pa.record_batch(
                    [
                        batch.column("vec_id").take(pa.array(rows)).take(of),
                        each(np.arange(1, k + 1, dtype=np.int32)),
                        pa.array(np.full(len(white), model.n, np.int64)),
                        model.deviation(x).take(of),
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(share, mask=np.isnan(share)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return spread


def whiten(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Vectors that are null, empty, or hold a null or non-finite entry are left out, and so
    are those of another length than most (ties: the longest).  Entries beyond +-2^62 after
    scaling count as that.  Components without variance have no whitened coordinate: null;
    without any variance `explained` is null too, and so is a deviation beyond 38 digits.
    Repeated rows count each; a null vec_id stays null; other columns are ignored; without
    usable vectors there are no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(rows, params)
    if model is None:
        empty = rows.sparkSession.createDataFrame([], _ROW)
        return empty.withColumn("identity_error", F.lit(None).cast("double"))
    error = identity_error(rows, model)
    return rows.mapInArrow(_spread(model), _ROW).withColumn(
        "identity_error", F.lit(error).cast("double")
    )
