"""Factorisation machines over hashed words: a linear part plus low-rank pair interactions.

The score of a row with active features A is  b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2),
sums over i in A: linear in |A|, though it counts every pair.  Features are present or not.

All hashed features of the sample take part in training.  What keeps noise out is a penalty
inside it, on weights and on factors, in units of the noise of each feature's own gradient:
a weight stays only if the data pull at it harder than chance does.  For factors the penalty
starts low, so that pairs without any effect of their single terms can grow, and rises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize
from .text import flat, fold, mix, prefix_hash, slices, span_hash, word_hashes, words

STATS = (
    "upper", "digit", "symbol", "other_bytes", "bar", "word_bytes", "symbol_ends", "capital_words",
    "distinct_words", "line_words", "log_words", "log_chars",
)


@dataclass(frozen=True)
class Params:
    """Training uses `sample` labelled rows at most (smallest seeded hashes; if labelled ids
    repeat in the documents, so many of their rows) and factors of rank `rank`.  `structure`
    adds binned structure statistics, `stems` the first so many bytes of longer words.

    Steps of `batch` rows: `alone` of them on weights only, then up to `steps` with factors,
    then `free` ones without the penalties, for what is not zero by then.  `strict` is the
    least pull on a weight, in standard deviations; that on factors rises from `loose` to
    `tight`.  `decay` is the precision of a normal prior."""

    sample: int = 20_000
    hash_bits: int = 18
    rank: int = 4
    bins: int = 12
    structure: bool = True
    stems: tuple[int, ...] = ()
    batch: int = 2_048
    alone: int = 60
    steps: int = 300
    free: int = 80
    strict: float = 3.0
    loose: float = 0.5
    tight: float = 4.0
    rate: float = 0.05
    decay: float = 1.0
    seed: int = 5


@dataclass
class Model:
    """Fixed size whatever the data: a weight and factors of each bucket, then of each bin."""

    params: Params
    edges: np.ndarray
    bias: float
    w: np.ndarray = field(repr=False)
    v: np.ndarray = field(repr=False)

    def __post_init__(self) -> None:
        self.active = (self.w != 0) | (self.v != 0).any(axis=1)

    def bins_of(self, stats: np.ndarray) -> np.ndarray:
        """Feature of each row and statistic; missing values have a bin of their own."""
        first, width = 1 << self.params.hash_bits, self.params.bins + 1
        found = np.zeros((len(stats), len(self.edges)), np.int64)
        for j, edge in enumerate(self.edges):
            value = stats[:, j]
            found[:, j] = first + j * width + np.where(
                np.isnan(value), self.params.bins, np.searchsorted(edge, value)
            )
        return found

    def features(self, buckets: np.ndarray, counts: np.ndarray, stats: np.ndarray):
        """(row, feature) of what is present and is not zero."""
        row = np.repeat(np.arange(len(counts)), counts)
        keep = self.active[buckets]
        size = len(self.w)
        pairs = np.unique(row[keep] * size + buckets[keep])
        if self.params.structure:
            more = np.arange(len(counts))[:, None] * size + self.bins_of(stats)
            pairs = np.concatenate([pairs, more.ravel()])
        return pairs // size, pairs % size

    def score(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        raw = np.full(rows, self.bias) + np.bincount(row, self.w[feature], rows)
        for f in range(self.v.shape[1]):
            part = self.v[feature, f]
            raw += 0.5 * (np.bincount(row, part, rows) ** 2 - np.bincount(row, part * part, rows))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def _sums(mask: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[rows]).astype(float)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"?!()-"]] = True


def extract(part: pa.RecordBatch, params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, words per row, and structure statistics per row."""
    raw, rows = flat(part.column("text"))
    data = fold(raw)
    begin, end, counts = words(data, rows)
    hashed = word_hashes(data, begin, end)
    shift = np.uint64(64 - params.hash_bits)
    buckets = (hashed >> shift).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    stats = np.zeros((len(counts), len(STATS)))
    if params.structure:
        size = np.maximum(np.diff(rows), 1)
        many = np.maximum(counts, 1)
        letters = (raw >= 65) & (raw <= 90)
        symbol = _SYMBOL[raw]
        fresh = np.unique(np.repeat(np.arange(len(counts)), counts) << params.hash_bits | buckets)
        for j, value in enumerate(
            (
                _sums(letters, rows) / size,
                _sums((raw >= 48) & (raw <= 57), rows) / size,
                _sums(symbol, rows) / size,
                _sums(raw >= 128, rows) / size,
                _sums(raw == 124, rows) / size,
                np.diff(np.concatenate([[0], np.cumsum(end - begin)])[first]) / many,
                _sums(symbol[end - 1], first) / many,
                _sums(letters[end - 1], first) / many,
                np.bincount(fresh >> params.hash_bits, minlength=len(counts)) / many,
                counts / (1 + _sums(raw == 10, rows)),
                np.log1p(counts),
            )
        ):
            stats[:, j] = value
        chars = pc.cast(part.column("n_chars"), pa.float64()).to_numpy(zero_copy_only=False)
        stats[:, -1] = np.log1p(np.maximum(chars, 0))
    if params.stems and len(hashed):
        row = np.repeat(np.arange(len(counts)), counts)
        prefix = prefix_hash(data)
        found, of = [buckets], [row]
        for size in params.stems:
            long = np.flatnonzero(end - begin > size)
            stem = mix(span_hash(prefix, begin[long], begin[long] + size) + np.uint64(size))
            found.append((stem >> shift).astype(np.int64))
            of.append(row[long])
        row = np.concatenate(of)
        buckets = np.concatenate(found)[np.argsort(row, kind="stable")]
        counts = np.bincount(row, minlength=len(counts))
    return buckets, counts, stats


def _inputs(docs: DataFrame, *more: Column) -> DataFrame:
    """Only what a score may see (and what passes through): the text and its length."""
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(*more, "text", chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, params: Params) -> Model:
    """`labels`: doc_id, label (0 or 1; other values and nulls are left out).

    Rows are joined on doc_id; other columns of the documents may have any name.  Without
    rows of both classes the model knows the share only.
    """
    chosen = labels.where("label in (0, 1) and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("key"), F.col("label").cast("int").alias("label")
    )
    chosen = chosen.orderBy(F.xxhash64(F.lit(params.seed), "key"), "key", "label").limit(params.sample)
    chosen = materialize(chosen, "sample")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            buckets, counts, stats = extract(part, params)
            lists = np.split(buckets, np.cumsum(counts)[:-1])
            yield pa.record_batch(
                [
                    part.column("label"),
                    pa.array([np.unique(x).astype(np.int32) for x in lists], pa.list_(pa.int32())),
                    pa.array(list(stats), pa.list_(pa.float64())),
                ],
                ["label", "buckets", "stats"],
            )

    # The labels have a bounded number of narrow rows, so they may be broadcast.
    keyed = _inputs(docs, F.col("doc_id").cast("long").alias("key"))
    joined = keyed.join(F.broadcast(chosen), "key").select("label", "text", "n_chars")
    sample = materialize(
        joined.mapInArrow(spread, "label int, buckets array<int>, stats array<double>"), "sample"
    )
    if sample.count() > params.sample:
        sample = sample.orderBy(F.xxhash64(F.lit(params.seed), *sample.columns)).limit(params.sample)
    found = sample.orderBy("label", F.xxhash64("buckets", "stats")).toArrow()
    label = found.column("label").to_numpy().astype(np.float32)
    stats = [c.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS)) for c in found.column("stats").chunks]
    stats = np.concatenate([np.zeros((0, len(STATS))), *stats])
    lists = found.column("buckets").chunks
    del found
    marks = np.linspace(0, 1, params.bins + 1)[1:-1]
    edges = [
        np.quantile(c[~np.isnan(c)], marks) if (~np.isnan(c)).any() else np.zeros(len(marks))
        for c in stats.T
    ]
    n1 = int(label.sum())
    bias = float(np.log((n1 + 0.5) / (len(label) - n1 + 0.5)))
    size = (1 << params.hash_bits) + (len(STATS) * (params.bins + 1) if params.structure else 0)
    edges = np.array(edges) if params.structure else np.zeros((0, len(marks)))
    model = Model(params, edges, bias, np.zeros(size, np.float32), np.zeros((size, params.rank), np.float32))
    if not 0 < n1 < len(label):
        return model
    bins = model.bins_of(stats).astype(np.int32) if params.structure else np.zeros((len(label), 0), np.int32)
    buckets, counts = _gathered(lists, bins)
    bias, w, v = fit(buckets, counts, label, size, params)
    return Model(params, edges, bias, w, v)


def _gathered(lists: list[pa.Array], bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of all rows, those of a row's list and then its `bins`, and how many each
    row has.  `lists` is emptied on the way, so the driver never holds all of it twice."""
    counts = [pc.list_value_length(part).to_numpy(zero_copy_only=False).astype(np.int64) for part in lists]
    out = np.empty(sum(int(c.sum()) for c in counts) + bins.size, np.int32)
    row = place = 0
    for own in counts:
        more = bins[row : row + len(own)]
        values = lists.pop(0).flatten().to_numpy(zero_copy_only=False)
        values = np.insert(values, np.repeat(np.cumsum(own), bins.shape[1]), more.ravel())
        out[place : place + len(values)] = values
        row, place = row + len(own), place + len(values)
    return out, np.concatenate(counts) + bins.shape[1]


class _Batch:
    """Some rows of the sample, both by row and by feature."""

    def __init__(self, feature: np.ndarray, counts: np.ndarray, label: np.ndarray):
        self.feature, self.label = feature, label
        self.some = np.flatnonzero(counts)
        self.begin = (np.cumsum(counts) - counts)[self.some]
        order = np.argsort(feature, kind="stable")
        self.row = np.repeat(np.arange(len(counts), dtype=np.min_scalar_type(len(counts))), counts)[order]
        ordered = feature[order]
        self.first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))[: len(ordered)]
        self.held = ordered[self.first]

    def by_row(self, values: np.ndarray, squares: bool = False) -> np.ndarray:
        """Sums of the values of a row's features, or of all squares of these."""
        total = np.zeros((len(self.label), *values.shape[1 : 1 if squares else None]), np.float32)
        total[self.some] = _sums_of(values, self.feature, self.begin, squares)
        return total

    def by_feature(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value per row, by feature held."""
        return _sums_of(values, self.row, self.first)


#: Values that are taken together at a time.
_TAKEN = 1 << 16


def _sums_of(values: np.ndarray, index: np.ndarray, begin: np.ndarray, squares: bool = False) -> np.ndarray:
    """Sums of values[index] over the runs that start at `begin`, a few runs at a time."""
    out = np.empty((len(begin), *values.shape[1 : 1 if squares else None]), np.float32)
    cuts = np.unique(np.searchsorted(begin, np.arange(0, len(index) + _TAKEN, _TAKEN)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        end = begin[b] if b < len(begin) else len(index)
        part = values[index[begin[a] : end]]
        if squares:
            part = (part * part).sum(1)
        out[a:b] = np.add.reduceat(part, begin[a:b] - begin[a], axis=0)
    return out


def fit(
    buckets: np.ndarray, counts: np.ndarray, label: np.ndarray, size: int, p: Params
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors for rows of `counts` features each, none twice in a row.

    Logistic loss; Adam steps, each followed by the proximal step of the penalties: weights
    are moved towards zero, and so are the lengths of the factors.
    """
    n = len(label)
    share = np.zeros(size, np.int64)
    for k in range(0, len(buckets), 1 << 18):  # counting makes wide copies
        share += np.bincount(buckets[k : k + (1 << 18)], minlength=size)
    seen = np.flatnonzero(share)
    share = share[seen] / n
    place = np.zeros(size, np.int32)
    place[seen] = np.arange(len(seen))
    odds = (label.sum() + 0.5) / (n + 1)
    noise = np.sqrt((share * (1 - share) + 0.25 / n) * odds * (1 - odds) / n).astype(np.float32)
    draw = np.random.default_rng(p.seed)
    start = np.cumsum(counts) - counts
    batches = []
    for rows in np.array_split(draw.permutation(n), max(1, -(-n // p.batch))):
        own = counts[rows]
        at = np.repeat(start[rows] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        batches.append(_Batch(place[buckets[at]], own, label[rows]))
    theta = [
        np.array([np.log(odds / (1 - odds))], np.float32),
        np.zeros(len(seen), np.float32),
        draw.normal(0, 0.05, (len(seen), p.rank)).astype(np.float32),
    ]
    mean = [np.zeros_like(t) for t in theta]
    square = [np.zeros_like(t) for t in theta]
    reach = 0.0  # typical length of a row's summed factors: factors' gradients grow with it
    for step in range(1, p.steps + p.free + 1):
        batch, alone, free = batches[(step - 1) % len(batches)], step <= p.alone, step > p.steps
        b, w, v = theta
        if step == p.steps + 1:
            held = None, (w != 0).astype(np.float32), v.any(axis=1).astype(np.float32)[:, None]
            for k in (1, 2):
                mean[k] *= held[k]
        own = v * np.float32(not alone)
        sums = batch.by_row(own)
        raw = b + batch.by_row(w) + 0.5 * ((sums * sums).sum(1) - batch.by_row(own, squares=True))
        rms = float(np.sqrt((sums * sums).sum(1).mean()))
        reach = 0.9 * reach + 0.1 * rms if reach else rms
        g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - batch.label) / len(batch.label)
        g = g.astype(np.float32)
        down = batch.by_feature(g)
        grads = [np.array([g.sum()], np.float32), p.decay / n * w, p.decay / n * v]
        grads[1][batch.held] += down
        if not alone:
            grads[2][batch.held] += batch.by_feature(g[:, None] * sums) - v[batch.held] * down[:, None]
        rate = p.rate * min(1, 2 * (1 - step / (p.steps + p.free * free + 1)))
        for k in range(2 if alone else 3):
            t, m, s, age = theta[k], mean[k], square[k], step - p.alone * (k == 2)
            m += 0.1 * (grads[k] - m)
            s += 0.001 * (grads[k] * grads[k] - s)
            scale = rate / (np.sqrt(s / (1 - 0.999**age)) + 1e-8)
            t -= scale * (m / (1 - 0.9**age))
            if free and k:
                t *= held[k]
            elif k == 1:
                t[:] = np.sign(t) * np.maximum(np.abs(t) - scale * p.strict * noise, 0)
            elif k == 2:
                ripe = min(1.0, (step - p.alone) / (0.7 * (p.steps - p.alone)))
                least = scale.mean(1) * reach * (p.loose + (p.tight - p.loose) * ripe) * noise
                t *= np.maximum(0, 1 - least / np.maximum(np.sqrt((t * t).sum(1)), 1e-9))[:, None]
    w, v = np.zeros(size, np.float32), np.zeros((size, p.rank), np.float32)
    w[seen], v[seen] = theta[1], theta[2]
    return float(theta[0][0]), w, v


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash, score for every row; the model goes along by broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches, "text"):
            buckets, counts, stats = extract(part, known.params)
            row, feature = known.features(buckets, counts, stats)
            yield pa.record_batch(
                [part.column(0), pa.array(known.score(row, feature, part.num_rows))], ["row", "score"]
            )

    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score",)])
    row = kept.alias("row")
    schema = _inputs(docs, row).select("row").schema.add("score", "double")
    return _inputs(docs, row).mapInArrow(scored, schema).select("row.*", "score")
