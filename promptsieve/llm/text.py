"""Text as arrays: whole Arrow columns of strings become bytes, words and hashes.

Used inside `mapInArrow` tasks.  Work goes over slices of about one megabyte, so a task
needs a fixed amount of memory besides its longest single text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def lowered(text: Column) -> Column:
    """A-Z in lower case; nothing else changes."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a whole text (null as empty)."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole), F.xxhash64(F.lit(1), whole)]


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about SLICE_BYTES of text each, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(row, stop - row)
            row = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings, and where each row starts (one more at the end)."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def fold(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def words(
    data: np.ndarray, rows: np.ndarray, blank: np.ndarray = _BLANK
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words each row has; `blank` marks the bytes
    between words."""
    solid = ~blank[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.diff(np.searchsorted(begin, rows))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = have = np.cumprod(steps)
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial hashes of 64-bit values, from which `span_hash` reads any span's."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power("up", _BASE, len(values)), out=total[1:])
    return total


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """The same of bytes."""
    return prefix_sums(_CODES[data])


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [begin, end): equal for equal bytes wherever they stand."""
    down = _power("down", _INVERSE, len(prefix))
    return mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), begin, end)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and how many each row has.

    A row of fewer words has its whole sequence as one shingle; one without words has none.
    """
    n = len(hashes)
    begin = np.concatenate([[0], np.cumsum(counts)])
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if not n:
        return np.zeros(0, np.uint64), many
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total[: n - j] += hashes[j:] * (mix(np.array([j + 1], np.uint64)) | np.uint64(1))
    whole = counts >= width
    place = np.arange(n) - np.repeat(begin[:-1], counts)
    keep = np.repeat(whole, counts) & (place <= np.repeat(counts - width, counts))
    short = np.flatnonzero(~whole & (counts > 0))
    for row in short:  # at most width - 1 words each
        own = hashes[begin[row] : begin[row + 1]]
        weight = np.arange(len(own), dtype=np.uint64) * np.uint64(2) + np.uint64(3)
        total[begin[row]] = (own * weight).sum() ^ np.uint64(len(own))
    keep[begin[short]] = True
    return mix(total[keep]), many


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending within the row, and their number."""
    values, ends = values.copy(), np.cumsum(counts)
    for begin, end in zip(ends - counts, ends):
        values[begin:end].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[(ends - counts)[counts > 0]] = True
    return values[new], np.diff(np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])])
