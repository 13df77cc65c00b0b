"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions, each made in the contexts of the last 0, 1, ... `depth`
bytes.  Every context keeps a Krichevsky-Trofimov estimate per decision, and the weights
of all depths follow from how well each would have coded the training text.

The tree is fitted on counts over all training text.  Every context met at least twice is a
node of its own; those met once share one further child of their node.  Contexts of three
bytes and more are fitted where their counts are, in whole families of equal last three bytes
(bounded by the alphabet, as is the tree of the contexts of 0 to 2 bytes above them), and
each distinct gram is scored there once.  Scores of frequent grams go along with the tasks,
the others are joined block by block.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import materialize
from .text import flat, fold, mix, slices, word_hashes, words

END = 10  # ends a text and fills the contexts before it; never part of a word


@dataclass(frozen=True)
class Params:
    """`known` is the share of tokens from which on a word count is broadcast: at most
    1 / known words; rarer words are joined.  The same holds for scores of grams.  With a
    `share`, contexts below that share of the training bytes are no nodes."""

    depth: int = 5
    share: float = 0.0
    known: float = 2.0**-20


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << (8 * size)) - 1)


def _stream(data: np.ndarray, begin: np.ndarray, end: np.ndarray, counts: np.ndarray, depth: int):
    """The grams (context and byte) of the texts' words, one blank apart, each text closed by
    END; and how many each text has."""
    rows = len(counts)
    last = np.cumsum(counts)
    size = end - begin + 1  # a word and what follows it
    row_size = np.diff(np.append(0, np.cumsum(size))[np.append(0, last)])
    row_size = np.where(counts > 0, row_size, 1) + depth
    start = np.cumsum(row_size) - row_size
    out = np.full(int(row_size.sum()), END, np.uint8)
    if len(begin):
        row = np.repeat(np.arange(rows), counts)
        before = np.cumsum(size) - size
        place = start[row] + depth + before - before[np.minimum(last - counts, len(before) - 1)][row]
        length = end - begin
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(place, length) + step] = data[np.repeat(begin, length) + step]
        gap = np.ones(len(begin), bool)
        gap[last[counts > 0] - 1] = False
        out[(place + length)[gap]] = 32
    gram = np.zeros(len(out) - depth, np.uint64)
    for j in range(depth + 1):
        gram |= out[depth - j : len(out) - j].astype(np.uint64) << np.uint64(8 * j)
    # positions whose byte belongs to the filling of the next text are no events
    at = np.arange(len(gram)) + depth
    fill = at - np.repeat(start, row_size)[depth:] < depth
    return gram[~fill], row_size - depth


class _Tally:
    """Counts of keys, merged as they come and given out before they grow large."""

    limit = 1 << 20

    def __init__(self, kind: int):
        self.kind, self.keys, self.counts, self.size = kind, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 2 * self.limit:
            self.merge()
            if self.size > self.limit:
                yield from self.flush()

    def merge(self) -> None:
        keys = np.concatenate(self.keys)
        self.keys = []
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.concatenate(self.counts)
        self.counts = []
        counts = counts[order]
        self.keys, self.counts, self.size = [keys[first]], [np.add.reduceat(counts, first)], len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.merge()
            for k in range(0, self.size, 1 << 16):
                keys, counts = self.keys[0][k : k + (1 << 16)], self.counts[0][k : k + (1 << 16)]
                yield pa.record_batch(
                    [pa.array(np.full(len(keys), self.kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)],
                    ["kind", "key", "n"],
                )
        self.keys, self.counts, self.size = [], [], 0


def _count(depth: int):
    """Words (kind 0) and grams (1) of training texts, grams of the others (2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, gram, more = _Tally(0), _Tally(1), _Tally(2)
        for part in slices(batches, "text"):
            for trained, grams in ((True, gram), (False, more)):
                own = part.filter(pc.equal(part.column("trained"), trained))
                if not own.num_rows:
                    continue
                raw, rows = flat(own.column("text"))
                data = fold(raw)
                begin, end, counts = words(data, rows)
                if trained:
                    yield from word.add(word_hashes(data, begin, end))
                yield from grams.add(_stream(data, begin, end, counts, depth)[0])
        for tally in (word, gram, more):
            yield from tally.flush()

    return count


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that a KT estimator gives to a zeros and b ones."""

    def gamma(x: np.ndarray) -> np.ndarray:
        values, of = np.unique(x, return_inverse=True)
        return _lgamma(values).astype(float)[of]

    return gamma(a + 0.5) + gamma(b + 0.5) - gamma(a + b + 1.0) - math.log(math.pi)


@dataclass
class Tree:
    """Per depth: contexts (sorted), decisions (context number * 256 + bits so far with a
    leading one, sorted), the chance of a one, the weight of stopping there, and the chance
    of a one in all contexts of the next depth that have no node.

    A part of a tree starts at depth `first`, so `contexts[0]` has that depth; `top` is what
    the decisions of depth `first` tell the depth above: zeros, ones, log probability."""

    depth: int
    contexts: list[np.ndarray]
    nodes: list[np.ndarray]
    one: list[np.ndarray]
    weight: list[np.ndarray]
    other: list[np.ndarray]
    first: int
    top: tuple[np.ndarray, np.ndarray, np.ndarray]

    @staticmethod
    def fit(
        depth: int, context: np.ndarray, at: np.ndarray, byte: np.ndarray, n: np.ndarray, first: int = 0, below=None
    ) -> Tree:
        """From counts of bytes: `at` is the depth of a row's context.  `below` has what the
        part under the last depth tells it: decision (context << 8 | bits), zeros, ones, log
        probability."""
        contexts, nodes, zeros, ones = [], [], [], []
        for d in range(first, depth + 1):
            own = np.flatnonzero(at == d)
            own = own[np.lexsort((byte[own], context[own]))]
            keys, number = np.unique(context[own], return_inverse=True)
            value, count = byte[own].astype(np.int64), n[own].astype(float)
            parts = []
            for j in range(8):  # in this order the rows of a decision stand together
                node = (number << 8) | (1 << j) | (value >> (8 - j))
                begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
                bit = (value >> (7 - j)) & 1
                if len(begin):
                    sums = [np.add.reduceat(count * (bit == b), begin) for b in (0, 1)]
                    parts.append((node[begin], *sums))
            node, a, b = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            order = np.argsort(node)
            contexts.append(keys)
            nodes.append(node[order])
            zeros.append(a[order].astype(float))
            ones.append(b[order].astype(float))
        one = [(b + 0.5) / (a + b + 1) for a, b in zip(zeros, ones)]
        last = depth - first
        weight: list[np.ndarray] = [np.zeros(0)] * (last + 1)
        other: list[np.ndarray] = [np.zeros(0)] * (last + 1)
        for d in range(last, -1, -1):
            own = _log_kt(zeros[d], ones[d])
            if below is None or not len(contexts[d]):
                weight[d], other[d], logs = np.ones(len(own)), one[d], own
            else:
                decision, *sums, logs = below
                parent = np.searchsorted(contexts[d], decision >> np.uint64(8))
                up = np.searchsorted(nodes[d], (parent << 8) | (decision & np.uint64(255)).astype(np.int64))
                size = len(nodes[d])
                a = np.maximum(zeros[d] - np.bincount(up, sums[0], size), 0)
                b = np.maximum(ones[d] - np.bincount(up, sums[1], size), 0)
                split = np.bincount(up, logs, size) + _log_kt(a, b)
                logs = np.logaddexp(own, split) - math.log(2)
                weight[d] = np.exp(own - math.log(2) - logs)
                other[d] = (b + 0.5) / (a + b + 1)
            # children belong to the context without their oldest byte
            up = contexts[d][nodes[d] >> 8] & _mask(max(first + d - 1, 0))
            below = (up << np.uint64(8)) | (nodes[d] & 255).astype(np.uint64), zeros[d], ones[d], logs
        return Tree(depth, contexts, nodes, one, weight, other, first, below)

    def chances(self, gram: np.ndarray, deep: np.ndarray | None = None) -> np.ndarray:
        """Per gram the chances of a one in the eight decisions of its byte.  In a part of a
        tree that starts below depth 0 they are NaN where the gram's context is no node;
        `deep` has the chances under the last depth in the same way."""
        byte = (gram & np.uint64(255)).astype(np.int64)
        numbers, found = [], []
        known = np.ones(len(gram), bool)
        for d, keys in enumerate(self.contexts):
            context = (gram >> np.uint64(8)) & _mask(self.first + d)
            if len(keys):
                number = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
                known = known & (keys[number] == context)
            else:
                number, known = np.zeros(len(gram), np.int64), np.zeros(len(gram), bool)
            numbers.append(number)
            found.append(known)
        out = np.zeros((len(gram), 8))
        for j in range(8):
            bits = (1 << j) | (byte >> (8 - j))
            chance, rest = np.zeros(len(gram)), np.ones(len(gram))
            fallback = np.full(len(gram), np.nan if self.first else 0.5)
            for d in range(len(self.contexts)):
                node = (numbers[d] << 8) | bits
                if not len(self.nodes[d]):
                    chance, rest = chance + rest * fallback, np.zeros(len(gram))
                    break
                at = np.minimum(np.searchsorted(self.nodes[d], node), len(self.nodes[d]) - 1)
                seen = found[d] & (self.nodes[d][at] == node)
                # a decision never met in a known context is even
                p = np.where(seen, self.one[d][at], np.where(found[d], 0.5, fallback))
                w = np.where(seen, self.weight[d][at], 1.0)
                chance += rest * w * p
                rest = rest * (1 - w)
                fallback = np.where(seen, self.other[d][at], 0.5)
            if deep is not None:
                chance += rest * np.where(np.isnan(deep[:, j]), fallback, deep[:, j])
            out[:, j] = chance
        return out

    def log10(self, gram: np.ndarray, deep: np.ndarray | None = None) -> np.ndarray:
        """log10 of the chance of each gram's byte after its context."""
        one = self.chances(gram, deep)
        bits = (gram[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)
        return np.log10(np.where(bits == 1, one, 1 - one)).sum(1)


SHALLOW = 2  # the last depth of the tree that goes along with the tasks


def _rows(keys: np.ndarray, n: np.ndarray, first: int, last: int, least: float):
    """(context, depth, byte, count) of the nodes at the depths `first` to `last`."""
    keys, n = keys[n > 0], n[n > 0]
    parts = []
    for d in range(first, last + 1):
        context = (keys >> np.uint64(8)) & _mask(d)
        of = np.unique(context, return_inverse=True)[1]
        keep = (np.bincount(of, n) >= least)[of] if d and len(of) else np.ones(len(of), bool)
        byte = (keys[keep] & np.uint64(255)).astype(np.int64)
        parts.append((context[keep], np.full(len(byte), d), byte, n[keep]))
    return [np.concatenate(x) for x in zip(*parts)]


_DEEP = "key long, n long, chances array<double>, zeros double, ones double, logs double"


def _deep(depth: int, least: float):
    """From grams sorted by their last three bytes of context: each gram with its chances
    under those, and what the contexts of three bytes tell those of two."""
    first, chunk = SHALLOW + 1, 1 << 17

    def fitted(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        tree = Tree.fit(depth, *_rows(keys, n, first, depth, least), first)
        chances = tree.chances(keys)
        for k in range(0, len(keys), 1 << 14):
            part = chances[k : k + (1 << 14)]
            none = pa.nulls(len(part), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * 8), pa.array(part.ravel()))
            yield pa.record_batch(
                [pa.array(keys[k : k + (1 << 14)].view(np.int64)), pa.array(n[k : k + (1 << 14)]), lists, none, none, none],
                ["key", "n", "chances", "zeros", "ones", "logs"],
            )
        decision, *sums = tree.top
        none = pa.nulls(len(decision), pa.int64()), pa.nulls(len(decision), pa.list_(pa.float64()))
        yield pa.record_batch(
            [pa.array(decision.view(np.int64)), *none, *[pa.array(x) for x in sums]],
            ["key", "n", "chances", "zeros", "ones", "logs"],
        )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n")])
            size += batch.num_rows
            if size < chunk:
                continue
            keys, n = (np.concatenate(x) for x in zip(*held))
            keys = keys.view(np.uint64)
            family = (keys >> np.uint64(8)) & _mask(first)
            cut = len(keys) - int((family == family[-1]).sum())  # the last family may go on
            if cut:
                yield from fitted(keys[:cut], n[:cut])
            held, size = [[keys[cut:].view(np.int64), n[cut:]]], len(keys) - cut
        if size:
            keys, n = (np.concatenate(x) for x in zip(*held))
            yield from fitted(keys.view(np.uint64), n)

    return fit


def _gram_scorer(shared):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            deep = batch.column("chances").flatten().to_numpy(zero_copy_only=False).reshape(-1, 8)
            yield pa.record_batch(
                [batch.column("key"), batch.column("n"), pa.array(tree.log10(keys, deep))], ["key", "n", "log"]
            )

    return scored


@dataclass
class _Often:
    """Scores of frequent grams by hash; where two meet, the more frequent one stays and the
    other is joined like a rare one."""

    keys: np.ndarray
    values: np.ndarray
    bits = 21

    @staticmethod
    def place(gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _Often.bits)).astype(np.int64)

    @staticmethod
    def of(gram: np.ndarray, n: np.ndarray, log: np.ndarray) -> _Often:
        keys = np.full(1 << _Often.bits, np.iinfo(np.uint64).max, np.uint64)
        values = np.zeros(1 << _Often.bits)
        order = np.argsort(n, kind="stable")  # of equal places the last is written
        place = _Often.place(gram[order])
        last = len(place) - 1 - np.unique(place[::-1], return_index=True)[1]
        keys[place[last]], values[place[last]] = gram[order][last], log[order][last]
        return _Often(keys, values)


class _Blocks:
    """Rare grams of many texts: the distinct ones as a list, the texts as places in it."""

    limit = 1 << 22
    parts = 16  # what is sorted at a time, of a block

    def __init__(self, schema: pa.Schema):
        self.schema, self.held, self.size = schema, [], 0

    def add(self, first: int, counts: np.ndarray, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(grams):
            self.held.append((first, counts, grams))
            self.size += len(grams)
        if self.size >= self.limit:
            yield from self.flush()

    def _numbered(self, block: int) -> Iterator[pa.RecordBatch]:
        """The list, by parts of all distinct grams; what is held gets their places instead."""
        part = [(mix(h[2]) % np.uint64(self.parts)).astype(np.uint8) for h in self.held]
        places = [np.empty(len(h[2]), np.int32) for h in self.held]
        first = 0
        for p in range(self.parts):
            chosen = [np.flatnonzero(own == p) for own in part]
            keys, of = np.unique(np.concatenate([h[2][c] for h, c in zip(self.held, chosen)]), return_inverse=True)
            begin = 0
            for own, c in zip(places, chosen):
                own[c] = of[begin : begin + len(c)] + first
                begin += len(c)
            for k in range(0, len(keys), 1 << 16):
                yield self.record(block=block, first=first + k, keys=keys[k : k + (1 << 16)].view(np.int64))
            first += len(keys)
        self.held = [(h[0], h[1], own) for h, own in zip(self.held, places)]

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        block = int.from_bytes(os.urandom(8), "little") >> 1
        yield from self._numbered(block)
        for first, counts, own in self.held:
            # sums do not depend on the order, and sorted places compress well
            own = np.sort((np.repeat(np.arange(len(counts)), counts) << 32) | own) & 0xFFFFFFFF
            step = np.diff(own, prepend=0).astype(np.int32).view(np.uint8).reshape(-1, 4)
            packed = pa.compress(step.T.tobytes(), "zstd", asbytes=True)
            yield self.record(block=block, first=first, lens=counts.astype(np.int32).tobytes(), places=packed)
        self.held, self.size = [], 0

    def record(self, **values) -> pa.RecordBatch:
        return pa.record_batch([pa.array([values.get(f.name)], f.type) for f in self.schema], schema=self.schema)


_ROW = (1 << 63) - 1


def _add_up(parts: pa.Table, listed: pa.Table) -> pa.Table:
    """Sums of the rare grams' scores for the rows of a block."""
    score = np.full(listed.num_rows, np.nan)
    score[listed.column("place").to_numpy()] = listed.column("log").to_numpy()
    rows, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    for first, lens, packed in zip(*(parts.column(c).to_pylist() for c in ("first", "lens", "places"))):
        counts = np.frombuffer(lens, np.int32)
        total = int(counts.sum())
        raw = pa.decompress(packed, 4 * total, "zstd", asbytes=True)
        step = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, total).T).view(np.int32).ravel()
        row = np.repeat(np.arange(len(counts)), counts)
        own = np.bincount(row, score[np.cumsum(step.astype(np.int64))], len(counts))
        rows.append(((np.uint64(first) + np.arange(len(counts), dtype=np.uint64)) & np.uint64(_ROW)).astype(np.int64))
        sums.append(own)
    return pa.table({"row": np.concatenate(rows), "rest": np.concatenate(sums)})


_SCORED = (
    "row long, n_tokens long, n_known long, logs double, score double, rare array<long>, "
    "block long, first long, keys array<long>, lens binary, places binary"
)
_SCORED_NAMES = [f.split()[0] for f in _SCORED.split(", ")]


def _scorer(shared, depth: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, logs = shared.value
        blocks = None
        # written once and then read: an unused number for each row of this task
        number = int.from_bytes(os.urandom(8), "little") >> 1
        for part in slices(batches, "text"):
            raw, rows = flat(part.column("text"))
            data = fold(raw)
            begin, end, counts = words(data, rows)
            hashes = word_hashes(data, begin, end).view(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                often = keys[at] == hashes
            else:
                at, often = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
            sums = np.bincount(row[often], logs[at[often]] if len(keys) else None, len(counts))
            gram, sizes = _stream(data, begin, end, counts, depth)
            place = _Often.place(gram)
            other = table.keys[place] != gram
            starts = np.cumsum(sizes) - sizes
            score = np.add.reduceat(np.where(other, 0.0, table.values[place]), starts)
            first = number & _ROW
            rare = np.bincount(row[~often], minlength=len(counts))
            ids = ((np.uint64(number) + np.arange(part.num_rows, dtype=np.uint64)) & np.uint64(_ROW)).astype(np.int64)
            number = (number + part.num_rows) & _ROW
            none = [pa.nulls(part.num_rows, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())]
            out = pa.record_batch(
                [
                    part.column("kept"),
                    pa.array(ids, pa.int64()),
                    pa.array(counts.astype(np.int64) + 1),
                    pa.array(np.bincount(row[often], minlength=len(counts)).astype(np.int64)),
                    pa.array(sums.astype(float)),
                    pa.array(score),
                    pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum(rare)).astype(np.int32)), pa.array(hashes[~often])
                    ),
                    *none,
                ],
                ["kept", *_SCORED_NAMES],
            )
            blocks = blocks or _Blocks(out.schema)
            yield out
            yield from blocks.add(first, np.add.reduceat(other.astype(np.int64), starts), gram[other])
        if blocks:
            yield from blocks.flush()

    return scored


def score(docs: DataFrame, training: Column, params: Params = Params()) -> DataFrame:
    """The documents' columns but `text`, plus n_tokens, n_known, train_tokens, base_score and
    score (columns of these names are replaced), learned from the rows where `training` holds.

    Texts are their words with A-Z in lower case, one blank apart, closed by an end; `score`
    is the log10 probability of that under the context tree, `base_score` under smoothed word
    counts.  A null or empty text is an end alone.  Repeated rows are trained on and scored
    row by row.  Without training text all decisions are even.
    """
    new = ("text", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    text = F.coalesce("text", F.lit(""))
    trained = F.coalesce(training, F.lit(False))
    train = docs.where(trained)
    tally = materialize(
        docs.select(text.alias("text"), trained.alias("trained"))
        .mapInArrow(_count(params.depth), "kind int, key long, n long")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n")),
        "tally",
    )
    ends = train.count()
    vocabulary = tally.where("kind = 0")
    distinct, tokens = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, distinct = tokens + ends, distinct + (1 if ends else 0)
    known = max(1.0, tokens * params.known)
    often = vocabulary.where(F.col("n") >= known).select("key", "n").toPandas()  # 1 / known words at most
    often = often.sort_values("key")

    spark, depth = docs.sparkSession, params.depth
    last = min(depth, SHALLOW)
    whole, places = tally.where("kind > 0").agg(F.sum(F.when(F.col("kind") == 1, F.col("n"))), F.sum("n")).first()
    least = max(2.0, (whole or 0) * params.share)
    learned = F.when(F.col("kind") == 1, F.col("n")).otherwise(0).alias("n")
    grams = tally.where("kind > 0").select("key", learned)
    grams = grams.groupBy("key").agg(F.sum("n").alias("n"))
    if depth > last:  # whole families come together, several a task
        family = F.shiftrightunsigned("key", 8).bitwiseAND((1 << (8 * (last + 1))) - 1)
        grams = grams.withColumn("family", family).repartition("family").sortWithinPartitions("family")
        deep = materialize(grams.drop("family").mapInArrow(_deep(depth, least), _DEEP), "deep")
    else:
        deep = grams.select("key", "n", F.array(*[F.lit(math.nan)] * 8).alias("chances"))
    # both are bounded by the alphabet: contexts of two bytes, with a byte or its decisions
    low = deep.where("n > 0").groupBy(F.col("key").bitwiseAND((1 << (8 * (last + 1))) - 1).alias("key"))
    low = low.agg(F.sum("n").alias("n")).toPandas()
    below = None
    if depth > last:
        sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "logs")]
        told = deep.where("n is null").groupBy("key").agg(*sums).toPandas()
        below = told["key"].to_numpy(np.int64).view(np.uint64), *(told[c].to_numpy(float) for c in ("zeros", "ones", "logs"))
    keys, n = low["key"].to_numpy(np.int64).view(np.uint64), low["n"].to_numpy(np.int64)
    tree = Tree.fit(last, *_rows(keys, n, 0, last, least), 0, below)
    known_grams = materialize(
        deep.where("n is not null").select("key", "n", "chances").mapInArrow(
            _gram_scorer(spark.sparkContext.broadcast(tree)), "key long, n long, log double"
        ),
        "grams",
    )
    table = known_grams.where(F.col("n") >= max(1.0, (places or 0) * params.known)).toPandas()  # 1 / known grams at most
    table = _Often.of(
        table["key"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(), table["log"].to_numpy(float)
    )
    logs = np.log10(often["n"].to_numpy(float) + 0.1)
    shared = spark.sparkContext.broadcast((table, often["key"].to_numpy(np.int64), logs))

    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("kept")
    inputs = docs.select(kept, text.alias("text"))
    schema = T.StructType([T.StructField("kept", inputs.schema["kept"].dataType, True)])
    for field in T.StructType.fromDDL(_SCORED):
        schema = schema.add(field)
    done = materialize(inputs.mapInArrow(_scorer(shared, depth), schema), "scored")
    scored = done.where("row is not null").drop("block", "first", "keys", "lens", "places")
    listed = done.where("keys is not null").select("block", "first", F.posexplode("keys").alias("at", "key"))
    listed = listed.select(F.col("block").alias("of"), (F.col("first") + F.col("at")).alias("place"), "key").join(
        known_grams.select("key", "log"), "key"
    )
    rest = (
        done.where("lens is not null").select("block", "first", "lens", "places").groupBy("block")
        .cogroup(listed.select("of", "place", "log").groupBy("of"))
        .applyInArrow(_add_up, "row long, rest double")
    )
    rare = (
        scored.select("row", F.explode("rare").alias("key"))
        .join(vocabulary.where(F.col("n") < known).select("key", "n"), "key", "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("rare_logs"),
            F.count("n").alias("rare_known"),
        )
    )
    none = F.lit(0)
    return (
        scored.drop("rare").join(rare, "row", "left").join(rest, "row", "left").select(
            "kept.*",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", none) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
            F.lit(int(tokens)).cast("long").alias("train_tokens"),
            (
                F.col("logs") + F.coalesce("rare_logs", none) + F.lit(math.log10(ends + 0.1))
                - F.col("n_tokens") * F.lit(math.log10(tokens + 0.1 * (distinct + 1)))
            ).alias("base_score"),
            (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
        )
    )
