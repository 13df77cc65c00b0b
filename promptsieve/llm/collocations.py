"""Frequent phrases and how strongly their parts hold together, by direct-address tiling.

A phrase of k words is a pair: a frequent phrase of k - 1 words and a frequent word.  Both
are numbered by falling frequency, so the pairs of the most frequent ones fall into few
square tiles of the table of pairs.  Tasks count a full tile by one `bincount` over its
cells, and what is thinly spread by sorting coordinates.  The pairs that turn out frequent
are numbered again and become the left side of the next length.

Only counts are shuffled.  What is broadcast has a fixed size: the keys of the `ranked` most
frequent phrases, and a bit field that spares pairs with a rare part; a pair that it lets
through, or one beyond the ranks, is counted by its coordinates all the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bits import Bits
from .tables import materialize
from .text import flat, fold, mix, slices, word_hashes, words

#: A tile has 2^SIDE rows and columns.
SIDE = 9
#: Pieces end at these characters; within a piece, words are parted by blanks and tabs.
BREAKS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[list(GAPS)] = True


@dataclass(frozen=True)
class Params:
    """Phrases of 2 to `longest` words found `least` times or more; of each language the first
    `top`.  A phrase goes if a longer one has `share` percent of its occurrences.  The
    `ranked` most frequent phrases of a length have tiles (2^16 at most); tasks count
    `buffer` pairs at a time."""

    longest: int = 5
    least: int = 100
    top: int = 2000
    share: int = 100
    ranked: int = 1 << 16
    buffer: int = 1 << 21


@dataclass(frozen=True)
class Level:
    """The frequent phrases of one length, as far as a task knows them."""

    bits: Bits
    keys: np.ndarray  # of the most frequent, ascending
    rank: np.ndarray  # of these keys
    by_rank: np.ndarray

    @staticmethod
    def of(phrases: DataFrame, ranked: int) -> Level:
        top = phrases.orderBy(F.desc("a"), "key").limit(ranked).select("key").toPandas()
        by_rank = top["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(by_rank)
        return Level(Bits.of(phrases, "key"), by_rank[order], order.astype(np.int64), by_rank)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key, -1 beyond the ranked ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], -1)


def longer(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of the phrase `left` with the word `right` behind it."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def tiles(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, count) of pairs of ranks below 2^16: full tiles by their cells, the
    others by sorted coordinates."""
    low = (1 << SIDE) - 1
    code = ((left >> SIDE << 16 - SIDE | right >> SIDE) << 2 * SIDE | (left & low) << SIDE | right & low).astype(np.uint32)
    place = (code >> 2 * SIDE).astype(np.uint16)
    order = np.argsort(place, kind="stable")
    code, filled = code[order], np.bincount(place, minlength=1)
    ends = np.cumsum(filled)
    dense = np.flatnonzero(filled >= 1 << 2 * SIDE - 3)
    found = []
    for tile in dense:
        cells = code[ends[tile] - filled[tile] : ends[tile]] & (1 << 2 * SIDE) - 1
        counts = np.bincount(cells, minlength=1 << 2 * SIDE)
        held = np.flatnonzero(counts)
        found.append((tile.astype(np.int64) << 2 * SIDE | held, counts[held]))
    thin = np.ones(len(filled), bool)
    thin[dense] = False
    found.append(np.unique(code[np.repeat(thin, filled)], return_counts=True))
    for codes, counts in found:
        codes = codes.astype(np.int64)
        tile, cell = codes >> 2 * SIDE, codes & (1 << 2 * SIDE) - 1
        across = (1 << 16 - SIDE) - 1
        yield tile >> 16 - SIDE << SIDE | cell >> SIDE, (tile & across) << SIDE | cell & low, counts


def coordinates(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, count) of any keys, by sorted coordinates; a pair may come twice."""
    order = np.argsort(longer(left, right))
    left, right = left[order], right[order]
    new = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))[: len(left)]
    return left[new], right[new], np.diff(np.append(new, len(left)))


def _keys(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """All bytes in lower case, begin, end, row and key of each word, and whether the next
    word follows in the same piece."""
    data, rows = flat(part.column("text"))
    data = fold(data)
    begin, end, counts = words(data, rows, _BETWEEN)
    row = np.repeat(np.arange(part.num_rows), counts)
    own = part.column("own").to_numpy().view(np.uint64)
    keys = mix(word_hashes(data, begin, end) ^ own[row])
    breaks = np.append(0, np.cumsum(_BREAK[data]))
    follows = np.zeros(len(begin), bool)
    follows[:-1] = (breaks[end[:-1]] == breaks[begin[1:]]) & (row[1:] == row[:-1])
    return data, begin, end, row, keys, follows


_WORD = "lang string, word string, key long, a long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of about 16 slices at a time; all words of a language: null."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        data = np.concatenate([h[0] for h in held])
        shift = np.cumsum([0] + [len(h[0]) for h in held])
        begin = np.concatenate([h[1] + s for h, s in zip(held, shift)])
        end = np.concatenate([h[2] + s for h, s in zip(held, shift)])
        keys = np.concatenate([h[3] for h in held])
        langs = pa.chunked_array([h[4] for h in held]).combine_chunks()
        _, at, counts = np.unique(keys, return_index=True, return_counts=True)
        size = end[at] - begin[at]
        ends = np.cumsum(size)
        spelt = data[np.repeat(begin[at] - (ends - size), size) + np.arange(size.sum())]
        word = pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(spelt)
        ).cast(pa.string())
        totals = langs.value_counts()
        lang, every = totals.field("values"), totals.field("counts")
        held.clear()
        return pa.record_batch(
            [
                pa.concat_arrays([langs.take(pa.array(at)), lang]),
                pa.concat_arrays([word, pa.nulls(len(lang), pa.string())]),
                pa.concat_arrays([pa.array(keys[at].view(np.int64)), pa.nulls(len(lang), pa.int64())]),
                pa.concat_arrays([pa.array(counts.astype(np.int64)), every]),
            ],
            ["lang", "word", "key", "a"],
        )

    size = 0
    for part in slices(batches, "text"):
        data, begin, end, row, keys, _ = _keys(part)
        lang = part.column("lang").take(pa.array(row))
        held.append((data, begin, end, keys, lang))
        size += len(data)
        if size >= 1 << 24:
            yield flush()
            size = 0
    if held:
        yield flush()


def _count_pairs(levels: list[Level], params: Params):
    """Counts of the phrases one word longer than the last level."""
    first, last = levels[0], levels[-1]

    def pack(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(counts.astype(np.int64))],
            ["left", "right", "a"],
        )

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        left, right = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        held.clear()
        i, j = last.ranks(left), first.ranks(right)
        both = (i >= 0) & (j >= 0)
        if both.any():
            for a, b, n in tiles(i[both], j[both]):
                yield pack(last.by_rank[a], first.by_rank[b], n)
        if not both.all():
            yield pack(*coordinates(left[~both], right[~both]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text"):
            *_, keys, follows = _keys(part)
            phrase, alive = keys, first.bits.has(keys)
            for k in range(1, len(levels) + 1):
                # a phrase can be frequent only if it is so without its last and its first word
                at = np.flatnonzero(alive[:-1] & alive[1:] & follows[:-1])
                if k == len(levels):
                    break
                phrase, before = np.zeros_like(keys), phrase
                phrase[at] = longer(before[at], keys[at + k])
                alive = np.zeros(len(keys), bool)
                alive[at] = levels[k].bits.has(phrase[at])
            held.append((phrase[at], keys[at + len(levels)]))
            size += len(at)
            if size >= params.buffer:
                yield from flush(held)
                size = 0
        if size:
            yield from flush(held)

    return count


def _longer(left: str, right: str) -> Column:
    """Key of a phrase and the word behind it, from two columns of keys."""

    @F.pandas_udf("long")
    def key(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = (c.to_numpy(np.int64).view(np.uint64) for c in (a, b))
        return pd.Series(longer(a, b).view(np.int64))

    return key(left, right)


def phrases(docs: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, n), and (lang, size, phrase, a) of all phrases of one to `longest`
    words found `least` times or more."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.where("text is not null").select(
        lang.alias("lang"), F.xxhash64(lang).alias("own"), F.col("text").cast("string").alias("text")
    )
    found = texts.mapInArrow(_count_words, _WORD).groupBy("lang", "word").agg(
        F.any_value("key").alias("key"), F.sum("a").alias("a")
    )
    found = materialize(found.where(F.col("word").isNull() | (F.col("a") >= params.least)), "words")
    totals = found.where("word is null").select("lang", F.col("a").alias("n"))
    word = found.where("word is not null").select("lang", F.col("word").alias("phrase"), "key", "a")
    tables, levels = [word], [Level.of(word, params.ranked)]
    for _ in range(2, params.longest + 1):
        pairs = texts.mapInArrow(_count_pairs(levels, params), "left long, right long, a long")
        pairs = pairs.groupBy("left", "right").agg(F.sum("a").alias("a")).where(F.col("a") >= params.least)
        pairs = (
            pairs.join(tables[-1].select(F.col("key").alias("left"), "lang", "phrase"), "left")
            .join(word.select(F.col("key").alias("right"), F.col("phrase").alias("next")), "right")
            .select("lang", F.concat_ws(" ", "phrase", "next").alias("phrase"), _longer("left", "right").alias("key"), "a")
        )
        tables.append(materialize(pairs, "phrases"))
        levels.append(Level.of(tables[-1], params.ranked))
    every = None
    for size, table in enumerate(tables, 1):
        table = table.select("lang", F.lit(size).alias("size"), "phrase", "a")
        every = table if every is None else every.unionByName(table)
    return totals, every


def _spans(words: Column, size: Column, shortest: int) -> Column:
    """All contiguous parts of `shortest` words or more, but for the whole."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(shortest), size - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), size - n + 1), lambda at: F.array_join(F.slice(words, at, n), " ")
            ),
        )
    )


def collocations(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    Words are parted by blanks and tabs inside pieces that end at `.,;:!?` and line ends;
    A-Z are lowered.  n counts all words of a language, a all occurrences of the phrase
    within pieces, overlaps included.  A cut into a first part (l occurrences) and a rest
    (r) scores floor(1000 a n / (l r)); the lowest cut counts, ties to the shortest first
    part.  A phrase goes if a longer frequent one holds it `share` percent as often.  Ties in
    rank go by a, then by the phrase's bytes.  A null text has no words, a null language is
    `und`; repeated rows count each; other columns are ignored.
    """
    totals, every = phrases(docs, params)
    many = every.where("size > 1").withColumn("words", F.split("phrase", " "))
    size = F.col("size")
    cuts = many.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, size), " ").alias("rest"),
    )
    part = lambda key, value: every.select("lang", F.col("phrase").alias(key), F.col("a").alias(value))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # at most 10 n, but the products need more than 64 bits
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(totals, "lang")
    cuts = cuts.withColumn("up", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn(
        "down", wide("l") * wide("r")
    )
    best = (
        cuts.withColumn("score", F.expr("up div down"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    inside = (
        many.where("size > 2")
        .select("lang", F.col("a").alias("longer"), F.explode(_spans(F.col("words"), size, 2)).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    kept = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < params.share * F.col("a"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= params.top)
        .select(
            "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
        )
    )
