"""Benchmark decontamination with canonical templates.

Numbers, names and units become typed placeholders, one for a number with or without its
unit, one for a number or a name of several words, and windows of words are joined by hash: once as written (in lower case) and once as templates.  A template match counts only
if the values in its slots are consistent: along one alignment of document and item, a value
of the item stands for that value of the document it meets in most windows, and windows that
say otherwise are left out, they alone.  Two values of an item may become equal by chance.
So questions are found again after their names and numbers were exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bits import Bits
from .tables import materialize
from .text import flat, fold, mix, prefix_hash, slices, span_hash, words

# Words that stand for numbers, and units of measure.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres mg g kg oz lb lbs gram grams kilogram kilograms ounce ounces "
    "pound pounds ton tons ml l liter liters litre litres gallon gallons cup cups s sec second seconds min "
    "minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro "
    "euros percent % $ km/h mph degree degrees"
).split()


@dataclass(frozen=True)
class Params:
    """Windows of `width` words; an item is found in a document that holds `coverage` of its
    windows, or `run` of them, as written, in one piece.  Shorter items are found where they
    are a whole line."""

    width: int = 5
    coverage: float = 0.5
    run: int = 6


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%"]] = True
_NUMERIC = np.zeros(256, bool)
_NUMERIC[[ord(c) for c in "0123456789.,:/+-%$"]] = True


def _listed(values: list[str]) -> np.ndarray:
    data, rows = flat(pa.array(values))
    return np.sort(span_hash(prefix_hash(data), rows[:-1], rows[1:]))


_NUMBER, _UNIT, _NAME = 1, 2, 3
_NUMBERS, _MEASURES = _listed(NUMBER_WORDS), _listed(UNITS)


def _member(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


@dataclass(frozen=True)
class Words:
    """Words of some rows, and the tokens of their templates: a word, or several that fill
    one slot (a number with its unit, a number of several words, a run of name words)."""

    word: np.ndarray  # hash of each word in lower case
    counts: np.ndarray  # words per row
    token: np.ndarray  # token of each word
    value: np.ndarray  # hash of each token's words
    template: np.ndarray  # its type if it is a slot, else its value
    slot: np.ndarray
    tokens: np.ndarray  # tokens per row
    opens: np.ndarray  # whether a line begins with the word,
    closes: np.ndarray  # and ends with it


def _canonical(raw: np.ndarray, rows: np.ndarray) -> Words:
    data = fold(raw)
    n = len(data)
    # capital letters with accents, two bytes each
    accent = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    data[1:][accent] += 32
    begin, end, counts = words(data, rows)
    row = np.repeat(np.arange(len(counts)), counts)
    lines = np.append(0, np.cumsum(data == 10))
    apart = np.ones(len(begin) + 1, bool)  # a line or row begins with the word
    apart[1:-1] = (row[1:] != row[:-1]) | (lines[begin[1:]] > lines[end[:-1]])
    # Punctuation at the edges goes, unless nothing else is there.
    solid = ~_PUNCTUATION[data]
    after = np.minimum.accumulate(np.where(solid, np.arange(n), n)[::-1])[::-1] if n else begin
    before = np.maximum.accumulate(np.where(solid, np.arange(n), -1))
    low, high = after[begin], before[end - 1] + 1
    some = low < high
    bare = np.where(some, low, begin) == begin, np.where(some, high, end) == end
    begin, end = np.where(some, low, begin), np.where(some, high, end)
    prefix = prefix_hash(data)
    word = span_hash(prefix, begin, end)
    sums = lambda mask: np.append(0, np.cumsum(mask))
    digits, numeric = sums((data >= 48) & (data <= 57)), sums(_NUMERIC[data])
    number = (digits[end] > digits[begin]) & (numeric[end] - numeric[begin] == end - begin)
    spelt = _member(word, _NUMBERS)
    number |= spelt
    unit = _member(word, _MEASURES)
    # A number written together with its unit is one slot.
    lead = np.append(_NUMERIC[data], False)
    stop = np.minimum.accumulate(np.where(lead[:n], n, np.arange(n))[::-1])[::-1] if n else begin
    split = np.minimum(stop[begin], end) if n else begin
    glued = (digits[split] > digits[begin]) & (split < end)
    glued[glued] = _member(span_hash(prefix, split[glued], end[glued]), _MEASURES)
    first = raw[begin] if n else raw
    second = raw[np.minimum(begin + 1, n - 1)] if n else raw
    name = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    kind = np.select([number, unit, glued, name], [_NUMBER, _UNIT, _NUMBER, _NAME], 0)
    # Neighbours without punctuation between them that fill one slot.
    joins = np.zeros(len(begin), bool)
    tight = (row[1:] == row[:-1]) & bare[1][:-1] & bare[0][1:]
    joins[1:] = tight & (
        (kind[1:] == _NAME) & (kind[:-1] == _NAME)
        | number[:-1] & (unit[1:] | number[1:] & (spelt[1:] | spelt[:-1]))
    )
    token = np.cumsum(~joins) - 1
    head = np.flatnonzero(~joins)
    turn = mix((np.arange(len(begin)) - head[token]).astype(np.uint64) + np.uint64(77)) | np.uint64(1)
    value = np.add.reduceat(np.where(joins, word * turn, word), head) if len(head) else word
    kind = kind[head]
    tokens = np.bincount(row[head], minlength=len(counts))
    template = np.where(kind > 0, mix(kind.astype(np.uint64)), value)
    return Words(word, counts, token, value, template, kind > 0, tokens, apart[:-1], apart[1:])


def _windows(values: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(max(len(values) - width + 1, 0), np.uint64)
    for j in range(width):
        total += values[j : j + len(total)] * (mix(np.array([j + 11], np.uint64)) | np.uint64(1))
    return mix(total)


_HIT = "name string, mark long, hash long, at int, word int, slots array<long>"


def _places(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place in it of each position, and whether a window fits from there."""
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, place, place <= counts[row] - width


def _found(w: Words, width: int, short: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, hash, token place, word place, first token if it has slots) of all windows."""
    row, place, fits = _places(w.counts, width)
    own, spot, typed = _places(w.tokens, width)
    # where the token of a word stands in its row; no later than a template window can begin
    stand = np.minimum(spot[w.token], np.maximum(w.tokens[row] - width, 0))
    at = np.flatnonzero(fits)
    yield row[at], _windows(w.word, width)[at], stand[at], place[at], np.full(len(at), -1)
    slots = np.append(0, np.cumsum(w.slot))
    n = max(len(w.value) - width + 1, 0)
    at = np.flatnonzero(typed[:n] & (slots[width : width + n] > slots[:n]))
    yield own[at], _windows(w.template, width)[at] ^ np.uint64(0x2545F4914F6CDD1D), spot[at], np.full(len(at), -1), at
    for size in range(1, width if short else 1):
        _, _, fits = _places(w.counts, size)
        at = np.flatnonzero(fits)
        at = at[w.opens[at] & w.closes[at + size - 1]]
        yield row[at], _windows(w.word, size)[at] ^ mix(np.array([size], np.uint64)), stand[at], np.full(len(at), -1), np.full(len(at), -1)


def _finder(width: int, bits: Bits | None, short: bool):
    """Windows of every text, plain and as templates, and short lines; with `bits`, only
    possible matches."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = _canonical(*flat(part.column("text")))
            for row, hashes, at, word, first in _found(w, width, short):
                hashes = hashes.view(np.int64)
                keep = np.flatnonzero(bits.has(hashes)) if bits else np.arange(len(hashes))
                of = pa.array(row[keep])
                seen = first[keep][:, None] + np.arange(width)
                inside = np.zeros(seen.shape, bool)
                typed = first[keep] >= 0
                inside[typed] = w.slot[seen[typed]]
                many = np.append(0, np.cumsum(inside.sum(1))).astype(np.int32)
                values = w.value[seen[inside]].view(np.int64)
                yield pa.record_batch(
                    [
                        part.column("name").take(of), part.column("mark").take(of), pa.array(hashes[keep]),
                        pa.array(at[keep].astype(np.int32)), pa.array(word[keep].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(many), pa.array(values)),
                    ],
                    ["name", "mark", "hash", "at", "word", "slots"],
                )

    return find


def _named(texts: DataFrame, key: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return texts.select(F.col(key).cast("string").alias("name"), F.xxhash64(text).alias("mark"), text.alias("text"))


def find_items(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """(name, mark, item_id, coverage): documents, by doc_id as text and text hash, and the
    benchmark items they hold.  Equal items are one, called by their smallest item_id."""
    items = benchmark.where("text is not null").groupBy("text").agg(
        F.min(F.col("item_id").cast("long")).alias("item_id")
    )
    # Items are found in documents through the windows they consist of; an item too short
    # for one is a window of its own.
    windows = _named(items, "item_id").mapInArrow(_finder(params.width, None, True), _HIT)
    whole = F.max(F.col("word") >= 0).over(W.partitionBy("name"))
    item_windows = materialize(
        windows.withColumn("long", whole).where("word >= 0 or size(slots) > 0 or not long"), "items"
    )
    item_windows = item_windows.select(
        F.col("name").cast("long").alias("item_id"), "hash", F.col("at").alias("item_at"),
        F.col("word").alias("item_word"), F.col("slots").alias("item_slots"),
    )
    sizes = item_windows.groupBy("item_id").agg(F.count_distinct("item_at").alias("size"))
    bits = Bits.of(item_windows.select("hash").distinct(), "hash")
    hits = materialize(_named(docs, "doc_id").mapInArrow(_finder(params.width, bits, True), _HIT), "hits")
    # hits of one hash may be a third of all: the adaptive join splits them
    matched = hits.join(item_windows, "hash").withColumn("shift", F.col("at") - F.col("item_at"))
    matched = materialize(matched.drop("hash"), "hits")
    line = ["name", "mark", "item_id", "shift"]
    typed = matched.where("size(slots) > 0").select(*line, "item_at", "item_slots", "slots").distinct()
    pairs = (
        typed.where("size(slots) = size(item_slots)")
        .select(*line, "item_at", F.explode(F.arrays_zip("item_slots", "slots")).alias("p"))
        .select(*line, "item_at", F.col("p.item_slots").alias("value"), F.col("p.slots").alias("met"))
    )
    usual = (
        pairs.groupBy(*line, "value", "met")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*line, "value")
        .agg(F.max(F.struct("n", "met")).alias("most"), F.count(F.lit(1)).alias("kinds"))
        .where("kinds > 1")
        .select(*line, "value", F.col("most.met").alias("usual"))
    )
    same = "x.name <=> o.name and x.mark = o.mark and x.item_id <=> o.item_id and x.shift = o.shift"
    odd = (
        pairs.alias("x")
        .join(usual.alias("o"), F.expr(f"{same} and x.value = o.value and x.met != o.usual"), "left_semi")
        .select(*line, "item_at")
        .distinct()
    )
    plain = matched.where("size(slots) = 0").select(*line, "item_at")
    joined = typed.select(*line, "item_at").alias("x").join(
        odd.alias("o"), F.expr(f"{same} and x.item_at = o.item_at"), "left_anti"
    )
    # Windows as written that follow each other in both texts.
    line_of_words = ["name", "mark", "item_id", "gap"]
    runs = (
        matched.where("size(slots) = 0 and word >= 0 and item_word >= 0")
        .select("name", "mark", "item_id", (F.col("word") - F.col("item_word")).alias("gap"), "item_word")
        .distinct()
        .withColumn("n", F.row_number().over(W.partitionBy(*line_of_words).orderBy("item_word")))
        .groupBy(*line_of_words, F.col("item_word") - F.col("n"))
        .agg(F.count(F.lit(1)).alias("run"))
        .groupBy("name", "mark", "item_id")
        .agg(F.max("run").alias("run"))
    )
    # Words put in or left out move the alignment, so an item's windows are counted over all
    # of its alignments in the document.
    best = (
        plain.union(joined)
        .select("name", "mark", "item_id", "item_at")
        .distinct()
        .groupBy("name", "mark", "item_id")
        .agg(F.count(F.lit(1)).alias("found"))
        .join(sizes, "item_id")
        .withColumn("coverage", F.col("found") / F.col("size"))
        .alias("b")
        .join(runs.alias("r"), F.expr("b.name <=> r.name and b.mark = r.mark and b.item_id = r.item_id"), "left")
        .where((F.col("coverage") >= params.coverage) | (F.col("run") >= params.run))
        .select("b.*")
    )
    return best.select("name", "mark", "item_id", "coverage")


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents that hold benchmark items, one row per distinct (doc_id, text): doc_id,
    item_ids (ascending), n_items, coverage (the largest).

    Null and empty texts hold nothing, on either side.  An item of fewer than `width` words
    must be a whole line.  Repeated documents are one row here.  Other columns are ignored.
    """
    found = find_items(docs, benchmark, params)
    return found.groupBy("name", "mark").agg(
        F.first(F.col("name").cast("long")).alias("doc_id"),
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.count_distinct("item_id").alias("n_items"),
        F.max("coverage").alias("coverage"),
    ).select("doc_id", "item_ids", "n_items", "coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns and repeats.

    Null and empty texts hold none.  Only documents that may be found are shuffled.
    """
    found = materialize(find_items(docs, benchmark, params).select("name", "mark").distinct(), "found")
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("string").alias("name"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
    )
    held = held.withColumn("may", Bits.of(found, "mark").may_hold(F.col("mark")))
    rest = held.where("may").alias("d").join(
        found.alias("f"), F.expr("d.name <=> f.name and d.mark = f.mark"), "left_anti"
    )
    return held.where("not may").select("row.*").unionByName(rest.select("row.*"))
