"""Long repeated substrings across all documents, by suffix arrays of shards.

Every string of `length` bytes belongs to the smallest hash among its grams, so equal
strings belong together wherever they stand.  Runs of neighbouring strings with the same
smallest gram are the unit of work:

1. runs whose gram occurs once cannot repeat and are left behind;
2. runs that occur twice with all their bytes repeat as a whole;
3. the others, one of each kind, are dealt into shards by gram, and a suffix array of each
   shard (induced sorting) with its permuted common prefixes shows which strings repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import Bits
from .suffix_array import repeated
from .tables import materialize
from .text import flat, prefix_hash, slices, span_hash


@dataclass(frozen=True)
class Params:
    """Strings of `length` bytes; `gram` bytes a gram; runs of at most `run` strings; about
    `shard` bytes in a suffix array.  A gram with more bytes than that in different runs is
    worked off string by string instead."""

    length: int = 200
    gram: int = 32
    run: int = 2048
    shard: int = 1 << 19


def _smallest(data: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest gram hash of the string at each position, where that gram is the string's
    first, and the prefix hashes."""
    prefix = prefix_hash(data)
    at = np.arange(len(data) - params.gram + 1)
    least = grams = span_hash(prefix, at, at + params.gram)
    window = params.length - params.gram + 1
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    return least, grams[: len(least)] == least, prefix


def _runs(data: np.ndarray, rows: np.ndarray, params: Params):
    """(row, gram, whole-run hash, start in the row, strings) of every run."""
    n = params.length
    if len(data) < n:
        return (np.zeros(0, np.int64),) * 5
    least, leads, prefix = _smallest(data, params)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[: len(least)]
    valid = np.arange(len(least)) + n <= rows[row + 1]
    # A gram that leads a string is gone from the next one; an equal gram further on begins a
    # run of its own, so that strings repeated side by side are in different runs.
    new = np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | leads[:-1])
    begin = np.flatnonzero(new & valid)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 5
    # a run ends where the next one begins or the row has no further string
    stop = np.minimum(np.append(begin[1:], len(least)), rows[row[begin] + 1] - n + 1)
    parts = -(-(stop - begin) // params.run)
    piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, stop = np.repeat(begin, parts) + piece * params.run, np.repeat(stop, parts)
    many = np.minimum(stop - begin, params.run)
    of = row[begin]
    whole = span_hash(prefix, begin, begin + many + n - 1)
    return of, least[begin].view(np.int64), whole.view(np.int64), begin - rows[of], many


_RUNS = "doc string, mark long, gram array<long>, whole array<long>, start array<int>, many array<int>"


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    ends = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind)))


def _find_runs(params: Params):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            row, gram, whole, start, many = _runs(*flat(part.column("text")), params)
            counts = np.bincount(row, minlength=part.num_rows)
            yield pa.record_batch(
                [
                    part.column("doc"),
                    part.column("mark"),
                    _lists(gram, counts, np.int64),
                    _lists(whole, counts, np.int64),
                    _lists(start, counts, np.int32),
                    _lists(many, counts, np.int32),
                ],
                ["doc", "mark", "gram", "whole", "start", "many"],
            )

    return find


_RUN = "doc string, mark long, gram long, whole long, start int, many int"


def _keep_shared(bits: Bits):
    """Runs whose gram may occur twice: a fixed-size filter, so some others stay too."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("gram")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            gram = lists.flatten().to_numpy()
            at = np.flatnonzero(bits.has(gram))
            yield pa.record_batch(
                [
                    batch.column("doc").take(pa.array(row[at])),
                    batch.column("mark").take(pa.array(row[at])),
                    pa.array(gram[at]),
                    *[batch.column(c).flatten().take(pa.array(at)) for c in ("whole", "start", "many")],
                ],
                ["doc", "mark", "gram", "whole", "start", "many"],
            )

    return keep


def _cut(length: int):
    """The bytes of the runs asked for, out of their documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = []
            for text, runs in zip(part.column("text"), part.column("runs")):
                data = text.as_py().encode()
                for r in runs.as_py():
                    found.append((r["gram"], r["whole"], data[r["start"] : r["start"] + r["many"] + length - 1]))
            gram, whole, data = zip(*found) if found else ((), (), ())
            yield pa.record_batch(
                [pa.array(gram, pa.int64()), pa.array(whole, pa.int64()), pa.array(data, pa.binary())],
                ["gram", "whole", "data"],
            )

    return cut


_PARTS = "gram long, whole long, first int, last int"


def _intervals(index: np.ndarray, start: np.ndarray, group: pd.DataFrame) -> pd.DataFrame:
    """Strings [first, last] of each run, from positions in the shard's text."""
    run = np.searchsorted(start, index, "right") - 1
    place = index - start[run]
    new = np.append(True, (np.diff(index) > 1) | (np.diff(run) > 0))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(index)) - 1
    return pd.DataFrame(
        {
            "gram": group["gram"].to_numpy()[run[begin]],
            "whole": group["whole"].to_numpy()[run[begin]],
            "first": place[begin].astype(np.int32),
            "last": place[end].astype(np.int32),
        }
    )


def _search(params: Params):
    def search(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["data"].map(len).to_numpy()
        raw = np.frombuffer(b"\0".join(group["data"]) + b"\0\0", np.uint8)
        text = raw.astype(np.uint16) + 2
        start = np.cumsum(sizes + 1) - sizes - 1
        text[start + sizes] = 1
        text[-1] = 0
        # Runs end in a letter of their own kind; what reaches across it is no string.
        inside = np.zeros(len(text), np.int8)
        inside[start] += 1
        inside[start + np.maximum(sizes - params.length + 1, 0)] -= 1
        found = np.flatnonzero(repeated(text, 258, params.length) & (np.cumsum(inside) > 0))
        if not len(found):
            return pd.DataFrame(columns=["gram", "whole", "first", "last"])
        return _intervals(found, start, group)

    return search


def _strings(length: int):
    """Every string of the runs of a crowded gram, as two hashes."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "data"):
            data, rows = flat(part.column("data"))
            many = np.maximum(np.diff(rows) - length + 1, 0)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row = np.repeat(np.arange(part.num_rows), many)
            prefix = prefix_hash(data)
            at = rows[row] + place
            half = span_hash(prefix, at, at + length // 2)
            yield pa.record_batch(
                [
                    part.column("gram").take(pa.array(row)),
                    part.column("whole").take(pa.array(row)),
                    pa.array(place.astype(np.int32)),
                    pa.array(span_hash(prefix, at, at + length).view(np.int64)),
                    pa.array(half.view(np.int64)),
                ],
                ["gram", "whole", "first", "h1", "h2"],
            )

    return spell


def repeats(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc, mark, spans): byte ranges [begin, end) of the documents that a repeated string
    covers, one row per document that has any; ranges may overlap."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(
        F.col("doc_id").cast("string").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text")
    )
    runs = materialize(
        named.where(F.octet_length("text") >= params.length).mapInArrow(_find_runs(params), _RUNS), "runs"
    )
    shared = runs.select(F.explode("gram").alias("gram")).groupBy("gram").count().where("count > 1")
    bits = Bits.of(shared, "gram")
    runs = materialize(runs.mapInArrow(_keep_shared(bits), _RUN), "runs")

    kinds = materialize(
        runs.groupBy("gram", "whole").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "mark", "start", "many")).alias("at")
        ),
        "runs",
    )
    grams = kinds.groupBy("gram").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum(F.col("at.many") + params.length - 1).alias("bytes")
    ).where("kinds > 1")
    open_kinds = kinds.join(grams, "gram").select("gram", "whole", "bytes", "at.*")
    wanted = materialize(
        open_kinds.groupBy("doc", "mark").agg(
            F.collect_list(F.struct("gram", "whole", "start", "many")).alias("runs")
        ),
        "cut",
    )
    cut = materialize(
        named.where(Bits.of(wanted, "mark").may_hold(F.col("mark")))
        .alias("d")
        .join(wanted.alias("w"), F.expr("d.doc <=> w.doc and d.mark = w.mark"))
        .select("text", "runs")
        .mapInArrow(_cut(params.length), "gram long, whole long, data binary")
        .dropDuplicates(["gram", "whole"]),
        "cut",
    )
    total = cut.agg(F.sum(F.octet_length("data") + 1)).first()[0] or 0
    shards = max(1, -(-int(total) // params.shard))
    crowded = grams.where(F.col("bytes") > params.shard).select("gram")
    parts = (
        cut.join(crowded, "gram", "left_anti")
        .groupBy(F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard"))
        .applyInPandas(_search(params), _PARTS)
    )
    strings = materialize(
        cut.join(crowded, "gram", "left_semi").mapInArrow(
            _strings(params.length), "gram long, whole long, first int, h1 long, h2 long"
        ),
        "cut",
    )
    twice = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    single = strings.join(twice, ["h1", "h2"]).select("gram", "whole", "first", F.col("first").alias("last"))
    found = (
        parts.union(single)
        .groupBy("gram", "whole")
        .agg(F.collect_list(F.struct("first", "last")).alias("parts"))
    )
    known = kinds.select("gram", "whole", (F.col("n") > 1).alias("all")).join(
        found, ["gram", "whole"], "left"
    ).where("all or parts is not null")
    known = materialize(known, "known")
    span = lambda first, last: F.struct(
        (F.col("start") + first).alias("begin"), (F.col("start") + last + params.length).alias("end")
    )
    spans = runs.join(known, ["gram", "whole"]).select(
        "doc",
        "mark",
        F.explode(
            F.when(F.col("all"), F.array(span(F.lit(0), F.col("many") - 1))).otherwise(
                F.transform("parts", lambda p: span(p["first"], p["last"]))
            )
        ).alias("span"),
    )
    return materialize(spans.groupBy("doc", "mark").agg(F.collect_set("span").alias("spans")), "spans")


def _remove(with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            size, gone, many, digest, kept = [], [], [], [], []
            spans = part.column("spans")
            for i, text in enumerate(part.column("text")):
                data = (text.as_py() or "").encode()
                left, count, removed, at = [], 0, 0, 0
                if spans[i].is_valid:
                    end = 0
                    for s in sorted((s["begin"], s["end"]) for s in spans[i].as_py()):
                        if s[0] > end or not count:
                            left.append(data[at : s[0]])
                            at = end = s[0]
                            count += 1
                        if s[1] > end:
                            removed += s[1] - end
                            at = end = s[1]
                left.append(data[at:])
                rest = b"".join(left)
                size.append(len(data))
                gone.append(removed)
                many.append(count)
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [part.column("row"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(digest, pa.string())]
            names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.record_batch(columns, names)

    return remove


def remove_repeats(docs: DataFrame, params: Params = Params(), with_text: bool = False) -> DataFrame:
    """All columns but `text`, plus n_bytes, n_removed, n_spans, kept_sha256 and, if asked
    for, `kept`: the remaining bytes (binary, as a cut may fall inside a character).

    A byte goes if a string of `length` bytes that covers it also starts at another place,
    in the same document or another; both copies go.  Strings are judged on the input.  A
    null text counts as empty; texts shorter than `length` stay whole.  Repeated rows are
    documents of their own, so all their long strings repeat.  Columns of `docs` with the
    names of results are replaced.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text")
    found = repeats(docs, params)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("row")
    held = docs.select(
        row,
        F.col("doc_id").cast("string").alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
        "text",
    )
    # Only texts that may have spans are shuffled to meet them.
    bits = Bits.of(found, "mark")
    held = held.withColumn("may", bits.may_hold(F.col("mark")))
    joined = held.where("may").alias("d").join(
        found.alias("f"), F.expr("d.doc <=> f.doc and d.mark = f.mark"), "left"
    ).select("row", "text", "spans").unionByName(
        held.where("not may").select("row", "text"), allowMissingColumns=True
    )
    schema = joined.select("row").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    if with_text:
        schema = schema.add("kept", "binary")
    out = joined.mapInArrow(_remove(with_text), schema)
    return out.select("row.*", *[F.col(c) for c in schema.names[1:]])
