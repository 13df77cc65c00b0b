"""Passages that stand earlier elsewhere, found by suffix automata of reference shards.

The unit is a window of `window` words.  Every window belongs to the smallest hash among its
grams, so equal windows belong together; a run of neighbours with the same smallest gram
travels as one.  Runs that differ from each other are kinds; a kind is read once, at its
first place, whatever the number of its copies.

1. Grams are counted; runs whose gram occurs once hold nothing that repeats.
2. Kinds are dealt into reference shards by gram.  A task builds the suffix automaton of its
   shard, kinds in the order of their places, and streams the kinds through it: the matching
   statistics give for every window the place where its words first stand.
3. Kinds with very many copies (there is room for `hot` at most) form one more automaton,
   which is broadcast: documents stream through it and drop what it knows from elsewhere.
   The others reach their documents by a join of run keys.

An automaton of all the corpus in every task would make each document meet each shard; so
only the hot shard, whose size is bounded, is broadcast, and the others go to the one task
that has the runs which may match them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Automaton
from .bits import Bits
from .tables import materialize
from .text import flat, mix, prefix_sums, slices, span_hash, word_hashes, words


@dataclass(frozen=True)
class Params:
    """Windows of `window` words, grams of `gram`; about `shard` words in an automaton.  A gram
    whose kinds hold more is worked off window by window.  Kinds with at least 1 / `hot` of
    all runs are broadcast."""

    window: int = 20
    gram: int = 6
    shard: int = 1 << 16
    hot: int = 2048


def _gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each position on, rows not minded."""
    many = max(0, len(hashes) - width + 1)
    total = np.zeros(many, np.uint64)
    for j in range(width):
        total += hashes[j : j + many] * (mix(np.array([j + 1], np.uint64)) | np.uint64(1))
    return mix(total)


def _runs(hashes: np.ndarray, counts: np.ndarray, params: Params):
    """(row, gram, start word in the row, windows) of every run, and its place in `hashes`."""
    none = (np.zeros(0, np.int64),) * 5
    n, grams = params.window, _gram_hashes(hashes, params.gram)
    wide = n - params.gram + 1
    if len(grams) < wide:
        return none
    least = np.lib.stride_tricks.sliding_window_view(grams, wide).min(axis=1)
    rows = np.append(0, np.cumsum(counts))
    row = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    valid = np.arange(len(least)) + n <= rows[row + 1]
    # Once the smallest gram was a window's first, an equal one further on is another.
    leads = grams[: len(least)] == least
    new = np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | leads[:-1])
    begin = np.flatnonzero(new & valid)
    if not len(begin):
        return none
    stop = np.minimum(np.append(begin[1:], len(least)), rows[row[begin] + 1] - n + 1)
    return row[begin], least[begin].view(np.int64), begin - rows[row[begin]], stop - begin, begin


def _hashed(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    data, rows = flat(part.column("text"))
    begin, end, counts = words(data, rows)
    return data, begin, end, counts, word_hashes(data, begin, end)


def _grams(params: Params):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            *_, counts, hashes = _hashed(part)
            yield pa.record_batch([pa.array(_runs(hashes, counts, params)[1])], ["gram"])

    return find


def _shared_runs(bits: Bits, params: Params):
    """Runs whose gram may occur twice: a fixed-size filter, so some others stay too."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            *_, counts, hashes = _hashed(part)
            row, gram, start, many, at = _runs(hashes, counts, params)
            keep = bits.has(gram)
            row, gram, start, many, at = (x[keep] for x in (row, gram, start, many, at))
            whole = span_hash(prefix_sums(hashes), at, at + many + params.window - 1)
            of = pa.array(row)
            yield pa.record_batch(
                [
                    part.column("doc_id").take(of), part.column("mark").take(of), pa.array(gram),
                    pa.array(whole.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)),
                ],
                ["doc_id", "mark", "gram", "whole", "start", "many"],
            )

    return find


_ASKED = ("gram", "whole", "doc_id", "mark", "start", "hot", "size")


def _cut(params: Params):
    """The words of the runs asked for, out of their documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, begin, end, counts, _ = _hashed(part)
            runs = part.column("runs")
            asked = runs.flatten()
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(runs).to_numpy())
            first = (np.cumsum(counts) - counts)[row] + asked.field("start").to_numpy()
            last = first + asked.field("many").to_numpy() + params.window - 2
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(begin[first].tolist(), end[last].tolist())]
            yield pa.record_batch(
                [*[asked.field(c) for c in _ASKED], pa.array(texts, pa.binary())], [*_ASKED, "data"]
            )

    return cut


def _key() -> Column:
    """One value for doc_id, null or not, and mark."""
    return F.concat_ws(":", F.col("mark").cast("string"), F.col("doc_id").cast("string"))


# --- reference shards ---------------------------------------------------------------------

_PLACE = ("doc_id", "mark", "start")


def _in_order(table: pa.Table) -> pa.Table:
    order = pc.sort_indices(table, [(c, "ascending") for c in _PLACE], null_placement="at_start")
    return table.take(order)


def _symbols(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as numbers, the distinct hashes these stand for, begin and end of each row."""
    raw, rows = flat(data)
    begin, end, counts = words(raw, rows)
    alphabet, text = np.unique(word_hashes(raw, begin, end), return_inverse=True)
    ends = np.cumsum(counts)
    return text, alphabet, ends - counts, ends


def _known(place: T.DataType) -> T.StructType:
    """Windows [first, last] of a kind that stand earlier in another one; of a hot kind also
    the first place of each window, and the words."""
    part = T.StructType().add("first", "integer").add("last", "integer")
    return (
        T.StructType().add("gram", "long").add("whole", "long").add("parts", T.ArrayType(part))
        .add("places", T.ArrayType(place)).add("data", "binary")
    )


def _search(params: Params, arrow: pa.Schema):
    def search(table: pa.Table) -> pa.Table:
        table = _in_order(table).combine_chunks()
        data = table.column("data").chunk(0)
        text, alphabet, begin, end = _symbols(data)
        automaton = Automaton([text[b:e].tolist() for b, e in zip(begin, end)], len(alphabet))
        state = automaton.matches(text, begin, end, params.window)
        # the place of the window that ends at each position, and of the first of its kind
        ends = np.flatnonzero(state >= 0)
        first = automaton.first[state[ends]]
        kind, known = (np.searchsorted(begin, x, "right") - 1 for x in (ends, first))
        place = ends - begin[kind] - params.window + 1
        at = table.column("start").to_numpy()[known] + first - begin[known] - params.window + 1
        old = known < kind
        hot = table.column("hot").to_numpy(zero_copy_only=False)
        # maximal stretches of windows that stand earlier
        late = np.flatnonzero(old)
        new = np.append(True, (np.diff(place[late]) > 1) | (np.diff(kind[late]) > 0))[: len(late)]
        head, tail = late[new], late[np.append(new[1:], True)[: len(late)]]
        many = np.bincount(kind[head], minlength=len(table))
        parts = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(many)).astype(np.int32)),
            pa.StructArray.from_arrays(
                [pa.array(place[x].astype(np.int32)) for x in (head, tail)], ["first", "last"]
            ),
        )
        of = np.flatnonzero(hot[kind])
        ids = pa.array(known[of])
        places = pa.StructArray.from_arrays(
            [table.column(c).combine_chunks().take(ids) for c in _PLACE[:2]] + [pa.array(at[of].astype(np.int32))], list(_PLACE)
        )
        many = np.bincount(kind[of], minlength=len(table))
        offsets = pa.array(np.append(0, np.cumsum(many)).astype(np.int32), mask=np.append(~hot, False))
        columns = [
            table.column("gram"), table.column("whole"), parts,
            pa.ListArray.from_arrays(offsets, places),
            pc.if_else(pa.array(hot), data, pa.scalar(None, data.type)),
        ]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return search


def _windows(params: Params):
    """Every window of the kinds of a crowded gram, as a hash."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "data"):
            raw, rows = flat(part.column("data"))
            begin, end, counts = words(raw, rows)
            prefix = prefix_sums(word_hashes(raw, begin, end))
            many = counts - params.window + 1
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(np.cumsum(counts) - counts, many) + place
            of = pa.array(np.repeat(np.arange(part.num_rows), many))
            taken = part.select([c for c in part.schema.names if c != "data"]).take(of)
            yield pa.record_batch(
                [*taken.columns, pa.array(place.astype(np.int32)), pa.array(span_hash(prefix, at, at + params.window).view(np.int64))],
                [*taken.schema.names, "first", "key"],
            )

    return spell


def _crowded(kinds: DataFrame, params: Params, known: T.StructType) -> DataFrame:
    """The same as from `_search` for grams too crowded for one task: each window's first
    place is an aggregate, combined before the shuffle."""
    schema = kinds.drop("data").schema.add("first", "integer").add("key", "long")
    windows = materialize(kinds.mapInArrow(_windows(params), schema), "windows")
    own = F.struct("doc_id", "mark", (F.col("start") + F.col("first")).alias("start"))
    firsts = windows.groupBy("gram", "key").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("place"))
    late = windows.withColumn("own", own).join(firsts, ["gram", "key"]).where("n > 1 or hot")
    part = F.struct("first", F.col("first").alias("last"))
    found = late.groupBy("gram", "whole").agg(
        F.collect_list(F.when(F.col("place") != F.col("own"), part)).alias("parts"),
        F.sort_array(F.collect_list(F.when(F.col("hot"), F.struct("first", "place")))).alias("places"),
    )
    data = kinds.where("hot").select("gram", "whole", "data")
    found = found.join(data, ["gram", "whole"], "left").withColumn(
        "places", F.when(F.col("data").isNotNull(), F.col("places.place"))
    )
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known])


# --- the broadcast shard ------------------------------------------------------------------


class Hot:
    """The automaton of the kinds with very many copies, and where each window first stands."""

    def __init__(self, rows: list, params: Params):
        self.params = params
        text, self.alphabet, begin, end = _symbols(pa.array([bytes(r["data"]) for r in rows], pa.binary()))
        self.automaton = Automaton([text[b:e].tolist() for b, e in zip(begin, end)], len(self.alphabet))
        state = self.automaton.matches(text, begin, end, params.window)
        self.doc = [p["doc_id"] for r in rows for p in r["places"]]
        self.mark = np.array([p["mark"] for r in rows for p in r["places"]], np.int64)
        self.start = np.array([p["start"] for r in rows for p in r["places"]], np.int64)
        self.place = np.full(len(self.automaton.link), -1)
        held = state[state >= 0]  # in the order of kinds and windows, as the places are
        self.place[held] = np.arange(len(held))
        hashes = self.alphabet[text] if len(text) else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 22, bool)  # spares most texts the automaton
        self.filter[_gram_hashes(hashes, params.gram) & np.uint64((1 << 22) - 1)] = True

    def late(self, part: pa.RecordBatch, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Positions where a window begins whose words first stand at another place."""
        p = self.params
        if not len(self.alphabet):
            return np.zeros(0, np.int64)
        rows = np.append(0, np.cumsum(counts))
        grams = _gram_hashes(hashes, p.gram)
        maybe = np.append(self.filter[grams & np.uint64((1 << 22) - 1)], False)
        maybe[(rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] <= len(grams))]) - 1] = False
        # stretches of grams the automaton may know, none across documents
        head = np.flatnonzero(maybe & ~np.append(False, maybe[:-1]))
        tail = np.flatnonzero(maybe & ~np.append(maybe[1:], False)) + p.gram
        long = tail - head >= p.window
        head, tail = head[long], tail[long]
        if not len(head):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        symbol = np.where(self.alphabet[at] == hashes, at, -1)
        state = self.automaton.matches(symbol, head, tail, p.window)
        hit = np.flatnonzero(state >= 0)
        place = self.place[state[hit]]
        hit, place = hit[place >= 0] - p.window + 1, place[place >= 0]
        row = np.searchsorted(rows, hit, "right") - 1
        mark = part.column("mark").to_numpy()[row]
        same = np.flatnonzero((self.mark[place] == mark) & (self.start[place] == hit - rows[row]))
        ids = part.column("doc_id")
        first = [i for i in same if ids[int(row[i])].as_py() == self.doc[place[i]]]
        keep = np.ones(len(hit), bool)
        keep[first] = False
        return hit[keep]


def _remove(hot: Hot):
    window = hot.params.window

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, _, _, counts, hashes = _hashed(part)
            rows = np.append(0, np.cumsum(counts))
            covered = np.zeros(len(hashes) + 1, np.int64)
            late = hot.late(part, counts, hashes)
            np.add.at(covered, late, 1)
            np.add.at(covered, late + window, -1)
            spans = part.column("spans")
            of = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
            spans = spans.flatten()
            np.add.at(covered, rows[of] + spans.field("begin").to_numpy(), 1)
            np.add.at(covered, rows[of] + spans.field("end").to_numpy(), -1)
            gone = np.cumsum(covered)[:-1] > 0
            total = np.append(0, np.cumsum(gone))
            removed = total[rows[1:]] - total[rows[:-1]]
            kept = []
            for i, text in enumerate(part.column("text")):
                left = (text.as_py() or "").encode().split()
                if removed[i]:
                    left = compress(left, ~gone[rows[i] : rows[i + 1]])
                kept.append(b" ".join(left).decode())
            yield pa.record_batch(
                [part.column("row"), pa.array(kept), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64))],
                ["row", "text", "n_words", "n_removed"],
            )

    return remove


def remove_passages(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """All columns, `text` with the words that are left joined by single blanks, and n_words
    (before) and n_removed.

    A word goes if a window of `window` words that covers it also starts earlier: in a
    document with a smaller doc_id, or before in the same.  Windows are judged on the input.
    Documents without doc_id come first; among different texts with one doc_id that with the
    smaller hash comes first; rows with equal doc_id and text are the same document and end
    the same.  A null text has no words and ends empty; texts shorter than a window stay
    whole.  Columns of `docs` with the names of results are replaced.
    """
    named = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.col("text").cast("string").alias("text")
    )
    texts = named.where("text is not null")
    id_type = named.schema["doc_id"].dataType
    grams = texts.mapInArrow(_grams(params), "gram long").groupBy("gram").count()
    bits = Bits.of(grams.where("count > 1"), "gram")
    schema = T.StructType().add("doc_id", id_type).add("mark", "long").add("gram", "long").add("whole", "long")
    runs = materialize(
        texts.mapInArrow(_shared_runs(bits, params), schema.add("start", "integer").add("many", "integer")), "runs"
    )

    kinds = runs.groupBy("gram", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*_PLACE)).alias("at"), F.max("many").alias("many")
    )
    kinds = materialize(kinds, "kinds")
    length = F.col("many") + params.window - 1
    grams = kinds.groupBy("gram").agg(F.sum("n").alias("copies"), F.sum(length).alias("size"))
    total = kinds.agg(F.sum("n")).first()[0] or 0
    # at most `hot` kinds can have that share of all runs
    hot = (F.col("n") >= max(64, total / params.hot)) & (F.col("n") > 1)
    wanted = materialize(
        kinds.join(grams.where("copies > 1"), "gram").select(
            "gram", "whole", "at.*", "many", "size", hot.alias("hot"), (F.col("n") > 1).alias("again")
        ),
        "kinds",
    )
    asked = wanted.groupBy(_key().alias("key")).agg(F.collect_list(F.struct(*_ASKED, "many")).alias("runs"))
    cut = (
        texts.where(Bits.of(wanted, "mark").may_hold(F.col("mark")))
        .select(_key().alias("key"), "text")
        .dropDuplicates(["key"])
        .join(asked, "key")
        .select("text", "runs")
        .mapInArrow(_cut(params), wanted.select(*_ASKED).schema.add("data", "binary"))
    )
    cut = materialize(cut, "cut")
    words_in_all = wanted.agg(F.sum(length)).first()[0] or 0
    shards = max(1, -(-int(words_in_all) // params.shard))
    place = T.StructType().add("doc_id", id_type).add("mark", "long").add("start", "integer")
    known = _known(place)
    fields = docs.sparkSession.createDataFrame([], known).toArrow().schema
    found = (
        cut.where(F.col("size") <= params.shard)
        .groupBy(F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard"))
        .applyInArrow(_search(params, fields), known)
    )
    crowded = cut.where(F.col("size") > params.shard).drop("size")
    found = materialize(found.unionByName(_crowded(crowded, params, known)), "known")
    often = found.where("places is not null").select("gram", "whole", "places", "data")
    hot_shard = Hot(often.collect(), params)

    # every copy but the first repeats as a whole; of the first, the parts found
    late = wanted.where("not hot").join(found.select("gram", "whole", "parts"), ["gram", "whole"], "left")
    late = late.where("again or size(parts) > 0").select(
        "gram", "whole", F.struct(*_PLACE).alias("at"), "parts", "many"
    )
    mine = F.struct(*[F.col(f"r.{c}") for c in _PLACE])
    span = lambda first, last: F.struct(
        (F.col("r.start") + first).alias("begin"), (F.col("r.start") + last + params.window).alias("end")
    )
    few = runs.join(F.broadcast(often.select("gram", "whole")), ["gram", "whole"], "left_anti")
    spans = (
        few.alias("r")
        .join(late.alias("k"), ["gram", "whole"])
        .select(
            "r.doc_id",
            "r.mark",
            F.explode(
                F.when(mine.eqNullSafe(F.col("k.at")), F.transform("k.parts", lambda p: span(p["first"], p["last"])))
                .otherwise(F.array(span(F.lit(0), F.col("r.many") - 1)))
            ).alias("span"),
        )
    )
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("spans"))
    spans = materialize(spans.select(_key().alias("key"), "mark", "spans"), "spans")

    new = ("text", "n_words", "n_removed")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("row")
    held = docs.select(
        row, F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.col("text").cast("string").alias("text")
    ).withColumn("may", Bits.of(spans, "mark").may_hold(F.col("mark")))
    joined = (
        held.where("may").withColumn("key", _key()).join(spans.select("key", "spans"), "key", "left")
        .select("row", "doc_id", "mark", "text", "spans")
    )
    joined = joined.unionByName(held.where("not may").drop("may"), allowMissingColumns=True)
    schema = joined.select("row").schema.add("text", "string").add("n_words", "long").add("n_removed", "long")
    out = joined.mapInArrow(_remove(hot_shard), schema)
    names = [c if c == "text" else f"row.`{c}`" for c in docs.columns if c not in new[1:]]
    return out.select(*names, "n_words", "n_removed")
