"""Lines that many documents share, found with levelled sorted runs of line hashes.

DataFrame operations only.  Batches of documents arrive one after another.  Each batch is
merge-anti-joined with the settled runs (lines already known to be frequent), and what is
left of it is added as a sorted run of its own; `fan` runs of a level are compacted into
one run of the next, and lines that reach the limit on the way settle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_SHARE, lookup_join
from .tables import materialize
from .text import lowered

EDGE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


@dataclass(frozen=True)
class Params:
    """A line goes if its key has `min_chars` code points and is in `min_docs` documents."""

    min_docs: int = 10
    min_chars: int = 1
    batches: int = 4
    fan: int = 2


class Runs:
    """Levels of sorted runs (h1, h2, docs): how many documents have a line, so far."""

    def __init__(self, min_docs: int, fan: int):
        self.min_docs, self.fan = min_docs, fan
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, runs).groupBy(*KEY).agg(F.sum("docs").alias("docs"))

    @staticmethod
    def _written(run: DataFrame) -> DataFrame:
        return materialize(run.select(*KEY, "docs").sortWithinPartitions(*KEY), "run")

    def add(self, batch: DataFrame) -> None:
        """One row of `batch` per document and distinct line."""
        new = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"))
        for run in self.settled:
            new = new.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._written(new))
        level = 0
        while len(self.levels[level]) >= self.fan:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._compact(self.levels[level]))
            self.levels[level] = []
            level += 1

    def _compact(self, runs: list[DataFrame]) -> DataFrame:
        merged = materialize(self._merged(runs), "run")
        self.settled = [
            self._written(
                reduce(DataFrame.union, [*self.settled, merged.where(F.col("docs") >= self.min_docs)])
            )
        ]
        return self._written(merged.where(F.col("docs") < self.min_docs))

    def frequent(self) -> DataFrame:
        """(h1, h2, docs): every line at the limit; docs is at least the limit, not exact."""
        open_runs = [run for level in self.levels for run in level]
        rest = self._merged(open_runs).where(F.col("docs") >= self.min_docs)
        return self._written(reduce(DataFrame.union, [*self.settled, rest]))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(text: Column, min_chars: int) -> Column:
    """Per line the hash of its key; null for keys that are too short to count."""

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(EDGE))
        return F.when(
            F.char_length(k) >= min_chars,
            F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")),
        )

    return F.transform(_lines(lowered(text)), key)


def _placed(keyed: DataFrame) -> DataFrame:
    """(doc, mark, h1, h2, at, first): a row per line that counts, with its number in the
    document and whether it is the first of its key there.

    Sorting the keys of a document puts equal ones side by side, so a document costs its
    lines times their logarithm, not their square.
    """
    placed = F.transform(
        "keys", lambda k, at: F.when(k.isNotNull(), F.struct(k["h1"].alias("h1"), k["h2"].alias("h2"), at.alias("at")))
    )
    ordered = keyed.select("doc", "mark", F.sort_array(F.filter(placed, F.isnotnull)).alias("s"))
    ordered = ordered.where(F.size("s") > 0)
    none = F.filter(F.slice("s", 1, 1), lambda k: F.lit(False))  # typed and empty
    before = F.concat(F.array(F.get(none, F.lit(0))), F.slice("s", F.lit(1), F.size("s") - 1))
    marked = F.zip_with(
        "s",
        before,
        lambda k, p: F.struct(
            k["h1"].alias("h1"), k["h2"].alias("h2"), k["at"].alias("at"),
            F.coalesce((k["h1"] != p["h1"]) | (k["h2"] != p["h2"]), F.lit(True)).alias("first"),
        ),
    )
    return ordered.select("doc", "mark", F.explode(marked).alias("k")).select("doc", "mark", "k.*")


def _stays(at: Column) -> Column:
    """Whether lines 0, 1, ... stay, up to the last that goes; `at` are those that go, ascending."""
    before = F.concat(F.array(F.lit(-1)), F.slice(at, F.lit(1), F.size(at) - 1))
    return F.flatten(
        F.zip_with(
            at, before, lambda x, p: F.concat(F.array_repeat(F.lit(True), x - p - 1), F.array(F.lit(False)))
        )
    )


def dedup_lines(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents with shared lines taken out of `text`, plus n_lines and n_dropped.

    A line's key is the line stripped of the six blank characters, A-Z in lower case.  All
    lines of a key found in `min_docs` documents (rows) go, the first ones too.  A null text
    counts as one empty line and becomes an empty text.  Repeated rows are documents of
    their own.  All columns of `docs` stay; columns called n_lines or n_dropped are replaced.
    """
    new = ("n_lines", "n_dropped")
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("row")
    )
    text, doc = F.col("row.text"), F.col("row.doc_id").cast("string").alias("doc")
    name = [doc, F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")]
    lines = _placed(held.select(*name, _keys(text, params.min_chars).alias("keys")))
    lines = materialize(
        lines.withColumn("batch", F.pmod(F.xxhash64("doc", "mark"), F.lit(params.batches)).cast("int")),
        "lines",
    )
    pairs = lines.where("first")
    runs = Runs(params.min_docs, params.fan)
    for number in range(params.batches):
        runs.add(pairs.where(F.col("batch") == number))
    frequent = runs.frequent()

    # `docs` counts a part of the pairs, so at most batches / HOT_SHARE keys can reach this
    # limit; they go by broadcast.  A hot key settles with the count of one batch or more.
    limit = max(params.min_docs, int(pairs.count() * HOT_SHARE / params.batches))
    exact = frequent.withColumn("often", F.col("docs") >= limit)
    gone = lookup_join(
        lines.select("doc", "mark", "at", *KEY), exact.select(*KEY, "often"), KEY, F.col("often"),
        ["doc", "mark"], "inner",
    )
    gone = gone.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("at")).alias("at"))
    gone = gone.select("doc", "mark", _stays(F.col("at")).alias("stays"))
    found = held.select("row", *name).alias("d").join(
        gone.alias("g"), F.expr("d.doc <=> g.doc and d.mark = g.mark"), "left"
    ).select("row", "stays")
    kept = F.filter(_lines(text), lambda line, at: F.coalesce(F.get("stays", at), F.lit(True)))
    found = found.withColumn("total", F.size(_lines(text)).cast("long")).withColumn(
        "kept",
        F.when(F.col("stays").isNotNull(), kept),
    )
    shorter = F.when(F.col("kept").isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join("kept", "\n")
    )
    return found.select(
        *[
            shorter.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
            if c not in new
        ],
        F.col("total").alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("total") - F.size("kept")).cast("long").alias("n_dropped"),
    )
