"""Near-duplicate documents by min-max hashing.

Every permutation of the shingles gives two signature values, its minimum and its maximum,
so a signature of n values costs n/2 hash evaluations.  Bands of these values name the
candidates; every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import materialize
from .text import distinct, flat, fold, lowered, mix, shingles, slices, word_hashes, words


@dataclass(frozen=True)
class Params:
    """`width` words a shingle; link at `percent` % of the union or more.

    A pair at 80 % is missed by all `bands` of four values (two permutations each) with a
    probability below 1e-7.  `block` is the number of documents compared in one task.
    """

    width: int = 5
    percent: int = 80
    bands: int = 32
    block: int = 256


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, rows = flat(texts)
    data = fold(data)
    begin, end, counts = words(data, rows)
    return distinct(*shingles(word_hashes(data, begin, end), counts, width))


_SIGNED = "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>"


def _signer(width: int, bands: int):
    draw = np.random.default_rng(977)
    factors = draw.integers(1, 1 << 63, 2 * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values, counts = _sets(part.column("text"), width)
            some = np.flatnonzero(counts)
            begin = (np.cumsum(counts) - counts)[some]
            keys = np.zeros((part.num_rows, bands), np.uint64)
            sums = np.zeros((2, part.num_rows), np.uint64)
            if len(some):
                sums[0, some] = np.add.reduceat(mix(values), begin)
                sums[1, some] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), begin)
                for band in range(bands):
                    key = np.full(len(some), band + 1, np.uint64)
                    for factor in factors[2 * band : 2 * band + 2]:
                        order = ((values * factor) >> np.uint64(32)).astype(np.uint32)
                        low = np.minimum.reduceat(order, begin).astype(np.uint64)
                        high = np.maximum.reduceat(order, begin).astype(np.uint64)
                        key = mix(mix(key + low) + high)
                    keys[some, band] = key
            rows = part.num_rows
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array(counts.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(rows + 1, dtype=np.int32) * bands),
                        pa.array(keys.ravel().view(np.int64)),
                    ),
                ],
                ["doc_id", "text_hash", "n_shingles", "s1", "s2", "bands"],
            )

    return sign


def signatures(docs: DataFrame, params: Params) -> DataFrame:
    """One row per document: size and two hashes of its whole shingle set, and its bands."""
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    )
    return chosen.mapInArrow(_signer(params.width, params.bands), _SIGNED)


def _comparer(width: int, percent: int):
    """Links between rows of side 0 and all rows of one task, fewer where they close a circle."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "node"], kind="stable").reset_index(drop=True)
        node, comp = group["node"].to_numpy(), group["comp"].to_numpy()
        inner = bool(group["inner"].iloc[0])
        values, counts = [], []
        texts = pa.array(group["text"], pa.string())
        for part in slices([pa.record_batch([texts], ["text"])], "text"):
            v, c = _sets(part.column("text"), width)
            values.append(v)
            counts.append(c)
        values, counts = np.concatenate(values), np.concatenate(counts)
        end = np.cumsum(counts)
        begin = end - counts
        leads = int((group["side"] == 0).sum())
        # Union-find over components within the task: pairs already tied need no comparison.
        names, tie = np.unique(comp, return_inverse=True)
        tie = tie.astype(np.int64)
        links = []
        for i in range(leads):
            others = np.arange(i + 1 if inner else leads, len(node))
            others = others[tie[others] != tie[i]]
            # sizes alone rule out most pairs
            small, large = np.minimum(counts[others], counts[i]), np.maximum(counts[others], counts[i])
            others = others[(small * 100 >= large * percent) & (small > 0)]
            if not len(others):
                continue
            own = values[begin[i] : end[i]]
            many = counts[others]
            starts = np.cumsum(many) - many
            at = np.repeat(begin[others] - starts, many) + np.arange(int(many.sum()))
            theirs = values[at]
            place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            both = np.add.reduceat((own[place] == theirs).astype(np.int64), starts)
            for j in others[both * 100 >= (many + counts[i] - both) * percent]:
                if tie[i] != tie[j]:
                    links.append((node[i], node[j]))
                    tie[tie == tie[j]] = tie[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return compare


def _links(tasks: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """Confirm on full sets.  tasks: t1 long, t2 long, inner boolean, side int, node, comp."""
    return (
        tasks.join(texts, "node")
        .groupBy("t1", "t2")
        .applyInPandas(_comparer(params.width, params.percent), "a long, b long")
    )


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Per document (a row): doc_id, text_hash, n_shingles, component_id, kept.

    Documents are linked when their shingle sets overlap by `percent` % of their union;
    `component_id` is the smallest doc_id reachable by links.  Case A-Z is ignored.

    * Equal sets are one class from the start, so copies cost one row each.
    * Each bucket of a band ties its members to its smallest one, in tasks of at most
      `block` documents.  Only where a bucket still holds different components are its
      members compared further: blocks of the smaller components against all blocks of
      their candidate cluster.  No pair of a bucket is left unconfirmed or unconnected,
      and no pairs are written out.
    * A null or empty text has no shingles and links with nothing.  A row without doc_id
      links with nothing: its component_id is null and it is kept.  Rows that share a
      doc_id are separate documents.  Other columns are ignored.
    """
    signed = materialize(signatures(docs, params), "minmax")
    classes = materialize(
        signed.where("doc_id is not null and n_shingles > 0")
        .groupBy("s1", "s2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("bands").alias("bands"))
        .select(
            "s1", "s2", "n_shingles", F.col("least.doc_id").alias("node"),
            F.col("least.text_hash").alias("text_hash"), "bands",
        ),
        "minmax",
    )
    # One class per node: rows that share a doc_id may differ in text.
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = (
        banded.groupBy("bucket")
        .agg(F.min("node").alias("lead"), F.max("node").alias("last"))
        .where("lead <> last")
        .select("bucket", "lead")
    )
    members = materialize(banded.join(shared, "bucket").distinct(), "minmax")
    named = members.select("node").distinct()
    texts = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("node"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
            lowered(F.col("text")).alias("text"),
        )
        .join(
            classes.join(named, "node").select("node", "text_hash").distinct(),
            ["node", "text_hash"],
        )
        .dropDuplicates(["node", "text_hash"])
        .select("node", "text"),
        "minmax",
    )

    # First every bucket's members against its smallest one.
    pairs = members.where("node <> lead").select("lead", "node").distinct()
    parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / params.block).alias("parts"))
    pairs = pairs.join(parts, "lead").withColumn(
        "t2", F.pmod(F.xxhash64("node"), F.col("parts")).cast("long")
    )
    stars = pairs.select(F.col("lead").alias("t1"), "t2", F.lit(1).alias("side"), "node").union(
        pairs.select(F.col("lead").alias("t1"), "t2", F.lit(0).alias("side"), F.col("lead").alias("node")).distinct()
    )
    stars = stars.select("t1", "t2", F.lit(False).alias("inner"), "side", "node", F.col("node").alias("comp"))
    links = materialize(_links(stars, texts, params), "minmax")

    # Then what a bucket holds beyond one component.
    tied = components(links)
    placed = members.join(tied.withColumnRenamed("component", "comp"), "node", "left").withColumn(
        "comp", F.coalesce("comp", "node")
    )
    mixed = placed.groupBy("bucket").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("lead")
    ).where("low <> high").select("bucket", "lead")
    left = materialize(placed.drop("lead").join(mixed, "bucket").select("node", "comp", "lead").distinct(), "minmax")
    clusters = components(left.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    more = materialize(_links(_rest(left, clusters, params), texts, params), "minmax")

    tied = components(links.union(more))
    found = classes.join(tied, "node", "left").select(
        "s1", "s2", "n_shingles", F.coalesce("component", "node").alias("component_id")
    )
    return (
        signed.select("doc_id", "text_hash", "n_shingles", "s1", "s2")
        .join(found, ["s1", "s2", "n_shingles"], "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents with one of each group of near-duplicates, all columns as they were.

    Rows with equal doc_id and text are copies too, and one of them stays.
    """
    kept = near_duplicates(docs, params).where("kept").select(
        F.col("doc_id").cast("string").alias("name"), F.col("text_hash").alias("mark")
    ).distinct()
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").cast("string").alias("name"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
    ).dropDuplicates(["name", "mark"])
    return held.alias("d").join(
        kept.alias("k"), F.expr("d.name <=> k.name and d.mark = k.mark"), "left_semi"
    ).select("row.*")


def _rest(left: DataFrame, clusters: DataFrame, params: Params) -> DataFrame:
    """Tasks that compare, within a cluster, every node of a lesser component with the rest.

    The largest component of a cluster is not compared with itself: its nodes are tied.
    """
    nodes = left.select("node", "comp").distinct().join(clusters, "node")
    sizes = nodes.groupBy("component", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("component").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most")
    )
    nodes = nodes.join(main, "component").withColumn("lesser", F.col("comp") != F.col("main"))
    lesser_blocks = F.ceil((F.col("total") - F.col("most")) / params.block).cast("long")
    main_blocks = F.ceil(F.col("most") / params.block).cast("long")
    place = F.xxhash64("node")
    nodes = nodes.withColumn("lb", lesser_blocks).withColumn("mb", main_blocks).withColumn(
        "own", F.when(F.col("lesser"), F.pmod(place, F.col("lb"))).otherwise(F.pmod(place, F.col("mb")))
    )
    # Task (x, y): lesser block x against block y; y < lb is a lesser block, else a main one.
    own, lb, mb = F.col("own"), F.col("lb"), F.col("mb")
    low, high = F.least(own, F.col("o")), F.greatest(own, F.col("o"))
    lesser = nodes.where("lesser").withColumn("o", F.explode(F.sequence(F.lit(0), lb + mb - 1)))
    lesser = lesser.select(
        "component", "node", "comp", "lb",
        F.when(F.col("o") < lb, low).otherwise(own).alias("x"),
        F.when(F.col("o") < lb, high).otherwise(F.col("o")).alias("y"),
        F.when((F.col("o") < lb) & (own > F.col("o")), 1).otherwise(0).alias("side"),
    )
    greater = nodes.where("not lesser").withColumn("x", F.explode(F.sequence(F.lit(0), lb - 1)))
    greater = greater.select(
        "component", "node", "comp", "lb", "x", (lb + own).alias("y"), F.lit(1).alias("side")
    )
    return lesser.union(greater).select(
        F.col("component").alias("t1"),
        (F.col("x") * F.lit(1 << 31) + F.col("y")).alias("t2"),
        (F.col("x") == F.col("y")).alias("inner"),
        "side",
        "node",
        "comp",
    )
