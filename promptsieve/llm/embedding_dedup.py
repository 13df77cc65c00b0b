"""Near-duplicate vectors: products of int8 tiles with a rigorous error bound.

A unit vector x is held as s * q + e with int8 numbers q.  Then x.y differs from
s_x s_y q_x.q_y by at most |s_x q_x| |e_y| + |e_x| |y|, and these norms are known.  Integer
products of whole tiles come first; only pairs whose bound reaches the threshold are
computed again in double precision.  Equal vectors are one row with a count, so a group
of copies costs what one vector costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_SHARE, lookup_join
from .components import components
from .tables import materialize

#: Columns of int8 products that add up exactly in single precision: 1024 * 127^2 < 2^24.
EXACT_COLUMNS = 1024


@dataclass(frozen=True)
class Params:
    """Cosine of `threshold` or more links; a tile holds at most `tile` vectors, and fewer
    where they are long: about `tile_bytes` of them, int8 and double together."""

    threshold: float = 0.98
    tile: int = 8192
    tile_bytes: int = 1 << 22


_ROW = "vec_id long, label string, q binary, scale double, lost double, v binary"
_KEY = ["h1", "h2"]


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    many, width = rows.shape[0], rows.shape[1] * rows.itemsize
    offsets = np.arange(many + 1, dtype=np.int32) * width
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors with their int8 form, a part of the batch at a time."""
    for batch in batches:
        lists = batch.column("embedding")
        # nulls become nan, and these are left out like any other non-finite component
        numbers = lists.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        offsets = lists.offsets.to_numpy()
        widths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        for width in np.unique(widths[widths > 0]):
            where = np.flatnonzero(widths == width)
            step = max(1, (1 << 19) // int(width))
            for part in (where[i : i + step] for i in range(0, len(where), step)):
                x = numbers[offsets[part][:, None] + np.arange(width)]
                most = np.abs(x).max(1)
                good = np.isfinite(most) & (most > 0)
                x, at = x[good] / most[good, None], part[good]  # the norm cannot overflow
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                scale = np.abs(x).max(1) / 127
                whole = np.rint(x / scale[:, None])
                lost = np.sqrt(((x - scale[:, None] * whole) ** 2).sum(1))
                at = pa.array(at)
                yield pa.record_batch(
                    [
                        batch.column("vec_id").take(at), batch.column("label").take(at),
                        _binary(whole.astype(np.int8)), pa.array(scale), pa.array(lost), _binary(x),
                    ],
                    ["vec_id", "label", "q", "scale", "lost", "v"],
                )


def possible(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine may reach the threshold, by the bound."""
    qa, qb = (np.frombuffer(b"".join(t["q"]), np.int8).reshape(len(t), -1) for t in (a, b))
    product = np.zeros((len(a), len(b)))
    for c in range(0, qa.shape[1], EXACT_COLUMNS):
        part = slice(c, c + EXACT_COLUMNS)
        product += qa[:, part].astype(np.float32) @ qb[:, part].astype(np.float32).T
    sa, sb = a["scale"].to_numpy(), b["scale"].to_numpy()
    la, lb = a["lost"].to_numpy(), b["lost"].to_numpy()
    held = sa * np.sqrt((qa.astype(np.float64) ** 2).sum(1))
    bound = held[:, None] * lb[None, :] + la[:, None] + 1e-12  # |y| is 1 but for rounding
    return np.nonzero(product * sa[:, None] * sb[None, :] + bound >= threshold)


def _united(tie: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Tie the rows i and j of each pair to the smallest row they are linked with."""
    while len(i):
        x, y = tie[i], tie[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(tie, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = tie[tie]
            if (up == tie).all():
                break
            tie[:] = up


_FOUND = "h1 long, h2 long, n long, a long, b long"


def _compare(params: Params):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """For each class in this pair of tiles, the vectors of other classes it is linked with
        (n), and a spanning set of links (a, b) between the classes' first vectors."""
        inner = bool((group["i"] == group["j"]).iloc[0])
        out = []
        for _, group in group.groupby(group["q"].map(len)):  # lengths differ only in odd data
            left = np.ones(len(group), bool) if inner else (group["own"] == group["i"]).to_numpy()
            a = group[left].reset_index(drop=True)
            b = a if inner else group[~left].reset_index(drop=True)
            if not len(a) or not len(b):
                continue
            both = a if inner else pd.concat([a, b], ignore_index=True)
            shift = 0 if inner else len(a)
            width = len(a["q"].iloc[0])
            v = np.frombuffer(b"".join(both["v"]), np.float64).reshape(len(both), width)
            many = both["many"].to_numpy().astype(np.float64)
            counts, tie = np.zeros(len(both)), np.arange(len(both))
            for top in range(0, len(a), 256):
                i, j = possible(a.iloc[top : top + 256], b, params.threshold)
                i, j = i + top, j + shift
                if inner:
                    i, j = i[i < j], j[i < j]
                near = np.zeros(len(i), bool)
                for c in range(0, len(i), 1 << 16):
                    s = slice(c, c + (1 << 16))
                    near[s] = np.einsum("ij,ij->i", v[i[s]], v[j[s]]) >= params.threshold
                i, j = i[near], j[near]
                counts += np.bincount(i, many[j], len(both)) + np.bincount(j, many[i], len(both))
                _united(tie, i, j)
            ids, linked, tied = both["vec_id"].to_numpy(), counts > 0, tie != np.arange(len(both))
            out.append(both.loc[linked, _KEY].assign(n=counts[linked].astype(np.int64), a=None, b=None))
            out.append(pd.DataFrame({"h1": None, "h2": None, "n": None, "a": ids[tie[tied]], "b": ids[tied]}))
        names = [*_KEY, "n", "a", "b"]
        if not out:
            return pd.DataFrame([], columns=names)
        return pd.concat([part.astype("Int64") for part in out], ignore_index=True)[names]

    return compare


def near_duplicates(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors with equal labels are linked at a cosine of `threshold` or more.  A null label, or
    a vector that is null, empty, zero, of another length, or has a null or non-finite
    component, links with nothing.  A row without vec_id links with nothing and is kept, its
    component_id null.  Rows that share a vec_id are one vector if equal; if not, their links
    are added up.  Other columns are ignored.
    """
    usable = vectors.where("vec_id is not null and label is not null and embedding is not null")
    rows = usable.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).mapInArrow(_quantise, _ROW)
    stands = [F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "label", "v")]
    rows = materialize(
        rows.withColumns(dict(zip(_KEY, stands))).withColumn("row", F.monotonically_increasing_id()), "vectors"
    )
    # Equal vectors of a label are a class.  Its first vector stands for all in the tiles.
    members = materialize(rows.groupBy("vec_id", *_KEY).agg(F.min("row").alias("row")), "vectors")
    classes = materialize(
        members.groupBy(*_KEY).agg(
            F.min_by("row", "vec_id").alias("row"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many")
        ),
        "vectors",
    )
    first = materialize(rows.join(classes.select("row", "many"), "row"), "vectors")
    width = F.max(F.octet_length("q") + F.octet_length("v"))
    sizes = materialize(first.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), width.alias("width")), "vectors")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    # A label may hold any share of the rows; the large ones are few and go by broadcast.
    room = F.greatest(F.lit(1), F.least(F.lit(params.tile), F.floor(F.lit(params.tile_bytes) / F.col("width"))))
    sizes = sizes.select(
        "label",
        F.ceil(F.col("rows") / room).cast("int").alias("tiles"),
        (F.col("rows") >= total * HOT_SHARE).alias("large"),
    )
    dealt = lookup_join(first, sizes, ["label"], F.col("large"), ["row"]).withColumn(
        "own", F.pmod("h1", F.col("tiles")).cast("int")
    )
    # The first of each class goes once to each pair of tiles that has its own.
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "vec_id", *_KEY, "many", "q", "scale", "lost", "v",
    )
    found = materialize(
        pairs.groupBy("label", "i", "j").applyInPandas(_compare(params), _FOUND), "vectors"
    )
    linked = found.where("n is not null").groupBy(*_KEY).agg(F.sum("n").alias("n"))
    # Members of a class are linked with each other and with what their class is linked with.
    several = classes.join(linked, _KEY, "left").where("many > 1 or n is not null").select(
        *_KEY, "least", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n"),
        (F.col("many") >= members.count() * HOT_SHARE).alias("often"),
    )
    placed = materialize(
        lookup_join(members, several, _KEY, F.col("often"), ["vec_id"], "inner"), "vectors"
    )
    counts = placed.groupBy(F.col("vec_id").alias("a")).agg(F.sum("n").alias("n_links"))
    tied = components(
        found.where("a <> b").select("a", "b").union(
            placed.where("least < vec_id").select(F.col("least").alias("a"), F.col("vec_id").alias("b"))
        )
    )
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
        .join(counts.withColumnRenamed("a", "vec_id"), "vec_id", "left")
        .join(tied.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
