"""Joins and rankings that stay spread out when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize

# A key is hot once it holds at least this share of the rows.  At most 1 / HOT_SHARE
# keys can be hot, so a table of hot keys is small however large the data is.
HOT_SHARE = 1 / 1000
MAX_HOT_KEYS = int(1 / HOT_SHARE)
#: Rows that one task sorts where ranks are cut.
ROWS_PER_TASK = 1 << 17


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys holding at least HOT_SHARE of the rows: never more than MAX_HOT_KEYS.

    One pass with a bounded frequent-items sketch (map-side combined, no shuffle of
    keys).  It may over- or under-report near the threshold; callers use it only to
    choose how a row travels, never what the result is.
    """
    top = (
        df.where(F.col(key).isNotNull())
        .agg(
            F.expr(f"approx_top_k({key}, {MAX_HOT_KEYS}, {MAX_HOT_KEYS * 10})").alias("top"),
            F.count(F.lit(1)).alias("total"),
        )
        .first()
    )
    return [e["item"] for e in top["top"] or [] if e["count"] >= max(2, top["total"] * HOT_SHARE)]


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    hot: Column | None,
    spread: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Join many `rows` to a `table` that is unique on `keys`.

    `hot` marks the table rows whose key is hot on the other side.  These, at most a
    few thousand, are broadcast; rows that found their partner there are scattered by
    `spread` in the shuffle for the rest, so no shuffle partition receives a hot key.
    """
    keys = list(keys)
    values = [c for c in table.columns if c not in keys]
    if hot is None:
        return rows.join(table, keys, how)
    packed = table.select(
        *keys, F.struct(*values).alias("_v"), F.coalesce(hot, F.lit(False)).alias("_hot")
    )
    hot_part = packed.where("_hot").select(*keys, F.col("_v").alias("_hot_v"))
    cold_part = packed.where(~F.col("_hot")).select(
        *keys, F.col("_v").alias("_cold_v"), F.lit(0).alias("_spread")
    )
    found = [*rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values]]
    if how == "inner":
        # Two inner joins, so that rows without a partner can be dropped before the
        # shuffle by a runtime filter; the hot ones are not shuffled at all.
        hot_keys_only = F.broadcast(hot_part.select(*keys))
        return (
            rows.join(F.broadcast(hot_part), keys)
            .withColumnRenamed("_hot_v", "_v")
            .select(*found)
            .unionByName(
                rows.join(hot_keys_only, keys, "left_anti")
                .join(cold_part.drop("_spread"), keys)
                .withColumnRenamed("_cold_v", "_v")
                .select(*found)
            )
        )
    if how != "left":
        raise ValueError(f"unsupported join type: {how!r}")
    scatter = F.lit(1) + F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int")
    return (
        rows.join(F.broadcast(hot_part), keys, "left")
        .withColumn("_spread", F.when(F.col("_hot_v").isNull(), 0).otherwise(scatter))
        .join(cold_part, [*keys, "_spread"], "left")
        .withColumn("_v", F.coalesce("_hot_v", "_cold_v"))
        .select(*found)
    )


def _in_parts(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: Column, size: int,
    weight: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by (keys, order) into parts of about `size` rows, `_part`; and per group and
    part `_limit`, the rows there (`_in`) and those of the group in earlier parts (`_before`);
    with `weight`, a row counts as so many.

    `order` is unique within a group, so a part has a bounded number of rows however they
    are spread over the groups: a group larger than that goes over several parts.  Written
    out, because the borders of a range come from a sample.
    """
    keys = list(keys)
    stored = materialize(rows.withColumn("_limit", limit), "rows")
    parts = max(1, -(-stored.count() // size))
    if parts > 1:
        stored = stored.repartitionByRange(parts, *keys, *order)
        stored = materialize(stored.withColumn("_part", F.spark_partition_id()), "parts")
    else:
        stored = stored.withColumn("_part", F.lit(0))
    counts = stored.groupBy(*keys, "_part").agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_in"),
        F.max("_limit").alias("_limit"),
    )
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    return stored.drop("_limit"), counts


_OWN = ("_part", "_in", "_before", "_limit", "_rank")


def _ranked(rows: DataFrame, cut: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`_rank` within the group, for the rows of some groups and parts."""
    part = W.partitionBy(*keys, "_part").orderBy(*order)
    return rows.join(cut, [*keys, "_part"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(part)
    )


def kth(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: Column, size: int = ROWS_PER_TASK
) -> DataFrame:
    """The row at rank `k` of each group, by `order`; none where the group is smaller.

    `k` is constant within a group.  Only the part that holds the rank is sorted.
    """
    stored, counts = _in_parts(rows, keys, order, k, size)
    cut = counts.where((F.col("_before") < F.col("_limit")) & (F.col("_limit") <= F.col("_before") + F.col("_in")))
    return _ranked(stored, cut, keys, order).where(F.col("_rank") == F.col("_limit")).drop(*_OWN)


def first_k(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: Column, size: int = ROWS_PER_TASK
) -> DataFrame:
    """The first `k` rows of each group, by `order`.

    Parts that lie within the limit are taken whole; only the one it cuts is sorted.
    """
    stored, counts = _in_parts(rows, keys, order, k, size)
    ends = F.col("_before") + F.col("_in")
    whole = stored.join(counts.where(ends <= F.col("_limit")), [*keys, "_part"])
    cut = counts.where((F.col("_before") < F.col("_limit")) & (F.col("_limit") < ends))
    some = _ranked(stored, cut, keys, order).where(F.col("_rank") <= F.col("_limit"))
    return whole.drop(*_OWN).unionByName(some.drop(*_OWN))


def at_ranks(
    rows: DataFrame, keys: Sequence[str], order: str, weight: str, ranks: DataFrame,
    size: int = ROWS_PER_TASK,
) -> DataFrame:
    """(keys, rank, `order`): the values at the `rank`s asked for of each group, where a row
    stands for `weight` equal ones.

    `ranks` (keys, rank) is small.  Of a group's values, only the parts that hold a rank are
    sorted.
    """
    keys = list(keys)
    stored, counts = _in_parts(rows, keys, [order], F.lit(0), size, weight)
    cut = counts.join(ranks, keys).where(
        (F.col("_before") < F.col("rank")) & (F.col("rank") <= F.col("_before") + F.col("_in"))
    )
    asked = cut.groupBy(*keys, "_part", "_before").agg(F.collect_set("rank").alias("_ranks"))
    upto = W.partitionBy(*keys, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        stored.join(asked, [*keys, "_part"])
        .withColumn("_upto", F.col("_before") + F.sum(weight).over(upto))
        .select(*keys, order, weight, "_upto", F.explode("_ranks").alias("rank"))
        .where((F.col("_upto") - F.col(weight) < F.col("rank")) & (F.col("rank") <= F.col("_upto")))
        .select(*keys, "rank", order)
    )
