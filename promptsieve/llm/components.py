"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: tie neighbours of each node to the smallest of them.

    The smallest neighbour comes from an aggregate that is combined before the shuffle and
    is joined back, so that the adaptive join can split a node with very many neighbours.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("a", "m"))
    tied = both.join(least, "a")
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    )


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.hash("b", "a"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node that has a link; a component is its smallest node.

    `links` has two long columns a and b.  Large-star and small-star steps alternate until
    nothing changes, which takes a logarithmic number of rounds; each round is written to
    the shared folder, so a lost executor costs one round at most.  Links from a node to
    itself, repeated links and nulls add nothing.
    """
    links = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = materialize(links.distinct(), "links")
    before = _state(links)
    while before[0]:
        links = _star(_star(links, large=True).where("a <> b").distinct(), large=False)
        links = materialize(links.where("a <> b").distinct(), "links")
        now = _state(links)
        if now == before:
            break
        before = now
    ends = links.groupBy("a").agg(F.min("b").alias("b"))
    return (
        ends.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .union(links.select(F.col("b").alias("node"), F.col("b").alias("component")))
        .distinct()
    )
