"""Mixing sources to target weights with Sainte-Lague apportionment.

Targets become whole blocks of equal token counts: blocks go to the sources with the
highest quotients, and a source's blocks go to its shards the same way.  Within a shard
the documents form a tape in seeded order; the quota takes whole passes of the tape and
fills the rest with blocks chosen by a seeded permutation.  DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import HOT_SHARE, lookup_join
from .tables import materialize
from .text import WORD

# Primes above any number of blocks in a shard; multiplying by one permutes the blocks.
PRIMES = (
    2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497,
    2147483489, 2147483477, 2147483423, 2147483399, 2147483353, 2147483323, 2147483269, 2147483249,
)


@dataclass(frozen=True)
class Params:
    """Sources in order of their names weigh `weights`, again and again; none is taken more
    than `epochs` times.  Shards hold about `shard` tokens, blocks exactly `block`."""

    weights: Sequence[int] = (1, 2, 3)
    epochs: int = 3
    block: int = 64
    shard: int = 1 << 18
    seed: int = 1


def targets(sources: DataFrame, params: Params) -> DataFrame:
    """sources (null first flag, name, source_size) with rank, target.

    One row per source, so these windows over all rows stay small.  Sources are capped in
    order of cap / weight until the common level of the rest caps nobody.
    """
    size = F.col("source_size")
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy("nameless", "name")))
    weight = F.element_at(
        F.array(*[F.lit(w) for w in params.weights]),
        (F.pmod(F.col("rank") - 1, F.lit(len(params.weights))) + 1).cast("int"),
    )
    ranked = ranked.withColumn("weight", weight).withColumn("cap", size * params.epochs)
    before = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("rank")
    ranked = ranked.withColumn(
        "level",
        (F.sum(size).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    free = F.col("cap") / F.col("weight") >= F.col("level")
    # The level falls from the first uncapped source on, so that one has the largest of these.
    level = F.max(F.when(free, F.col("level"))).over(every)
    return ranked.withColumn(
        "target", F.least(F.col("cap").cast("double"), level * F.col("weight"))
    ).drop("level", "cap", "weight")


def sainte_lague(parties: DataFrame, group: str, order: str, weight: str, seats: str) -> DataFrame:
    """parties with `won` (long): the seats of each group dealt to the highest quotients
    weight / 1, 3, 5, ...; equal quotients go by `order`.

    Any divisor that gives the right total lies within half a seat per party of the plain
    ratio.  So most seats are certain, and only the few quotients in between are ranked.
    """
    whole = W.partitionBy(group)
    w = F.col(weight).cast("double")
    slack = F.count(F.lit(1)).over(whole) / 2.0
    total = F.sum(w).over(whole)
    rate = F.when(total > 0, w / total).otherwise(F.lit(0.0))
    sure = F.ceil(rate * (F.col(seats) - F.col("_slack")) - 0.5) - 1
    most = F.floor(rate * (F.col(seats) + F.col("_slack")) + 0.5) + 1
    bounds = parties.withColumn("_slack", slack).withColumn(
        "_sure", F.greatest(F.lit(0), sure).cast("long")
    ).withColumn("_most", F.when(w > 0, F.greatest(F.lit(0), most)).otherwise(F.lit(0)).cast("long"))
    bounds = bounds.withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    contest = bounds.where("_most > _sure").select(
        group, order, "_open", w.alias("_w"), F.explode(F.expr("sequence(_sure, _most - 1)")).alias("_k")
    )
    by = W.partitionBy(group).orderBy((F.col("_w") / (2 * F.col("_k") + 1)).desc(), order)
    extra = (
        contest.withColumn("_place", F.row_number().over(by))
        .where("_place <= _open")
        .groupBy(group, order)
        .agg(F.count(F.lit(1)).alias("_extra"))
    )
    return (
        bounds.join(extra, [group, order], "left")
        .withColumn("won", F.col("_sure") + F.coalesce("_extra", F.lit(0)))
        .drop("_slack", "_sure", "_most", "_open", "_extra")
    )


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


#: What the mix says of a document.
MIX = ("size", "source_size", "target", "passes", "spans", "taken")


def mix_sources(docs: DataFrame, params: Params = Params(), key: str = "doc_id") -> DataFrame:
    """Per document: `key`, source, and MIX: the mix takes all of its words `passes` times and,
    once more, those of `spans` (first, stop; words counted from 0, ascending).

    size counts words (0 for null); `taken` counts the words the mix takes, repeats
    included, never above `epochs` * size.  A null source is a source of its own, after all
    others.  Order and selection depend on doc_id and the seed alone, so reruns agree; rows
    that share doc_id and size can stand for each other, and a null doc_id counts as ''.
    Empty documents take nothing.  Other columns are ignored.
    """
    own = [key] if key != "doc_id" else []
    digest = F.md5(F.concat(F.lit(f"mix-{params.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = materialize(
        docs.select(
            *own,
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            digest.alias("digest"),
            F.isnull("source").alias("nameless"),
            F.coalesce("source", F.lit("")).alias("name"),
        ),
        "mix",
    )
    sources = sized.groupBy("nameless", "name").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("many")
    )
    sources = targets(sources, params)
    sources = sources.withColumn("all", F.lit(0)).withColumn(
        "blocks", F.floor(F.sum("source_size").over(W.partitionBy("all")) / params.block + 0.5)
    )
    sources = sainte_lague(sources, "all", "rank", "target", "blocks").withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / params.shard)).cast("long")
    )
    sources = materialize(
        sources.select("nameless", "name", "rank", "source_size", "target", "many", "won", "shards"), "mix"
    )
    count = sized.count()
    known = lookup_join(
        sized,
        sources.drop("many").join(
            sources.select("rank", (F.col("many") >= count * HOT_SHARE).alias("_often")), "rank"
        ),
        ["nameless", "name"],
        F.col("_often"),
        ["doc_id", "digest"],
    ).withColumn("shard", F.pmod(_number(F.substring("digest", 1, 8)), F.col("shards")))
    known = known.drop("nameless", "name", "_often")

    # A shard is bounded in tokens, and so are the windows over it; empty documents are on no tape.
    full = known.where("size > 0")
    shard = full.groupBy("rank", "shard").agg(F.sum("size").alias("length"), F.first("won").alias("seats"))
    blocks = F.ceil(F.col("length") / params.block).cast("long")
    quotas = sainte_lague(shard, "rank", "shard", "length", "seats").withColumn("blocks", blocks)
    tokens = F.least(F.col("won") * params.block, F.col("length") * params.epochs)
    quotas = quotas.withColumn("quota", tokens).withColumn("passes", F.floor(F.col("quota") / F.col("length")))
    seed = F.md5(F.concat(F.lit(f"blocks-{params.seed}:"), F.col("rank").cast("string"), F.lit(":"), F.col("shard").cast("string")))
    quotas = quotas.select(
        "rank",
        "shard",
        "blocks",
        "passes",
        F.floor((F.col("quota") - F.col("passes") * F.col("length")) / params.block + 0.5).alias("rest"),
        F.element_at(
            F.array(*[F.lit(p) for p in PRIMES]),
            (F.pmod(_number(F.substring(seed, 1, 8)), F.lit(len(PRIMES))) + 1).cast("int"),
        ).alias("factor"),
        F.pmod(_number(F.substring(seed, 9, 8)), F.col("blocks")).alias("offset"),
    )
    tape = W.partitionBy("rank", "shard").orderBy("digest", "doc_id", "size")
    placed = full.withColumn("stop", F.sum("size").over(tape.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.join(quotas, ["rank", "shard"]).withColumn("start", F.col("stop") - F.col("size"))
    b = params.block
    first, last = F.floor(F.col("start") / b), F.floor((F.col("stop") - 1) / b)
    spans = F.filter(
        F.transform(
            F.filter(
                F.sequence(first, last),
                lambda k: F.pmod(k * F.col("factor") + F.col("offset"), F.col("blocks")) < F.col("rest"),
            ),
            lambda k: F.struct(
                (F.greatest("start", k * b) - F.col("start")).alias("first"),
                (F.least("stop", (k + 1) * b) - F.col("start")).alias("stop"),
            ),
        ),
        lambda s: s["stop"] > s["first"],
    )
    out = [key, "source", "size", "source_size", "target"]
    mixed = placed.select(*out, F.col("passes").cast("long").alias("passes"), spans.alias("spans")).union(
        known.where("size = 0").select(
            *out, F.lit(0).cast("long"), F.expr("cast(array() as array<struct<first:bigint,stop:bigint>>)")
        )
    )
    once = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return mixed.withColumn("taken", F.col("passes") * F.col("size") + once)


def mix_documents(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The mix itself: the rows of `docs` it takes words of, with their columns and MIX.

    Columns of `docs` called like one of MIX are replaced.  `mixed_words` gives the words.
    Rows are known by a number of their own, so repeated ones and null ids keep their texts.
    """
    number = "row"
    while number in docs.columns:
        number += "_"
    held = [c for c in docs.columns if c not in MIX]
    numbered = materialize(
        docs.select(*[f"`{c}`" for c in held], F.monotonically_increasing_id().alias(number)), "mix"
    )
    mixed = mix_sources(numbered, params, number).where("taken > 0").select(number, *MIX)
    return numbered.join(mixed, number).select(*[f"`{c}`" for c in held], *MIX)


def mixed_words(text: Column, passes: Column, spans: Column) -> Column:
    """The words the mix takes of a text, as an array: whole passes, then its spans."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def taken(w: Column) -> Column:
        parts = F.transform(
            spans, lambda s: F.slice(w, (s["first"] + 1).cast("int"), (s["stop"] - s["first"]).cast("int"))
        )
        return F.concat(F.flatten(F.array_repeat(w, passes.cast("int"))), F.flatten(parts))

    # As a variable the words are found once, not once for each span.
    return F.flatten(F.transform(F.array(words), taken))
