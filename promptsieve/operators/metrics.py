"""Table-level summaries of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .skew import at_ranks

_TWO_PLACES = "decimal(18,2)"


def decision_counts(verdicts: DataFrame, *by: str) -> DataFrame:
    return verdicts.groupBy(*by, "decision", "recommended_action").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("scores.prompt_injection").cast(_TWO_PLACES)).alias("sum_injection"),
    )


def decision_rollup(verdicts: DataFrame, *by: str) -> DataFrame:
    """Decision counts at every level of `by`: of all rows, by the first column, by the first
    two, and so on, in one pass (Expand).  `level` is the number of columns that count."""
    return (
        verdicts.rollup(*by)
        .agg(
            F.grouping_id().alias("_id"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("decision") == "block").alias("blocked"),
            F.count_if(F.col("decision") == "redact").alias("redacted"),
        )
        .withColumn("level", F.lit(len(by)) - F.bit_count("_id"))
        .drop("_id")
    )


def exploded_matches(verdicts: DataFrame, *columns: str) -> DataFrame:
    """One row per match with its position.  The outer form keeps the optimizer from
    adding a size filter that would evaluate the detectors a second time."""
    return (
        verdicts.select(*columns, F.posexplode_outer("matches").alias("pos", "m"))
        .where(F.col("m").isNotNull())
        .select(*columns, "pos", "m.*")
    )


def match_counts(verdicts: DataFrame, *by: str) -> DataFrame:
    return exploded_matches(verdicts, *by).groupBy(*by, "category", "type").agg(
        F.count(F.lit(1)).alias("n")
    )


def score_rows(verdicts: DataFrame, *columns: str) -> DataFrame:
    """Scores flattened to (panel, name, score)."""

    def single(name: str) -> Column:
        return F.array(
            F.struct(
                F.lit("signal").alias("panel"),
                F.lit(name).alias("name"),
                F.col(f"scores.{name}").alias("score"),
            )
        )

    def panel(name: str) -> Column:
        return F.transform(
            F.map_entries(F.col(f"scores.{name}")),
            lambda e: F.struct(
                F.lit(name).alias("panel"), e["key"].alias("name"), e["value"].alias("score")
            ),
        )

    rows = F.concat(
        single("pii"), single("secrets"), single("prompt_injection"), panel("topics"), panel("content")
    )
    return verdicts.select(*columns, F.inline(rows))


def score_summary(verdicts: DataFrame, *by: str) -> DataFrame:
    return score_rows(verdicts, *by).groupBy(*by, "panel", "name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("score").cast(_TWO_PLACES)).alias("sum_score"),
        F.max("score").alias("max_score"),
    )


def percent(score: Column) -> Column:
    """Whole-number percentage, halves rounded up."""
    return F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%"))


PERCENTILES = (0.5, 0.95, 0.99)


def latency_percentiles(audit: DataFrame) -> DataFrame:
    """Exact P50/P95/P99 per leg, between ranks in proportion.

    Equal values are counted first.  Counts are dealt by value into ranges, whose sums tell
    which range holds a rank; only these are sorted, so no task sees all values of a leg.
    """
    legs = [
        F.struct(F.lit(leg).alias("leg"), F.col(f"latency_ms.{leg}").alias("ms"))
        for leg in ("policy", "guardrail", "injection", "total")
    ]
    counted = (
        audit.select(F.inline(F.array(*legs)))
        .where(F.col("ms").isNotNull())
        .groupBy("leg", "ms")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = materialize(counted, "latencies")
    totals = counted.groupBy("leg").agg(F.sum("n").alias("n"))
    place = F.col("p") * (F.col("n") - 1)
    wanted = totals.select("leg", "n", F.explode(F.array(*[F.lit(p) for p in PERCENTILES])).alias("p")).select(
        "leg", "n", "p", place.alias("place"),
        (F.floor(place) + 1).alias("low"), (F.ceil(place) + 1).alias("high"),
    )
    ranks = wanted.select("leg", F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = at_ranks(counted, ["leg"], "ms", "n", ranks)
    low, high = (found.select("leg", F.col("rank").alias(c), F.col("ms").alias(f"{c}_ms")) for c in ("low", "high"))
    value = F.when(F.col("low") == F.col("high"), F.col("low_ms")).otherwise(
        (F.col("high") - 1 - F.col("place")) * F.col("low_ms")
        + (F.col("place") - F.col("low") + 1) * F.col("high_ms")
    )
    named = wanted.join(low, ["leg", "low"]).join(high, ["leg", "high"]).withColumn("value", value)
    return named.groupBy("leg").agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{int(p * 100)}") for p in PERCENTILES],
    )


def eval_gate(verdicts: DataFrame, expected: Column, *by: str) -> DataFrame:
    """Verified k of n: verdicts whose decision is the expected one."""
    return verdicts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("decision") == expected).alias("verified"),
    ).withColumn("passed", F.col("cases") == F.col("verified"))


def without_text(df: DataFrame) -> DataFrame:
    """For logs and metric tables: no prompt text in any form."""
    return df.drop("prompt", "normalized", "redacted_prompt")
