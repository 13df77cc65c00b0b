"""Tiered injection screening: cheap signal, escalation, model answers."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import detectors as D
from ..functions.memo import per_session

# (prompts, denied topics) -> frame with detected, confidence, indicators, topic_scores
Scorer = Callable[[pd.Series, pd.Series], pd.DataFrame]

_ANSWER = "detected boolean, confidence double, indicators array<string>, topic_scores map<string,double>"


def escalation(confidence: Column, obfuscated: Column) -> Column:
    """Struct(escalate, reason): does the cheap signal settle the prompt?"""

    def settle(escalate: bool, reason: str) -> Column:
        return F.struct(F.lit(escalate).alias("escalate"), F.lit(reason).alias("reason"))

    return (
        F.when(obfuscated, settle(True, "obfuscation present"))
        .when(confidence == 0, settle(False, "no deterministic signal"))
        .when(confidence >= S.STRONG_SIGNAL, settle(False, "high-confidence deterministic hit"))
        .otherwise(settle(True, "borderline deterministic signal"))
    )


def skipped_injection() -> Column:
    """The fail-open result: it influences neither decision nor scores."""
    return F.struct(
        F.lit(False).alias("detected"),
        F.lit(0.0).alias("confidence"),
        F.array().cast("array<string>").alias("indicators"),
        F.create_map().cast("map<string,double>").alias("topic_scores"),
        F.lit(True).alias("skipped"),
        F.lit(False).alias("escalated"),
        F.lit(0.0).alias("latency_ms"),
    ).cast(S.INJECTION)


def answered_injection(answer: Column, escalated: Column) -> Column:
    return F.struct(
        answer["detected"].alias("detected"),
        answer["confidence"].alias("confidence"),
        answer["indicators"].alias("indicators"),
        F.coalesce(answer["topic_scores"], F.create_map().cast("map<string,double>")).alias(
            "topic_scores"
        ),
        F.lit(False).alias("skipped"),
        escalated.alias("escalated"),
        F.lit(None).cast("double").alias("latency_ms"),
    ).cast(S.INJECTION)


@per_session
def heuristic_answer() -> Column:
    """The cheap tier's answer for an evidence row under its `policy` struct."""
    policy = F.col("policy")
    return F.struct(
        (F.col("inj_confidence") > 0).alias("detected"),
        F.col("inj_confidence").alias("confidence"),
        F.col("inj_indicators").alias("indicators"),
        D.grade_topics(F.col("topic_hits"), policy["denied_topics"]).alias("topic_scores"),
    )


@per_session
def _cheap_tier() -> Column:
    return answered_injection(heuristic_answer(), F.col("_tier"))


def scorer_udf(scorer: Scorer):
    """Arrow UDF around a batch scorer.

    A NULL prompt never reaches the scorer.  A failing batch is halved until the rows that
    fail stand alone, so that only these fail open, at a few more calls.
    """

    names = ("detected", "confidence", "indicators", "topic_scores")

    def answered(prompts: pd.Series, topics: pd.Series) -> Iterator[tuple[int, dict[str, list]]]:
        """(place of the first row, answers) of the parts that were answered."""
        parts, failed, why = [(0, len(prompts))], 0, None
        while parts:
            start, end = parts.pop()
            try:
                answers = scorer(prompts.iloc[start:end], topics.iloc[start:end])
                if len(answers) != end - start:
                    raise ValueError(f"{len(answers)} answers to {end - start} prompts")
                columns = {name: list(answers.get(name, ())) for name in names}
            except Exception as error:
                if end - start > 1:
                    half = (start + end) // 2
                    parts += [(half, end), (start, half)]
                else:
                    failed, why = failed + 1, error
                continue
            yield start, columns
        if failed:
            logging.getLogger(__name__).warning("scorer failed open for %d rows, last: %r", failed, why)

    @F.pandas_udf(_ANSWER)
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for prompts, topics in batches:
            asked = [i for i, wanted in enumerate(prompts.notna()) if wanted]
            out = {name: [None] * len(prompts) for name in names}
            if asked:
                for start, answers in answered(prompts.iloc[asked], topics.iloc[asked]):
                    for name in names:
                        for i, value in zip(asked[start:], answers[name]):
                            if not (isinstance(value, float) and value != value):  # NaN: no answer
                                out[name][i] = value
            yield pd.DataFrame(out, columns=names, dtype=object)

    return score


def with_injection(df: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Add `injection` to rows holding evidence and a `policy` struct.

    Without a scorer the escalated tier re-runs the same heuristics, so the result is
    a plain expression.  With one, the rows are split by tier and put together again: only
    escalated rows go through Python, the cheap tier stays a plain expression.  A missing
    or out-of-contract answer falls back to the skipped result.
    """
    mode_on = F.col("policy")["mode"] != "off"
    df = df.withColumn(
        "_tier", escalation(F.col("inj_confidence"), F.col("obfuscated"))["escalate"]
    )
    if scorer is None:
        return df.withColumn("injection", F.when(mode_on, _cheap_tier())).drop("_tier")
    ask = F.coalesce(F.col("_tier") & mode_on, F.lit(False))
    settled = df.where(~ask).withColumn("injection", F.when(mode_on, _cheap_tier()))
    answer = scorer_udf(scorer)(F.col("normalized"), F.col("policy")["denied_topics"])
    asked = df.where(ask).withColumn("_answer", answer).withColumn(
        "injection",
        F.when(
            valid_answer(F.col("_answer")), answered_injection(F.col("_answer"), F.lit(True))
        ).otherwise(skipped_injection()),
    )
    return settled.drop("_tier").unionByName(asked.drop("_tier", "_answer"))


def valid_answer(answer: Column) -> Column:
    """Contract check of a screener answer (NULL-safe: never returns NULL)."""
    in_range = answer["confidence"].between(0.0, 1.0)
    topics = F.coalesce(answer["topic_scores"], F.create_map().cast("map<string,double>"))
    topics_ok = F.forall(F.map_values(topics), lambda v: v.isNotNull() & v.between(0.0, 1.0))
    indicators_ok = F.forall(answer["indicators"], lambda i: i.isNotNull())
    return F.coalesce(
        answer["detected"].isNotNull() & in_range & indicators_ok & topics_ok, F.lit(False)
    )


def first_valid_answers(responses: DataFrame, models: Sequence[str]) -> DataFrame:
    """The answer of the first model, in the given order, that answered validly.

    `responses` holds (request_id, model, ok, answer), as `extract_answers` returns it.
    Map-side combine keeps one candidate per request and task, so a request that was
    retried endlessly does not gather in one task.
    """
    rank = F.array_position(F.lit(list(models)), F.col("model"))
    return (
        responses.where(F.col("ok") & (rank > 0))
        .groupBy("request_id")
        .agg(F.min_by(F.struct("model", "answer"), rank).alias("_first"))
        .select(
            "request_id",
            F.col("_first.model").alias("answered_by"),
            F.col("_first.answer").alias("answer"),
        )
    )


def with_ingested_injection(
    df: DataFrame, responses: DataFrame, models: Sequence[str]
) -> DataFrame:
    """As `with_injection`, with the escalated tier answered by stored responses, and
    `answered_by`, the model whose answer was taken.

    Only escalated rows meet the answers: the cheap tier, most of the rows, is not shuffled.
    """
    ask = F.coalesce(
        escalation(F.col("inj_confidence"), F.col("obfuscated"))["escalate"]
        & (F.col("policy")["mode"] != "off"),
        F.lit(False),
    )
    cheap = answered_injection(heuristic_answer(), F.lit(False))
    settled = df.where(~ask).withColumns(
        {
            "answered_by": F.lit(None).cast("string"),
            "injection": F.when(F.col("policy")["mode"] != "off", cheap),
        }
    )
    asked = df.where(ask).join(first_valid_answers(responses, models), "request_id", "left")
    taken = F.when(
        F.col("answered_by").isNotNull(), answered_injection(F.col("answer"), F.lit(True))
    ).otherwise(skipped_injection())
    return settled.unionByName(asked.withColumn("injection", taken).drop("answer"))
