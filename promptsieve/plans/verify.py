"""One request log through all checks: limit, validate, find the policy, screen, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ratelimit as R
from ..operators import validate as V
from ..operators.evidence import evidence
from ..operators.injection import Scorer, with_injection
from ..operators.verdict import combine
from ..sources.ingest import located_guardrail, with_assessment
from ..sources.policies import Policy, attach_policy, bundled_policies
from ..sources.scratch import scratch
from .screening import WORK, screen

#: Requests that one task classifies.
ROWS_PER_TASK = 1 << 16
OUTCOME = ("status", "title", "detail", "retry_after_seconds")


def classify(
    requests: DataFrame,
    limits: R.RateLimits,
    policies: Sequence[Policy] | None = None,
    assessments: DataFrame | None = None,
) -> DataFrame:
    """The requests with status, title, detail and retry_after_seconds.

    Only keys meet the limiter and the assessments (request_id, guardrail); what these
    refuse is joined back once.  Without `assessments` the guardrail is the built-in one,
    which always answers.
    """
    known = [p.id for p in (bundled_policies() if policies is None else policies)]
    keys = requests.select("request_id", "ts", "client_id", "ip")
    found = R.denials(keys, limits).select(
        "request_id", "scope", F.col("retry_after_seconds").alias("_retry"), F.lit(True).alias("_ok")
    )
    if assessments is not None:
        readable = assessments.where("guardrail is not null").select("request_id").distinct()
        without = keys.select("request_id").join(readable, "request_id", "left_anti").select(
            "request_id", F.lit(None).cast("string").alias("scope"),
            F.lit(None).cast("bigint").alias("_retry"), F.lit(False).alias("_ok"),
        )
        found = found.unionByName(without).groupBy("request_id").agg(
            F.max("scope").alias("scope"), F.max("_retry").alias("_retry"), F.min("_ok").alias("_ok")
        )
    wanted = F.coalesce("policy_id", F.lit("default"))
    outcome = V.outcome(
        retry_after=F.col("_retry"),
        scope=F.col("scope"),
        issues=F.col("_issues"),
        policy_id=wanted,
        policy_known=wanted.isin(known),
        guardrail_ok=F.coalesce("_ok", F.lit(True)),
    )
    # Dealt by rows: long prompts may pack so well that few tasks by bytes would hold them all.
    cores = requests.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-requests.count() // ROWS_PER_TASK))
    checked = requests.withColumn("_issues", V.request_issues()).repartition(tasks, "request_id")
    return checked.join(found, "request_id", "left").select(
        *requests.columns, outcome.alias("_o")
    ).select(*requests.columns, "_o.*")


def route(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) requests: written once, in a folder for each, so that what
    classified them ran once whichever of the two is read."""
    spark, folder = classified.sparkSession, scratch(classified.sparkSession, "verified")
    accepted = F.coalesce(F.col("status") == 200, F.lit(False))
    classified.withColumn("accepted", accepted).write.partitionBy("accepted").parquet(folder)
    schema = classified.schema.add("accepted", "boolean")
    stored = spark.read.schema(schema).parquet(folder)
    return stored.where("accepted").drop("accepted"), stored.where("not accepted").drop("accepted")


def verify(
    requests: DataFrame,
    limits: R.RateLimits = R.RateLimits(),
    policies: Sequence[Policy] | None = None,
    scorer: Scorer | None = None,
    assessments: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts of the accepted requests, refused requests with their outcome).

    With `assessments`, the stored answers of an external guardrail, these are its evidence,
    and a request without a readable one is refused with 503.  Refused requests get no
    verdict and so never reach the audit table.
    """
    accepted, refused = route(classify(requests, limits, policies, assessments))
    accepted = V.with_defaults(accepted.drop(*OUTCOME))
    if assessments is None:
        return screen(accepted, policies, scorer), refused
    asked = attach_policy(accepted, bundled_policies() if policies is None else policies)
    found = located_guardrail(evidence(with_assessment(asked, assessments)))
    judged = combine(with_injection(found, scorer))
    return judged.drop(*WORK), refused
