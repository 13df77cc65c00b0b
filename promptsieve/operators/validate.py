"""Request validation, quarantine and outcome classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import patterns as P
from ..functions.memo import per_session
from ..functions.text import utf16_length

# Messages a failed check reports.
REQUIRED = "Required"
TOO_SHORT = "String must contain at least 1 character(s)"
TOO_LONG = f"String must contain at most {S.MAX_PROMPT_LENGTH} character(s)"
CONTROL = "Prompt must not contain control characters"


def with_defaults(df: DataFrame) -> DataFrame:
    """Absent policy id means `default`; an empty one is an error, not a default."""
    return df.withColumn("policy_id", F.coalesce("policy_id", F.lit("default")))


def _issue(path: str, message: Column | str, failed: Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(failed, F.struct(F.lit(path).alias("path"), text.alias("message")))


def _issues(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda issue: issue.isNotNull())


def prompt_length(prompt: Column) -> Column:
    return utf16_length(prompt)


@per_session
def request_issues() -> Column:
    """All failed checks of a request as array<struct<path, message>>."""
    prompt, context = F.col("prompt"), F.col("context")
    expected = " | ".join(f"'{c}'" for c in S.PROMPT_CONTEXTS)
    return _issues(
        _issue("prompt", REQUIRED, prompt.isNull()),
        _issue("prompt", TOO_SHORT, prompt == ""),
        _issue("prompt", TOO_LONG, prompt_length(prompt) > S.MAX_PROMPT_LENGTH),
        _issue("prompt", CONTROL, prompt.rlike(P.CONTROL_CHARS)),
        _issue("policyId", TOO_SHORT, F.col("policy_id") == ""),
        _issue(
            "context",
            F.concat(
                F.lit(f"Invalid enum value. Expected {expected}, received '"), context, F.lit("'")
            ),
            ~context.isin(*S.PROMPT_CONTEXTS),
        ),
        _issue("appId", TOO_SHORT, F.col("app_id") == ""),
    )


@per_session
def replay_request_issues() -> Column:
    checks = []
    for path, name in (("requestId", "request_id"), ("policyId", "policy_id")):
        checks += [
            _issue(path, REQUIRED, F.col(name).isNull()),
            _issue(path, TOO_SHORT, F.col(name) == ""),
        ]
    return _issues(*checks)


def validate(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with defaults applied, rejected rows with their `issues`)."""
    checked = requests.withColumn("issues", request_issues())
    return (
        with_defaults(checked.where(F.size("issues") == 0).drop("issues")),
        checked.where(F.size("issues") > 0),
    )


@per_session
def verdict_violations() -> Column:
    """Names of the output-contract checks a verdict row fails."""

    def unit(c: Column) -> Column:
        return F.coalesce(c.between(0.0, 1.0), F.lit(False))

    def units(m: Column) -> Column:
        return F.coalesce(F.forall(F.map_values(m), unit), F.lit(False))

    scores, matches = F.col("scores"), F.col("matches")
    rules = {
        "decision": F.col("decision").isin(*S.DECISIONS),
        "recommended_action": F.col("recommended_action").isin(*S.RECOMMENDED_ACTION.values()),
        "policy_id": F.col("policy_id").isNotNull(),
        "request_id": F.col("request_id").isNotNull(),
        "scores": unit(scores["pii"]) & unit(scores["secrets"]) & unit(scores["prompt_injection"])
        & units(scores["topics"]) & units(scores["content"]),
        "matches": F.forall(
            matches,
            lambda m: m["category"].isin(*S.MATCH_PRECEDENCE)
            & m["type"].isNotNull()
            & unit(m["confidence"])
            & F.coalesce((m["span"]["start"] >= 0) & (m["span"]["end"] >= 0), m["span"].isNull()),
        ),
        "reason": F.col("reason").isNotNull(),
        "advice": F.col("advice").isNotNull(),
    }
    return F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]),
        lambda name: name.isNotNull(),
    )


# Problem titles by status.
TITLES = {
    200: "OK",
    400: "Validation failed",
    404: "Not Found",
    429: "Too Many Requests",
    500: "Internal Server Error",
    503: "Service Unavailable",
}
GUARDRAIL_DOWN = "Guardrail assessment is currently unavailable"


def title_of(status: Column) -> Column:
    expr = F.when(status == 200, TITLES[200])
    for code, title in TITLES.items():
        expr = expr.when(status == code, title)
    return expr.otherwise(TITLES[500])


def outcome(
    *,
    retry_after: Column,
    scope: Column,
    issues: Column,
    policy_id: Column,
    policy_known: Column,
    guardrail_ok: Column,
) -> Column:
    """Struct(status, title, detail, retry_after_seconds) of one request.

    In the order of the checks: rate limit, validation, policy, guardrail.  A NULL
    flag is an unclassified failure: status 500, no detail.
    """
    status = (
        F.when(retry_after.isNotNull(), 429)
        .when(F.size(issues) > 0, 400)
        .when(~policy_known, 404)
        .when(~guardrail_ok, 503)
        .when(issues.isNotNull() & policy_known & guardrail_ok, 200)
        .otherwise(500)
    )
    detail = (
        F.when(
            retry_after.isNotNull(),
            F.concat(
                F.lit("Rate limit exceeded"),
                F.coalesce(F.concat(F.lit(" ("), scope, F.lit(")")), F.lit("")),
                F.lit(". Retry after "),
                retry_after.cast("string"),
                F.lit("s."),
            ),
        )
        .when(F.size(issues) > 0, F.lit(None).cast("string"))
        .when(~policy_known, F.concat(F.lit("Unknown policy: '"), policy_id, F.lit("'")))
        .when(~guardrail_ok, GUARDRAIL_DOWN)
    )
    return F.struct(
        status.alias("status"),
        title_of(status).alias("title"),
        detail.alias("detail"),
        retry_after.alias("retry_after_seconds"),
    )
