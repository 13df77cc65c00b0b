"""Ingestion of answers external services have already produced, as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.memo import per_session
from ..operators.evidence import add_spans
from ..operators.injection import valid_answer
from ..operators.validate import GUARDRAIL_DOWN
from ..operators.verdict import VERDICT

# Names in the JSON of the two services.
SCREENING_TOOL = "report_screening"
INTERVENED = "GUARDRAIL_INTERVENED"

ASSESSMENT_DDL = """
    action string, actionReason string, outputs array<struct<text:string>>,
    assessments array<struct<
        sensitiveInformationPolicy:struct<
            piiEntities:array<struct<type:string,action:string,detected:boolean,match:string>>,
            regexes:array<struct<name:string,action:string,detected:boolean,match:string>>>,
        topicPolicy:struct<topics:array<struct<name:string,action:string,detected:boolean>>>,
        contentPolicy:struct<
            filters:array<struct<type:string,confidence:string,action:string,detected:boolean>>>>>,
    _corrupt string
"""
RESPONSE_DDL = """
    usage struct<inputTokens:bigint,outputTokens:bigint>,
    output struct<message:struct<content:array<struct<toolUse:struct<name:string,input:string>>>>>
"""
ANSWER_DDL = (
    "detected boolean, confidence double, indicators array<string>, topicScores map<string,double>"
)


def _action(raw: Column) -> Column:
    return F.when(raw.isin("BLOCKED", "ANONYMIZED"), raw).otherwise("NONE")


def _detected(entry: Column) -> Column:
    return F.coalesce(entry["detected"], _action(entry["action"]) != "NONE")


def _entity(type_: Column, entry: Column) -> Column:
    return F.struct(
        type_.alias("type"),
        _action(entry["action"]).alias("action"),
        _detected(entry).alias("detected"),
        entry["match"].alias("match"),
        F.lit(None).cast(S.SPAN).alias("span"),
    ).cast(S.ENTITY)


def _each(assessments: Column, build) -> Column:
    """Concatenate `build(assessment)` over all assessments, missing parts empty."""
    return F.flatten(F.filter(F.transform(assessments, build), lambda a: a.isNotNull()))


@per_session
def _guardrail_of_raw() -> Column:
    """Normalised guardrail result of the parsed assessment in `_raw`."""
    raw = F.col("_raw")
    assessments = F.coalesce(raw["assessments"], F.from_json(F.lit("[]"), _assessments_type()))
    kind = lambda e: F.coalesce(e["type"], F.lit("UNKNOWN"))
    is_secret = lambda e: kind(e).isin(*S.SECRET_ENTITY_TYPES)
    entities = lambda a: a["sensitiveInformationPolicy"]["piiEntities"]
    regexes = lambda a: a["sensitiveInformationPolicy"]["regexes"]
    none = S.empty_array(S.ENTITY)

    def secrets_of(a: Column) -> Column:
        managed = F.transform(F.filter(entities(a), is_secret), lambda e: _entity(kind(e), e))
        custom = F.transform(
            regexes(a), lambda r: _entity(F.coalesce(r["name"], F.lit("REGEX")), r)
        )
        return F.concat(F.coalesce(managed, none), F.coalesce(custom, none))

    pii = _each(
        assessments,
        lambda a: F.transform(
            F.filter(entities(a), lambda e: ~is_secret(e)), lambda e: _entity(kind(e), e)
        ),
    )
    topics = _each(
        assessments,
        lambda a: F.transform(
            F.filter(a["topicPolicy"]["topics"], lambda t: F.char_length(t["name"]) > 0),
            lambda t: F.struct(
                t["name"].alias("name"),
                _action(t["action"]).alias("action"),
                _detected(t).alias("detected"),
            ),
        ),
    )
    content = _each(
        assessments,
        lambda a: F.transform(
            F.filter(
                a["contentPolicy"]["filters"],
                lambda f: f["type"].isin(*S.CONTENT_FILTERS, S.PROMPT_ATTACK),
            ),
            lambda f: F.struct(
                f["type"].alias("type"),
                F.coalesce(f["confidence"], F.lit("NONE")).alias("confidence"),
                _action(f["action"]).alias("action"),
                _detected(f).alias("detected"),
            ),
        ),
    )
    result = F.struct(
        F.coalesce(raw["action"] == INTERVENED, F.lit(False)).alias("intervened"),
        raw["actionReason"].alias("action_reason"),
        pii.alias("pii"),
        _each(assessments, secrets_of).alias("secrets"),
        topics.alias("topics"),
        content.alias("content"),
        F.get(raw["outputs"], F.lit(0))["text"].alias("redacted_text"),
        F.lit(None).cast("double").alias("latency_ms"),
    ).cast(S.GUARDRAIL)
    return F.when(raw.isNotNull() & raw["_corrupt"].isNull(), result)


def _assessments_type() -> str:
    start = ASSESSMENT_DDL.index("assessments ") + len("assessments ")
    return ASSESSMENT_DDL[start : ASSESSMENT_DDL.rindex(",")].strip()


def flatten_assessments(raw: DataFrame) -> DataFrame:
    """(request_id, guardrail) of raw assessments (request_id, json); the guardrail is
    NULL where the text is unreadable.  The text is parsed once, in a step of its own."""
    parsed = F.from_json(
        "json", ASSESSMENT_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    return raw.select("request_id", parsed.alias("_raw")).select(
        "request_id", _guardrail_of_raw().alias("guardrail")
    )


def with_assessment(requests: DataFrame, assessments: DataFrame) -> DataFrame:
    """Add the stored guardrail result of each request, NULL where there is none.

    Join before `evidence`: the shuffle then carries a prompt once, and neither its cleaned
    form nor what was detected in it.
    """
    readable = assessments.where(F.col("guardrail").isNotNull()).select("request_id", "guardrail")
    return requests.join(readable, "request_id", "left")


def located_guardrail(found: DataFrame) -> DataFrame:
    """Evidence rows with the matches of their stored `guardrail` located in `normalized`."""
    return found.withColumn(
        "guardrail",
        F.when(
            F.col("guardrail").isNotNull(), add_spans(F.col("guardrail"), F.col("normalized"))
        ),
    )


def fail_closed(verdicts: DataFrame) -> DataFrame:
    """Without guardrail evidence there is no verdict: status 503, verdict columns NULL.

    Only rows with status 200 may be written to the audit table.
    """
    assessed = F.col("guardrail").isNotNull()
    return verdicts.withColumns(
        {
            "status": F.when(assessed, 200).otherwise(503),
            **{name: F.when(assessed, F.col(name)) for name in VERDICT},
            "reason": F.when(assessed, F.col("reason")).otherwise(GUARDRAIL_DOWN),
        }
    )


def extract_answers(responses: DataFrame) -> DataFrame:
    """Add `answer`, `ok`, `input_tokens` and `output_tokens` to (request_id, model, json).

    The first content block calling the screening tool counts; its input must keep the
    contract.  Without one, or off contract, `ok` is false.
    """
    raw = F.col("_raw")
    block = F.get(
        F.filter(
            raw["output"]["message"]["content"],
            lambda b: b["toolUse"]["name"] == SCREENING_TOOL,
        ),
        F.lit(0),
    )
    parsed, tree = F.col("_parsed"), F.col("_tree")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(tree, path, "variant"))
    answer = F.struct(
        parsed["detected"].alias("detected"),
        parsed["confidence"].alias("confidence"),
        parsed["indicators"].alias("indicators"),
        parsed["topicScores"].alias("topic_scores"),
    )
    # from_json turns any scalar into text, and reads an explicit null as absent.
    strict = F.coalesce(kind("$.indicators").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)) & (
        F.coalesce(kind("$.topicScores").startswith("OBJECT<"), F.lit(True))
    )
    return (
        responses.withColumn("_raw", F.from_json("json", RESPONSE_DDL))
        .withColumns(
            {
                "_input": block["toolUse"]["input"],
                "input_tokens": F.coalesce(raw["usage"]["inputTokens"], F.lit(0)),
                "output_tokens": F.coalesce(raw["usage"]["outputTokens"], F.lit(0)),
            }
        )
        .withColumns(
            {
                "_parsed": F.from_json(F.col("_input"), ANSWER_DDL),
                "_tree": F.try_parse_json(F.col("_input")),
            }
        )
        .withColumn("answer", answer)
        .withColumn("ok", valid_answer(F.col("answer")) & strict)
        .withColumn("answer", F.when(F.col("ok"), F.col("answer")))
        .drop("_input", "_raw", "_parsed", "_tree", "json")
    )


def token_usage(answers: DataFrame) -> DataFrame:
    return answers.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("ok").alias("answered"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
