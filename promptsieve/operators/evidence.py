"""Policy-independent evidence: detect once, decide per policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import detectors as D
from ..functions.memo import per_session
from ..functions.text import SANITIZED, sanitize

# Stamp stored evidence with this, and recompute it when the detectors change.
DETECTOR_VERSION = 1

EVIDENCE = SANITIZED + (
    "pii_hits", "secret_hits", "inj_confidence", "inj_indicators", "topic_hits", "misconduct",
)


@per_session
def _stages() -> list[dict[str, Column]]:
    text, lower, flags = F.col("normalized"), F.col("_lower"), F.col("_flags")
    return [
        {"_lower": F.lower(text)},
        {
            "pii_hits": D.pii_hits(text, lower),
            "secret_hits": D.secret_hits(text, lower),
            "_flags": F.array(*D.injection_flags(text, lower)),
            "_topics": F.array(*D.topic_flags(text, lower)),
            "misconduct": D.misconduct(text, lower),
        },
        {
            "inj_confidence": D.injection_confidence(flags),
            "inj_indicators": D.injection_indicators(flags),
            "topic_hits": D.named_topics(F.col("_topics")),
        },
    ]


def evidence(df: DataFrame, prompt: str = "prompt", nfkc_engine: str = "jvm") -> DataFrame:
    """Add the evidence columns to every row; no shuffle, no Python.

    Only what later steps read is computed: an unused detector is pruned away.
    """
    df = sanitize(df, prompt, nfkc_engine)
    for stage in _stages():
        df = df.withColumns(stage)
    return df.drop("_lower", "_flags", "_topics")


def unless_empty(entries: Column, value: Column, empty: Column) -> Column:
    """`value`, made from the entries by lambdas, or `empty` where there are none.

    Spark generates no code for lambdas, and most rows have few kinds of evidence."""
    return F.when(F.size(entries) == 0, empty).otherwise(value)


def _entities(hits: Column, action: str) -> Column:
    entities = F.transform(
        hits,
        lambda h: F.struct(
            h["type"].alias("type"),
            F.lit(action).alias("action"),
            F.lit(True).alias("detected"),
            h["match"].alias("match"),
            h["span"].alias("span"),
        ),
    ).cast(f"array<{S.ENTITY}>")
    return unless_empty(hits, entities, S.empty_array(S.ENTITY))


def content_evidence(misconduct: Column, confidence: Column, strength: Column) -> Column:
    """The five baseline filters, then PROMPT_ATTACK where injection was detected.

    A LOW-strength policy records a hit without acting on it.
    """
    low = strength == "LOW"

    def entry(name: str, hit: Column, level: Column) -> Column:
        return F.struct(
            F.lit(name).alias("type"),
            level.alias("confidence"),
            F.when(hit & ~low, "BLOCKED").otherwise("NONE").alias("action"),
            hit.alias("detected"),
        )

    def filters(misconduct: Column) -> Column:
        return F.array(
            *[
                entry(
                    name,
                    misconduct if name == "MISCONDUCT" else F.lit(False),
                    F.when(misconduct, F.when(low, "LOW").otherwise("HIGH")).otherwise("NONE")
                    if name == "MISCONDUCT"
                    else F.lit("NONE"),
                )
                for name in S.CONTENT_FILTERS
            ]
        ).cast(f"array<{S.CONTENT}>")

    # without misconduct the filters are a constant, which Spark folds
    baseline = F.when(~misconduct, filters(F.lit(False))).otherwise(filters(misconduct))
    attack = F.array(entry(S.PROMPT_ATTACK, F.lit(True), attack_level(confidence)))
    return F.concat(
        baseline,
        F.when(confidence > 0, attack.cast(f"array<{S.CONTENT}>")).otherwise(
            S.empty_array(S.CONTENT)
        ),
    )


def attack_level(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.7, "HIGH")
        .when(confidence >= 0.4, "MEDIUM")
        .when(confidence > 0, "LOW")
        .otherwise("NONE")
    )


def mask_entities(text: Column, entities: Column, opening: Column, closing: Column) -> Column:
    """Replace each literal match by its bracketed type, in order: a later match may
    lie inside what an earlier one put there."""
    masked = F.aggregate(
        F.filter(entities, lambda e: F.char_length(e["match"]) > 0),
        text,
        lambda acc, e: F.replace(acc, e["match"], F.concat(opening, e["type"], closing)),
    )
    return unless_empty(entities, masked, text)


@per_session
def guardrail_evidence(redacted: bool = True) -> Column:
    """Guardrail result of an evidence row under its `policy` struct; the `redacted_text`, which
    no verdict reads, only where asked for."""
    policy = F.col("policy")
    pii = _entities(F.col("pii_hits"), "ANONYMIZED")
    secrets = _entities(F.col("secret_hits"), "BLOCKED")
    denied = F.transform(
        F.filter(policy["denied_topics"], lambda t: F.array_contains(F.col("topic_hits"), t)),
        lambda t: F.struct(
            t.alias("name"), F.lit("BLOCKED").alias("action"), F.lit(True).alias("detected")
        ),
    ).cast(f"array<{S.TOPIC}>")
    on_topic = F.size("topic_hits") > 0
    topics = F.when(on_topic | policy["denied_topics"].isNull(), denied).otherwise(
        S.empty_array(S.TOPIC)
    )
    content = content_evidence(F.col("misconduct"), F.col("inj_confidence"), policy["strength"])
    intervened = (
        (F.size("secret_hits") > 0)
        | (F.size("pii_hits") > 0)
        | (
            on_topic
            & F.exists(policy["denied_topics"], lambda t: F.array_contains(F.col("topic_hits"), t))
        )
        | ((policy["strength"] != "LOW") & (F.col("misconduct") | (F.col("inj_confidence") > 0)))
    )
    return F.struct(
        intervened.alias("intervened"),
        F.lit(None).cast("string").alias("action_reason"),
        pii.alias("pii"),
        secrets.alias("secrets"),
        topics.alias("topics"),
        content.alias("content"),
        (
            mask_entities(
                F.col("normalized"),
                F.concat(F.col("pii_hits"), F.col("secret_hits")),
                F.lit("{"),
                F.lit("}"),
            )
            if redacted
            else F.lit(None).cast("string")
        ).alias("redacted_text"),
        F.lit(None).cast("double").alias("latency_ms"),
    ).cast(S.GUARDRAIL)


def add_spans(guardrail: Column, text: Column) -> Column:
    """Locate the matches of an ingested guardrail result in the text it judged."""

    def locate(entities: Column) -> Column:
        return F.transform(
            entities, lambda e: e.withField("span", D.span_of(text, e["match"]))
        )

    return guardrail.withField("pii", locate(guardrail["pii"])).withField(
        "secrets", locate(guardrail["secrets"])
    )
